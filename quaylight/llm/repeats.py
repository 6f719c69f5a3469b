"""Removal of long repeated byte strings, by a column-wise suffix construction on anchored reads.

Every byte covered by a SPAN-byte string that starts at two places of the collection is removed.

A column-wise construction over whole documents takes as many rounds as the longest document has
bytes, each of which rewrites the files of the whole collection. Strings of SPAN bytes need less:
1. Anchors. The least hashed GRAM-gram of each SPAN-byte window is its anchor (a function of the
   window alone, so equal windows have equal anchors at equal offsets). Neighbouring windows with
   the same anchor make a run; a document has one run for about 70 bytes. Runs whose whole string
   occurs twice are repeated; runs whose anchor occurs once are not. Only counts of hashes are
   shuffled for this.
2. Reads. The other runs (same anchor, different string: the ends of repeats) become reads of at
   most 2 * SPAN - GRAM bytes, dealt by anchor and aligned on it. In a task, reads are inserted
   column by column from the right, one symbol for each read a round: a stable sort by the symbol
   turns the order of the suffixes from one column into that of the next (the step of a
   Burrows-Wheeler transform), and common prefixes are updated by range minima. Neighbours with a
   common prefix of SPAN bytes are repeats. A task streams its reads sorted by anchor and holds
   one slice of READS at a time.
3. Frequent anchors (in a passage shared by very many documents) would put very many reads in one
   task. Tasks report anchors and strings that they see twice; the most frequent MOST of each, seen
   over HOT times, are sent to all tasks. A frequent string is repeated, as it stands; other runs of
   a frequent anchor are compared by counting the 64-bit hashes of their windows, which combine
   before they are shuffled.

Whether a string is frequent changes only the way it takes, not the result.

Defined results: a null text has no bytes (n_bytes 0, hash of nothing); texts under SPAN bytes
keep everything; a repeated row is a copy like any other; an empty table gives an empty result.
Documents of many megabytes are read in stretches of STRETCH windows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, partitions_for, store, strings, table

SPAN, GRAM, HOT, MOST, READS, STRETCH = 200, 64, 256, 100_000, 16_384, 1 << 19
U, NULL = np.uint64, np.iinfo(np.int64).min
BASE = 0x5851F42D4C957F2D
REPEATED, READ, SAMPLE, COUNTED, COUNTED_SAMPLE = 1, 2, 3, 4, 5


class Powers:
    """Powers of BASE and of its inverse modulo 2**64, as far as asked for."""

    up = down = np.ones(0, U)
    bytes = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            step = np.full(n, BASE, U)
            step[0] = 1
            cls.up = np.cumprod(step, dtype=U)
            step[1:] = pow(BASE, -1, 1 << 64)
            cls.down = np.cumprod(step, dtype=U)
        return cls.up[:n], cls.down[:n]


class Hashed:
    """64-bit hashes of all stretches of a byte string."""

    def __init__(self, b: np.ndarray) -> None:
        up, self.down = Powers.of(len(b) + 1)
        self.sums = np.zeros(len(b) + 1, U)
        np.cumsum(Powers.bytes[b] * up[:-1], out=self.sums[1:])

    def at(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.down[start]


def runs(b: np.ndarray) -> np.ndarray:
    """Rows (first window, last window, anchor's place, anchor, string), the last two hashes as int64."""
    out = [_runs(b[lo : lo + STRETCH + SPAN - 1], lo) for lo in range(0, max(1, len(b) - SPAN + 1), STRETCH)]
    return np.concatenate(out)


def _runs(b: np.ndarray, lo: int) -> np.ndarray:
    n = len(b) - SPAN + 1
    if n < 1:
        return np.zeros((0, 5), np.int64)
    hashed, width = Hashed(b), SPAN - GRAM + 1
    place = np.arange(len(b) - GRAM + 1)
    grams = mix(hashed.at(place, GRAM))
    low = U((1 << 20) - 1)
    keys = (grams & ~low) | place.astype(U)
    padded = np.full(-(-len(keys) // width) * width, ~U(0))
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    anchor = (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & low).astype(np.int64)
    first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    last = np.r_[first[1:] - 1, n - 1]
    a = anchor[first]
    shape = mix(((a - first) * 1024 + (last - first)).astype(U) + U(1))
    string = mix(hashed.at(first, last - first + SPAN) ^ shape)
    return np.stack([first + lo, last + lo, a + lo, mix(grams[a] ^ U(BASE)).view(np.int64), string.view(np.int64)], axis=1)


def raw(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)


def frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Anchors and strings that occur very often."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def seen() -> Iterator[pa.RecordBatch]:
            every = np.concatenate(held) if held else np.zeros((0, 2), np.int64)
            for kind in (0, 1):
                at, n = np.unique(every[:, kind], return_counts=True)
                at, n = at[n > 1], n[n > 1]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), pa.array(at), pa.array(n)], names=["kind", "at", "n"])

        for batch in batches:
            for text in strings(batch.column(0)):
                held.append(runs(raw(text))[:, 3:])
                size += len(held[-1])
                if size > 2_000_000:
                    yield from seen()
                    held, size = [], 0
        yield from seen()

    found = docs.select("text").mapInArrow(each, "kind int, at long, n long").groupBy("kind", "at").agg(F.sum("n").alias("n")).where(F.col("n") > HOT)
    top = lambda kind: np.sort(found.where(F.col("kind") == kind).orderBy(F.desc("n"), "at").limit(MOST).select("at").toPandas()["at"].to_numpy(np.int64))
    found = store(found, "often")
    return top(0), top(1)


def within(x: np.ndarray, among: np.ndarray) -> np.ndarray:
    return among[np.minimum(np.searchsorted(among, x), len(among) - 1)] == x if len(among) else np.zeros(len(x), bool)


RUN = "doc_id long, h long, first int, last int, at int, deal long, string long, way int"


def dealt_runs(docs: DataFrame) -> DataFrame:
    """Runs with the hash by which they meet (their anchor, or their string where the anchor is frequent)."""
    shipped = docs.sparkSession.sparkContext.broadcast(frequent(docs))  # MOST hashes of each kind at most

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, often = shipped.value
        sampled = np.zeros(len(often), bool)
        for batch in batches:
            texts = strings(batch.column(2))
            made = [runs(raw(t)) for t in texts]
            k = np.array([len(m) for m in made], dtype=np.int64)
            r = np.concatenate(made) if made else np.zeros((0, 5), np.int64)
            hot, known = within(r[:, 3], anchors), within(r[:, 4], often)
            way = np.where(known, REPEATED, np.where(hot, COUNTED, READ))
            # One run of each frequent string of a task also stands for it where strings are compared.
            use, which = np.unique(np.searchsorted(often, r[known, 4]), return_index=True)
            fresh = np.flatnonzero(known)[which[~sampled[use]]]
            sampled[use] = True
            # Neighbouring runs that are repeated make one: a periodic text has a run for each byte.
            doc = np.repeat(np.arange(len(k)), k)
            after = known[1:] & known[:-1] & (doc[1:] == doc[:-1]) & (r[1:, 0] <= r[:-1, 1] + 1)
            starts = np.flatnonzero(np.r_[np.ones(min(1, len(r)), bool), ~after])
            ends = np.r_[starts[1:], len(r)][: len(starts)] - 1
            rows, last = np.r_[starts, fresh], np.r_[r[ends, 1], r[fresh, 1]]
            way = np.r_[way[starts], np.where(hot[fresh], COUNTED_SAMPLE, SAMPLE)]
            deal = np.where(hot[rows], r[rows, 4], r[rows, 3])
            deal = np.where(way == REPEATED, np.arange(len(rows)), deal)  # settled: dealt evenly
            doc = doc[rows]
            arrays = [batch.column(0).take(pa.array(doc)), batch.column(1).take(pa.array(doc)), pa.array(r[rows, 0].astype(np.int32)), pa.array(last.astype(np.int32)), pa.array(r[rows, 2].astype(np.int32)), pa.array(deal), pa.array(r[rows, 4]), pa.array(way.astype(np.int32))]
            for lo in range(0, len(rows), 100_000):
                yield pa.RecordBatch.from_arrays([x.slice(lo, 100_000) for x in arrays], names=[x.split()[0] for x in RUN.split(", ")])

    return docs.select("doc_id", "h", "text").mapInArrow(each, RUN)


def settled(dealt: DataFrame) -> DataFrame:
    """Runs that are repeated, and those still to be compared."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        got = pa.Table.from_batches(held)
        deal, string, way = (got.column(c).to_numpy() for c in ("deal", "string", "way"))
        order = np.lexsort((way, string, deal))
        d, s, w = deal[order], string[order], way[order]
        open_ = w != REPEATED
        group = np.cumsum(np.r_[True, d[1:] != d[:-1]]) - 1
        same = np.cumsum(np.r_[True, (d[1:] != d[:-1]) | (s[1:] != s[:-1])]) - 1
        lone = (np.bincount(same)[same] == 1) & open_
        sample = (w == SAMPLE) | (w == COUNTED_SAMPLE)
        twice = open_ & ~lone & ~sample
        # Of each repeated string one run goes on where others of its anchor are still to be compared.
        stands = np.r_[True, same[1:] != same[:-1]] & open_ & ~lone
        counted = (w == COUNTED) | (w == COUNTED_SAMPLE)
        many = np.bincount(group)[group] > 1
        unsure = np.bincount(group, weights=lone & ~counted, minlength=group[-1] + 1)[group] > 0
        out = []
        for rows, kind in (
            (~open_ | twice, REPEATED),
            (lone & ~counted & ~sample & many, READ),
            ((stands | (sample & lone)) & ~counted & unsure, SAMPLE),
            (lone & counted & ~sample, COUNTED),
            ((stands | (sample & lone)) & counted, COUNTED_SAMPLE),
        ):
            at = order[np.flatnonzero(rows)]
            out.append(got.take(pa.array(at)).drop_columns("way").append_column("way", pa.array(np.full(len(at), kind, np.int32))))
        yield from pa.concat_tables(out).drop_columns("string").to_batches(max_chunksize=50_000)

    parts = partitions_for(dealt.sparkSession)
    return dealt.repartition(parts, "deal").mapInArrow(each, RUN.replace("string long, ", ""))


def columns(reads: list[np.ndarray], offset: np.ndarray) -> list[np.ndarray]:
    """For each read, which of its SPAN-byte windows another read has at the same offset from the anchor.

    reads: bytes; offset: the anchor's place in each.
    """
    m, lead = len(reads), int(offset.max())
    start, size = lead - offset, np.array([len(r) for r in reads])
    wide = int((start + size).max())
    symbols = np.full((m, wide), -1, dtype=np.int16)
    for i, r in enumerate(reads):
        symbols[i, start[i] : start[i] + len(r)] = r
    symbols = np.ascontiguousarray(symbols.T)
    order, common = np.arange(m), np.zeros(m, dtype=np.uint8)  # common[k]: of suffixes k - 1 and k
    marked = np.zeros((wide, m), dtype=bool)
    for c in range(wide - 1, -1, -1):
        s = symbols[c][order]
        step = np.argsort(s, kind="stable")
        s, before = s[step], step
        # The common prefix of two suffixes that become neighbours: the least over those between them before.
        levels = [common]
        width = 1
        while 2 * width <= m:
            levels.append(np.minimum(levels[-1][:-width], levels[-1][width:]))
            width *= 2
        lo, hi = before[:-1] + 1, before[1:] + 1
        length = np.maximum(hi - lo, 1)
        power = np.frexp(length)[1] - 1
        least = np.zeros(m - 1, dtype=np.uint8)
        same = (s[1:] == s[:-1]) & (s[1:] >= 0)
        for p in np.unique(power[same]):
            at = np.flatnonzero(same & (power == p))
            least[at] = np.minimum(levels[p][lo[at]], levels[p][hi[at] - (1 << p)])
        common = np.zeros(m, dtype=np.uint8)
        common[1:] = np.where(same, np.minimum(least, SPAN - 1) + 1, 0)
        order = order[step]
        full = np.flatnonzero(common == SPAN)
        marked[c, order[full]] = True
        marked[c, order[full - 1]] = True
    marked = np.ascontiguousarray(marked.T)
    return [marked[i, start[i] : start[i] + size[i] - SPAN + 1] for i in range(m)]


def stretches(mark: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.r_[False, mark, False].astype(np.int8))
    return first + np.flatnonzero(edge == 1), first + np.flatnonzero(edge == -1) - 1


FOUND = "doc_id long, h long, first int, last int"


def found_batch(rows: list[tuple]) -> pa.RecordBatch:
    """rows: (doc_id, h, firsts, lasts)."""
    k = [len(r[2]) for r in rows]
    rep = lambda c: pa.array([r[c] for r, n in zip(rows, k, strict=True) for _ in range(n)], pa.int64())
    flat = lambda c: pa.array(np.concatenate([r[c] for r in rows]).astype(np.int32) if rows else np.zeros(0, np.int32))
    return pa.RecordBatch.from_arrays([rep(0), rep(1), flat(2), flat(3)], names=["doc_id", "h", "first", "last"])


def compared_reads(affected: DataFrame) -> DataFrame:
    """Repeated windows of the runs that are compared as reads."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, h, text, own in zip(*(batch.column(c) for c in range(4)), strict=True):
                b = raw(text.as_py())
                use = [r for r in own.as_py() if r["way"] in (READ, SAMPLE)]
                if use:
                    made = {n: [r[n] for r in use] for n in ("deal", "first", "at", "way")}
                    arrays = [pa.array([doc.as_py()] * len(use), pa.int64()), pa.array([h.as_py()] * len(use), pa.int64()), pa.array(made["deal"], pa.int64()), pa.array(made["first"], pa.int32()), pa.array(made["at"], pa.int32()), pa.array(made["way"], pa.int32()), pa.array([b[r["first"] : r["last"] + SPAN].tobytes() for r in use], pa.binary())]
                    yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "h", "deal", "first", "at", "way", "bytes"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            held = pa.concat_tables([held, pa.Table.from_batches([batch])]) if held is not None else pa.Table.from_batches([batch])
            if held.num_rows >= READS:  # sorted by anchor: the last anchor's reads wait for the rest
                deal = held.column("deal").to_numpy()
                edge = int(np.searchsorted(deal, deal[-1]))
                if edge:
                    yield one(held.slice(0, edge))
                    held = held.slice(edge)
        if held is not None and held.num_rows:
            yield one(held)

    def one(part: pa.Table) -> pa.RecordBatch:
        doc, h = part.column("doc_id").to_pylist(), part.column("h").to_pylist()
        first, at, way = (part.column(c).to_numpy() for c in ("first", "at", "way"))
        marks = columns([np.frombuffer(x, dtype=np.uint8) for x in part.column("bytes").to_pylist()], (at - first).astype(np.int64))
        return found_batch([(doc[i], h[i], *stretches(marks[i], int(first[i]))) for i in range(len(doc)) if way[i] == READ and marks[i].any()])

    reads = affected.where(F.exists("runs", lambda r: r["way"].isin(READ, SAMPLE))).select("doc_id", "h", "text", "runs")
    cut_reads = reads.mapInArrow(cut, "doc_id long, h long, deal long, first int, at int, way int, bytes binary")
    return cut_reads.repartition(partitions_for(affected.sparkSession), "deal").sortWithinPartitions("deal").mapInArrow(compare, FOUND)


WINDOW = "w long, doc_id long, h long, first int, last int, way int"


def compared_windows(affected: DataFrame) -> DataFrame:
    """Repeated windows of the runs of frequent anchors, by counts of their hashes.

    What a task sees twice is settled there; of each such window one stands for it elsewhere, and
    only the others are left to meet by hash.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in WINDOW.split(", ")]

        def sent() -> Iterator[pa.RecordBatch]:
            w, doc, h, first, way = (np.concatenate([x[c] for x in held]) for c in range(5))
            _, one, of, n = np.unique(w, return_index=True, return_inverse=True, return_counts=True)
            twice = n[of] > 1
            stand = np.zeros(len(w), bool)
            stand[one[n > 1]] = True
            for use, kind in (((way == COUNTED) & twice, REPEATED), (~twice, 0), (stand, COUNTED_SAMPLE)):
                at = np.flatnonzero(use)
                kinds = way[at] if not kind else np.full(len(at), kind, np.int32)
                if kind == REPEATED and len(at):  # neighbouring windows of a run make one row
                    order = at[np.lexsort((first[at], h[at], doc[at]))]
                    new = np.r_[True, (doc[order][1:] != doc[order][:-1]) | (h[order][1:] != h[order][:-1]) | (first[order][1:] > first[order][:-1] + 1)]
                    starts = np.flatnonzero(new)
                    ends = np.r_[starts[1:], len(order)] - 1
                    at, last, kinds = order[starts], first[order[ends]], kinds[: len(starts)]
                else:
                    last = first[at]
                for lo in range(0, len(at), 100_000):
                    p = slice(lo, lo + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(w[at[p]]), pa.array(doc[at[p]], mask=doc[at[p]] == NULL), pa.array(h[at[p]]), pa.array(first[at[p]]), pa.array(last[p]), pa.array(kinds[p])], names=names)

        held, size = [], 0
        for batch in batches:
            for doc, h, text, own in zip(*(batch.column(c) for c in range(4)), strict=True):
                use = [r for r in own.as_py() if r["way"] in (COUNTED, COUNTED_SAMPLE)]
                b, name = raw(text.as_py()), NULL if doc.as_py() is None else doc.as_py()
                for r in use:
                    n = r["last"] - r["first"] + 1
                    w = mix(Hashed(b[r["first"] : r["last"] + SPAN]).at(np.arange(n), SPAN)).view(np.int64)
                    held.append((w, np.full(n, name), np.full(n, h.as_py()), np.arange(r["first"], r["last"] + 1, dtype=np.int32), np.full(n, r["way"], np.int32)))
                    size += n
            if size > 2_000_000:
                yield from sent()
                held, size = [], 0
        if held:
            yield from sent()

    hot = affected.where(F.exists("runs", lambda r: r["way"].isin(COUNTED, COUNTED_SAMPLE))).select("doc_id", "h", "text", "runs")
    windows = store(hot.mapInArrow(cut, WINDOW), "windows")
    open_ = windows.where(F.col("way") != REPEATED)
    twice = open_.groupBy("w").agg(F.count("*").alias("n")).where("n > 1").select("w")
    met = open_.where(F.col("way") == COUNTED).join(twice.hint("merge"), "w")
    return met.unionByName(windows.where(F.col("way") == REPEATED)).select("doc_id", "h", "first", "last")


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs (doc_id, text)."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), F.coalesce("text", F.lit("")).alias("text"))
    found = settled(dealt_runs(keyed))
    run = F.struct("first", "last", "at", "deal", "way")
    by_doc = found.groupBy(F.col("doc_id").alias("_d"), F.col("h").alias("_h")).agg(F.collect_set(run).alias("runs"))
    same = lambda other: keyed["doc_id"].eqNullSafe(other["_d"]) & (keyed["h"] == other["_h"])
    text = keyed["text"]
    met = store(
        keyed.join(by_doc.hint("merge"), same(by_doc), "left").select(
            "doc_id", "h", F.octet_length(text).cast("long").alias("n_bytes"), F.when(F.col("runs").isNull(), F.sha2(text, 256)).alias("kept_sha256"), F.when(F.col("runs").isNotNull(), text).alias("text"), "runs"
        ),
        "met",
    )
    affected = met.where(F.col("runs").isNotNull())
    more = compared_reads(affected).unionByName(compared_windows(affected))
    more = store(more.groupBy(F.col("doc_id").alias("_d"), F.col("h").alias("_h")).agg(F.collect_list(F.struct("first", "last")).alias("more")), "more")
    known = F.transform(F.filter("runs", lambda r: r["way"] == REPEATED), lambda r: F.struct(r["first"].alias("first"), r["last"].alias("last")))
    done = affected.join(more.hint("merge"), affected["doc_id"].eqNullSafe(more["_d"]) & (affected["h"] == more["_h"]), "left").select(
        "doc_id", "text", F.concat(known, F.coalesce("more", F.array().cast("array<struct<first:int,last:int>>"))).alias("covered")
    )

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, covered in zip(batch.column(1), batch.column(2), strict=True):
                b, c = raw(text.as_py()), covered.values
                edge = np.zeros(len(b) + 1, dtype=np.int32)
                np.add.at(edge, c.field("first").to_numpy(zero_copy_only=False), 1)
                np.add.at(edge, c.field("last").to_numpy(zero_copy_only=False) + SPAN, -1)
                gone = np.cumsum(edge[:-1]) > 0
                rows.append((len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.view(np.int8)]) == 1).sum()), hashlib.sha256(b[~gone].tobytes()).hexdigest()))
            made = [pa.array([r[i] for r in rows], pa.string() if i == 3 else pa.int64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=[x.split()[0] for x in RESULT.split(", ")])

    rest = met.where(F.col("runs").isNull()).select("doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), "kept_sha256")
    return done.mapInArrow(remove, RESULT).unionByName(rest)


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
