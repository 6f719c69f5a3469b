"""Exact n-gram Jaccard self-join with set-relation skipping, and its components.

A text's set holds the 64-bit hashes of its distinct word shingles. Equal sets are one node.
All sets are ordered by one global order, frequent shingles last, and each set is indexed under
its prefix: two sets with 100 * intersection >= percent * union share COMMON prefix shingles, or as
many as they need to have in common, if those are fewer.

Index level. The list of a shingle is sorted by set size and position and read in steps: a block
of entries whose sizes are out of reach is skipped whole, entries are skipped by the positions of
the shared shingle (it bounds the overlap left and right of it) and by a sketch of each set (counts
of its shingles in bins of the hash; 32 bins, and four times as many for each fourfold size over
`longest`), which bounds the overlap from above. `longest` follows the similarity: up to it, two
sets without a common shingle miss each other in twice as many bins as a link may. No sketch travels
with an entry of a list of up to SHORT, as nearly all are: such lists give pairs, a pair of sets is
counted over all lists, and one that meets less than COMMON times, as most chance pairs do, is
dropped (shingles of longer lists, which are not counted, may make up for what it misses). The others
meet the two sketches in joins, once for each pair and in batches, so no task holds the sketches of a
part. In longer lists, whose entries get a sketch (of long sets once for each task), one set leads:
what passes with the leader is settled against it in one step, and only the rest is compared further.
The number of parts follows the number of entries (ENTRIES in each, about) and the bytes of their
sketches (BYTES at most, but for one list); a task has one part.

Answer level. What passes makes candidate groups (connected components of the survivors), each
with all its sets together. Within a group a set leads: its overlaps with all others are computed
once. A set Y that links with the leader X has its answers derived from X's: the overlap with Z is
that of X, less what Z holds of X without Y, plus what Z holds of Y without X. It is at most X's
overlap plus the size of Y without X, so nearly all of Y's comparisons are skipped; sets that are in
X's component already need none. What links with no leader leads next. A cell of a group holds at
most about GROUP sets and SHINGLES shingles (a bound on a task's memory); a larger group is cut at
random into cells, all of which also hold the group's LANDMARKS, so that near copies meet in one
component. Sets of the group's main component need no further comparison with each other, and the
remaining sets, in parts of OTHERS, are compared with every cell.

Only any fixed set of frequent shingles is needed for exactness, so finding it may be rough: tasks
report what they see twice, and the most frequent MOST of those seen over OFTEN times are sent to
all tasks (8 MB at most).

Defined results: words are runs of anything but space and \\t\\n\\v\\f\\r, with A-Z lower-cased; with
fewer words than a shingle the whole sequence is one shingle; null and empty texts and texts without
words have an empty set, link with nothing and are their own component; repeated rows are repeated;
rows with a null doc_id belong to the component of the texts they equal or resemble. An empty
table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, partitions_for, store, strings, table
from .graph import components

WORDS, PERCENT = 3, 90
OFTEN, MOST, SHORT, GROUP, SHINGLES, OTHERS, BINS, LONG, ENTRIES, BYTES, LANDMARKS, SALTS, FAN, COMMON = 100, 500_000, 48, 512, 300_000, 1024, 32, 1500, 200_000, 32 << 20, 8, 16, 16, 4
U = np.uint64
STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=U)


class Hashes(dict):
    """64-bit hashes of words, remembered up to a size."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        got = self[word] = xxhash.xxh64_intdigest(word)
        return got


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_set(text: str | None, hashes: Hashes, n: int = WORDS) -> np.ndarray:
    """Sorted hashes of the distinct shingles."""
    w = tokens(text)
    h = np.fromiter(map(hashes.__getitem__, w), dtype=U, count=len(w))
    if len(h) == 0:
        return h
    k = min(n, len(h))
    out = np.full(len(h) - k + 1, U(k))
    for i in range(k):
        out = mix(out + h[i : len(h) - k + 1 + i] * STEPS[i % 5])
    return np.unique(out)


def identity(s: np.ndarray) -> int:
    """One 64-bit id of a set, from its members alone."""
    x = mix(np.array([mix(s ^ STEPS[0]).sum(), np.bitwise_xor.reduce(s) ^ U(len(s))], dtype=U)) * STEPS[1:3]
    return int((x[0] ^ x[1]).view(np.int64))


def prefix_length(n: int, percent: int) -> int:
    """Shingles of a set of which a set that links with it holds one; each further one asks for one more."""
    return n - (n * percent + 99) // 100 + 1


READ = "doc_id long, text_hash long, n_shingles long, node long, sketch binary, shingle long, n long"


def read_sets(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Two kinds of rows from one pass over the texts: doc_id, text_hash, n_shingles, node and sketch (null without a
    set) of each row, and (shingle, n) of what a task sees more than once near the start of the plain hash order."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, size, long_from = Hashes(), [], 0, longest(percent)
        names = [x.split()[0] for x in READ.split(", ")]

        def seen() -> pa.RecordBatch:
            at, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, U), np.zeros(0, int))
            at, n = at[n > 1].view(np.int64), n[n > 1]
            none = pa.nulls(len(at), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(len(at), pa.binary()), pa.array(at), pa.array(n)], names=names)

        for batch in batches:
            sizes, nodes, sketches = [], [], []
            for text in strings(batch.column(2)):
                s = shingle_set(text, hashes, words)
                sizes.append(len(s))
                nodes.append(identity(s) if len(s) else None)
                sketches.append(sketch(s, long_from) if len(s) else None)
                if len(s):
                    held.append(s[: prefix_length(len(s), percent) * 3 // 2 + 8])
                    size += len(held[-1])
            none = pa.nulls(len(sizes), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(sketches, pa.binary()), none, none], names=names)
            if size > 1_000_000:
                yield seen()
                held, size = [], 0
        yield seen()

    return docs.select("doc_id", "text_hash", "text").mapInArrow(each, READ)


def frequent(read: DataFrame) -> np.ndarray:
    """The most frequent shingles, sorted; MOST at most."""
    found = read.where(F.col("shingle").isNotNull()).groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") > OFTEN)
    rows = found.orderBy(F.desc("n"), "shingle").limit(MOST).select("shingle").toPandas()
    return np.sort(rows["shingle"].to_numpy(np.int64).view(U))


ENTRY = "part int, shingle long, node long, n int, at int"
POSTING = f"{ENTRY}, sketch binary"


def longest(percent: int) -> int:
    """Up to this size BINS bins tell unlike sets apart: of two random sets of n, each leaves n / sqrt(pi * n / BINS) unmatched, about."""
    missing = 1 - 2 * percent / (100 + percent)
    return max(1, min(LONG, int(BINS / (4 * math.pi * max(missing, 1e-3) ** 2))))


def level(n: np.ndarray | int, long: int):
    """How many times a size is fourfold over `long`: 0 for short sets."""
    return np.ceil(np.log2(np.maximum(n, long) / long) / 2).astype(np.int64)


def sketch(s: np.ndarray, long: int) -> bytes:
    """Counts by the leading bits of the hash, scaled to a byte and rounded up."""
    bits = BINS.bit_length() - 1 + 2 * int(level(len(s), long))
    counts = np.bincount((s >> U(64 - bits)).astype(np.int64), minlength=1 << bits)
    return np.minimum(-(-counts // scale(len(s))), 255).astype(np.uint8).tobytes()


def scale(n):
    return 1 + n // 200_000


def postings(docs: DataFrame, often: np.ndarray, words: int, percent: int, parts: int) -> DataFrame:
    """Prefix entries of each set, with the part of their shingle."""
    shipped = docs.sparkSession.sparkContext.broadcast(often)  # MOST hashes at most

    def made(found: list[tuple]) -> pa.RecordBatch:
        k = [len(f[0]) for f in found]
        shingle = np.concatenate([f[0] for f in found])
        columns = [(mix(shingle) % U(parts)).astype(np.int32), shingle.view(np.int64), np.repeat(np.array([f[1] for f in found], np.int64), k), np.repeat(np.array([f[2] for f in found], np.int32), k), np.concatenate([np.arange(x, dtype=np.int32) for x in k])]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[x.split()[0] for x in ENTRY.split(", ")])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, last, known = Hashes(), shipped.value, set()
        found, size = [], 0
        for batch in batches:
            if len(known) > 1_000_000:  # what a task has posted before is not posted again
                known.clear()
            for text in strings(batch.column(0)):
                s = shingle_set(text, hashes, words)
                if not len(s) or (node := identity(s)) in known:
                    continue
                known.add(node)
                late = last[np.minimum(np.searchsorted(last, s), len(last) - 1)] == s if len(last) else np.zeros(len(s), bool)
                found.append((np.r_[s[~late], s[late]][: prefix_length(len(s), percent) + COMMON - 1], node, len(s)))
                size += len(found[-1][0])
                if size > 200_000:
                    yield made(found)
                    found, size = [], 0
        if found:
            yield made(found)

    return docs.select("text").mapInArrow(each, ENTRY)


def dealt(index: DataFrame, parts: int) -> DataFrame:
    """One part for each task: hashes of the part's number would bring up to seven together."""
    return index.repartitionById(parts, "part")


def within(a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether sizes a, b and the positions p, q of a common shingle leave two sets a chance, and the overlap that they need."""
    need = -(-percent * (a + b) // (100 + percent))
    ok = (np.minimum(p, q) + 1 + np.minimum(a - 1 - p, b - 1 - q)) >= need
    return ok & (np.minimum(a, b) * 100 >= percent * np.maximum(a, b)), need


def steps(n: np.ndarray, end_of: np.ndarray, i: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Entries i, of lists of up to SHORT that end at end_of, with those behind them within reach of their size."""
    for d in range(1, SHORT):
        i = i[i + d < end_of[i]]
        i = i[n[i] * 100 >= percent * n[i + d]]  # sizes only grow: the rest of the list is skipped
        if not len(i):
            break
        for part in np.array_split(i, 1 + len(i) // 200_000):
            yield part, part + d


FOUND = "shingle long, node long, n int, at int, a long, b long, need int, k long"


def shared(index: DataFrame, percent: int, parts: int) -> DataFrame:
    """Two kinds of rows: of lists of up to SHORT entries the pairs (a, b, need, k) that sizes and positions leave a chance, which
    meet k times here; of longer ones the entries (shingle, node, n, at) whose list holds another set within reach of their size.
    Most shingles are in one set only."""
    names = ["shingle", "node", "n", "at"]

    def rows(entry: list[np.ndarray], pair: list[np.ndarray]) -> pa.RecordBatch:
        kinds = [x.split()[1] for x in FOUND.split(", ")]
        kinds = [pa.int64() if x == "long" else pa.int32() for x in kinds]
        size = len((entry or pair)[0])
        columns = [pa.array(x).cast(t) if x is not None else pa.nulls(size, t) for x, t in zip([*(entry or [None] * 4), *(pair or [None] * 4)], kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in FOUND.split(", ")])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b.select(names) for b in batches]
        if not held:
            return
        got = pa.Table.from_batches(held)
        s, node, n, at = (got.column(c).to_numpy() for c in names)
        order = np.lexsort((node, at, n, s))
        s, node, n, at = s[order], node[order], n[order].astype(np.int64), at[order].astype(np.int64)
        order = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (node[1:] != node[:-1])][: len(s)])
        s, node, n, at = s[order], node[order], n[order], at[order]
        starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]][: len(s)])
        size = np.diff(np.r_[starts, len(s)])
        end_of, long = np.repeat(starts + size, size), np.repeat(size > SHORT, size)
        near = (s[1:] == s[:-1]) & (n[:-1] * 100 >= percent * n[1:])  # sizes grow within a list
        keep = np.flatnonzero(long & (np.r_[near, False] | np.r_[False, near])) if len(s) else np.zeros(0, np.int64)
        for lo in range(0, len(keep), 100_000):
            k = keep[lo : lo + 100_000]
            yield rows([s[k], node[k], n[k], at[k]], [])

        sets, first, name = np.unique(node, return_index=True, return_inverse=True)
        held = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]  # pairs as numbers, and how often they met

        def summed() -> tuple[np.ndarray, np.ndarray]:
            pair, at = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
            return pair, np.bincount(at, weights=np.concatenate([x[1] for x in held]), minlength=len(pair)).astype(np.int64)

        def made(pair: np.ndarray, k: np.ndarray) -> Iterator[pa.RecordBatch]:
            for lo in range(0, len(pair), 100_000):
                a, b = np.divmod(pair[lo : lo + 100_000], len(sets))
                need = -(-percent * (n[first[a]] + n[first[b]]) // (100 + percent))
                yield rows([], [sets[a], sets[b], need, k[lo : lo + 100_000]])

        size = 0
        for i, j in steps(n, end_of, np.flatnonzero(~long), percent):
            ok = within(n[i], n[j], at[i], at[j], percent)[0]
            x, y = name[i[ok]], name[j[ok]]
            held.append((np.minimum(x, y) * len(sets) + np.maximum(x, y), np.ones(len(x), np.int64)))
            size += len(x)
            if size > 1_000_000:
                held, size = [summed()], 0
                if len(held[0][0]) > 1_000_000:
                    yield from made(*held.pop())
                    held = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        yield from made(*summed())

    return dealt(index, parts).mapInArrow(each, FOUND)


def often_met(found: DataFrame) -> DataFrame:
    """Pairs (a, b, need) that meet COMMON times, or as often as they need to; each shingle of a longer list that both may hold counts too."""
    pairs = store(found.where(F.col("a").isNotNull()).groupBy("a", "b").agg(F.max("need").alias("need"), F.sum("k").alias("k")), "met")
    asked = F.least("need", F.lit(COMMON))
    hidden = found.where(F.col("shingle").isNotNull()).groupBy("node").agg(F.count("*").alias("h"))
    of = lambda x: hidden.select(F.col("node").alias(x), F.col("h").alias(f"h_{x}")).hint("merge")
    rest = pairs.where(F.col("k") < asked).join(of("a"), "a").join(of("b"), "b").where(F.col("k") + F.least("h_a", "h_b") >= asked)
    return pairs.where(F.col("k") >= asked).select("a", "b", "need").union(rest.select("a", "b", "need"))


def most(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What two sketches, row by row, leave as the overlap of sets of n and m at most."""
    bins, got = min(x.shape[1], y.shape[1]), []
    for z, by in ((x, scale(n)), (y, scale(m))):
        if z.shape[1] > bins:  # the finer one is added up to the coarser one's bins
            z = z.reshape(len(z), bins, -1).sum(axis=2, dtype=np.int32)
        got.append(z if (by == 1).all() else z.astype(np.int64) * by[:, None])
    return np.minimum(*got).sum(axis=1, dtype=np.int64)


def alike(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sketches leave the overlap that they need."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, need, n, m = (batch.column(c).to_numpy() for c in ("a", "b", "need", "n_a", "n_b"))
            width = [pc.binary_length(batch.column(c)).to_numpy() for c in ("s_a", "s_b")]
            ok = np.zeros(len(a), bool)
            for p, q in np.unique(np.stack(width, axis=1), axis=0).tolist():
                at = np.flatnonzero((width[0] == p) & (width[1] == q))
                for part in np.array_split(at, 1 + len(at) * max(p, q) // 8_000_000):
                    x, y = (np.frombuffer(b"".join(batch.column(c).take(pa.array(part)).to_pylist()), dtype=np.uint8).reshape(len(part), w) for c, w in (("s_a", p), ("s_b", q)))
                    ok[part] = most(x, y, n[part].astype(np.int64), m[part].astype(np.int64)) >= need[part]
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], names=["a", "b"])

    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}")).hint("merge")
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(each, "a long, b long")


def sketched(entries: DataFrame, nodes: DataFrame, parts: int, long_from: int) -> DataFrame:
    """Entries with the sketches of short sets; rows without a shingle bring the sketch of a long set to a part."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, shingle, n, at = (batch.column(c).to_numpy() for c in range(4))
            part = (mix(shingle.view(U)) % U(parts)).astype(np.int32)
            long = level(n.astype(np.int64), long_from) > 0
            _, brings = np.unique(np.stack([node[long], part[long]], axis=1), axis=0, return_index=True)
            brings = np.flatnonzero(long)[brings]
            all_of = np.r_[np.arange(len(node)), brings]
            late = np.arange(len(all_of)) >= len(node)
            columns = [pa.array(part[all_of]), pa.array(shingle[all_of], mask=late), pa.array(node[all_of]), pa.array(n[all_of]), pa.array(at[all_of], mask=late)]
            kept = pc.if_else(pa.array(~late & long[all_of]), pa.scalar(None, pa.binary()), batch.column(4).take(pa.array(all_of)))
            yield pa.RecordBatch.from_arrays([*columns, kept], names=[x.split()[0] for x in POSTING.split(", ")])

    met = entries.join(nodes.select("node", "sketch").hint("merge"), "node").select("node", "shingle", "n", "at", "sketch")
    return met.mapInArrow(each, POSTING)


def trees(pairs: np.ndarray) -> np.ndarray:
    """Edges with the same components: in each component the sorted nodes form a tree of FAN branches, so that it is shallow and no node has many edges."""
    nodes, at = np.unique(pairs, return_inverse=True)
    at = at.reshape(-1, 2)
    label = np.arange(len(nodes))
    while len(at):
        low = np.minimum(label[at[:, 0]], label[at[:, 1]])
        new = label.copy()
        np.minimum.at(new, label[at[:, 0]], low)
        np.minimum.at(new, label[at[:, 1]], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    order = np.argsort(label, kind="stable")
    starts = np.flatnonzero(np.r_[True, label[order][1:] != label[order][:-1]][: len(order)])
    start = np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    rank = np.arange(len(order)) - start
    up, below = start + (rank - 1) // FAN, rank > 0
    return np.stack([nodes[order[up[below]]], nodes[order[below]]], axis=1)


class Lists:
    """Index lists of a task: entries sorted by (shingle, size, position)."""

    def __init__(self, got: pa.Table, percent: int, long_from: int) -> None:
        brought = got.filter(pc.is_null(got.column("shingle")))
        got = got.filter(pc.is_valid(got.column("shingle")))
        s, node, n, at = (got.column(c).to_numpy() for c in ("shingle", "node", "n", "at"))
        order = np.lexsort((node, at, n, s))
        fresh = np.r_[True, (s[order][1:] != s[order][:-1]) | (node[order][1:] != node[order][:-1])] if len(s) else np.zeros(0, bool)
        order = order[fresh]
        self.s, self.node, self.n, self.at, self.percent = s[order], node[order], n[order].astype(np.int64), at[order].astype(np.int64), percent
        self.level, self.row = level(self.n, long_from), np.zeros(len(order), np.int64)
        short = got.column("sketch").take(pa.array(order[self.level == 0])).to_pylist()
        self.row[self.level == 0] = np.arange(len(short))
        self.sketches = {0: np.frombuffer(b"".join(short), dtype=np.uint8).reshape(-1, BINS)}
        name, kept = brought.column("node").to_numpy(), brought.column("sketch").to_pylist()
        of = level(brought.column("n").to_numpy(), long_from)
        for k in np.unique(of).tolist():
            at = np.flatnonzero(of == k)
            names, first = np.unique(name[at], return_index=True)
            self.sketches[k] = np.frombuffer(b"".join(kept[x] for x in at[first]), dtype=np.uint8).reshape(len(names), -1)
            own = self.level == k
            self.row[own] = np.searchsorted(names, self.node[own])

    def most(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """What the sketches of entries i and j leave as their overlap at most."""
        out = np.zeros(len(i), dtype=np.int64)
        li, lj = self.level[i], self.level[j]
        for p in np.unique(li).tolist():
            for q in np.unique(lj[li == p]).tolist():
                at = np.flatnonzero((li == p) & (lj == q))
                for part in np.array_split(at, 1 + len(at) * self.sketches[max(p, q)].shape[1] // 8_000_000):
                    x, y = i[part], j[part]
                    out[part] = most(self.sketches[p][self.row[x]], self.sketches[q][self.row[y]], self.n[x], self.n[y])
        return out

    def near(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether sizes, positions and sketches leave entries i and j a chance."""
        ok, need = within(self.n[i], self.n[j], self.at[i], self.at[j], self.percent)
        at = np.flatnonzero(ok)
        if len(at):
            ok[at] = self.most(i[at], j[at]) >= need[at]
        return ok

    def pairs(self) -> np.ndarray:
        """Edges whose components are those of all pairs that pass, list by list."""
        edges = np.flatnonzero(np.r_[True, self.s[1:] != self.s[:-1]])
        ends = np.r_[edges[1:], len(self.s)]
        end_of = np.repeat(ends, ends - edges)
        long = np.repeat(ends - edges > SHORT, ends - edges)
        out = []
        for i, j in steps(self.n, end_of, np.flatnonzero(~long), self.percent):
            ok = self.near(i, j)
            out.append(np.stack([self.node[i[ok]], self.node[j[ok]]], axis=1))
        for lo, hi in zip(edges[ends - edges > SHORT], ends[ends - edges > SHORT], strict=True):
            out.append(self.led(np.arange(lo, hi)))
        got = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
        return trees(got)

    def led(self, at: np.ndarray) -> np.ndarray:
        """A long list: leaders settle what passes with them; every set that a leader leaves is compared with all."""
        label, found = np.arange(len(at)), []
        rest = np.ones(len(at), bool)
        first = 0
        while True:
            size = self.n[at[first]]
            lo = np.searchsorted(self.n[at], -(-size * self.percent // 100))
            hi = np.searchsorted(self.n[at], size * 100 // self.percent, side="right")
            window = np.arange(lo, hi)
            ok = window[self.near(np.broadcast_to(at[first], len(window)), at[window])]
            if rest.all():  # the first leader: who passes with it needs no leader of its own
                rest[ok] = False
            rest[first] = False
            ok = ok[ok != first]
            fresh = ok[np.unique(label[ok], return_index=True)[1]] if len(ok) else ok
            fresh = fresh[label[fresh] != label[first]]
            line = np.r_[first, fresh]
            found += zip(line[:-1], line[1:], strict=True)
            for x in np.unique(label[fresh]):
                label[label == x] = label[first]
            left = np.flatnonzero(rest)
            if not len(left):
                break
            first = left[0]
        got = np.array(found, dtype=np.int64).reshape(-1, 2)
        return np.stack([self.node[at[got[:, 0]]], self.node[at[got[:, 1]]]], axis=1)


def candidates(index: DataFrame, percent: int, parts: int, long_from: int) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            got = Lists(pa.Table.from_batches(held), percent, long_from).pairs()
            yield pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], names=["a", "b"])

    return dealt(index, parts).mapInArrow(each, "a long, b long")


class Cell:
    """Sets of a cell, their shingles numbered."""

    def __init__(self, sets: list[np.ndarray], percent: int) -> None:
        self.size = np.array([len(s) for s in sets])
        self.start = np.cumsum(self.size) - self.size
        _, self.flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.worth = np.zeros(int(self.flat.max()) + 1, dtype=np.int32)
        self.percent, self.label = percent, np.arange(len(sets))

    def members(self, i: int) -> np.ndarray:
        return self.flat[self.start[i] : self.start[i] + self.size[i]]

    def overlaps(self, x: int) -> np.ndarray:
        """Overlap of set x with every set."""
        self.worth[self.members(x)] = 1
        out = np.add.reduceat(self.worth[self.flat], self.start)
        self.worth[self.members(x)] = 0
        return out

    def need(self, y: int, of: np.ndarray) -> np.ndarray:
        return -(-self.percent * (self.size[y] + of) // (100 + self.percent))

    def derived(self, x: int, both: np.ndarray, y: int, others: np.ndarray) -> np.ndarray:
        """Which of `others` link with y, from the overlaps of x, which y resembles."""
        need = self.need(y, self.size[others])
        near = both[others] + self.size[y] - both[y] >= need
        others, need = others[near], need[near]
        if not len(others):
            return others
        self.worth[self.members(x)] -= 1
        self.worth[self.members(y)] += 1
        step = np.array([self.worth[self.members(z)].sum() for z in others])
        self.worth[self.members(x)] = 0
        self.worth[self.members(y)] = 0
        return others[both[others] + step >= need]

    def join(self, x: int, linked: np.ndarray) -> list[tuple[int, int]]:
        """Merge components; one edge for each that x's component did not hold."""
        linked = linked[self.label[linked] != self.label[x]]
        names, first = np.unique(self.label[linked], return_index=True)
        self.label[np.isin(self.label, names)] = self.label[x]
        return [(x, int(linked[i])) for i in first]

    def links(self, asked: np.ndarray) -> list[tuple[int, int]]:
        """Edges with the components of all links of asked sets."""
        found, waiting = [], np.zeros(len(self.size), bool)
        waiting[asked] = True
        for x in asked[np.argsort(-self.size[asked], kind="stable")].tolist():
            if not waiting[x]:
                continue
            both = self.overlaps(x)
            linked = both >= self.need(x, self.size)
            linked[x] = False
            found += self.join(x, np.flatnonzero(linked))
            waiting[x] = False
            follow = np.flatnonzero(linked & waiting)
            waiting[follow] = False
            for y in follow.tolist():
                found += self.join(y, self.derived(x, both, y, np.flatnonzero(self.label != self.label[x])))
        return found


def verify(sets: DataFrame, words: int, percent: int) -> DataFrame:
    """Edges with the components of the links within each (grp, cell, part); where rows have role 1, of the links of those alone."""

    def each(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("role", ascending=False, kind="stable").drop_duplicates("node")  # asked rows first
        node, hashes = part["node"].to_numpy(), Hashes()
        asked = np.flatnonzero(part["role"].to_numpy() == 1)
        found = []
        if len(node) > 1:
            cell = Cell([shingle_set(x, hashes, words) for x in part["text"]], percent)
            found = cell.links(asked if len(asked) else np.arange(len(node)))
        at = np.array(found, dtype=np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": node[at[:, 0]], "b": node[at[:, 1]]}, dtype="int64")

    return sets.groupBy("grp", "cell", "part").applyInPandas(each, "a long, b long")


def salted(many: DataFrame, one: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    """Join of many rows with at most one row for each key; a hot key is spread over SALTS tasks by another column."""
    spread = one.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return many.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(spread.hint("merge"), [key, "_salt"], how).drop("_salt")


def labelled(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id and label for each row of docs (doc_id, text). Rows of a component share a label; texts without shingles have none."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    read = store(read_sets(docs, words, percent), "sets")
    base = read.where(F.col("n_shingles").isNotNull()).select("doc_id", "text_hash", "n_shingles", "node")
    # The row that stands for a node: the least doc_id that is known, and its text.
    row = F.min(F.struct(F.col("doc_id").isNull().alias("u"), "doc_id", "text_hash"))
    nodes = read.where(F.col("node").isNotNull()).groupBy("node").agg(row.alias("r"), F.max("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    nodes = store(nodes.select("node", F.col("r.doc_id").alias("first"), F.col("r.text_hash").alias("first_hash"), "n", "sketch"), "nodes")
    entries = nodes.agg(F.sum(F.least("n", F.col("n") - F.ceil(F.col("n") * percent / 100) + COMMON)).alias("n")).first()["n"] or 0
    parts, long_from = max(partitions_for(docs.sparkSession), -(-int(entries) // ENTRIES)), longest(percent)
    found = store(shared(postings(docs, frequent(read), words, percent, parts), percent, parts), "entries")
    pairs = store(often_met(found), "pairs")
    entries = found.where(F.col("shingle").isNotNull()).select("shingle", "node", "n", "at")
    bins = BINS * F.pow(F.lit(4), F.greatest(F.ceil(F.log2(F.col("n") / long_from) / 2), F.lit(0)))
    many, size = entries.agg(F.count("*"), F.coalesce(F.sum(bins), F.lit(0.0))).first()
    parts = max(-(-many // ENTRIES), math.ceil(size / BYTES), min(partitions_for(docs.sparkSession), -(-many // (ENTRIES // 10))), 1)
    long = candidates(sketched(entries, nodes, parts, long_from), percent, parts, long_from)
    survivors = store(alike(pairs, nodes).union(long).distinct(), "survivors")
    nodes = nodes.drop("sketch")
    groups = components(survivors).select(F.col("id").alias("node"), F.col("label").alias("grp"))
    groups = store(groups.join(nodes.hint("merge"), "node"), "groups")
    cells = F.greatest(F.ceil(F.count("*") / GROUP), F.ceil(F.sum("n") / SHINGLES))
    marks = F.array_distinct(F.array(*[F.min_by("node", F.xxhash64("node", F.lit(k))) for k in range(LANDMARKS)]))
    large = store(groups.groupBy("grp").agg(cells.alias("cells"), marks.alias("marks")).where("cells > 1"), "large")
    groups = salted(groups.drop("n"), large, "grp", "node", "left").withColumn("cells", F.coalesce("cells", F.lit(1).cast("long")))

    # Texts travel in place of their sets, which are twice as large.
    sets = docs.join(groups.hint("merge"), F.col("doc_id").eqNullSafe(F.col("first")) & (F.col("text_hash") == F.col("first_hash")))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    own = F.array(F.pmod(F.xxhash64("node"), F.col("cells")))
    whole = F.array_contains("marks", F.col("node"))
    cell = F.explode(F.when(whole, F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)).otherwise(own))
    sets = store(sets.select("grp", "cells", "node", "text", F.coalesce(whole, F.lit(False)).alias("mark"), cell.alias("cell"), F.lit(0).alias("role"), F.lit(0).cast("long").alias("part")), "members")
    links = store(verify(sets, words, percent), "links")

    if large.limit(1).count():
        label = components(links).withColumnRenamed("id", "node")
        label = groups.where("cells > 1").select("grp", "node").join(label.hint("merge"), "node", "left").select("grp", "node", F.coalesce("label", "node").alias("label"))
        counted = label.groupBy("grp", "label").agg(F.count("*").alias("n"))
        main = store(counted.groupBy("grp").agg(F.max_by("label", F.struct("n", "label")).alias("main")), "main")
        open_ = store(salted(label, main, "grp", "node").where("label <> main").select("grp", "node"), "open")
        parts = store(open_.groupBy("grp").agg(F.ceil(F.count("*") / OTHERS).alias("parts")), "parts")
        # One row of each set: marks stand in every cell.
        rest = sets.where((F.col("cells") > 1) & (~F.col("mark") | (F.col("cell") == F.pmod(F.xxhash64("node"), F.col("cells")))))
        asked = salted(rest.join(open_.select("node").hint("merge"), "node", "left_semi"), parts, "grp", "node")
        asked = asked.select("grp", "node", "text", every(F.col("cells")).alias("cell"), F.lit(1).alias("role"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).alias("part"))
        there = salted(rest, parts, "grp", "node").select("grp", "node", "text", "cell", "role", every(F.col("parts")).alias("part"))
        links = store(links.union(verify(asked.unionByName(there), words, percent)), "links")

    label = components(links).withColumnRenamed("id", "node")
    first = store(label.join(nodes.hint("merge"), "node").groupBy("label").agg(F.min("first").alias("least")), "least")
    named = salted(label, first, "label", "node").select("node", "least", "label")
    own = nodes.join(named.hint("merge"), "node", "left").select("node", F.coalesce("least", "first").alias("component_id"), F.coalesce("label", "node").alias("label"))
    named = store(own, "named")
    return base.join(named.hint("merge"), "node", "left").select("doc_id", "text_hash", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "label")


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs (doc_id, text)."""
    return labelled(docs, words, percent).select("doc_id", "n_shingles", "component_id")


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), WORDS, PERCENT)


def first_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near copies: that with the least (doc_id, text hash), known ids first; of repeated rows, one.

    Texts without shingles are in no group: one row of each known id stays, and all without an id.
    """
    named = labelled(docs, words, percent)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("u"), "doc_id", "text_hash"))
    alone = named.where(F.col("label").isNull()).select("doc_id", "text_hash").distinct()
    first = named.where(F.col("label").isNotNull()).groupBy("label").agg(least.alias("r")).select("r.doc_id", "r.text_hash")
    first = store(first.unionByName(alone.where(F.col("doc_id").isNotNull())).select(F.col("doc_id").alias("_first_id"), F.col("text_hash").alias("_first_hash")), "first")
    keyed = docs.withColumn("_text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    once = keyed.dropDuplicates(["doc_id", "_text_hash"])
    kept = once.join(first.hint("merge"), F.col("doc_id").cast("long").eqNullSafe(F.col("_first_id")) & (F.col("_text_hash") == F.col("_first_hash")), "left_semi")
    empty = alone.where(F.col("doc_id").isNull()).select(F.col("text_hash").alias("_text_hash"))
    rest = keyed.where(F.col("doc_id").isNull()).join(empty.hint("merge"), "_text_hash", "left_semi")
    return kept.select(*docs.columns).unionByName(rest.select(*docs.columns))


OP8_SQL = """
with recursive d as (select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\x09-\\x0D]+') as w from documents),
s as (select distinct rid, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) end) as g from d),
n as (select rid, count(*) as n from s group by rid),
p as (select a.rid as x, b.rid as y, count(*) as k from s a join s b on a.g = b.g and a.rid < b.rid group by all),
e as (select x, y from p join n a on a.rid = x join n b on b.rid = y where 100 * k >= 90 * (a.n + b.n - k)),
r(rid, other) as (select rid, rid from d union select r.rid, case when e.x = r.other then e.y else e.x end from r join e on r.other = e.x or r.other = e.y)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, (select min(o.doc_id) from r join d o on o.rid = r.other where r.rid = d.rid) as component_id from d left join n on n.rid = d.rid
"""
