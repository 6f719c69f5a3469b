"""Known phrases of any length in texts: one pass over the texts against a filter of all phrases' beginnings, then an exact join."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder

#: Bytes of a filter, which has a byte at least for each word of the phrases and each phrase: one filter for 64 million words.
FILTER = 64 << 20
#: Bits of a part of a filter that one group of a task makes.
PART = 1 << 20
#: Bytes of rows that leave a task at once, and words that are looked at together.
BATCH, TOGETHER = 8 << 20, 1 << 20
_MUL, _MIX, _WHOLE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def hashed_words(text: Column) -> Column:
    """The hashes of a text's words; none for null."""
    return F.coalesce(F.transform(F.split(text, " "), lambda w: F.xxhash64(w)), F.array().cast("array<bigint>"))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def _longer(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a run of words that is longer by a word."""
    return _mixed(h * _MUL + word)


def _places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a hash in a filter of a power of two of bits."""
    m = np.uint64(bits - 1)
    return h & m, (h >> np.uint64(32)) & m


def _runs(words: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words of a column, the row of each, and the end of its row."""
    flat = words.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    sizes = words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat, np.repeat(np.arange(len(sizes)), sizes), np.repeat(np.cumsum(sizes), sizes)


def _beginnings(bits: int) -> Callable:
    """Phrases' words as bits (part, place) of all their beginnings and of the phrases as a whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, _, end = _runs(batch.column("words"))
            at = np.flatnonzero(np.r_[True, end[1:] != end[:-1]]) if len(flat) else np.zeros(0, np.int64)
            h, k = _mixed(flat[at]), 1
            while len(at):
                last = at + k == end[at]
                places = np.concatenate([p for x in (h, h[last] * _WHOLE) for p in _places(x, bits)]).astype(np.int64)
                yield pa.record_batch([pa.array(places // PART, pa.int64()), pa.array((places % PART).astype(np.int32))], names=["part", "place"])
                at, h = at[~last], h[~last]
                h, k = _longer(h, flat[at + k]), k + 1

    return run


def _part(group: pa.Table) -> pa.Table:
    held = np.zeros(PART, np.uint8)
    held[group.column("place").to_numpy()] = 1
    return pa.table({"part": group.column("part")[:1].combine_chunks(), "bits": pa.array([np.packbits(held, bitorder="little").tobytes()], pa.binary())})


def phrase_filter(phrases: DataFrame, bits: int) -> bytes:
    """Bits of the beginnings of phrases (words), made part by part by tasks; the driver gets the bits / 8 bytes of the result."""
    made = phrases.mapInArrow(_beginnings(bits), "part bigint, place int").groupBy("part").applyInArrow(_part, "part bigint, bits binary")
    whole = bytearray(max(bits, PART) // 8)
    for r in made.toLocalIterator():
        whole[r["part"] * (PART // 8) : (r["part"] + 1) * (PART // 8)] = r["bits"]
    return bytes(whole)


def _finder(shared, keys: list[str], bits: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(shared.value, np.uint8)

        def inside(h: np.ndarray) -> np.ndarray:
            a, b = (p.astype(np.int64) for p in _places(h, bits))
            return ((held[a >> 3] >> (a & 7)) & (held[b >> 3] >> (b & 7)) & 1).astype(bool)

        def starts(flat: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Where a phrase may start, and its words."""
            at, h, k = np.arange(len(flat)), _mixed(flat), 1
            found = [(at[:0], at[:0])]
            while len(at):
                ok = inside(h)
                at, h = at[ok], h[ok]
                whole = at[inside(h * _WHOLE)]
                found.append((whole, np.full(len(whole), k)))
                more = at + k < end[at]
                at, h = at[more], h[more]
                h, k = _longer(h, flat[at + k]), k + 1
            return np.concatenate([a for a, _ in found]), np.concatenate([n for _, n in found])

        def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            """Rows with about TOGETHER words, one row at least."""
            before = np.r_[0, np.cumsum(batch.column("_words").value_lengths().to_numpy(zero_copy_only=False))]
            i = 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(before, before[i] + TOGETHER, "right")) - 1)
                yield batch.slice(i, j - i)
                i = j

        for batch in (part for whole in batches for part in slices(whole)):
            flat, row, end = _runs(batch.column("_words"))
            at, many = starts(flat, end)
            begin = np.searchsorted(row, np.arange(batch.num_rows))
            rows: list[int] = []
            found: list[str] = []
            size, each, last, words, seen = 0, 64 + sum(batch.column(k).nbytes for k in keys) // max(1, batch.num_rows), -1, [], set()
            made = lambda: pa.record_batch([*batch.select(keys).take(pa.array(rows, pa.int64())).columns, pa.array(found, pa.string())], names=[*keys, "phrase"])  # noqa: B023, E731
            for x in np.argsort(at, kind="stable"):
                i = int(row[at[x]])
                if i != last:
                    last, words, seen = i, batch.column("_text")[i].as_py().split(" "), set()
                start = int(at[x] - begin[i])
                phrase = " ".join(words[start : start + int(many[x])])
                if phrase in seen:
                    continue
                seen.add(phrase)
                rows.append(i)
                found.append(phrase)
                size += each + len(phrase)
                if size > BATCH:
                    yield made()
                    rows, found, size = [], [], 0
            if rows:
                yield made()

    return run


def find_phrases(texts: DataFrame, text: str, known: DataFrame, owner: str = "owner", size: int = FILTER) -> DataFrame:
    """(other columns of texts, owner, phrase): the longest phrase of each owner that occurs in the text as whole words.

    text holds words parted by single blanks (see normalize_name), known (phrase, owner) as well, a
    phrase once. Phrases have any number of words. A filter of two bits for each beginning of a
    phrase goes to the tasks; a text's runs of words grow while the filter knows them, and those that
    may be phrases meet the phrases by an equi-join, which settles them. Texts are read once, or once
    for each `size` words of phrases: only phrases beyond 64 million words take a second pass. Only
    runs that may be phrases are shuffled, without the text. Null texts and empty phrases match
    nothing; repeated rows are repeated.
    """
    spark = texts.sparkSession
    keys = [c for c in texts.columns if c != text]
    known = known.select("phrase", F.col(owner).cast("string").alias(owner)).where("phrase <> ''")
    whole = known.agg(F.sum(F.size(F.split("phrase", " ")) + 1)).first()[0] or 0
    parts = max(1, -(-whole // size))
    bits = 1 << max(16, (16 * whole // parts).bit_length())
    bits = min(bits, 1 << max(16, (8 * size - 1).bit_length()))
    schema = ", ".join([*(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in keys), "_row bigint", "phrase string"])
    read = texts.select(*keys, F.monotonically_increasing_id().alias("_row"), F.col(text).alias("_text"), hashed_words(F.col(text)).alias("_words")).where(F.col("_text").isNotNull())
    out = []
    for part in range(parts):
        mine = known.where(F.pmod(F.xxhash64("phrase"), F.lit(parts)) == part).select(hashed_words(F.col("phrase")).alias("words"))
        shared = spark.sparkContext.broadcast(phrase_filter(mine, bits))  # about `size` bytes at most
        got = read.mapInArrow(_finder(shared, [*keys, "_row"], bits), schema)
        if parts > 1:  # so that one filter is held at a time
            path = shared_folder(spark, "phrases")
            got.write.parquet(path)
            got = spark.read.schema(got.schema).parquet(path)
            shared.unpersist()
        out.append(got)
    met = reduce(DataFrame.unionByName, out).join(known.hint("merge"), "phrase")
    best = F.max_by("phrase", F.struct(F.length("phrase"), "phrase")).alias("phrase")
    return met.groupBy(*keys, "_row", owner).agg(best).drop("_row")
