"""Packing token sequences into windows by best fit decreasing.

Texts are turned into ids inside the tasks that read them (the byte-level BPE vocabulary of
`tokenizer`, then one end id). Documents longer than a window are cut into full windows first;
what is left over is a shorter piece. Only the pieces' metadata (ids' checksum, start, length) is
kept, written to the shared folder, and dealt by hash into groups of about GROUP pieces; a task
(of TASKS at most, each with its own groups, sorted) holds one group at a time. In a group, pieces are taken by
decreasing length; a segment tree over remaining capacities 0..window finds the tightest open
window that still holds the piece in O(log window), else a new window is opened.

Sequence ids are group * 2**32 + number in the group: they depend on the stored pieces alone, so a
recomputed task gives the same ids. Rows that agree in id, start, length and checksum are alike.

The ids are those of the named `tokenizers` file, whose special tokens' strings in a text are those
tokens (`<|endoftext|>` is 50256); they are made with the same ranks through the faster `tiktoken`
(tests compare both). Two patterns serve: without its look-ahead the split pattern runs in linear
time and differs only where two white-space characters meet or a special token follows one, so
texts with such runs or tokens take the full pattern.

Defined results: a null or empty text is the single end id; repeated rows are packed each; ties
of length are ordered by doc_id and start; an empty table gives an empty result. Extra columns are
not read.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import store, strings, table

WINDOW, GROUP, TASKS = 1024, 32_768, 20_000
#: The vocabulary's special token. Fixed values.
SPECIAL, END_OF_TEXT = "<|endoftext|>", 50256
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = f"{PIECE}, sequence_id long, offset long"


def to_arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


@cache
def encoder(ranks_file: str) -> Callable[[str], list[int]]:
    import public_tokenizers
    import tiktoken

    special = {SPECIAL: END_OF_TEXT}
    with open(public_tokenizers.path(ranks_file), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    pattern = public_tokenizers.PATTERN
    whole = tiktoken.Encoding("whole", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    linear = tiktoken.Encoding("linear", pat_str=pattern.replace(r"|\s+(?!\S)", ""), mergeable_ranks=ranks, special_tokens={})
    runs = re.compile(r"\s\s|[\x1c-\x1f]")

    def encode(text: str) -> list[int]:
        if SPECIAL in text:
            return whole.encode(text, allowed_special={SPECIAL})
        return (whole if runs.search(text) else linear).encode_ordinary(text)

    return encode


def pieces(docs: DataFrame, window: int = WINDOW, tokenizer: str = "byte_bpe_50k.tiktoken", end: int = 0) -> DataFrame:
    """One row for each piece of at most `window` ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, schema = encoder(tokenizer), to_arrow(PIECE)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), strings(batch.column("text")), strict=True):
                ids = np.array([*encode(text or ""), end], dtype="<u4")
                n = len(ids)
                rows += [(doc_id, at, min(window, n - at), zlib.crc32(ids[at : at + window].tobytes()), n) for at in range(0, n, window)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], k.type) for k in schema], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECE)


class Capacities:
    """Open windows by remaining capacity; tightest(n) gives one with the least capacity >= n."""

    def __init__(self, window: int) -> None:
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def put(self, capacity: int, sequence: int) -> None:
        self.open[capacity].append(sequence)
        self._add(capacity, 1)

    def _add(self, capacity: int, n: int) -> None:
        at = capacity + self.size
        while at:
            self.count[at] += n
            at >>= 1

    def tightest(self, length: int) -> tuple[int, int] | None:
        count, at = self.count, length + self.size
        if not count[at]:
            while at > 1 and (at & 1 or not count[at + 1]):  # climb until a right sibling has one
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:  # then go down, left first
                at = 2 * at if count[2 * at] else 2 * at + 1
        capacity = at - self.size
        self._add(capacity, -1)
        return capacity, self.open[capacity].pop()


def best_fit(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece; lengths are in decreasing order."""
    tree, made = Capacities(window), 0
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i, n in enumerate(lengths.tolist()):
        if n < window and (hit := tree.tightest(n)):
            left, where = hit
        else:
            left, where, made = window, made, made + 1
        sequence[i], offset[i] = where, window - left
        if left > n:
            tree.put(left - n, where)
    return sequence, offset


def pack(cut: DataFrame, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """Sequence and offset for stored pieces."""
    groups = max(1, -(-cut.count() // group))

    def placed(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = pa.Table.from_batches(held)
        sequence, offset = best_fit(part.column("length").to_numpy(), window)
        first = int(part.column("g")[0].as_py()) << 32
        part = part.drop_columns("g").append_column("sequence_id", pa.array(first + sequence)).append_column("offset", pa.array(offset))
        yield from part.to_batches(max_chunksize=10_000)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None  # one group at a time; a task's rows are sorted by it
        for batch in batches:
            g = batch.column("g").to_numpy()
            edges = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), len(g)], strict=True):
                if hi > lo:
                    if held and g[lo] != now:
                        yield from placed(held)
                        held = []
                    now = g[lo]
                    held.append(batch.slice(lo, hi - lo))
        if held:
            yield from placed(held)

    # Rows that are repeated many times are dealt too.
    dealt = cut.withColumn("g", F.pmod(F.xxhash64("doc_id", "start", F.monotonically_increasing_id()), F.lit(groups)))
    tasks = min(groups, TASKS)
    dealt = dealt.repartitionById(tasks, (F.col("g") % tasks).cast("int")).sortWithinPartitions("g", F.desc("length"), "doc_id", "start", "ids_crc32")
    return dealt.mapInArrow(fill, PACKED)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(store(pieces(docs), "pieces"))
