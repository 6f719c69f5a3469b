"""Benchmark decontamination: BM25 retrieval with block maxima, then overlap checks.

Test items are indexed: every term has a BM25 weight in each item, scaled by the score that the
item must reach, so that the threshold is 1 for all. Items lie in blocks of BLOCK consecutive
ordinals and groups of GROUP; each term has its largest weight over all items (its list), in each
group and in each block. Texts are read as overlapping passages of PASSAGE words, and every passage
is a query. WAND's pivot test, the sum of the maxima of the query's lists against the threshold, is
made for many passages at once on nested ranges of ordinals: all items, then each group, then each
block of the groups that passed. A range that fails holds no item at the threshold and is skipped
whole. In the blocks left the weights of the query's terms are summed up for each item, and every
item at or above its threshold is retrieved, whatever it shares with the text.

Retrieved items are verified: those without a common run of SHINGLE words are left out by codes of
runs, and of the rest the question (all but the last sentence) and answer (the last sentence) are
compared with the whole text by shingles. An item is a hit if `least` of all its shingles occur, or of
those of its question or its answer, where that part has SPECIFIC words at least.

What an item must reach: `share`, at most `least`, of the least BM25 self-score over the runs of
PASSAGE / 2 words of the item and of its parts of SPECIFIC words (of the whole where shorter). Every
run of PASSAGE / 2 words lies wholly in one passage, so a verbatim item or part is always retrieved.

The index is built by tasks, a slice of at most about SLICE bytes of item text in each, with document
frequencies counted over all items before they meet the slices, and is written to the shared folder.
Compressed slices of HELD bytes together at most (one slice at least) are broadcast at a time; where
there are more, the texts are written with the hits so far and read once for each such part of the
index. A task holds one unpacked slice at a time. No text is shuffled.

Defined results: null and empty texts and items hit nothing; items of fewer than SHINGLE words
count as one shingle; repeated rows and repeated items are each reported; an empty table gives an
empty result; very long texts are read whole, passage by passage; items of one slice are listed by
their place in it. Extra columns pass through untouched.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import store, strings, table

PASSAGE, BLOCK, GROUP, SHINGLE, K1, B = 64, 4, 64, 5, 1.2, 0.75
SHARE, LEAST, SLICE, HELD = 0.6, 0.5, 1 << 20, 64 << 20
#: Passages that are tested at once, and words of short texts that are gathered for it.
AT_ONCE, GATHERED = 512, 1 << 15
#: A question or answer of fewer words is too common to be a hit by itself.
SPECIFIC = 8
HITS = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("question_overlap", T.DoubleType()), T.StructField("answer_overlap", T.DoubleType()), T.StructField("overlap", T.DoubleType())]))
BLANK = bytes(32 if i < 128 and not chr(i).isalnum() else i for i in range(256))


def words(text: str) -> list[bytes]:
    """Lower-cased words; ASCII punctuation and white space end a word."""
    return text.lower().encode("utf-8", "replace").translate(BLANK).split()


def shingles(w: list[bytes]) -> list[int]:
    if not w:
        return []
    n = min(SHINGLE, len(w))
    return [hash(tuple(w[i : i + n])) for i in range(len(w) - n + 1)]


def parts(text: str) -> tuple[list[bytes], list[bytes]]:
    """Question and answer of an item: the last sentence is the answer; a single sentence is all question."""
    body = text.rstrip(" \t\r\n.!?")
    cut = max(body.rfind(x) for x in (". ", "! ", "? ", ".\n", "!\n", "?\n", "\n"))
    return (words(text[: cut + 1]), words(text[cut + 1 :])) if cut > 0 else (words(text), [])


def specific(*of: list[bytes]) -> list[list[bytes]]:
    """The parts that are a hit by themselves."""
    return [p for p in of if len(p) >= SPECIFIC]


class Index:
    """items: (item_id, text); frequency: in how many of `total` items a term occurs."""

    def __init__(self, items: list[tuple[int, str]], frequency: dict[bytes, int], total: int, mean: float, share: float = SHARE) -> None:
        self.items = [(i, *parts(t)) for i, t in items]
        self.ids: dict[bytes, int] = {}
        weights: list[tuple[int, int, float]] = []
        for n, (_, text) in enumerate(items):
            w = words(text)
            tf = Counter(w)
            norm = K1 * (1 - B + B * len(w) / mean)
            bm25 = {t: math.log(1 + (total - frequency[t] + 0.5) / (frequency[t] + 0.5)) * c * (K1 + 1) / (c + norm) for t, c in tf.items()}
            run = PASSAGE // 2
            runs = [p[i : i + run] for p in (w, *specific(*self.items[n][1:])) for i in range(max(1, len(p) - run + 1))]
            least = min(sum(bm25[t] for t in set(r)) for r in runs)
            weights += [(self.ids.setdefault(t, len(self.ids)), n, x / max(1e-9, share * least)) for t, x in bm25.items()]
        t, n = (np.array([w[c] for w in weights], dtype=np.int64) for c in (0, 1))
        x, every = np.array([w[2] for w in weights]), len(self.ids) + 1  # the last term: words of no item
        count = max(1, -(-len(items) // GROUP))
        self.top, self.group_top = np.zeros(every, np.float32), np.zeros((every, count), np.float32)
        np.maximum.at(self.top, t, x)
        np.maximum.at(self.group_top, (t, n // GROUP), x)
        self.groups: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # of each: a term's row, its block maxima, its weights
        for g in range(count):
            own = n // GROUP == g
            terms, row = np.unique(t[own], return_inverse=True)
            place = np.full(every, len(terms), dtype=np.int32)
            place[terms] = np.arange(len(terms))
            blocks = -(-min(GROUP, len(items) - g * GROUP) // BLOCK)
            weight = np.zeros((len(terms) + 1, blocks * BLOCK))
            weight[row, n[own] - g * GROUP] = x[own]
            weight = weight.reshape(-1, blocks, BLOCK)
            self.groups.append((place, weight.max(axis=2).astype(np.float32), weight))
        codes: dict[int, list[tuple[int, int]]] = {}  # by length of shingles: (code, item)
        for n, (_, question, answer) in enumerate(self.items):
            t = self.numbers(question + answer)
            deciding = [t, *specific(t[: len(question)], t[len(question) :])]
            for size, own in {(min(SHINGLE, len(x)), c) for x in deciding for c in self.codes(x, min(SHINGLE, len(x))).tolist()}:
                codes.setdefault(size, []).append((own, n))
        self.shingled = {size: (np.array([c for c, _ in sorted(x)], dtype=np.uint64), [n for _, n in sorted(x)]) for size, x in codes.items()}

    def numbers(self, w: list[bytes]) -> np.ndarray:
        """The number of each word's term."""
        none, get = len(self.ids), self.ids.get
        return np.array([get(x, none) for x in w], dtype=np.int64)

    def codes(self, t: np.ndarray, size: int) -> np.ndarray:
        """A hash for each run of `size` term numbers; one term number that is in no item leaves a run out."""
        n = len(t) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        known, code = np.ones(n, dtype=bool), np.zeros(n, np.uint64)
        for i in range(size):
            known &= t[i : i + n] != len(self.ids)
            code = code * np.uint64(0x9E3779B97F4A7C15) + t[i : i + n].astype(np.uint64) + np.uint64(1)
        return code[known]

    def sharing(self, t: np.ndarray) -> set[int]:
        """Items that share a shingle with the text; no other can overlap."""
        out: set[int] = set()
        for size, (codes, items) in self.shingled.items():
            own = np.unique(self.codes(t, size))
            lo, hi = np.searchsorted(codes, own, "left"), np.searchsorted(codes, own, "right")
            for a, b in zip(lo[lo < hi].tolist(), hi[lo < hi].tolist(), strict=True):
                out.update(items[a:b])
        return out

    def retrieve(self, texts: list[np.ndarray]) -> list[dict[int, float]]:
        """For each text (numbers of terms) all items that a passage of it scores at or above the threshold, with their best score (1: the threshold)."""
        none, half = len(self.ids), PASSAGE // 2
        best: list[dict[int, float]] = [{} for _ in texts]
        halves, owner = [], []
        for i, t in enumerate(texts):
            count = max(2, -(-len(t) // half))
            halves.append(np.r_[t, np.full(count * half - len(t), none)].reshape(count, half))
            owner.append(np.full(count, i))
        half_of, of = np.concatenate(halves), np.concatenate(owner)
        first = np.flatnonzero(of[:-1] == of[1:])
        for lo in range(0, len(first), AT_ONCE):
            at = first[lo : lo + AT_ONCE]
            query = np.sort(np.hstack([half_of[at], half_of[at + 1]]), axis=1)
            again = query[:, 1:] == query[:, :-1]
            query[:, 1:][again] = none  # a term counts once
            query = np.ascontiguousarray(query.T)
            may = np.flatnonzero(self.top[query].sum(axis=0) >= 0.999)
            at, query = at[may], query[:, may]
            in_group = self.group_top[query].sum(axis=0) >= 0.999
            for g in np.flatnonzero(in_group.any(axis=0)):
                place, block_top, weight = self.groups[g]
                own = np.flatnonzero(in_group[:, g])
                rows = place[query[:, own]]
                p, b = np.nonzero(block_top[rows].sum(axis=0) >= 0.999)
                scores = weight[rows[:, p], b].sum(axis=0)
                r, c = np.nonzero(scores >= 1)
                found = (of[at[own[p[r]]]], g * GROUP + b[r] * BLOCK + c, scores[r, c])
                for i, n, x in zip(*(y.tolist() for y in found), strict=True):
                    if x > best[i].get(n, 0.0):
                        best[i][n] = x
        return best

    def hits(self, texts: list[list[bytes]], least: float) -> list[list[dict]]:
        """The items that occur in each text, given as words."""
        numbers = [self.numbers(w) for w in texts]
        return [self.verified(w, t, found, least) if found else [] for w, t, found in zip(texts, numbers, self.retrieve(numbers), strict=True)]

    def verified(self, w: list[bytes], t: np.ndarray, found: dict[int, float], least: float) -> list[dict]:
        """Of the items found for a text those whose shingles it has."""
        out: list[dict] = []
        sharing = self.sharing(t)
        if found := {n: x for n, x in found.items() if n in sharing}:
            have = set(shingles(w))
            short = {n: {hash(tuple(w[i : i + n])) for i in range(len(w) - n + 1)} for n in range(1, SHINGLE)}

            def overlap(part: list[bytes]) -> float | None:
                own = shingles(part)
                return sum(s in (have if len(part) >= SHINGLE and len(w) >= SHINGLE else short.get(len(part), ())) for s in own) / len(own) if own else None

            for n, score in sorted(found.items()):
                item, question, answer = self.items[n]
                all_of = overlap(question + answer)
                if all_of is not None and max(all_of, *(overlap(p) for p in specific(question, answer)), 0.0) >= least:
                    out.append({"item_id": item, "score": float(score), "question_overlap": overlap(question), "answer_overlap": overlap(answer), "overlap": all_of})
        return out


def slices_of(items: DataFrame, share: float = SHARE) -> Iterator[list[bytes]]:
    """The index as compressed slices, in parts of HELD bytes at most (or of one slice)."""
    rows = items.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    bytes_ = rows.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    slices = max(1, -(-bytes_ // SLICE))
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)).cast("int"))

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(slice, term, n): in how many items; with the number of items and words under the term b""."""
        for batch in batches:
            n: Counter = Counter()
            for k, text in zip(batch.column(0).to_pylist(), strings(batch.column(1)), strict=True):
                w = words(text)
                if w:
                    n.update((k, t) for t in set(w))
                    n[k, b""] += 1
                    n[k, b" "] += len(w)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in n], pa.int32()), pa.array([t for _, t in n], pa.binary()), pa.array(list(n.values()), pa.int64())], names=["slice", "term", "n"])

    found = store(rows.select("slice", "text").mapInArrow(terms, "slice int, term binary, n long").groupBy("slice", "term").agg(F.sum("n").alias("n")), "terms")
    sums = {r["term"]: r["n"] for r in found.where(F.col("term").isin(b"", b" ")).groupBy("term").agg(F.sum("n").alias("n")).collect()}
    total, mean = sums.get(b"", 0), sums.get(b" ", 0) / max(1, sums.get(b"", 0))
    if not total:
        return
    # A term has one row for each slice at most; it is counted before it meets the slices that use it.
    counted = found.where(~F.col("term").isin(b"", b" ")).groupBy("term").agg(F.sum("n").alias("df"))
    own = found.select("slice", "term").join(counted.hint("merge"), "term")

    def build(part: pd.DataFrame, frequency: pd.DataFrame) -> pd.DataFrame:
        texts = sorted((i, t) for i, t in zip(part["item_id"], part["text"], strict=True) if words(t))
        made = [Index(texts, dict(zip(frequency["term"], frequency["df"], strict=True)), total, mean, share)] if texts else []
        return pd.DataFrame({"slice": part["slice"].iloc[: len(made)], "index": [zlib.compress(pickle.dumps(m, protocol=5), 1) for m in made]})

    built = store(rows.groupBy("slice").cogroup(own.groupBy("slice")).applyInPandas(build, "slice int, index binary"), "index")
    part: list[bytes] = []
    for k in range(slices):
        for r in built.where(F.col("slice") == k).select("index").collect():  # one slice
            if part and sum(map(len, part)) + len(r["index"]) > HELD:
                yield part
                part = []
            part.append(bytes(r["index"]))
    if part:
        yield part


def gathered(column: pa.Array) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Words of the texts of a batch, some texts at a time, with the place of the first."""
    first, held, size = 0, [], 0
    for text in strings(column):
        held.append(words(text or ""))
        size += len(held[-1])
        if size >= GATHERED:
            yield first, held
            first, held, size = first + len(held), [], 0
    if held:
        yield first, held


def with_hits(docs: DataFrame, items: DataFrame, least: float = LEAST, name: str = "hits") -> DataFrame:
    """docs with a column of the items found in each text; it replaces one of that name."""
    docs = docs.drop(name)
    at, schema = docs.columns.index("text"), T.StructType([*docs.schema.fields, T.StructField(name, HITS)])

    def pass_over(rows: DataFrame, held: list[Broadcast]) -> DataFrame:
        """rows with the hits in these slices after those they have."""

        def find(batches: Iterator[pa.RecordBatch], names=schema.names) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_type

            kind, loaded = to_arrow_type(HITS), (None, None)
            for batch in batches:
                got: list[list[dict]] = batch.column(len(names) - 1).to_pylist() if batch.num_columns == len(names) else [[] for _ in range(batch.num_rows)]
                for k, slice_ in enumerate(held):
                    if loaded[0] != k:
                        loaded = (None, None)  # the one before goes first
                        loaded = (k, pickle.loads(zlib.decompress(slice_.value)))
                    for first, texts in gathered(batch.column(at)):
                        for i, found in enumerate(loaded[1].hits(texts, least)):
                            got[first + i] += found
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names) - 1], pa.array(got, kind)], names=names)

        return rows.mapInArrow(find, schema)

    context, out, before = docs.sparkSession.sparkContext, docs, []
    for part in slices_of(items, min(SHARE, least)):
        if before:  # the part before is done with once its hits are written
            out = store(out, "hits")
            for b in before:
                b.destroy()
        before = [context.broadcast(x) for x in part]
        out = pass_over(out, before)
    return out if before else pass_over(docs, [])


def clean(docs: DataFrame, items: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of docs that hold no item; columns as before."""
    return with_hits(docs, items, least, "_items_found").where(F.size("_items_found") == 0).drop("_items_found")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_hits(docs, table(spark, sf_dir, "benchmark")).where(F.size("hits") > 0).select("doc_id", F.inline("hits"))
