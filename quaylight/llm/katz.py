"""Language-model scoring: a Katz backoff model with Good-Turing discounts.

P(w | h) = d(c) * c(h, w) / c(h) for pairs seen in training, alpha(h) * P(w) otherwise, with
P(w) = (c(w) + 1) / (N + V + 1), which leaves one share for all unknown words. d(c) are Katz's
discounts for c <= 5 from the counts of counts. alpha(h) makes each context sum to one exactly:
(1 - sum of discounted probabilities) / (1 - sum of P(w) over the words seen after h). A context
without discounted mass has its count raised by one; an unseen context backs off with weight 1.

A row for each token would be several times the text. So texts are read in blocks, and blocks ask
shards: the block sends its distinct words (or pairs), each with its own training count, to the
shard of its hash; the shard adds the counts of all blocks and answers each block in the order it
asked. Two such rounds, words then pairs, and no others:
  1. encode: a block's tokens become ranks of its words; words are sent.
  2. word tables: the shard's totals, dense ids, c(w); N and V from all shards.
  3. pair requests: ids of distinct pairs with counts and c(w), dealt by context. Contexts with
     more than 1/HEAVY of all tokens are spread over SPREAD shards by the second word.
  4. pair tables: totals c(h, w), and for each context the counts of counts and the sum of
     c(w) + 1 over its words; the global counts of counts.
  5. score: blocks add up their tokens' logarithms, recursively from pair to word.
The word and pair tables are written to the shared folder, dealt by shard. Arrays travel as
compressed byte planes. A task holds one block (BLOCK bytes of text) or one shard at a time; the
number of shards follows spark.sql.shuffle.partitions.

The order of the model is two: for three the distinct word triples alone come near the text's size.

Tokens: A-Z lower-cased; runs of anything but space and \\t\\n\\v\\f\\r; then one end token for each
text. Words meet by 64-bit hashes.

Defined results: null and empty texts are one end token; rows with a null doc_id are scored but
not trained on; without training rows N is 0 and every token has P = 1 / (N + V + 1); repeated rows
count twice and are scored twice; an empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, mix, partitions_for, store, strings, table

BLOCK, DISCOUNTED, HEAVY, SPREAD, FOLDS = 6 << 20, 5, 4000, 16, 7
WORDS, TOKENS, IDS, WORD_TOTALS, PAIRS, COUNTS, PAIR_TOTALS = range(7)
ROW = "block long, shard int, kind int, data binary"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of integers as compressed byte planes."""
    press, out = zstandard.ZstdCompressor(level=3), []
    for a in arrays:
        a = np.ascontiguousarray(a)
        planes = a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T if len(a) else np.zeros((1, 0), np.uint8)
        out.append((a.dtype.str, len(a), press.compress(np.ascontiguousarray(planes).tobytes())))
    return pickle.dumps(out, protocol=5)


def unpacked(data: bytes) -> list[np.ndarray]:
    press, out = zstandard.ZstdDecompressor(), []
    for kind, n, body in pickle.loads(data):
        kind = np.dtype(kind)
        flat = np.frombuffer(press.decompress(body, max_output_size=max(1, n * kind.itemsize)), dtype=np.uint8)
        out.append(np.ascontiguousarray(flat.reshape(kind.itemsize, n).T).view(kind).ravel() if n else np.zeros(0, kind))
    return out


def rows(made: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], k) for i, k in enumerate(kinds)], names=["block", "shard", "kind", "data"])


def grouped(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[tuple[int, list[tuple]]]:
    """Rows of each key; batches are sorted by it."""
    now, held = None, []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in range(3)), batch.column(3), strict=True):
            if held and row[key] != now:
                yield now, held
                held = []
            now = row[key]
            held.append((*row[:3], row[3].as_py()))
    if held:
        yield now, held


def by(df: DataFrame, key: str, parts: int) -> DataFrame:
    return df.repartition(parts, key).sortWithinPartitions(key, "kind", "block", "shard")


def encode(docs: DataFrame, shards: int) -> DataFrame:
    """TOKENS rows (a block's texts as ranks) and WORDS rows (its distinct words, for each shard)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, part = 0, TaskContext.get().partitionId()

        def fresh() -> tuple:
            known: dict[bytes, int] = defaultdict()
            known.default_factory = known.__len__
            return known, [], []

        def block() -> Iterator[pa.RecordBatch]:
            size = np.array([len(t) for t in texts], dtype=np.int64)
            flat = np.concatenate(texts)
            held = np.array([k[1] for k in keys], dtype=np.uint8)
            trained = np.repeat(np.array([k[2] for k in keys], dtype=bool), size)
            n = np.bincount(flat, minlength=len(known))
            order = np.argsort(-n, kind="stable")
            rank = np.empty(len(order), dtype=np.int32)
            rank[order] = np.arange(len(order), dtype=np.int32)
            words = list(known)
            hashes = np.fromiter((xxhash.xxh64_intdigest(words[i]) for i in order), dtype=np.uint64, count=len(order))
            count = np.bincount(flat[trained], minlength=len(known))[order]
            shard = (mix(hashes) % np.uint64(shards)).astype(np.int32)
            doc = np.array([k[0] or 0 for k in keys], dtype=np.int64)
            null = np.array([k[0] is None for k in keys], dtype=np.uint8)
            name = (part << 20) | number
            yield rows([(name, -1, TOKENS, packed(rank[flat], size, doc, null, held, np.array([k[2] for k in keys], np.uint8), shard))])
            at = np.argsort(shard, kind="stable")
            cut = np.searchsorted(shard[at], np.arange(shards + 1))
            made = [(name, s, WORDS, packed(hashes[at[a:b]], count[at[a:b]])) for s, a, b in zip(range(shards), cut[:-1], cut[1:], strict=True) if b > a]
            for lo in range(0, len(made), 64):
                yield rows(made[lo : lo + 64])

        known, texts, keys, size = *fresh(), 0
        for batch in batches:
            for doc, held, trained, text in zip(*(batch.column(c).to_pylist() for c in range(3)), strings(batch.column(3)), strict=True):
                words = (text or "").encode("utf-8", "surrogatepass").lower()
                size += len(words) + 16
                words = words.split()
                words.append(b"")  # the end; no word is empty
                texts.append(np.fromiter(map(known.__getitem__, words), dtype=np.int32, count=len(words)))
                keys.append((doc, held, trained))
                if size >= BLOCK:
                    yield from block()
                    number += 1
                    known, texts, keys, size = *fresh(), 0
        if texts:
            yield from block()

    mod = fold("doc_id", FOLDS)
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(mod == 2, F.lit(False)).alias("held"), F.coalesce(mod != 2, F.lit(False)).alias("trained"), "text")
    return given.mapInArrow(each, ROW)


def word_tables(encoded: DataFrame, shards: int, parts: int) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, asked in grouped(batches, 1):
            sent = [unpacked(a[3]) for a in asked]
            words, at = np.unique(np.concatenate([s[0] for s in sent]), return_inverse=True)
            total = np.bincount(at, weights=np.concatenate([s[1] for s in sent])).astype(np.int64)
            ids = np.empty(len(words), dtype=np.int64)
            ids[np.argsort(-total, kind="stable")] = np.arange(len(words)) * shards + shard
            lo = 0
            for (block, *_), s in zip(asked, sent, strict=True):
                own = at[lo : lo + len(s[0])]
                lo += len(own)
                yield rows([(block, shard, IDS, packed(ids[own], total[own]))])
            yield rows([(-1, shard, WORD_TOTALS, packed(np.array([total.sum(), (total > 0).sum()])))])

    return by(encoded.where(F.col("kind") == WORDS), "shard", parts).mapInArrow(each, ROW)


class Block:
    """A block's texts with the ids and counts of its words, and its distinct pairs in a fixed order."""

    def __init__(self, given: list[tuple], n: int, shards: int) -> None:
        tokens, self.size, self.doc, self.null, self.held, trained, shard = unpacked(next(g[3] for g in given if g[2] == TOKENS))
        self.tokens = tokens.astype(np.int64)
        words = len(shard)
        ids, self.count = np.zeros(words, np.int64), np.zeros(words, np.int64)
        where = np.argsort(shard, kind="stable")
        cut = np.searchsorted(shard[where], np.arange(shards + 1))
        for g in given:
            if g[2] == IDS:
                own = where[cut[g[1]] : cut[g[1] + 1]]
                ids[own], self.count[own] = unpacked(g[3])
        first = np.cumsum(self.size) - self.size
        before = np.r_[0, self.tokens[:-1] + 1]
        before[first] = 0  # rank + 1 of the word before; 0 at a start
        pair, self.pair_of = np.unique(before * words + self.tokens, return_inverse=True)
        self.pair_n = np.bincount(self.pair_of, weights=np.repeat(trained, self.size)).astype(np.int64)
        self.context, self.word = pair // words, pair % words
        self.context_id = np.r_[-1, ids]  # of rank + 1
        weight = np.r_[n, self.count]
        heavy = weight * HEAVY > n
        h, w = self.context_id[self.context], ids[self.word]
        sub = np.where(heavy[self.context], w % SPREAD, 0)
        to = self.shard_of(h, sub, shards)
        order = np.lexsort((w, h, to))
        self.order, self.to, self.h, self.w = order, to[order], h[order], w[order]
        used = np.unique(self.context)
        wide = used[heavy[used]]
        self.every = [(int(self.shard_of(self.context_id[c : c + 1], np.array([k]), shards)[0]), int(self.context_id[c])) for c in wide for k in range(SPREAD)]

    @staticmethod
    def shard_of(h: np.ndarray, sub: np.ndarray, shards: int) -> np.ndarray:
        return (mix((h + 2).astype(np.uint64) * np.uint64(SPREAD) + sub.astype(np.uint64)) % np.uint64(shards)).astype(np.int64)

    def asked(self, shards: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, slice]]:
        """For each shard: contexts, how many pairs each has here, and the pairs' place in the order."""
        cut = np.searchsorted(self.to, np.arange(shards + 1))
        extra = defaultdict(set)
        for s, h in self.every:
            extra[s].add(h)
        for s in range(shards):
            part = slice(cut[s], cut[s + 1])
            h, k = np.unique(self.h[part], return_counts=True)
            more = np.array(sorted(extra[s] - set(h[np.isin(h, list(extra[s]))].tolist())), dtype=np.int64) if s in extra else np.zeros(0, np.int64)
            if len(h) + len(more):
                yield s, np.r_[h, more], np.r_[k, np.zeros(len(more), np.int64)], part


def pair_requests(encoded: DataFrame, words: DataFrame, n: int, shards: int, parts: int) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, given in grouped(batches, 0):
            b = Block(given, n, shards)
            count, seen = b.pair_n[b.order], b.count[b.word[b.order]]
            for s, h, k, part in b.asked(shards):
                yield rows([(name, s, PAIRS, packed(h, k, b.w[part], count[part], seen[part]))])

    given = encoded.where(F.col("kind") == TOKENS).unionByName(words.where(F.col("kind") == IDS))
    return by(given, "block", parts).mapInArrow(each, ROW)


def pair_tables(requests: DataFrame, parts: int) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, asked in grouped(batches, 1):
            sent = [unpacked(a[3]) for a in asked]
            h = np.concatenate([np.repeat(s[0], s[1]) for s in sent])
            w, n, seen = (np.concatenate([s[c] for s in sent]) for c in (2, 3, 4))
            order = np.lexsort((w, h))
            new = np.r_[True, (h[order][1:] != h[order][:-1]) | (w[order][1:] != w[order][:-1])] if len(h) else np.zeros(0, bool)
            group = np.empty(len(h), dtype=np.int64)
            group[order] = np.cumsum(new) - 1
            total = np.bincount(group, weights=n).astype(np.int64) if len(h) else np.zeros(0, np.int64)
            one = order[new]  # a row of each pair, in the order of groups
            contexts, of = np.unique(h[one], return_inverse=True)
            add = lambda x: np.bincount(of, weights=x, minlength=len(contexts)).astype(np.int64)  # noqa: B023, E731
            facts = np.stack([*(add(total == r) for r in range(1, DISCOUNTED + 1)), add(np.where(total > DISCOUNTED, total, 0)), add(np.where(total > 0, seen[one] + 1, 0))]) if len(contexts) else np.zeros((DISCOUNTED + 2, 0), np.int64)
            lo = 0
            for (block, *_), s in zip(asked, sent, strict=True):
                own = total[group[lo : lo + len(s[2])]]
                lo += len(own)
                at = np.minimum(np.searchsorted(contexts, s[0]), max(0, len(contexts) - 1))
                known = contexts[at] == s[0] if len(contexts) else np.zeros(len(s[0]), bool)
                yield rows([(block, shard, COUNTS, packed(own, *(np.where(known, f[at], 0) if len(contexts) else np.zeros(len(s[0]), np.int64) for f in facts)))])
            yield rows([(-1, shard, PAIR_TOTALS, packed(np.bincount(np.minimum(total, DISCOUNTED + 2), minlength=DISCOUNTED + 3)[: DISCOUNTED + 2]))])

    return by(requests, "shard", parts).mapInArrow(each, ROW)


def discounts(of: np.ndarray) -> np.ndarray:
    """Katz's d(0..DISCOUNTED) from counts of counts of[0..DISCOUNTED + 1]; 1 where they give nothing between 0 and 1."""
    d = np.ones(DISCOUNTED + 1)
    if of[1] > 0:
        tail = (DISCOUNTED + 1) * of[DISCOUNTED + 1] / of[1]
        for r in range(1, DISCOUNTED + 1):
            if of[r] > 0 and tail < 1:
                x = ((r + 1) * of[r + 1] / (r * of[r]) - tail) / (1 - tail)
                d[r] = x if 0 < x < 1 else 1
    return d


def scores(encoded: DataFrame, words: DataFrame, pairs: DataFrame, n: int, v: int, d: np.ndarray, shards: int, parts: int) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, given in grouped(batches, 0):
            b = Block(given, n, shards)
            answers = {g[1]: unpacked(g[3]) for g in given if g[2] == COUNTS}
            total = np.zeros(len(b.word), dtype=np.int64)
            at, facts = [], []
            for s, h, _, part in b.asked(shards):
                own, *rest = answers[s]
                total[b.order[part]] = own
                at.append(h)
                facts.append(np.stack(rest))
            contexts, of = np.unique(np.concatenate(at), return_inverse=True)
            facts = np.stack([np.bincount(of, weights=f) for f in np.concatenate(facts, axis=1)])
            whole = n + v + 1

            def level(order: int) -> np.ndarray:
                """log10 of the probability of each distinct pair's word, at a level of the model."""
                if order == 1:
                    return np.log10((b.count[b.word] + 1) / whole)
                r = np.arange(1, DISCOUNTED + 1)
                count = (r[:, None] * facts[:DISCOUNTED]).sum(axis=0) + facts[DISCOUNTED]
                kept = ((d[1:] * r)[:, None] * facts[:DISCOUNTED]).sum(axis=0) + facts[DISCOUNTED]
                flat = (count > 0) & (kept >= count * (1 - 1e-12))
                below = np.where(flat, count + 1, count)
                alpha = np.where(count > 0, (1 - kept / np.maximum(below, 1)) / (1 - facts[DISCOUNTED + 1] / whole), 1.0)
                h = np.searchsorted(contexts, b.context_id[b.context])
                seen = total > 0
                upper = np.log10(np.where(seen, d[np.minimum(np.where(total > DISCOUNTED, 0, total), DISCOUNTED)] * total, 1)) - np.log10(np.maximum(below[h], 1))
                return np.where(seen, upper, np.log10(alpha[h]) + level(order - 1))

            doc = np.repeat(np.arange(len(b.size)), b.size)
            add = lambda x: np.bincount(doc, weights=x, minlength=len(b.size))  # noqa: B023, E731
            base = add(np.log10((b.count[b.tokens] + 1) / whole))
            made = [
                pa.array(b.doc, mask=b.null.astype(bool)),
                pa.array(b.held.astype(bool)),
                pa.array(b.size),
                pa.array(add(b.count[b.tokens] > 0).astype(np.int64)),
                pa.array(np.full(len(b.size), n)),
                pa.array(base),
                pa.array(add(level(2)[b.pair_of])),
            ]
            yield pa.RecordBatch.from_arrays(made, names=[x.split()[0] for x in SCORED.split(", ")])

    given = encoded.where(F.col("kind") == TOKENS).unionByName(words.where(F.col("kind") == IDS)).unionByName(pairs.where(F.col("kind") == COUNTS))
    return by(given, "block", parts).mapInArrow(each, SCORED)


def totals(df: DataFrame, kind: int, size: int) -> np.ndarray:
    found = df.where(F.col("kind") == kind).select("data").collect()  # a few numbers for each shard
    return np.sum([unpacked(r["data"])[0] for r in found], axis=0).astype(np.int64) if found else np.zeros(size, np.int64)


def katz(docs: DataFrame) -> DataFrame:
    parts = partitions_for(docs.sparkSession)
    shards = parts * 2
    encoded = store(encode(docs, shards), "tokens")
    words = store(word_tables(encoded, shards, parts), "words")
    n, v = (int(x) for x in totals(words, WORD_TOTALS, 2))
    pairs = store(pair_tables(pair_requests(encoded, words, n, shards, parts), parts), "pairs")
    return scores(encoded, words, pairs, n, v, discounts(totals(pairs, PAIR_TOTALS, DISCOUNTED + 2)), shards, parts)


def op5_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz(table(spark, sf_dir, "documents").select("doc_id", "text"))
