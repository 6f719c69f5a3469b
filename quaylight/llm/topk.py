"""Exact top-k inner products by term-at-a-time accumulation.

Rows are quantised to integer terms (dimension, weight). Query rows are dealt by hash into slabs of
at most about SLAB bytes; a slab is collected and broadcast (the bound of what any task or the
driver holds of the queries), and the candidate rows, which never follow the queries through a
shuffle, are scored where they are. A task takes rows batch by batch: they are inverted into one
postings list per dimension, and for each dimension the queries that use it scatter their weighted
postings into a dense (queries x rows) score array of CELLS cells. A partition selection gives a
query's k-th score; what reaches it is merged with the query's best so far, ties to smaller ids. Only
the k best of each query leave a task, and a window over them merges the tasks.

The work is queries x rows, as the task says; nothing is sampled. Rows are dealt anew, once, only
where a task would have more than WORK multiplications. Several slabs are scored one after another,
each result written to the shared folder.

Scores are whole numbers of 64 bits. A narrower type serves where the terms' bound allows; where the
bound passes 2**62, Python's integers do, and a best score that has no 64-bit value raises an error,
as does a component of 2**54 or more.

Defined results: vectors that are null or hold a null or non-finite component take no part,
neither as query nor as candidate, nor do rows without an id; shorter vectors count as padded with
zeros; rows that share the query's id are not its candidates; equal query rows count once, unlike
ones under one id are ranked together, and repeated candidate rows count each; ties go to the
smaller vec_id; an empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import store, table

SLAB, CELLS, WORK, LARGEST = 32 << 20, 1 << 17, 2e11, 2.0**62


def quantised(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and terms: floor(256 * x) of each component x as double."""
    x = F.col(vector)
    whole = F.when(x.isNotNull(), F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    scaled = lambda v: v.cast("double") * 256
    term = lambda v: F.when(F.abs(scaled(v)) < LARGEST, F.floor(scaled(v))).otherwise(F.raise_error(F.lit("a component of 2**54 or more has no exact score")).cast("long"))
    return df.where(whole & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(x, term).alias("terms"))


def matrix(terms: pa.Array, width: int | None = None) -> np.ndarray:
    """Lists as rows, padded with zeros or cut to `width`."""
    size = np.diff(terms.offsets.to_numpy())
    width = int(size.max(initial=0)) if width is None else width
    row = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    out = np.zeros((len(size), width), dtype=np.int64)
    use = at < width
    out[row[use], at[use]] = terms.flatten().to_numpy()[use]
    return out


def kind_of(asked: np.ndarray, weights: np.ndarray) -> type:
    """The narrowest type that holds every score of these rows."""
    bound = np.abs(asked).max(axis=0, initial=0).astype(float) @ np.abs(weights).max(axis=0, initial=0).astype(float)
    return np.int32 if bound < 2**30 else np.int64 if bound < LARGEST else object


class Best:
    """The best k of each query so far."""

    def __init__(self, ids: np.ndarray, asked: np.ndarray, k: int) -> None:
        self.ids, self.asked, self.k = ids, asked, k
        self.row, self.score = np.zeros((len(ids), k), np.int64), np.zeros((len(ids), k), object if len(asked) and np.abs(asked).max(initial=0) >= 2**31 else np.int64)
        self.have = np.zeros(len(ids), np.int64)

    def add(self, ids: np.ndarray, weights: np.ndarray) -> None:
        kind = kind_of(self.asked, weights)
        if kind is object:
            self.score = self.score.astype(object)
        least = -(1 << 200) if kind is object else np.iinfo(kind).min
        weights, width = weights.astype(kind), self.asked.shape[1]
        postings = [(at, np.ascontiguousarray(weights[at, t])) for t in range(width) for at in [np.flatnonzero(weights[:, t])]]
        order = np.argsort(ids, kind="stable")
        step = max(1, CELLS // max(1, len(ids)))
        for lo in range(0, len(self.ids), step):
            part = self.asked[lo : lo + step].astype(kind)
            scores, room = np.zeros((len(part), len(ids)), dtype=kind), np.zeros((len(part), len(ids)), dtype=kind)
            for t, (at, w) in enumerate(postings):
                use = np.flatnonzero(part[:, t])
                if len(use) == len(part) and len(at) == len(ids):
                    scores += np.multiply.outer(part[:, t], w, out=room)
                elif len(use) and len(at):
                    scores[np.ix_(use, at)] += np.multiply.outer(part[use, t], w)
            own = np.searchsorted(ids[order], self.ids[lo : lo + step], "left"), np.searchsorted(ids[order], self.ids[lo : lo + step], "right")
            for q in np.flatnonzero(own[1] > own[0]).tolist():
                scores[q, order[own[0][q] : own[1][q]]] = least
            self.merge(lo, scores, ids, least)

    def merge(self, lo: int, scores: np.ndarray, ids: np.ndarray, least: int) -> None:
        m, n = scores.shape
        have = self.have[lo : lo + m]
        floor = np.full(m, least, dtype=scores.dtype)
        full = have == self.k
        if full.any():
            last = self.score[lo : lo + m][full, -1]
            if scores.dtype != object:  # the k-th of earlier batches may be outside this batch's type
                info = np.iinfo(scores.dtype)
                last = np.clip(last.astype(np.int64) if last.dtype != object else np.array([min(max(x, info.min), info.max) for x in last], np.int64), info.min, info.max)
            floor[full] = last
        if n > self.k and not full.all():
            some = np.flatnonzero(~full)
            floor[some] = np.partition(scores[some], n - self.k, axis=1)[:, n - self.k]
        q, r = np.nonzero((scores >= floor[:, None]) & (scores > least))
        if not len(q):
            return
        touched = np.unique(q)
        old = np.repeat(touched, have[touched])
        at = np.concatenate([np.arange(h) for h in have[touched]]) if len(old) else np.zeros(0, np.int64)
        qs = np.r_[q, old]
        kept = self.score[lo + old, at]
        ss = np.concatenate([scores[q, r].astype(self.score.dtype), kept])
        rs = np.r_[ids[r], self.row[lo + old, at]]
        order = np.lexsort((rs, -ss, qs)) if ss.dtype != object else np.array(sorted(range(len(qs)), key=lambda i: (qs[i], -ss[i], rs[i])))
        qs, ss, rs = qs[order], ss[order], rs[order]
        first = np.searchsorted(qs, touched)
        place = np.arange(len(qs)) - np.repeat(first, np.diff(np.r_[first, len(qs)]))
        keep = place < self.k
        self.row[lo + qs[keep], place[keep]] = rs[keep]
        self.score[lo + qs[keep], place[keep]] = ss[keep]
        self.have[lo + touched] = np.minimum(self.k, np.diff(np.r_[first, len(qs)]))

    def rows(self) -> Iterator[pa.RecordBatch]:
        use = np.arange(self.k)[None, :] < self.have[:, None]
        if self.score.dtype == object and any(abs(x) >= 2**63 for x in self.score[use]):
            raise OverflowError("a score passes 64 bits")
        made = pa.RecordBatch.from_arrays([pa.array(np.repeat(self.ids, self.have)), pa.array(self.row[use]), pa.array(self.score[use].astype(np.int64))], names=["query_id", "vec_id", "score"])
        for at in range(0, made.num_rows, 50_000):
            yield made.slice(at, 50_000)


def slab_bytes(queries: DataFrame) -> int:
    """What the distinct queries take as arrays of 64-bit terms."""
    return int(queries.agg(F.sum(8 * F.size("terms").cast("long") + 16).alias("b")).first()["b"] or 0)


def search(queries: DataFrame, rows: DataFrame, k: int = 5, slab: int = SLAB) -> DataFrame:
    """The k best rows of each query: query_id, rank, vec_id, score. Both inputs as quantised() gives them."""
    queries = queries.distinct()
    slabs = max(1, -(-slab_bytes(queries) // slab))
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("terms")).alias("w")).first()
    spark, best = rows.sparkSession, None
    for part in range(slabs):
        asked = queries.where(F.pmod(F.xxhash64("vec_id", F.lit(slabs)), F.lit(slabs)) == part).orderBy("vec_id").toArrow().combine_chunks()  # SLAB bytes, about
        terms = asked.column("terms").combine_chunks()
        ids = asked.column("vec_id").to_numpy()
        held = spark.sparkContext.broadcast((ids, matrix(terms) if len(ids) else np.zeros((0, 0), np.int64)))

        def each(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            ids, asked = held.value
            found = Best(ids, asked, k)
            for batch in batches:
                if batch.num_rows and len(ids):
                    found.add(batch.column(0).to_numpy(), matrix(batch.column(1), asked.shape[1]))
            yield from found.rows()

        tasks = int(-(-(size["n"] * len(ids) * (size["w"] or 1)) // WORK))
        dealt = rows.repartition(tasks, F.xxhash64("vec_id", "terms")) if tasks > 2 * spark.sparkContext.defaultParallelism else rows
        got = dealt.mapInArrow(each, "query_id long, vec_id long, score long")
        if slabs > 1:
            got = store(got, "slab")
            held.unpersist()
        best = got if best is None else best.unionByName(got)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantised(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return search(rows.where(F.col("vec_id") % 50 == 0), rows, 5)


OP10_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as t from embeddings
  where embedding is not null and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (
  select q.vec_id as query_id, r.vec_id, list_dot_product(q.t, r.t)::bigint as score
  from v q join v r on q.vec_id <> r.vec_id where q.vec_id % 50 = 0),
k as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from k where rank <= 5
"""
