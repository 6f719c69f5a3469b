"""Whitening of embeddings: a distributed covariance, eigenvectors refined from float32.

Components c of a vector become whole numbers x = floor(SCALE * c) + SHIFT. The fit list is each
distinct vector once (one shuffle, combined first, so a vector that many rows share is cheap). Its
count, sums and second moments are exact: tasks centre at the rounded mean and multiply blocks so
small that doubles hold every product sum exactly; the whole numbers then meet in sums for each
pair of dimensions, whatever the partitions. The mean's remainder is taken off in extended
precision. Only these dimensions x dimensions numbers reach the driver, never rows.

`eigenvectors` starts from float32 and corrects all vectors at once by the matrix multiplications
of Ogita and Aishima (Iterative refinement for symmetric eigenvalue decomposition, 2018), first in
double, then in extended precision; each round about squares the error. Where eigenvalues lie closer
than a round's own error bound, their vectors are only made orthogonal by it, and the cluster's
small projected matrix, shifted by its mean so that its differences are kept, is solved by itself
and turns them (as in their paper of 2019 on clustered eigenvalues). The sign makes a vector's
largest entry positive.

Defined results: null vectors and those with null, NaN or infinite entries go; so do vectors whose
length is not the commonest (of equal counts the longest), as they lie in another space, and empty
ones; a null vec_id is kept; repeated rows are repeated and count once in the fit; components
without variance (under 1e-12 of all) have no scale and are left out, so an empty table or one
distinct vector gives an empty result; entries whose squares pass what 64 bits hold raise
ArithmeticError. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import store, table

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Rows that a task multiplies at once.
BLOCK = 4096
WHITENED = "vec_id long, component int, n long, deviation long, whitened double"


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, x) of every usable row."""
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    held = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0)).where(F.forall("v", fine))
    commonest = held.groupBy(F.size("v").alias("d")).count().agg(F.max_by("d", F.struct("count", "d"))).first()[0]
    far = F.exists("v", lambda c: F.abs(c) > float(1 << 40))
    x = F.transform("v", lambda c: F.floor(c * SCALE).cast("long") + SHIFT)
    return held.where(F.size("v") == (commonest or 0)).select("vec_id", F.when(far, F.raise_error(F.lit("a vector's entry is too large"))).otherwise(x).alias("x"))


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            yield part, part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)


def _pairs(total: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """A task's sums as rows (i, j, v); one row is one matrix row."""
    if total is not None:
        for i, row in enumerate(total):
            yield pa.record_batch([pa.array(np.full(len(row), i, np.int32)), pa.array(np.arange(len(row), dtype=np.int32)), pa.array(row)], names=["i", "j", "v"])


def _summed(rows: DataFrame, run, kind: str, shape: tuple[int, int]) -> np.ndarray:
    """The sum over all tasks of the matrix that run makes in each; shape bounds what reaches the driver."""
    sums = rows.mapInArrow(run, f"i int, j int, v {kind}").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(shape, object if kind == "long" else float)
    for i, j, v in sums:
        out[i, j] = v
    return out


def moments(fit: DataFrame, d: int) -> tuple[int, list[int], np.ndarray]:
    """The number of vectors, their sums, and the covariance in extended precision."""

    def firsts(batches):
        total = None
        for _, x in _matrices(batches):
            one = np.concatenate([[len(x)], x.sum(0)]).astype(np.int64)
            total = one if total is None else total + one
        yield from _pairs(None if total is None else total[None])

    n, *sums = (int(v) for v in _summed(fit, firsts, "long", (1, d + 1))[0])
    if not n:
        return 0, sums, np.zeros((d, d), np.longdouble)
    centre = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)

    def seconds(batches):
        total = None
        for _, x in _matrices(batches):
            y = x - centre
            most = int(np.abs(y).max(initial=0))
            step = (1 << 53) // max(1, most * most)
            if len(y) * most * most + (0 if total is None else int(np.abs(total).max())) >= 1 << 63:
                raise ArithmeticError("squares of entries pass 64 bits")
            for at in range(0, len(y), step or len(y)):
                z = y[at : at + step].astype(float) if step else y
                one = (z.T @ z).astype(np.int64)  # whole numbers, of doubles only under 2**53, so exact
                total = one if total is None else total + one
        yield from _pairs(total)

    second = _summed(fit, seconds, "long", (d, d))
    rest = np.array([np.longdouble(s - n * int(c)) for s, c in zip(sums, centre, strict=True)]) / np.longdouble(n)
    return n, sums, second.astype(np.longdouble) / np.longdouble(n) - np.outer(rest, rest)


def _clusters(values: np.ndarray, bound: float) -> Iterator[np.ndarray]:
    """Places of eigenvalues, two or more, that follow one another closer than bound."""
    order = np.argsort(values, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(values[order]) > bound) + 1):
        if len(part) > 1:
            yield part


def _round(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, float]:
    """One correction of all vectors, clusters by sub-solves; and its size."""
    one = np.eye(len(a), dtype=a.dtype)
    r, s = one - x.T @ x, x.T @ (a @ x)
    values = np.diag(s) / (1 - np.diag(r))
    bound = 2 * (np.sqrt(((s - np.diag(values)) ** 2).sum()) + np.sqrt((a**2).sum()) * np.sqrt((r**2).sum()))
    gap = values[None, :] - values[:, None]
    near = np.abs(gap) <= bound
    e = np.where(near, r / 2, (s + values[None, :] * r) / np.where(near, 1, gap))
    x = x + x @ e
    for part in _clusters(values, bound):
        y = x[:, part]
        inner = y.T @ (a @ y) - np.mean(values[part]) * (y.T @ y)
        size = np.abs(inner).max()
        if size > 0:
            turn = np.linalg.eigh(((inner + inner.T) / (2 * size)).astype(float))[1].astype(a.dtype)
            turn = turn @ (1.5 * np.eye(len(part), dtype=a.dtype) - turn.T @ turn / 2)  # orthogonal in a's precision
            x[:, part] = y @ turn
    return x, float(np.abs(e).max())


def eigenvectors(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns, in extended precision."""
    whole = np.trace(v)
    if not len(v) or whole <= 0:
        return np.zeros(len(v), v.dtype), np.eye(len(v), dtype=v.dtype)
    a = v / whole
    x = np.linalg.eigh(a.astype(np.float32))[1]
    for kind, rounds in ((np.float64, 12), (np.longdouble, 6)):
        x = x.astype(kind)
        for _ in range(rounds):
            x, change = _round(a.astype(kind), x)
            if change < 8 * np.finfo(kind).eps:
                break
    x = x @ (1.5 * np.eye(len(a), dtype=a.dtype) - x.T @ x / 2)  # near clusters a round leaves a little of each vector in others
    x /= np.sqrt((x * x).sum(0))
    values = np.einsum("ij,ij->j", x, a @ x)
    order = np.argsort(-values, kind="stable")
    x = x[:, order]
    sign = np.sign(x[np.abs(x).argmax(0), np.arange(len(x))])
    return values[order] * whole, x * sign


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each usable row and component."""
    spark = embeddings.sparkSession
    rows = store(whole_vectors(embeddings), "vectors")
    fit = store(rows.select("x").distinct(), "fit")
    d = fit.agg(F.max(F.size("x"))).first()[0] or 0
    n, sums, v = moments(fit, d)
    values, vectors = eigenvectors(v)
    k = int(((values > 1e-12 * np.trace(v)) & (np.arange(d) < components)).sum())
    if not k:
        return spark.createDataFrame([], f"{WHITENED}, explained double, identity_error double")
    centre = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    off = np.array([s - n * int(c) for s, c in zip(sums, centre, strict=True)], np.int64)  # at most n / 2
    scaled = (vectors[:, :k] / np.sqrt(values[:k])).astype(float)
    at_mean = (off.astype(np.longdouble) / n @ (vectors[:, :k] / np.sqrt(values[:k]))).astype(float)

    def whitened(x: np.ndarray) -> np.ndarray:
        return (x - centre).astype(float) @ scaled - at_mean

    def checked(batches):
        total = None
        for _, x in _matrices(batches):
            w = np.concatenate([whitened(x), np.ones((len(x), 1))], axis=1)
            one = w.T @ w
            total = one if total is None else total + one
        yield from _pairs(total)

    sums2 = _summed(fit, checked, "double", (k + 1, k + 1)) / n
    error = float(np.abs(sums2[:k, :k] - np.outer(sums2[k, :k], sums2[k, :k]) - np.eye(k)).max())
    share = [float(x) for x in values[:k] / np.trace(v)]

    def final(batches):
        for part, x in _matrices(batches):
            y = x - centre
            most = n * (int(np.abs(y).max(initial=0)) + 1)
            wide = d * most * most >= 1 << 63
            far = n * y.astype(object) - off.astype(object) if wide else n * y - off
            deviation = (far * far).sum(1)
            if wide and len(x) and max(deviation) >= 1 << 63:
                raise ArithmeticError("a deviation passes 64 bits")
            m = len(x)
            yield pa.record_batch(
                [
                    pa.array(np.repeat(np.arange(m), k)).cast(pa.int64()) if m == 0 else part.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n, np.int64)),
                    pa.array(np.repeat(deviation.astype(np.int64), k)),
                    pa.array(whitened(x).reshape(-1)),
                ],
                names=[c.split()[0] for c in WHITENED.split(", ")],
            )

    return rows.mapInArrow(final, WHITENED).select("*", F.element_at(F.array(*map(F.lit, share)), F.col("component")).alias("explained"), F.lit(error).alias("identity_error"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
