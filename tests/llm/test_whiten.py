"""Whitening against whole-matrix numpy, and the refinement of eigenvectors."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaylight.llm import whiten

ROWS = "vec_id long, embedding array<float>, label int"


def plain(rows: list[tuple], k: int) -> dict:
    x = [(i, [int(np.floor(64.0 * float(np.float32(c)))) + 1_000_000 for c in v]) for i, v, _ in rows]
    fit = np.array(sorted({tuple(v) for _, v in x}), dtype=object)
    n, s = len(fit), fit.sum(0)
    v = ((fit * n - s).T.dot(fit * n - s)).astype(np.longdouble) / np.longdouble(n) ** 3
    values, vectors = np.linalg.eigh(v.astype(float))
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    out = {}
    for i, a in x:
        far = np.array(a, dtype=object) * n - s
        out[i] = (n, int((far * far).sum()), (far.astype(float) / n) @ vectors / np.sqrt(values))
    return out, values / float(np.trace(v))


def test_whitening(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(size=(300, 20)) @ rng.normal(size=(20, 20)) * 0.3
    rows = [(i, [float(c) for c in v], None) for i, v in enumerate(a)]
    rows += [(1000 + i, rows[7][1], 1) for i in range(200)]  # a vector that many rows share
    bad = [(1, None, 1), (2, [1.0] * 19 + [None], 1), (3, [float("nan")] * 20, 1), (4, [float("-inf")] + [0.0] * 19, 1), (5, [], 1), (6, [1.0] * 7, 1)]
    df = spark.createDataFrame([*rows, *((10_000 + i, v, x) for i, v, x in bad)], ROWS).withColumn("x", F.lit(1)).withColumn("n", F.lit("n")).repartition(5)
    got = whiten.whiten(df).collect()
    want, share = plain(rows, 16)
    assert len(got) == 16 * len(rows) and {r.vec_id for r in got} == set(want)
    by: dict = {}
    for r in got:
        by.setdefault(r.vec_id, {})[r.component] = r
    sign = np.sign([by[0][c].whitened * want[0][2][c - 1] for c in range(1, 17)])
    for i, parts in by.items():
        n, deviation, w = want[i]
        assert {(r.n, r.deviation) for r in parts.values()} == {(n, deviation)}
        assert np.allclose([parts[c].whitened for c in range(1, 17)], w * sign, atol=1e-9)
        assert np.allclose([parts[c].explained for c in range(1, 17)], share, rtol=1e-9)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-10


def test_odd_tables(spark):
    empty = whiten.whiten(spark.createDataFrame([], ROWS))
    assert empty.count() == 0 and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whiten.whiten(spark.createDataFrame([(1, [1.0, 2.0], 1)] * 3, ROWS)).count() == 0
    flat = spark.createDataFrame([(None, [float(i), 1.0, 2.0 * i], 1) for i in range(4)], ROWS)  # one direction only
    got = flat.transform(whiten.whiten).collect()
    assert [r.component for r in got] == [1] * 4 and abs(got[0].explained - 1) < 1e-9 and got[0].vec_id is None
    with pytest.raises(Exception, match="too large"):
        whiten.whiten(spark.createDataFrame([(1, [1e30], 1), (2, [0.0], 1)], ROWS)).collect()


def test_wide_sums_stay_exact(spark):
    """Entries whose products pass what a double holds; and those that pass what the result's type holds."""
    rows = [(i, [float((i * 37) % 101) * 2.0**15, float(i % 3)], 1) for i in range(40)]
    got = {r.vec_id: r.deviation for r in whiten.whiten(spark.createDataFrame(rows[:8], ROWS)).collect()}
    assert got == {i: v[1] for i, v in plain(rows[:8], 1)[0].items()}
    with pytest.raises(Exception, match="passes 64 bits"):
        whiten.whiten(spark.createDataFrame(rows, ROWS)).collect()


@pytest.mark.parametrize("gaps", [[0.0, 0.0, 0.0], [1e-9, 1e-12, 0.0], [1e-6, 1e-7, 1e-15]])
def test_eigenvectors_of_clusters(gaps):
    """Residual and orthogonality far below what double precision alone gives, float32 start or not."""
    rng = np.random.default_rng(2)
    q = np.linalg.qr(rng.normal(size=(30, 30)))[0].astype(np.longdouble)
    for _ in range(3):  # orthogonal in extended precision
        q = q @ (1.5 * np.eye(30, dtype=np.longdouble) - 0.5 * (q.T @ q))
    values = np.concatenate([np.linspace(5, 3, 24), [1, 1 + gaps[0], 1 + gaps[1], 1 + gaps[2]], [1e-3, 1e-4]]).astype(np.longdouble)
    v = (q * values) @ q.T
    v = (v + v.T) / 2
    found, x = whiten.eigenvectors(v)
    assert np.abs(x.T @ x - np.eye(30)).max() < 1e-17
    assert np.abs(v @ x - x * found).max() < 1e-16
    assert np.abs(found - np.sort(values)[::-1]).max() < 1e-17 * 100
    single = np.linalg.eigh((v / np.trace(v)).astype(np.float32))[1]
    assert np.abs(single.astype(float).T @ single.astype(float) - np.eye(30)).max() > 1e-8  # what it starts from
