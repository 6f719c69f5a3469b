"""History as model input, neighbours, staged checkpoints."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaylight.operators import features as fe
from quaylight.operators import history as hi
from quaylight.operators import models as mo

FRAMES = "id string, step int, a double, b double"


def test_history_equals_a_plain_version(spark):
    rng = random.Random(1)
    rows = [(str(i), t, rng.choice([None, 0.0, 1.0, rng.random()]), float(t * i)) for i in range(40) for t in range(4) if rng.random() < 0.7]
    rows += [("z", 9, 1.0, 1.0), ("late", 0, 1.0, 2.0)]  # a step beyond the last; a key that the last frame lacks
    got = {r.id: r.asDict() for r in hi.history(spark.createDataFrame(rows, FRAMES).repartition(3), ["a", "b"], 4).collect()}
    by: dict = {}
    for i, t, a, b in rows:
        by.setdefault(i, {})[t] = {"a": a or 0.0, "b": b}
    assert set(got) == {i for i, seen in by.items() if 3 in seen}
    for i, row in got.items():
        seen = {t: v for t, v in by[i].items() if t < 4}
        for c in ("a", "b"):
            assert [row[f"{c}_lag{k}"] for k in range(4)] == [seen.get(3 - k, {}).get(c, 0.0) for k in range(4)]
            slope = np.polyfit(sorted(seen), [seen[t][c] for t in sorted(seen)], 1)[0] if len(seen) > 1 else 0.0
            assert math.isclose(row[f"{c}_trend"], slope, abs_tol=1e-9)
        assert [row[f"present_lag{k}"] for k in (1, 2, 3)] == [float(3 - k in seen) for k in (1, 2, 3)]
    assert hi.history(spark.createDataFrame([], FRAMES), ["a"], 3).count() == 0


def test_without_time_only_the_last_frame_counts(spark):
    rows = spark.createDataFrame([("x", t, float(t), 1.0) for t in range(3)] + [("y", 2, 5.0, 2.0)], FRAMES)
    whole = hi.history(rows, ["a", "b"], 3)
    want = hi.history(fe.last_frame_only(rows), ["a", "b"], 3)
    assert sorted(map(tuple, fe.ablate(whole, "no_temporal").select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    news = hi.history(rows.withColumnRenamed("a", "news_value").withColumnRenamed("b", "ais_value"), ["news_value", "ais_value"], 3)
    gone = fe.ablate(news, "no_news").where("id = 'x'").first()
    assert gone.news_value_lag0 == gone.news_value_lag2 == gone.news_value_trend == 0 and gone.ais_value_lag1 == 1


def test_examples_and_neighbours(spark):
    nodes = spark.createDataFrame([(s, i, float(s[-1]) + i) for s in ("s1", "s2", "s3") for i in range(3)], "snapshot_id string, id int, v double")
    examples = spark.createDataFrame([("e1", ["s1", "s2"]), ("e2", ["s2", "s3"])], "example_id string, frames array<string>")
    by = ("example_id", "id")
    rows = hi.history(hi.example_frames(examples, nodes, ["v"]), ["v"], 2, by)
    edges = spark.createDataFrame([("e1", 0, 1), ("e1", 2, 1), ("e2", 1, 0)], "example_id string, src int, dst int")
    got = {(r.example_id, r.id): (r.v_lag0, r.v_lag1, r.mean_v_lag1) for r in hi.with_neighbours(rows, edges, ["v_lag1"], by).collect()}
    assert got == {("e1", 0): (2, 1, 0), ("e1", 1): (3, 2, 2), ("e1", 2): (4, 3, 0), ("e2", 0): (3, 2, 3), ("e2", 1): (4, 3, 0), ("e2", 2): (5, 4, 0)}


@pytest.fixture(scope="module")
def learnt(spark):
    rng = random.Random(8)
    rows = []
    for i in range(600):
        x, noise = rng.random(), rng.random()
        rows.append((["train", "train", "validation", "test"][i % 4], int(x + 0.6 * (rng.random() - 0.5) > 0.5), x, noise))
    return spark.createDataFrame(rows, "split string, y int, news_value double, ais_value double").cache()


def test_validation_picks_the_checkpoint(spark, learnt):
    train, validation = learnt.where("split = 'train'"), learnt.where("split = 'validation'")
    used = ["news_value", "ais_value"]
    for architecture in ("trees", "logistic"):
        model, step, scores = hi.fit_checkpoint(train, validation, used, architecture, 7, 8)
        assert step == min(scores, key=lambda s: (s[1], s[0]))[0] and 1 <= step <= 8
        p = hi.predictions(model, validation)
        assert math.isclose(p.agg(F.avg(F.pow(F.col("p") - F.col("y"), 2))).first()[0], dict(scores)[step], rel_tol=1e-12)
        again = hi.fit_checkpoint(train, validation, used, architecture, 7, 8)
        assert again[1:] == (step, scores)
    whole = hi.classifier("trees", used, 7, 8).fit(train)
    last = hi.tree_stages(whole, validation).select(F.element_at("stages", -1).alias("s"), "y", *used)
    assert max(abs(r.s - r.p) for r in hi.predictions(whole, last).collect()) < 1e-12


def test_the_test_split_never_selects(spark, learnt):
    other = learnt.withColumn("y", F.when(F.col("split") == "test", 1 - F.col("y")).otherwise(F.col("y")))
    runs = [mo.fit_and_select(d, ["news_value", "ais_value"], ("trees",), ablations=("full",), rounds=5)[0].where("split <> 'test'").orderBy("split").collect() for d in (learnt, other)]
    assert runs[0] == runs[1] and len(runs[0]) == 2


def test_staged_brier_of_nothing(spark):
    assert hi.staged_brier(spark.createDataFrame([], "y int, stages array<double>")).count() == 0


def test_metrics_do_not_score_again(spark, learnt):
    """m7: each run's predictions are written once, and all metrics read them."""
    runs, _ = mo.fit_and_select(learnt, ["news_value", "ais_value"], ("logistic",), ablations=("full", "no_news"), rounds=2)
    assert runs.count() == 6 and runs.inputFiles() and all("/scored-" in f for f in runs.inputFiles())
    assert "UDF" not in runs._jdf.queryExecution().toString()
