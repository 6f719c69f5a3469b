"""Forms that hold for large groups: boxes of any size, rankings and quantiles by ranges, paging by key, the node limit."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaylight.operators import metrics as me
from quaylight.operators import ranks
from quaylight.operators import relational as re_
from quaylight.operators import sensors as se
from quaylight.operators import serving as sv
from quaylight.sources.files import wkb_point


def test_boxes_of_any_size(spark):
    """Metres to the whole globe, points, edges of cells, upside down and over the antimeridian; a box never has over four cells."""
    rng = random.Random(2)
    boxes = [(0, -180.0, -90.0, 180.0, 90.0), (1, 0.0, 0.0, 45.0, 45.0), (2, 11.25, 22.5, 11.25, 22.5), (3, 170.0, 0.0, -170.0, 10.0), (4, 0.0, 10.0, 5.0, 5.0)]
    for i in range(5, 120):
        w, s, size = rng.uniform(-180, 179), rng.uniform(-90, 89), 10 ** rng.uniform(-5, 2)
        boxes.append((i, w, s, min(180.0, w + size), min(90.0, s + size * rng.random())))
    points = [(11.25, 22.5), (45.0, 45.0), (0.0, 0.0), (-180.0, -90.0), (180.0, 90.0)] + [(rng.uniform(-180, 180), rng.uniform(-90, 90)) for _ in range(300)]
    points += [(b[1], b[2]) for b in boxes] + [(b[3], b[4]) for b in boxes]
    there = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(points)], "p long, lon double, lat double")
    frames = spark.createDataFrame(boxes, "box_id long, west double, south double, east double, north double")
    got = sorted((r.p, r.box_id) for r in re_.in_boxes(there, frames).select("p", "box_id").collect())
    assert got == sorted((i, b) for i, (x, y) in enumerate(points) for b, w, s, e, n in boxes if w <= x <= e and s <= y <= n)
    plan = re_.in_boxes(there, frames.where("box_id > 4"))
    cells = plan.groupBy("p", "box_id").count().where("count > 1").count()
    assert cells == 0
    assert re_.in_boxes(there, frames.where("box_id < 0")).count() == 0


def test_running_sums_and_quantiles(spark):
    rng = random.Random(3)
    rows = [(g, rng.choice([0.5, round(rng.random(), 2)]) * (1 if g != "b" else 1e300)) for g in ("a", "b", None) for _ in range(400)] + [("one", 7.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    got = {r.g: r.quantile for r in ranks.exact_quantile(df, ["g"], "v", 0.98).collect()}
    want = {g: np.quantile([v for h, v in rows if h == g], 0.98) for g in ("a", "b", None, "one")}
    assert set(got) == set(want) and all(abs(got[g] - want[g]) <= 1e-9 * abs(want[g]) for g in want)
    numbered = spark.range(1000).select((F.col("id") % 2).alias("g"), "id", F.lit(1).alias("one")).repartition(5)
    run = ranks.running(numbered, ["g"], [F.desc("id")], {"seen": "one"}).collect()
    assert all(r.seen == (999 - r.id) // 2 + 1 and r.seen_total == 500 for r in run) and len(run) == 1000


def test_one_group_is_dealt_over_ranges(spark):
    """All rows in one group with distinct scores: no range holds much more than its share."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        dealt = spark.range(20_000).select(F.lit("x").alias("g"), F.rand(1).alias("p")).repartitionByRange(F.col("g"), F.desc("p"))
        sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == 4 and max(sizes) < 20_000 / 4 * 1.5
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rng = random.Random(9)
    rows = [("x", int(rng.random() < 0.3), rng.random()) for _ in range(2000)] + [("y", 1, 0.5)] * 3
    got = {r.g: (r.roc_auc, r.average_precision) for r in me.ranking(spark.createDataFrame(rows, "g string, y int, p double").repartition(4), ["g"]).collect()}
    x = sorted(((p, y) for g, y, p in rows if g == "x"), reverse=True)
    pos, neg, tp, wins, ap = sum(y for _, y in x), sum(1 - y for _, y in x), 0, 0, 0.0
    for i, (_, y) in enumerate(x, 1):
        tp += y
        wins += (1 - y) * tp
        ap += y * tp / i
    assert abs(got["x"][0] - wins / (pos * neg)) < 1e-12 and abs(got["x"][1] - ap / pos) < 1e-12 and got["y"] == (None, None)


def test_radiance_of_a_flat_scene(spark):
    rows = [("s", 1.0, 0.5)] * 10 + [("t", 0.0, 0.0)]
    got = {r.scene_id: (r.bright_level, r.relative_decrease) for r in se.radiance_change(spark.createDataFrame(rows, "scene_id string, before_radiance double, after_radiance double")).collect()}
    assert got == {"s": (1.0, 0.5), "t": (0.1, None)}


@pytest.mark.parametrize("order", [[("at", True), ("id", False)], [("name", False), ("id", True)]])
def test_pages_by_key_are_those_by_offset(spark, order):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([None, dt.datetime(2024, 1, rng.randint(1, 5))])) for i in range(97)]
    df = spark.createDataFrame(rows, "id long, name string, at timestamp").repartition(3)
    columns = [F.desc(n) if down else F.asc(n) for n, down in order]
    whole, after, number = [r.id for r in df.orderBy(*columns).collect()], None, 0
    while True:
        page = re_.page_after(df, order, after, 10).collect()
        assert [r.id for r in page] == whole[number * 10 : number * 10 + 10]
        if not page:
            break
        after, number = page[-1].asDict(), number + 1
    assert number == 10
    with pytest.raises(ValueError):
        re_.page_after(df, order, None, 101)


def test_bounds_of_a_page_reach_the_scan(spark, tmp_path):
    spark.range(100).select("id", (F.col("id") * 2).alias("k")).write.parquet(f"{tmp_path}/t")
    page = re_.page_after(spark.read.parquet(f"{tmp_path}/t"), [("k", False), ("id", False)], {"k": 50, "id": 25}, 5)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(" in plan and "GreaterThan(k,50)" in plan and [r.id for r in page.collect()] == [26, 27, 28, 29, 30]


def test_a_graph_over_the_limit_is_refused(spark):
    edges = spark.createDataFrame([("hub", f"n{i}", 0.5) for i in range(12)], "src string, dst string, criticality double")
    companies = spark.createDataFrame([("hub", "Hub")] + [(f"n{i}", "N") for i in range(12)], "id string, name string")
    scores = spark.createDataFrame([], "id string, company_id string, score double, computed_at timestamp")
    assert sv.ego_graph(edges, companies, scores, "hub", 1, "downstream", most=13)[0].count() == 13
    with pytest.raises(ValueError, match="more than 12 reached nodes"):
        sv.ego_graph(edges, companies, scores, "hub", 1, "downstream", most=12)


def test_points_of_a_batch(spark):
    import struct

    good = lambda order, x, y, kind=1: struct.pack(f"{order}BIdd", order == "<", kind, x, y)
    rows = [(good("<", 1.5, 2.5), 2.5, 1.5), (good(">", -3.0, 4.0), 4.0, -3.0), (good("<", 1.0, 2.0, 2), None, None), (b"short", None, None), (None, None, None), (b"\x02" + good("<", 1.0, 2.0)[1:], None, None)]
    df = spark.createDataFrame([(bytearray(r[0]) if r[0] is not None else None, i) for i, r in enumerate(rows)], "wkb binary, i int").coalesce(1)
    assert [(r.p.lat, r.p.lon) for r in df.orderBy("i").select(wkb_point("wkb").alias("p")).collect()] == [r[1:] for r in rows]
