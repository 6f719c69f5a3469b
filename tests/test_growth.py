"""Queries whose rows must not multiply where many rows share a place: same results, and no step with a row for each pair."""

from __future__ import annotations

import datetime as dt
import pathlib
import random

from pyspark.sql import functions as F

from quaylight.operators import extraction as ex
from quaylight.operators import features as fe
from quaylight.operators import phrases as ph
from quaylight.operators import relational as rel

NOW = dt.datetime(2024, 1, 20)
SIGNALS = "id long, company_id long, location_id long, source_type string, severity double, extracted string, observed_at timestamp, ingested_at timestamp"
LINKS = "company_id long, location_id long, source_url string, available_at timestamp"


def rows_of(df):
    """The rows of df, and the largest number that any of its steps counted."""
    rows, spark = df.collect(), df.sparkSession
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store = spark._jsparkSession.sharedState().statusStore()
    shown = store.executionMetrics(store.executionsList().last().executionId()).values().mkString(";").split(";")
    return rows, max(int(x.replace(",", "")) for x in shown if x.replace(",", "").isdigit())


def place(spark, companies, signals):
    """Companies and signals of one location, beside some of two locations, of their own company, with repeated and without ids."""
    at = NOW - dt.timedelta(days=1)
    rows = [(i, None, 0, "news", 0.5, "{}", at, at) for i in range(signals)]
    rows += [(1, None, 1, "news", 0.5, "{}", at, at), (1, 3, None, "news", 0.5, "{}", at, at), (2, 3, 0, "news", 0.5, "{}", at, at), (-1, 4, None, "news", 0.5, "{}", at, at), (-1, 4, None, "news", 0.5, "{}", at, at), (None, 5, None, "news", 0.5, "{}", at, at), (None, None, 1, "news", 0.5, "{}", at, at), (-2, None, None, "news", 0.5, "{}", at, at)]
    links = [(i, 0, "https://x", at) for i in range(companies)] + [(3, 1, "https://x", at), (3, 1, "https://y", at), (6, 1, "", at), (7, 1, "https://x", NOW + dt.timedelta(days=1))]
    return spark.createDataFrame(rows, SIGNALS), spark.createDataFrame(links, LINKS)


def universe(spark, n):
    named = spark.range(n).select("id", F.lit("Energy").alias("industry"), (F.col("id") == 8).alias("is_synthetic"), F.lit(NOW).alias("created_at"))
    none = "id string, supplier_id long, customer_id long, source_signal_id long, relationship_type string, criticality double, confidence double, status string, provenance string, created_at timestamp, reviewed_at timestamp"
    return named, spark.createDataFrame([], none)


def test_signals_of_a_location_are_counted_without_pairs(spark):
    """j5: the counts of `targets`, whatever ids repeat."""
    signals, links = place(spark, 20, 30)
    want = {r.company_id: r["count"] for r in rel.targets(signals, links, F.lit(NOW)).groupBy("company_id").count().collect()}
    assert {r.company_id: r.signals for r in rel.count_targets(signals, links, F.lit(NOW)).collect()} == want and want[3] == 31 and want[5] == 31
    rows, most = rows_of(rel.count_targets(*place(spark, 300, 300), F.lit(NOW)))
    assert len(rows) == 300 and most < 5_000


def test_evidence_is_counted_without_pairs(spark):
    """a18: as from the pairs."""
    signals, links = place(spark, 20, 30)
    made = fe.assemble(universe(spark, 20)[0], signals, universe(spark, 20)[1], links, F.lit(NOW))
    want = sorted(map(tuple, fe.evidence_count(made["evidence"]).collect()))
    assert sorted(map(tuple, made["counts"].collect())) == want and len(want) == 19
    companies, none = universe(spark, 300)
    signals, links = place(spark, 300, 300)
    rows, most = rows_of(fe.assemble(companies, signals, none, links, F.lit(NOW))["counts"])
    assert len(rows) == 299 and most < 5_000


def test_coverage_is_counted_without_pairs(spark):
    """a19: as from the pairs."""
    signals, links = place(spark, 300, 300)
    companies, none = universe(spark, 300)
    rows, most = rows_of(fe.feature_coverage(fe.assemble(companies, signals, none, links, F.lit(NOW))["covered"]))
    assert [tuple(r) for r in rows] == [("news", 299)] and most < 5_000


def test_nearest_of_many(spark):
    """j8: against plain search, with ties, and without a row for each pair of a place."""
    rng = random.Random(5)
    start = dt.datetime(2024, 1, 1)
    scenes = [(i, i % 3, start + dt.timedelta(hours=rng.randint(0, 24 * 30)), float(rng.randint(0, 60))) for i in range(200)]
    wanted = [(i, i % 4, (start + dt.timedelta(days=rng.randint(-12, 40))).date()) for i in range(300)]
    targets = spark.createDataFrame(wanted, "target_id long, place int, day date")
    there = "id long, place int, observed_at timestamp, cloud_cover double"
    got = {r.target_id: r.id for r in rel.nearest_before_after(targets, spark.createDataFrame(scenes, there)).collect()}
    want = {}
    for t, p, day in wanted:
        at = dt.datetime.combine(day, dt.time())
        near = [(abs(s - at - dt.timedelta(hours=12)), i) for i, q, s, cloud in scenes if q == p and cloud <= 35 and dt.timedelta(-7) <= s - at <= dt.timedelta(8)]
        if near:
            want[t] = min(near)[1]
    assert got == want and len(want) > 100
    same = spark.range(300).select(F.col("id").alias("target_id"), F.lit(1).alias("place"), F.lit(dt.date(2024, 1, 5)).alias("day"))
    many = spark.range(300).select("id", F.lit(1).alias("place"), F.lit(start).alias("observed_at"), F.lit(1.0).alias("cloud_cover"))
    rows, most = rows_of(rel.nearest_before_after(same, many))
    assert {(r.target_id, r.id) for r in rows} == {(i, 0) for i in range(300)} and most < 10_000


def test_texts_are_read_once_for_megabytes_of_phrases(spark):
    """e4, e1, e5: 6 MB of phrases that begin alike; with slices of 4 MB texts were read twice, each time into a folder of its own."""
    folder = pathlib.Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    name = F.concat(F.lit("customer of the north "), F.lpad(F.col("id").cast("string"), 9, "0"))
    known = spark.range(150_000).select(name.alias("phrase"), F.col("id").cast("string").alias("owner"))
    texts = spark.range(50).select("id", F.concat(F.lit("a customer of the north customer of the north "), F.lpad((F.col("id") * 4000).cast("string"), 9, "0"), F.lit(" of the")).alias("text"))
    before = set(folder.glob("phrases-*"))
    got = ph.find_phrases(texts, "text", known).collect()
    assert sorted((r.id, r.owner, r.phrase) for r in got) == [(i, str(4000 * i), f"customer of the north {4000 * i:09}") for i in range(38)]
    assert set(folder.glob("phrases-*")) == before


def test_boxes_are_summed_without_pairs(spark):
    """j7: as `in_boxes`, with equal points and boxes, edges on points, boxes of no size, upside down and empty; no row for each pair."""
    rng = random.Random(6)
    spot = lambda: (rng.randint(-5, 5) / 4, rng.randint(-5, 5) / 4)
    points = spark.createDataFrame([(i, *spot()) for i in range(150)] + [(999, None, 0.0), (1000, 0.0, float("nan"))], "v long, lat double, lon double")
    rows = [(i, *spot(), *spot()) for i in range(60)] + [(i + 60, -1.0, -1.0, 1.0, 1.0) for i in range(3)] + [(70, 0.25, 0.5, 0.25, 0.5), (71, 50.0, 50.0, 60.0, 60.0), (72, -180.0, -90.0, 180.0, 90.0)]
    boxes = spark.createDataFrame(rows, "box_id long, west double, south double, east double, north double")
    want = rel.in_boxes(points, boxes).groupBy("box_id").agg(F.count("*").alias("n"), F.sum("v").alias("v"))
    got = sorted(map(tuple, rel.sums_in_boxes(points, boxes, {"v": "v"}).collect()))
    assert got == sorted(map(tuple, want.collect())) and (72, 150, sum(range(150))) in got
    assert rel.sums_in_boxes(points.limit(0), boxes, {"v": "v"}).count() == 0 and rel.sums_in_boxes(points, boxes.limit(0), {"v": "v"}).count() == 0
    many = spark.range(400).select(F.lit(1).cast("long").alias("v"), (F.col("id") / 1000).alias("lat"), (F.col("id") / 1000).alias("lon"))
    wide = spark.range(400).select(F.col("id").alias("box_id"), (-F.col("id") / 100).alias("west"), F.lit(-1.0).alias("south"), F.lit(1.0).alias("east"), F.lit(2.0).alias("north"))
    rows, most = rows_of(rel.sums_in_boxes(many, wide, {"v": "v"}))
    assert {tuple(r) for r in rows} == {(i, 400, 400) for i in range(400)} and most < 20_000


def test_runner_ups_are_found_without_all_pairs(spark):
    """j12: as by comparing every mention with every alias; random names meet only those near them."""
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))

    def typed(s: str, n: int) -> str:
        for _ in range(n):
            i = rng.randrange(len(s) + 1)
            s = rng.choice([s[:i] + rng.choice("abcxyz") + s[i:], s[:i] + s[i + 1 :], s[:i] + "q" + s[i + 1 :]])
        return s

    base = [word(rng.randint(6, 45)) for _ in range(60)]
    names = sorted({*base, *(typed(b, rng.randint(1, 5)) for b in base[:40])})
    said = sorted({typed(b, rng.randint(0, 4)) for b in base * 3})
    directory = spark.createDataFrame([(str(i), n) for i, n in enumerate(names)] + [("again", names[0])], "cik string, name string")
    pairs = spark.createDataFrame([(m, n) for m in said for n in names], "m string, n string")
    ratios: dict = {}
    for m, n, r in pairs.select("m", "n", ex.indel_ratio("m", "n")).collect():
        ratios.setdefault(m, []).append((r, n))
    want = set()
    for m, near in ratios.items():
        (r, n), (second, _) = sorted(near, reverse=True)[:2]
        if len(m) >= 6 and r >= 92 and r - second >= 8 and n != names[0]:
            want.add((m, str(names.index(n))))
    got = {(r.mention, r.cik) for r in ex.resolve_fuzzy(spark.createDataFrame([(m,) for m in said], "mention string"), directory).collect()}
    assert got == want and 20 < len(want) < len(said)
    hashes = spark.range(1500).select(F.sha1(F.col("id").cast("string")).alias("name"), F.col("id").cast("string").alias("cik"))
    mentions = hashes.select(F.concat(F.col("name").substr(1, 20), F.lit("x"), F.col("name").substr(21, 20)).alias("mention"))
    rows, most = rows_of(ex.resolve_fuzzy(mentions, hashes))
    assert len(rows) == 1500 and most < 600_000


def test_recent_or_referenced_signals_are_read_once(spark):
    """m2, j19: as the union of both, each id once, null ids and times included; signals stand in the plan once."""
    old, new = NOW - dt.timedelta(days=200), NOW - dt.timedelta(days=1)
    signals = spark.createDataFrame([(1, new, "a"), (2, old, "b"), (3, old, "c"), (4, None, "d"), (5, None, "e"), (None, new, "f"), (None, old, "g"), (6, new, "h"), (6, new, "h")], "id long, observed_at timestamp, text string")
    edges = spark.createDataFrame([(2,), (2,), (4,), (1,), (9,), (None,)], "source_signal_id long")
    got = rel.recent_or_referenced(signals, edges, F.lit(NOW))
    assert got.columns == signals.columns and sorted(r.text for r in got.collect()) == ["a", "b", "d", "f", "h"]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 2
