"""Hand-written cases for the evidence, sensor, graph, feature and text operators."""

from __future__ import annotations

import datetime as dt
import json
import math
import random
import struct
from collections import deque

import pytest
from pyspark.sql import functions as F

from quaylight import schemas
from quaylight.functions import text as ft
from quaylight.functions import values as fv
from quaylight.operators import evidence as ev
from quaylight.operators import extraction as ex
from quaylight.operators import features as fe
from quaylight.operators import graph as gr
from quaylight.operators import metrics as me
from quaylight.operators import models as mo
from quaylight.operators import relational as rel
from quaylight.operators import sensors as se
from quaylight.sources import files, sinks
from quaylight.streaming import jobs

NOW = dt.datetime(2026, 9, 25)


def now():
    return F.lit("2026-09-25 00:00:00").cast("timestamp")


def one(spark, column, **values):
    kinds = {str: "string", int: "long", float: "double", bool: "boolean"}
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items())) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


# --- files -------------------------------------------------------------------------------------


def test_positions_csv(spark, tmp_path):
    lines = ["MMSI,BaseDateTime,LAT,LON,SOG"]
    for d in (1, 2, 3, 4):
        lines += [f"123456789,2024-01-0{d}T{h:02d}:00:00,33.72,-118.265,0.5" for h in (0, 2, 4, 6)]
    lines += [lines[1], "bad,2024-01-01T00:00:00,33.72,-118.265,0.5", "123456789,2024-01-01T00:00:00,40,-118.265,0.5"]
    (tmp_path / "p.csv").write_text("﻿" + "\n".join(lines))
    box = {"west": -118.28, "south": 33.7, "east": -118.25, "north": 33.74}
    positions, quality = files.read_positions_csv(spark, str(tmp_path / "p.csv"), box)
    assert positions.count() == 16 and tuple(quality.first()) == (16, 1, 1)
    daily = se.daily_activity(positions)
    wanted = spark.createDataFrame([(dt.date(2024, 1, 4),), (dt.date(2024, 1, 5),)], "target date")
    got = {r.target.day: r for r in se.activity_ratio(daily, wanted, 3).collect()}
    assert (got[4].vessels, got[4].ratio, got[4].error) == (1, 1.0, None) and got[5].error and got[5].ratio is None
    with pytest.raises(ValueError, match="missing columns"):
        (tmp_path / "q.csv").write_text("a,b\n1,2")
        files.read_positions_csv(spark, str(tmp_path / "q.csv"), box)


def test_positions_parquet_job(spark, tmp_path):
    point = lambda order, kind=1: struct.pack(order + "BIdd", order == "<", kind, -118.265, 33.72)
    rows = [(123456789, dt.datetime(2024, 1, d, h), 0.5, p) for d in (1, 2) for h, p in ((1, point("<")), (2, point(">")), (3, b"bad"), (4, point("<", 2)))]
    spark.createDataFrame(rows, "mmsi long, base_date_time timestamp, sog double, geometry binary").write.parquet(f"{tmp_path}/in")
    box = {"west": -119.0, "south": 33.0, "east": -118.0, "north": 34.0}
    manifest = files.bbox_subset_job(spark, {"2024-01-01": f"{tmp_path}/in", "2024-01-02": f"{tmp_path}/in"}, box, f"{tmp_path}/out", least_hours=0.0)
    assert sorted((r.day, r.accepted, r.invalid, r.positions) for r in manifest.collect()) == [("2024-01-01", 2, 2, 2), ("2024-01-02", 2, 2, 2)]
    assert {(r.lat, r.lon) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {(33.72, -118.265)}
    with pytest.raises(ValueError, match="no usable coverage"):
        files.bbox_subset_job(spark, {"2024-01-09": f"{tmp_path}/in"}, box, f"{tmp_path}/out2", least_hours=0.0)
    with pytest.raises(ValueError, match="no usable coverage on .'2024-01-01', '2024-01-02'"):  # positions, but of less than four hours
        files.bbox_subset_job(spark, {"2024-01-01": f"{tmp_path}/in", "2024-01-02": f"{tmp_path}/in"}, box, f"{tmp_path}/out3")


def test_directory_filings_articles_catalog(spark, tmp_path):
    text = lambda x: spark.createDataFrame([(json.dumps(x),)], "value string")
    directory = files.read_company_directory(text({"0": {"cik_str": 99, "ticker": "tst", "title": "Test Corp."}}))
    assert tuple(directory.first()) == ("0000000099", "TST", "Test Corp.")
    index = {"form": ["10-K", "8-K", "20-F"], "accessionNumber": ["0000000001-24-000001", "0000000001-24-000002", "bad"], "primaryDocument": ["a.htm", "b.htm", "c.htm"], "filingDate": ["2024-02-01", "2024-03-01", "2024-04-01"]}
    filings = files.read_filing_index(text(index))
    assert [r.document for r in filings.collect()] == ["a.htm"]
    older = filings.withColumn("document", F.lit("old.htm")).withColumn("filing_date", F.to_date(F.lit("2030-01-01")))
    both = [df.withColumn("cik", F.lit("1")) for df in (filings, older)]
    assert files.latest_filing(*both, ["cik"]).first().document == "a.htm"
    assert files.latest_filing(both[0].where("false"), both[1], ["cik"]).first().document == "old.htm"
    articles = {"articles": [{"title": "A", "url": "https://publisher.invalid/story?utm_source=x&x=1#part", "seendate": "20260901T000000Z"}, {"title": "B", "url": "javascript:alert(1)", "seendate": "20260901T000000Z"}, {"title": "C", "url": "https://a.invalid/", "seendate": "bad"}, {"title": " ", "url": "https://a.invalid/", "seendate": "20260901T000000Z"}, {"title": "D", "url": "https://a.invalid/", "seendate": "20200901T000000Z"}]}
    got = files.read_articles(text(articles), F.lit("2026-08-26").cast("timestamp"), now()).collect()
    assert [(r.title, r.url) for r in got] == [("A", "https://publisher.invalid/story?x=1")]
    (tmp_path / "c.json").write_text(json.dumps({"companies": [{"id": "a"}, {"id": "b"}], "locations": [{"slug": "x"}], "version": 1}, indent=1))
    catalog = files.read_catalog(spark, str(tmp_path / "c.json"))
    assert {k: v.count() for k, v in catalog.items()} == {"companies": 2, "locations": 1}
    many = spark.createDataFrame([(c,) for c in "DBCA"], "ticker string")
    assert [r.ticker for r in files.read_universe(many, ["C"], 2, 0).collect()] == ["C", "A"] and [r.ticker for r in files.read_universe(many, ["C"], 9, 2).collect()] == ["B", "D"]
    known = spark.createDataFrame([("T", "1"), ("U", None)], "ticker string, cik string")
    assert files.directory_fallback(many, known).count() == 4 and files.directory_fallback(known.where("false").select("ticker"), known).collect()[0].ticker == "T"


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1.0, NOW), ("b", None, NOW)], "id string, x double, as_of timestamp")
    for _ in range(2):
        there = sinks.write_snapshot(rows, f"{tmp_path}/snap", schemas.FEATURE_SCHEMA)
    assert there.count() == 2 and there.select("snapshot_id").distinct().count() == 1
    ids = [sinks.content_id(df, "as_of").first().snapshot_id for df in (rows, rows.orderBy(F.desc("id")), rows.fillna(0.0))]
    assert ids[0] == ids[1] != ids[2] and len(ids[0]) == 64
    sinks.append_scores(rows, f"{tmp_path}/scores")
    sinks.append_scores(rows, f"{tmp_path}/scores")
    assert spark.read.parquet(f"{tmp_path}/scores").count() == 4
    sinks.write_report(rows, rows, f"{tmp_path}/report")
    assert spark.read.json(f"{tmp_path}/report/summary").count() == 2


# --- functions -----------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://publisher.invalid/story?utm_source=x&x=1#part", "https://publisher.invalid/story?x=1"),
        ("HTTP://Host.Invalid", "http://host.invalid/"),
        ("https://h.invalid/a?b=&a=2&a=1&fbclid=z", "https://h.invalid/a?a=1&a=2&b="),
        ("https://user@h.invalid/", None),
        ("ftp://h.invalid/", None),
        ("javascript:alert(1)", None),
        ("not a url", None),
        ("https://h.invalid/a?q=a%20b", "https://h.invalid/a?q=a+b"),
    ],
)
def test_canonical_url(spark, url, want):
    assert one(spark, ft.canonical_url(F.col("u")), u=url) == want


def test_text_functions(spark):
    import uuid

    assert one(spark, ft.short_name(F.col("n")), n="Test Assembly, Inc. Ltd.") == "Test Assembly"
    assert one(spark, ft.normalize_name(F.col("n")), n=" Té-st & Co.") == "t st co"
    assert one(spark, ft.uuid5(F.col("n")), n="company:é") == str(uuid.uuid5(uuid.NAMESPACE_URL, "company:é"))
    assert one(spark, ft.clean_html(F.col("h")), h="<p>a&amp;b<script>x</script>\n c</p><style>s</style>") == "a&b c"
    assert one(spark, ft.clean_html(F.col("h")), h="caf&eacute;&#233;&#xe9; &lt;b&gt; x&nbsp;y") == "cafééé <b> x y"
    assert one(spark, ft.sentences(F.col("t")), t="One. Two!  Three") == ["One.", "Two!", "Three"]
    assert one(spark, ft.sanitize_phrase(F.col("t")), t="né&w (x)") == "né&w  x" and one(spark, ft.sanitize_phrase(F.col("t")), t="()") is None
    assert one(spark, ft.canonical_url(F.col("u")), u="https://A.org/?UTM_Source=x&Fbclid=2&b=1") == "https://a.org/?b=1"
    assert one(spark, ft.excerpt(F.col("t"), F.lit("The Needle")), t="x" * 900 + "the, NEEDLE" + "y" * 2000)[500:511] == "the, NEEDLE"
    assert one(spark, ft.excerpt(F.col("t"), F.lit("needle")), t="x" * 900 + "needle" + "y" * 2000)[499:506] == "xneedle"
    assert one(spark, ft.ticker_list(F.split("t", ",")), t=" ab,AB,,c.d") == ["AB", "C.D"] and one(spark, ft.ticker_list(F.split("t", ",")), t="a,b,c,d,e,f") is None
    assert one(spark, ft.archive_url(F.col("c"), F.lit("0-1-2"), F.lit("d.htm")), c="0000000007").endswith("/7/012/d.htm")


def test_value_functions(spark):
    assert one(spark, fv.bbox(F.lit(90.0), F.lit(0.0), F.lit(4.0))) is None
    box = one(spark, fv.bbox(F.lit(33.72), F.lit(-118.265), F.lit(4.0)))
    assert box.north == pytest.approx(33.72 + 4 / 111.32, abs=1e-7)
    assert one(spark, fv.tile_of_box(fv.bbox(F.lit(33.72), F.lit(-118.265), F.lit(4.0)))) == "h06v05"
    assert one(spark, fv.tile_of_box(fv.bbox(F.lit(40.0), F.lit(-118.0), F.lit(4.0)))) is None
    assert str(one(spark, fv.month_range(F.to_date(F.lit("2024-02-01")))[1])) == "2024-02-29"
    assert one(spark, fv.parse_utc(F.lit("2024-01-01T00:00:00"), naive=False)) is None and one(spark, fv.parse_utc(F.lit("2024-01-01T00:00:00Z"), naive=False))
    assert one(spark, fv.finite(F.lit("nan"))) is None and one(spark, fv.finite(F.lit("2"))) == 2
    assert [one(spark, fv.risk_band(F.lit(x))) for x in (None, 0.7, 0.4, 0.1)] == ["unscored", "high", "moderate", "low"]
    assert [one(spark, fv.sic_to_industry(F.lit(x))) for x in ("3571", "1311", "20")] == ["Electronics", "Energy", "Other"]
    assert [one(spark, c) for c in fv.industry_features(F.lit("Space"))] == [0, 0, 0, 0, 0, 1] and sum(one(spark, c) for c in fv.relation_features(F.lit("?"))) == 0
    lat, lon = fv.pixel_center(F.lit(6), F.lit(5), F.lit(0), F.lit(0))
    assert (one(spark, lat), one(spark, lon)) == (pytest.approx(40 - 0.5 / 240), pytest.approx(-120 + 0.5 / 240))


# --- sensors -----------------------------------------------------------------------------------


def pixels(spark, value, valid=True, n=3, name="radiance"):
    return spark.createDataFrame([("s", i, j, valid, float(value), float(value)) for i in range(n) for j in range(n)], f"scene_id string, row int, col int, valid boolean, {name} double, near double")


def test_pixel_change(spark):
    drop = lambda a, b: se.radiance_change(se.aligned(pixels(spark, a), pixels(spark, b), ["radiance"])).first()
    assert drop(10, 5).relative_decrease == 0.5 and drop(0, 1).relative_decrease is None
    met = se.aligned(pixels(spark, 0.2, name="red"), pixels(spark, 0.4, name="red"), ["red", "near"])
    got = se.surface_change(met).first()
    assert (round(got.surface_change, 9), got.valid_share) == (0.2, 1)
    assert se.aligned(pixels(spark, 0.2, name="red"), pixels(spark, 0.2, False, name="red"), ["red", "near"]).count() == 0
    assert one(spark, se.optical_valid(F.lit(4), F.lit(1), [F.lit(0.2), F.lit(1.5)])) and not one(spark, se.optical_valid(F.lit(8), F.lit(1), [F.lit(0.2)]))
    night = lambda raw, n: one(spark, se.night_valid(F.lit(raw), F.lit(-1.0), F.lit(0), F.lit(n), F.lit(raw)))
    assert night(1.0, 4) and night(1.0, 3) and not night(1.0, 2) and not night(-1.0, 9)


def test_nearest_acquisition(spark):
    target = spark.createDataFrame([(1, "p", dt.date(2024, 1, 4)), (2, "q", dt.date(2024, 1, 4)), (3, "r", dt.date(2024, 1, 4))], "target_id long, place string, day date")
    at = lambda *x: dt.datetime(2024, 1, *x)
    scenes = [("a", "p", at(3, 10), 10.0), ("b", "p", at(4, 11), 90.0), ("c", "p", at(20), 1.0), ("d", "o", at(4, 12), 1.0), ("e", "q", at(4, 0), 1.0), ("f", "q", at(5, 0), 1.0), ("g", "q", at(3, 23), 1.0), ("h", "r", at(12, 0), 1.0), ("i", "r", at(12, 1), 1.0)]
    df = spark.createDataFrame(scenes, "id string, place string, observed_at timestamp, cloud_cover double")
    # The nearest to noon, ties by id, in the target's place; a scene at the window's last midnight counts.
    assert {r.target_id: r.id for r in rel.nearest_before_after(target, df).collect()} == {1: "a", 2: "e", 3: "h"}


def test_activity_gate_is_not_rounded(spark):
    rows = [(d, 100 + d, dt.datetime(2024, 1, d, 0, 0), 1.0, 1.0, 0.0) for d in (1, 2, 3, 4)] + [(d, 100 + d, dt.datetime(2024, 1, d, 3, 59, 50), 1.0, 1.0, 0.0) for d in (1, 2, 3, 4)]
    daily = se.daily_activity(spark.createDataFrame([r[1:] for r in rows], "mmsi long, at timestamp, lat double, lon double, sog double"))
    got = se.activity_ratio(daily, spark.createDataFrame([(dt.date(2024, 1, 4),)], "target date"), 3).first()
    assert daily.first().span_hours == 4.0 and got.ratio is None and got.error


def test_measurements_by_type(spark):
    located = {"origin": "location_observation", "provenance": "f", "vessel_activity_ratio": 1.5}
    cases = [(located, math.tanh(0.5)), (located | {"provenance": ""}, None), (located | {"provenance": ["f"]}, math.tanh(0.5)), (located | {"provenance": {}}, None), (located | {"vessel_activity_ratio": "1.5"}, None), (located | {"vessel_activity_ratio": True}, None)]
    df = spark.createDataFrame([(json.dumps(c), "ais", 0.5) for c, _ in cases], "extracted string, source_type string, severity double")
    assert [r.x for r in df.select(fe.parsed_once(fe.measurement).alias("x")).collect()] == [want if want is None else pytest.approx(want) for _, want in cases]
    news = [({}, 0.5), ({"eligible_for_scoring": True}, 0.5), ({"eligible_for_scoring": False}, None), ({"eligible_for_scoring": None}, None), ({"eligible_for_scoring": 0}, None), ({"eligible_for_scoring": "no"}, 0.5)]
    df = spark.createDataFrame([(json.dumps(c), "news", 0.5) for c, _ in news] + [("no json", "news", 0.5)], "extracted string, source_type string, severity double")
    assert [r.x for r in df.select(fe.parsed_once(fe.measurement).alias("x")).collect()] == [*(want for _, want in news), 0.5]


# --- evidence ----------------------------------------------------------------------------------

SIG = "id string, company_id string, location_id string, source_type string, severity double, extracted string, observed_at timestamp, ingested_at timestamp"


def day(n, **more):
    return NOW - dt.timedelta(days=n, **more)


def signals(spark):
    located = json.dumps({"origin": "location_observation", "provenance": "file", "vessel_activity_ratio": 1.5})
    rows = [
        ("s", "a", None, "news", 0.8, "{}", day(1), day(1)),
        ("late", "a", None, "news", 0.9, "{}", day(2), NOW + dt.timedelta(seconds=1)),
        ("future", "a", None, "news", 0.9, "{}", NOW + dt.timedelta(seconds=1), day(0)),
        ("old", "a", None, "news", 0.9, "{}", day(31), day(31)),
        ("no", "a", None, "news", 0.9, '{"eligible_for_scoring": false}', day(1), day(1)),
        ("ais", None, "L", "ais", None, located, day(1), day(1)),
        ("bare", None, "L", "satellite", None, '{"surface_change": 1}', day(1), day(1)),
        ("year", "b", None, "news", 0.5, "{}", day(365), day(365)),
    ]
    return spark.createDataFrame(rows, SIG)


COMPANY = "id string, name string, ticker string, industry string, is_synthetic boolean, created_at timestamp"
RELS = "id string, supplier_id string, customer_id string, source_signal_id string, relationship_type string, criticality double, confidence double, status string, provenance string, created_at timestamp, reviewed_at timestamp"


def companies(spark):
    return spark.createDataFrame([("a", "A 100%", "AA", "Electronics", False, day(9)), ("b", "B", "BB", "Nothing", False, day(9)), ("x", "X", "XX", "Energy", True, day(9)), ("n", "New", "NN", "Energy", False, NOW + dt.timedelta(1))], COMPANY)


def relationship(spark, *rows):
    base = ("a", "b", "year", "component", 0.5, 0.9)
    return spark.createDataFrame([(i, *base, status, "sec_filing", day(5), reviewed) for i, status, reviewed in rows], RELS)


def links(spark, at):
    return spark.createDataFrame([("b", "L", "https://x", at)], "company_id string, location_id string, source_url string, available_at timestamp")


def test_point_in_time_features(spark):
    got = fe.assemble(companies(spark), signals(spark), relationship(spark, ("r", "approved", NOW)), links(spark, NOW), now())
    nodes = {r.id: r for r in got["nodes"].collect()}
    assert set(nodes) == {"a", "b"} and len(got["nodes"].columns) == 2 + 22
    assert (nodes["a"].news_value, nodes["a"].news_present, nodes["a"].industry_Electronics) == (0.8, 1, 1)
    assert (nodes["b"].news_present, nodes["b"].news_age, nodes["b"].industry_Other) == (0, 1, 1)
    assert nodes["b"].ais_value == pytest.approx(math.tanh(0.5)) and nodes["b"].satellite_present == 0
    assert nodes["a"].news_count == pytest.approx(math.log(2) / math.log(251)) and nodes["a"].news_age == pytest.approx(1 / 30)
    assert {(r.company_id, r.signal_id) for r in got["evidence"].collect()} == {("a", "s"), ("b", "ais")}
    assert got["edges"].count() == 1  # evidence of 365 days ago keeps its edge
    late = fe.assemble(companies(spark), signals(spark), relationship(spark, ("r", "approved", NOW + dt.timedelta(seconds=1)), ("p", "pending", NOW)), links(spark, NOW + dt.timedelta(seconds=1)), now())
    assert late["edges"].count() == 0 and {r.company_id for r in late["evidence"].collect()} == {"a"}
    assert {r.company_id: r.evidence_count for r in fe.evidence_count(got["evidence"]).collect()} == {"a": 1, "b": 1}
    off = fe.ablate(got["nodes"], "no_news").where("id = 'a'").first()
    assert [off[f"news_{s}"] for s in fe.STATS] == [0, 0, 0, 0] and off.ais_age == 1


def test_last_valid_edge_wins(spark):
    rows = [("1", "approved", day(4)), ("2", "rejected", day(3))]
    assert ev.valid_edges(relationship(spark, *rows), companies(spark), signals(spark), now()).first().id == "1"
    projected = ev.project_edges(relationship(spark, ("1", "approved", day(4)), ("2", "approved", day(3)))).first()
    assert projected.evidence_ids == ["year", "year"] and projected.src == "a"
    decided = spark.createDataFrame([("1", "approved", day(2)), ("1", "rejected", day(1)), ("9", "approved", day(1))], "id string, status string, decided_at timestamp")
    assert ev.review(relationship(spark, ("1", "pending", None)), decided).first().status == "rejected"


def test_merges_and_purge(spark):
    there = signals(spark).where("id in ('s', 'old')")
    new = signals(spark).withColumn("ingested_at", now())
    once = ev.insert_only(there, new)
    again = ev.insert_only(once, new.withColumn("ingested_at", now() + F.expr("interval 9 days")))
    assert once.count() == 8 and sorted(map(tuple, once.collect()), key=str) == sorted(map(tuple, again.collect()), key=str)
    assert once.where("id = 's'").first().ingested_at == day(1)
    tables = {"companies": companies(spark), "signals": signals(spark).withColumn("company_id", F.when(F.col("id") == "s", "x").otherwise(F.col("company_id")))}
    left, preview = ev.purge(tables, "observed")
    assert {r.table: r.removed for r in preview.collect()} == {"companies": 1, "signals": 1} and left["signals"].count() == 7
    assert {r.removed for r in ev.purge(left, "observed")[1].collect()} == {0}
    up = ev.upsert_company(spark.createDataFrame([("i1", "Old", "1", "Energy", "US")], "id string, name string, cik string, industry string, country string"), spark.createDataFrame([("1", "New", "3571"), ("2", "Two", "20")], "cik string, name string, sic string"))
    got = {r.cik: r for r in up.collect()}
    assert (got["1"].id, got["1"].name, got["1"].industry, got["1"].country) == ("i1", "New", "Electronics", None) and got["2"].industry == "Other"
    saved = ev.save_relationships(relationship(spark, ("1", "approved", day(1))), spark.createDataFrame([("a", "b", "s")], "supplier_id string, customer_id string, source_signal_id string"))
    assert sorted(r.status for r in saved.collect()) == ["approved", "pending"] and ev.save_relationships(saved, saved.select("supplier_id", "customer_id", "source_signal_id")).count() >= 2
    catalog = {"companies": companies(spark)}
    installed = ev.install_catalog({"companies": companies(spark).limit(0), "signals": there}, catalog)
    assert installed["companies"].count() == 4 and ev.install_catalog(installed, catalog)["companies"].count() == 4


def test_runs_windows_and_pages(spark):
    state = lambda e, p: one(spark, ev.run_status(F.lit(e), F.lit(p)))
    assert [state(0, 0), state(1, 2), state(1, 0)] == ["success", "partial", "failed"]
    audit = spark.createDataFrame([("r", "running", None, day(2)), ("r", "success", day(1), day(1)), ("q", "running", None, day(3))], "id string, status string, finished_at timestamp, written_at timestamp")
    assert {r.id: r.status for r in ev.close_abandoned(ev.latest_runs(audit), now()).collect()} == {"r": "success", "q": "failed"}
    many = spark.range(250).select(F.lit("t").alias("topic"), F.lit("https://u").alias("url"), F.lit("T").alias("title"), F.lit("2026-09-01").cast("timestamp").alias("seen_at"), F.lit("2026-09-01").cast("timestamp").alias("window_start"))
    volume = ev.window_counts(many)
    assert ev.first_by_url(many).count() == 1 and volume.first().saturated and tuple(ev.topic_summary(volume).first()) == ("t", 250, 1)
    assert rel.list_companies(companies(spark), search="%").count() == 1 and rel.list_companies(companies(spark).where("id = 'b'"), search="%").count() == 0
    with pytest.raises(ValueError, match="1 to 100"):
        rel.page(companies(spark), [F.col("id")], 1, 101)
    with pytest.raises(ValueError, match="more than 2"):
        rel.guarded(companies(spark), 2, "companies")
    found, missing = rel.resolve_tickers(spark.createDataFrame([("AA",), ("ZZ",)], "ticker string"), companies(spark))
    assert found.count() == 1 and missing.first().ticker == "ZZ"
    ok, bad = rel.checked(signals(spark), F.when(~F.col("source_type").isin(schemas.SOURCE_TYPES), "source").when(F.col("severity") > 0.85, "severity"))
    assert ok.count() == 4 and bad.count() == 4


# --- graph and metrics ---------------------------------------------------------------------------


def test_graph(spark):
    rng = random.Random(1)
    pairs = sorted({(rng.randrange(30), rng.randrange(30)) for _ in range(45)})
    edges = spark.createDataFrame([(a, b, 1.0, 1.0) for a, b in pairs if a != b], "src long, dst long, criticality double, w double").cache()

    def bfs(steps, depth):
        seen, todo = {3: 0}, deque([3])
        while todo:
            x = todo.popleft()
            for y in steps.get(x, ()):
                if y not in seen and seen[x] < depth:
                    seen[y] = seen[x] + 1
                    todo.append(y)
        return seen

    down, up = {}, {}
    for a, b in pairs:
        down.setdefault(a, []).append(b)
        up.setdefault(b, []).append(a)
    both = {k: down.get(k, []) + up.get(k, []) for k in {*down, *up}}
    for name, steps in (("downstream", down), ("upstream", up), ("both", both)):
        for depth in (1, 3):
            assert {r.id: r.hops for r in gr.k_hop(edges, 3, depth, name).collect()} == bfs(steps, depth)
    near = sorted(both[3])[0]
    only = spark.createDataFrame([(i,) for i in range(30) if i != near], "id long")
    assert near not in {r.id for r in gr.k_hop(edges, 3, 2, "both", only).collect()}
    labels = {r.id: r.label for r in gr.weak_components(edges).collect()}
    for a in labels:
        whole, todo = {a}, [a]
        while todo:
            for y in both.get(todo.pop(), ()):
                if y not in whole:
                    whole.add(y)
                    todo.append(y)
        assert labels[a] == min(whole)
    observed = spark.createDataFrame([(3,), (99,)], "id long")
    assert {r.id for r in gr.observed_components(edges, observed).collect()} == {i for i, x in labels.items() if x == labels[3]} | {99}
    sums = gr.edge_softmax(edges.withColumn("s", F.rand(1) * 50), F.col("s")).groupBy("dst").agg(F.sum("weight").alias("x")).collect()
    assert all(abs(r.x - 1) < 1e-6 for r in sums)


def test_propagation(spark):
    shocks = spark.createDataFrame([("s", 1.0), ("c", 0.0)], "id string, shock double")
    edge = lambda a, b: spark.createDataFrame([(a, b, 1.0)], "src string, dst string, criticality double")
    risk = lambda e: {r.id: round(r.risk, 9) for r in gr.propagate_risk(shocks, e).collect()}
    assert risk(edge("s", "c")) == {"s": 1.0, "c": 0.65} and risk(edge("c", "s")) == {"s": 1.0, "c": 0.0}
    quiet = spark.createDataFrame([(str(i), 0.0) for i in range(5)], "id string, shock double")
    assert {r.risk for r in gr.propagate_risk(quiet, edge("a", "b").limit(0)).collect()} == {0.0}


def test_metrics(spark):
    rng = random.Random(4)
    rows = [("g", rng.randint(0, 1), rng.choice([0.1, 0.4, 0.5, 0.8])) for _ in range(40)] + [("one", 1, 0.3), ("one", 1, 0.6)]
    df = spark.createDataFrame(rows, "split string, y int, p double")
    g = [(y, p) for s, y, p in rows if s == "g"]
    wins = [1.0 if a > b else 0.5 if a == b else 0.0 for y, a in g if y for z, b in g if not z]
    auc = {r.split: r.roc_auc for r in me.roc_auc(df, ["split"]).collect()}
    assert auc["g"] == pytest.approx(sum(wins) / len(wins)) and auc["one"] is None
    ap = {r.split: r.average_precision for r in me.average_precision(df, ["split"]).collect()}
    total, want = sum(y for y, _ in g), 0.0
    for cut in sorted({p for _, p in g}, reverse=True):
        tp, seen = sum(y for y, p in g if p >= cut), sum(p >= cut for _, p in g)
        want += tp / seen * sum(y for y, p in g if p == cut) / total
    assert ap["g"] == pytest.approx(want) and ap["one"] is None
    c = {r.split: r for r in me.confusion(df, ["split"]).collect()}
    assert (c["one"].precision, c["one"].recall) == (1.0, 0.5)
    assert {r.split for r in me.split_problems(df.withColumn("split", F.lit("train"))).collect()} == {"validation", "test"}


# --- datasets and models -------------------------------------------------------------------------


def test_sequences_split_and_labels(spark, tmp_path):
    snaps = spark.createDataFrame([(f"s{i}{h}", dt.datetime(2026, 1, 1, h) + dt.timedelta(days=i)) for i in range(6) for h in (1, 9) if i != 3], "snapshot_id string, as_of timestamp")
    days = fe.last_of_day(snaps)
    assert [r.frames for r in fe.sequences(days, 2).orderBy("day").collect()] == [["s09", "s19"], ["s19", "s29"], ["s49", "s59"]]
    rows = [(str(i), dt.datetime(2026, 1, 1) + dt.timedelta(days=i)) for i in range(100)]
    ex_ = spark.createDataFrame(rows, "example_id string, as_of timestamp").selectExpr("*", "as_of - interval 3 days as start", "as_of + interval 7 days as label_end", "as_of + interval 7 days as label_available")
    split = fe.temporal_split(ex_.withColumn("label_available", F.when(F.col("example_id") == "5", F.lit("2030-01-01").cast("timestamp")).otherwise(F.col("label_available"))))
    ends = {r.split: r for r in split.groupBy("split").agg(F.max("label_end").alias("e"), F.min("start").alias("s")).collect()}
    assert ends["train"].e < ends["validation"].s and ends["validation"].e < ends["test"].s
    assert split.where("example_id = '5'").count() == 0
    with pytest.raises(ValueError, match="at least 12"):
        fe.temporal_split(ex_.limit(5))
    good = ("b", "snap", schemas.TARGET, "1", day(20), day(13), day(12), "me", "https://h.invalid/x", "why")
    bad = {"label": good[:3] + ("0.0",) + good[4:], "review": good[:9] + (" ",), "horizon": good[:5] + (day(12), day(12)) + good[7:], "source": good[:8] + ("http://h",) + good[9:]}
    df = spark.createDataFrame([good, *bad.values()], schemas.LABELS)
    assert [r.x for r in df.select(fe.label_problem(now()).alias("x")).collect()] == [None, *bad]
    assert fe.duplicate_labels(df).count() == 1
    assert fe.checked_labels(df.limit(1), now()).first().label == 1
    for rows, why in ((df, "label"), (df.limit(1).union(df.limit(1)), "repeat")):
        with pytest.raises(ValueError, match=why):
            fe.checked_labels(rows, now())
    lines = [json.dumps({"company_id": "b", "label": x}) for x in (0, 1, 0.0, 1.0, True, "1", None, 2)]
    (tmp_path / "labels.jsonl").write_text("\n".join(lines) + "\n")
    read = files.read_outcome_labels(spark, str(tmp_path / "labels.jsonl"))
    assert read.columns == schemas.LABELS.names and [r.label in ("0", "1") for r in read.collect()] == [True, True, *[False] * 6]
    frames = spark.createDataFrame([(1, "b", 0.5), (2, "a", 0.2), (2, "b", 0.7)], "step int, id string, v double")
    assert {(r.step, r.id): (r.present, r.v) for r in fe.align(frames, ["v"]).collect()} == {(1, "a"): (False, 0.0), (1, "b"): (True, 0.5), (2, "a"): (True, 0.2), (2, "b"): (True, 0.7)}
    assert fe.last_frame_only(frames).count() == 2
    made, lost = fe.examples(days, spark.createDataFrame([("c", "s59", 1.0, dt.datetime(2026, 1, 6, 9), day(0), day(0)), ("c", "zz", 1.0, NOW, NOW, NOW)], "company_id string, snapshot_id string, label double, as_of timestamp, outcome_end timestamp, available_at timestamp"), 2)
    assert made.first().frames == ["s49", "s59"] and lost.count() == 1


MODEL = "id string, data_basis string, schema_ok boolean, basis_ok boolean, ablation string, lineage_ok boolean, steps int, train_n int, train_positives int, validation_n int, validation_positives int, test_n int, test_positives int, validation_brier double, constant_brier double, trained_at timestamp, is_active boolean"


def test_models(spark):
    good = ("m1", "real", True, True, "full", True, 4, 90, 40, 30, 10, 30, 10, 0.1, 0.2, NOW, True)
    bad = ("m2", "real", True, True, "full", True, 4, 90, 40, 30, 10, 30, 10, 0.3, 0.2, NOW, False)
    small = ("m3", "real", True, True, "no_news", True, 4, 9, 4, 3, 1, 3, 1, 0.1, 0.2, NOW, False)
    models = spark.createDataFrame([good, bad, small], MODEL)
    assert {r.id: r.reason for r in mo.models_view(models, "real").collect()} == {"m1": None, "m2": "no better than a constant", "m3": "not the full model"}
    assert [r.id for r in mo.activate(models, "m1").where("is_active").collect()] == ["m1"]
    with pytest.raises(ValueError, match="not eligible"):
        mo.activate(models, "m2")
    rng = random.Random(3)
    rows = [(["train", "validation", "test"][i % 5 % 3], int(x > 0.5), x, rng.random()) for i in range(200) for x in [rng.random()]]
    data = spark.createDataFrame(rows, "split string, y int, news_value double, ais_value double").selectExpr("*", "0.0 as satellite_value", "0.0 as viirs_value")
    runs, model = mo.fit_and_select(data, ["news_value", "ais_value"], architectures=("logistic",), ablations=("full", "no_news"))
    f1 = {r.ablation: r.f1 for r in runs.where("split = 'test'").collect()}
    assert f1["full"] > 0.9 > f1["no_news"]
    report = mo.experiment_report(runs)
    assert report.where("recommended").count() == 1
    nodes = data.withColumn("id", F.monotonically_increasing_id().cast("string"))
    evidence = spark.createDataFrame([("0", 2)], "company_id string, evidence_count long")
    scored = mo.score_current(model, nodes, evidence, "m1", "snap", "real", now())
    assert scored.count() == 1 and 0 <= scored.first().score <= 1
    inputs = mo.observed_inputs(companies(spark), spark.createDataFrame([("a", 0.8)], "company_id string, severity double"), spark.createDataFrame([("a",), ("b",)], "id string"))
    assert {r.id: (r.severity, r.missing) for r in inputs.collect()} == {"a": (0.8, False), "b": (0.0, True)}


# --- text extraction -------------------------------------------------------------------------


def test_entities(spark):
    names = spark.createDataFrame([("1", "Test Materials Corp."), ("2", "Test Materials Ltd."), ("3", "Test Assembly Inc."), ("4", "Northern Logistics")], "cik string, name string")
    say = lambda *m: spark.createDataFrame([(x,) for x in m], "mention string")
    got = {r.mention: r.cik for r in ex.resolve(say("Test Materials", "Test Assembly, Inc.", "Northern Logistic", "Nothing alike"), names).collect()}
    assert got == {"Test Assembly, Inc.": "3", "Northern Logistic": "4"}
    scored = {r.mention: round(r.confidence, 4) for r in ex.resolve(say("Test Assembly, Inc.", "Northern Logistic"), names).collect()}
    assert scored == {"Test Assembly, Inc.": 1.0, "Northern Logistic": 0.9714}
    # Two aliases of one company close together: no clear winner.
    assert ex.resolve(say("Alpha Beta Gamma Delt C"), spark.createDataFrame([("5", "Alpha Beta Gamma Delta Co")], "cik string, name string")).count() == 0
    ratio = spark.createDataFrame([("kitten", "sitting"), ("", ""), ("abc", "abc")], "a string, b string").select(ex.indel_ratio("a", "b").alias("r")).collect()
    assert [round(r.r, 4) for r in ratio] == [61.5385, 100.0, 100.0]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("We purchase components from Test Materials Corp.", ("2", "1")),
        ("We supply components to Test Materials Corp.", ("1", "2")),
        ("We may purchase components from Test Materials Corp.", None),
        ("We no longer purchase parts from Test Materials Corp.", None),
        ("Test Materials Corp. is a competitor that sells similar goods.", None),
        ("Test Materials Corp provides logistics services to our plants.", ("2", "1")),
        ("we purchase components from test materials corp.", ("2", "1")),
    ],
)
def test_supplier_mentions(spark, text, want):
    names = spark.createDataFrame([("1", "Test Assembly Inc."), ("2", "Test Materials Corp.")], "cik string, name string")
    filing = spark.createDataFrame([("d", "1", "Hello there. " + text)], "doc_id string, filer_cik string, text string")
    got = [(r.supplier_cik, r.customer_cik) for r in ex.supplier_mentions(filing, names).where("status = 'pending' and confidence = 0.95").collect()]
    assert got == ([want] if want else [])
    long = spark.createDataFrame([("d", "1", "We know suppliers " + "x " * 950 + "and we buy parts from Test  Materials, Corp.")], "doc_id string, filer_cik string, text string")
    assert "Test  Materials, Corp" in ex.supplier_mentions(long, names).first().evidence
    typo = spark.createDataFrame([("d", "1", "We purchase components from Test Material Corp.")], "doc_id string, filer_cik string, text string")
    assert ex.supplier_mentions(typo, names.union(spark.createDataFrame([("9", "Unlike Name")], "cik string, name string"))).first().confidence == round(0.95 * 36 / 37, 4)
    rows = ex.filing_evidence(filing, ex.supplier_mentions(filing, names)).first()
    assert rows.candidates == len(got) and len(rows.text_sha256) == 64


def test_events_relevance_and_signals(spark):
    titles = spark.createDataFrame([(1, "Test Assembly workers strike", [1.0, 0.0]), (2, "Test Assembly avoids strike", [1.0, 0.0]), (3, "Test Assembly announces dividend", [1.0, 0.0]), (4, "flood and strike", [0.0, 1.0])], "id int, title string, vector array<double>")
    vectors = spark.createDataFrame([("strike", [1.0, 0.0]), ("natural_disaster", [0.0, 1.0])], "event_type string, vector array<double>")
    got = {r.id: (r.event_type, r.severity) for r in ex.classify_events(titles, vectors).collect()}
    assert got == {1: ("strike", 0.7), 2: ("other", None), 3: ("other", None), 4: ("natural_disaster", 0.8)}
    pairs = titles.selectExpr("title", "'Test Assembly Inc.' as name", "vector as title_vector", "array(1.0d, 0.0d) as name_vector")
    assert [r.relevance for r in ex.relevance(pairs).orderBy("title").collect()] == [1.0, 1.0, 1.0, 0.0]
    news = spark.createDataFrame([("c", "https://u", "T", 0.9, "strike", 0.7, NOW), ("c", "https://v", "T", 0.1, "strike", 0.7, NOW)], "company_id string, url string, title string, relevance double, event_type string, severity double, seen_at timestamp")
    assert ex.news_evidence(news).count() == 1
    context = ex.context_rows(news.selectExpr("'t' as topic", "url", "title", "seen_at")).first()
    assert json.loads(context.extracted)["origin"] == "geopolitical_context"
    metric = spark.createDataFrame([("l", "m1", "d1", 0.5), ("l", "m1", "d2", 0.5), ("l", "m2", "d1", 0.5)], "location string, month string, downloaded_at string, v double")
    ids = [r.id for r in ex.sensor_observations(metric, ["location", "month"]).collect()]
    assert ids[0] == ids[1] != ids[2]


# --- streams -------------------------------------------------------------------------------------


def test_streams(spark, tmp_path):
    rows = [(f"e{i % 8}", dt.datetime(2024, 1, 1 + i % 3, i % 24), i % 4, NOW + dt.timedelta(seconds=i)) for i in range(24)]
    schema = "id string, at timestamp, mmsi int, ingested_at timestamp"
    spark.createDataFrame(rows, schema).repartition(2).write.parquet(f"{tmp_path}/in")
    stream = lambda: jobs.landed(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema)
    jobs.once(jobs.distinct_events(stream(), "id", "at", "30 days"), f"{tmp_path}/out", f"{tmp_path}/c1").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 8
    for k in (1, 2):
        merge = jobs.merge_new(f"{tmp_path}/merged")
        stream().writeStream.foreachBatch(merge).option("checkpointLocation", f"{tmp_path}/m{k}").trigger(availableNow=True).start().awaitTermination()
    merged = spark.read.parquet(f"{tmp_path}/merged")
    assert merged.count() == 8 and merged.where("id = 'e0'").first().ingested_at == NOW
    late = jobs.daily_vessels(stream(), late="0 seconds")
    assert late.isStreaming and jobs.window_volume(stream(), "at").isStreaming
    both = jobs.quarantined(f"{tmp_path}/bad", f"{tmp_path}/good")
    for _ in range(2):  # a batch that is run again changes nothing
        both(spark.createDataFrame([("a", None), ("b", "why"), ("c", None)], "id string, reason string"), 0)
    both(spark.createDataFrame([("d", None)], "id string, reason string"), 1)
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/bad").collect()] == [("b", "why", 0)]
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/good").collect()) == ["a", "c", "d"]


def test_references_are_read_in_spark(spark):
    """f4: as html.unescape, whatever stands after an &; no page goes through Python."""
    import html as entities
    import random

    rng = random.Random(11)
    parts = ["&", "&amp", "&amp;", "&ampx", "&notit;", "&notin;", "&#38", "&#x26;", "&#0;", "&#13;", "&#128;", "&#x81;", "&#11;", "&#xD800;", "&#xFDD0;", "&#x1FFFE;", "&#x10FFFF;", "&#x110000;", "&#99999999999999999999;", "&#xFEFF;", "&#x1F600;", "&#0000065;", "&#xffg", "&#", "&#x;", "&acE;", "&NotEqualTilde;", "&b=2", "é", "😀", ";", " ", "x", "<", "#", "\\", "$1", "&CounterClockwiseContourIntegral;", "&eacutes"]
    texts = ["", "&", "plain", *parts, *("".join(rng.choice(parts) for _ in range(rng.randint(2, 12))) for _ in range(400)), *(f"&#{n};" for n in range(200)), *(f"&{n}" for n in entities.entities.html5)]
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "h string").select("h", ft.unescaped(F.col("h")).alias("t"))
    assert "Python" not in rows._jdf.queryExecution().toString()
    assert {r.h: r.t for r in rows.collect()} == {t: entities.unescape(t) for t in texts} | {None: None}


def test_page_text_of_cut_references(spark, tmp_path):
    """f4: titles that are cut within a reference, as the query's SQL has them."""
    import duckdb

    from quaylight.plans.queries import QUERIES, SQL

    cuts = ["&", "&a", "&am", "&amp", "&quo", "&quot", "&q", "&copy", "&middo", "&middot", "&nbsp", "&lt", "&gt", "&#39", "&#3", "&#", "&ampx", "&quotx", "&amp; &quot; &lt; &gt; &copy; &middot; &#39;"]
    rows = [(i, f"<title>of {c}</title><p>{'word ' * 80}{c} {c}</p>") for i, c in enumerate(cuts)]
    spark.createDataFrame(rows, "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = sorted(duck.execute(SQL["f4_page_text"]).fetchall())
    assert sorted(tuple(r) for r in QUERIES["f4_page_text"](spark, str(tmp_path)).collect()) == want and len(want) == len(cuts)
    assert one(spark, ft.unescaped(F.col("h")), h="&quot &#39") == "\" '"
