"""The evidence store in tables of hash buckets: the rules of operators.evidence, only touched buckets, replays and crashes."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quaylight.operators import evidence as ev
from quaylight.schemas import TS, S, schema
from quaylight.sources.evidence_tables import EvidenceTables

COMPANY = "id string, name string, cik string, industry string, country string"
RELATIONSHIP = schema(id=S, supplier_id=S, customer_id=S, source_signal_id=S, status=S, reviewed_at=TS)


@pytest.fixture
def store(spark, tmp_path):
    company = spark.createDataFrame([], COMPANY).schema
    return EvidenceTables(spark, f"{tmp_path}/s", {"companies": company, "relationships": RELATIONSHIP, "locations": schema(id=S, name=S)}, 4)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_profiles_equal_the_plain_merge(spark, store):
    there = spark.createDataFrame([(f"i{i}", f"n{i}", f"c{i}", "Energy", "US") for i in range(20)] + [("none", "no cik", None, "Other", "DE")], COMPANY)
    profiles = spark.createDataFrame([("c3", "New 3", "3571"), ("c7", "New 7", "20"), ("x1", "Fresh", "1311")], "cik string, name string, sic string")
    store.install({"companies": there})
    assert store.upsert_companies(profiles) > 0
    want = rows(ev.upsert_company(there, profiles).select("id", "name", "cik", "industry", "country"))
    assert rows(store.read("companies")) == want and len(want) == 22
    version = store.tables["companies"].version()
    odd = spark.createDataFrame([(None, "No cik", "1"), ("c3", None, None)], "cik string, name string, sic string")
    assert store.upsert_companies(profiles) == 0 and store.upsert_companies(odd) == 0  # a replay, and profiles that say nothing
    assert store.tables["companies"].version() == version and rows(store.read("companies")) == want


def test_a_crash_before_the_table_of_ciks(spark, store, monkeypatch):
    profiles = spark.createDataFrame([("x1", "Fresh", "1311")], "cik string, name string, sic string")
    with monkeypatch.context() as m:
        m.setattr(store, "_index", lambda rows: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            store.upsert_companies(profiles)
    was = rows(store.read("companies"))
    assert len(was) == 1 and store.upsert_companies(profiles) == 0 and rows(store.read("companies")) == was and store.by_cik.read().count() == 1


def test_a_catalog_inserts_and_replaces(spark, store):
    places = spark.createDataFrame([("a", "A"), ("b", "B"), (None, "no id")], "id string, name string")
    firms = spark.createDataFrame([("1", "One", "c1", "Other", "US"), ("1", "Other one", "c1", "Other", "US")], COMPANY)  # a repeated id: the least row
    assert store.install({"locations": places, "companies": firms})["locations"] > 0
    again = store.install({"locations": places.withColumn("name", F.lower("name")), "companies": firms.withColumn("name", F.lit("changed"))})
    assert again["companies"] == 0 and rows(store.read("locations")) == [("a", "a"), ("b", "b")] and [r.name for r in store.read("companies").collect()] == ["One"]
    assert store.install({"locations": places.limit(0)}) == {"locations": 0}


def test_reviews_stay_and_touch_their_buckets_only(spark, store):
    found = spark.createDataFrame([(f"s{i}", f"c{i}", f"g{i}") for i in range(40)] + [("s1", "c1", "g1")], "supplier_id string, customer_id string, source_signal_id string")
    store.save_relationships(found)
    table = store.tables["relationships"]
    assert table.read().count() == 40 and {r.status for r in table.read().collect()} == {"pending"}
    one, before, all_of = table.read().where("supplier_id = 's5'").first(), table.manifest(), table.read().collect()
    at = dt.datetime(2024, 1, 2)
    decisions = spark.createDataFrame([(one.id, "rejected", at), (one.id, "approved", dt.datetime(2024, 1, 1)), (one.id, "maybe", dt.datetime(2024, 1, 9)), ("unknown", "approved", at), (None, "approved", at)], "id string, status string, decided_at timestamp")
    want = rows(ev.review(spark.createDataFrame(all_of, RELATIONSHIP), decisions))
    assert store.review(decisions) == 1 and rows(table.read()) == want and [r.status for r in table.look_up([one.id]).collect()] == ["rejected"]
    assert sum(before[b] != f for b, f in table.manifest().items()) == 1
    version = table.version()
    assert store.review(decisions) == 0 and store.save_relationships(found) == 0 and table.version() == version
    assert table.meeting(decisions).count() == 1 and table.meeting(decisions.limit(0)).count() == 0
