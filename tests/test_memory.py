"""Steps whose tasks must not grow with the tables: as many partitions as the input's files ask for, which are not merged."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quaylight import session
from quaylight.operators import evidence as ev
from quaylight.plans.bindings import bound
from quaylight.sources.buckets import BucketTable

RELATIONSHIPS = "id long, supplier_id long, customer_id long, source_signal_id long, status string, reviewed_at timestamp"


@pytest.fixture
def many(spark, tmp_path, monkeypatch):
    """Relationships in files of some kilobytes, where a task's share is one."""
    monkeypatch.setattr(session, "SHARE", 1 << 10, raising=False)
    spark.range(3000).selectExpr("id", "id % 40 as supplier_id", "id % 70 as customer_id", "id % 90 as source_signal_id", "'approved' as status", "cast(null as timestamp) as reviewed_at").write.parquet(f"{tmp_path}/rows")
    return spark.read.schema(RELATIONSHIPS).parquet(f"{tmp_path}/rows")


def tasks(df) -> int:
    """How many partitions have rows."""
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_partitions_follow_the_files(spark, many):
    n = session.parts(many, many)
    assert n == session.parts(many) and n > 8 and session.parts(spark.range(3)) == 4


def test_found_relationships_are_dealt(spark, many):
    """k3: what is inserted is met by the key in tasks of a bounded share."""
    there = many.where("id % 2 = 0")
    got = ev.insert_only(there, many)
    assert got.count() == 3000 and tasks(got.where("id % 2 = 1")) > 8


def test_reviews_are_dealt(spark, many):
    """k4: the last decision counts; those on what is not there have none."""
    decided = many.selectExpr("id + 1500 as id", "if(id % 2 = 0, 'rejected', 'pending') as status", "timestamp '2024-01-01' as decided_at")
    got = ev.review(many, decided)
    assert tasks(got) > 8 and got.where("status = 'rejected'").count() == 750 and got.count() == 3000


def test_joined_lines_are_dealt(spark, monkeypatch):
    """q4 and all others on relationships: the join of lines and orders."""
    monkeypatch.setattr(session, "SHARE", 1 << 13, raising=False)
    assert tasks(bound(spark, "/root/testdata/sf0.001", "relationships").select("id", "status")) > 8


def test_pairs_are_counted_in_shares(spark, many):
    """a27: partial counts come from many tasks, which their shuffle's rows show."""
    one = spark.range(3).select("id")
    got = ev.graph_counts(one, one, many)
    assert tuple(got.first()) == (3, 3, 280)
    assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().toString()


def test_purged_rows_are_counted_in_one_pass(spark):
    """k5: equal to counting what is left, with null and repeated keys and a null basis."""
    companies = spark.createDataFrame([(1, True), (1, True), (2, False), (3, True), (None, True), (4, None)], "id long, is_synthetic boolean")
    signals = spark.createDataFrame([(1, 1), (2, None), (3, 2), (4, 3), (5, 9)], "id long, company_id long")
    relationships = spark.createDataFrame([(1, 1, 3), (2, 2, 1), (3, None, 2), (4, 2, 2), (5, 3, None)], "id long, supplier_id long, customer_id long")
    scores = spark.createDataFrame([(1, 2, "observed"), (2, 1, "observed"), (3, 2, "simulated"), (4, 2, None), (5, None, "observed")], "id long, company_id long, input_basis string")
    tables = {"companies": companies, "signals": signals, "relationships": relationships, "risk_scores": scores}
    left, counts = ev.purge(tables, "observed")
    assert {r.table: r.removed for r in counts.collect()} == {n: tables[n].count() - left[n].count() for n in tables}
    assert counts.where("removed > 0").count() == 4
    assert "REPARTITION_BY_NUM" in counts._jdf.queryExecution().toString()


def test_merges_set_rows_and_columns(spark, many, tmp_path, monkeypatch):
    """k4_reviewed_tables: merges with small filters; `update` sets columns of the rows that are there."""
    table = BucketTable(spark, f"{tmp_path}/t", many.schema, "id", 2)
    assert table.insert(many) == 2
    files = [f for fs in table.manifest().values() for part in fs for f in (tmp_path / "t/data" / part).glob("*.parquet")]
    assert files and max(f.stat().st_size for f in files) < 1 << 18
    monkeypatch.setattr(session, "SHARE", 1 << 18)  # filters make such small files large
    assert table.upsert(many.where("id < 1500").withColumn("status", F.lit("rejected"))) == 2
    assert table.read().count() == 3000 and table.read().where("status = 'rejected'").count() == 1500
    assert table.update(many.selectExpr("id + 2990 as id", "'new' as status"), lambda dealt: dealt) == 2 and table.read().count() == 3000
    assert table.read().where("status = 'new' and source_signal_id is not null").count() == 10
    assert table.update(many.selectExpr("id + 2990 as id", "'new' as status"), lambda dealt: dealt) == 0


def test_a_table_of_another_hash_is_refused(spark, many, tmp_path):
    table = BucketTable(spark, f"{tmp_path}/t", many.schema, "id", 2)
    table._switch(0, {0: ["tag/_bucket=0"]})
    with pytest.raises(RuntimeError, match="another hash"):
        table.insert(many)
