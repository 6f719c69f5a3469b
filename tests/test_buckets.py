"""Merges that touch only their buckets, switch at once, and survive a crash."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quaylight.sources.buckets import BucketTable


def made(spark, ids, value="v"):
    return spark.createDataFrame([(i, f"{value}{i}") for i in ids], "id long, v string")


def rows(df):
    return sorted((r.id, r.v) for r in df.collect())


@pytest.fixture
def table(spark, tmp_path):
    return BucketTable(spark, f"{tmp_path}/t", made(spark, []).schema, "id", 8)


def test_inserts_touch_their_buckets_only(spark, table):
    assert table.read().count() == 0 and table.insert(made(spark, [])) == 0 and table.version() == 0
    table.insert(made(spark, range(100)))
    before = table.manifest()
    assert len(before) == 8 and rows(table.read()) == [(i, f"v{i}") for i in range(100)]
    assert table.insert(made(spark, range(100), "other")) == 0  # a replay
    assert table.manifest() == before and table.version() == 1 and table.clean() == []
    assert table.insert(made(spark, [5, 1000])) == 1
    changed = [b for b, f in table.manifest().items() if before.get(b) != f]
    own = spark.range(1000, 1001).select(table.bucket(F.col("id")).alias("b")).first().b
    assert changed == [own] and table.manifest()[own][:1] == before[own]  # added to, not written anew
    assert rows(table.read()) == [(i, f"v{i}") for i in [*range(100), 1000]]
    assert table.read(version=1).count() == 100  # readers of the version before


def test_upserts_write_changed_buckets_anew(spark, table):
    table.upsert(made(spark, range(50)))
    before = table.manifest()
    assert table.upsert(made(spark, range(50))) == 0 and table.manifest() == before
    nulls = spark.createDataFrame([(7, None), (None, "gone")], "id long, v string")
    assert table.upsert(nulls) == 1 and table.upsert(nulls) == 0
    want = [(i, f"v{i}" if i != 7 else None) for i in range(50)]
    assert sorted((r.id, r.v) for r in table.read().collect()) == want
    assert sum(before[b] != f for b, f in table.manifest().items()) == 1


def test_a_crash_before_the_switch_changes_nothing(spark, table, monkeypatch):
    table.insert(made(spark, range(20)))
    before = rows(table.read())

    def crash(*_):
        raise RuntimeError("lost the driver")

    with monkeypatch.context() as m:
        m.setattr(table, "_switch", crash)
        for merge in (table.insert, table.upsert):
            with pytest.raises(RuntimeError):
                merge(made(spark, range(10, 40), "w"))
    assert rows(table.read()) == before and table.version() == 1
    left = table.clean()
    assert len(left) == 3 and rows(table.read()) == before
    table.upsert(made(spark, range(10, 40), "w"))
    assert rows(table.read()) == [(i, f"{'v' if i < 10 else 'w'}{i}") for i in range(40)]


def test_a_second_writer_is_noticed(spark, table):
    table.insert(made(spark, range(5)))
    with pytest.raises(RuntimeError, match="another merge"):
        table._switch(0, {})
    assert rows(table.read()) == [(i, f"v{i}") for i in range(5)]


def test_many_inserts_are_compacted_and_looked_up(spark, table):
    for k in range(10):
        table.insert(made(spark, range(k * 10, k * 10 + 10)))
    assert max(map(len, table.manifest().values())) <= 9 and table.read().count() == 100
    assert rows(table.look_up([3, 97, 500])) == [(3, "v3"), (97, "v97")]
    assert "PushedFilters: [In(id" in table.look_up([3, 97])._jdf.queryExecution().executedPlan().toString()
