"""Streams over several micro-batches: cursors, restarts, replays, late rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quaylight.streaming import windows

DAY = windows.DAY
START = 1_700_000_000_000_000


def articles(seed: int, n: int, days: int) -> list[tuple]:
    rng = random.Random(seed)
    return [(rng.choice("ab"), f"u{rng.randint(0, n // 3)}", START + rng.randint(0, days * DAY - 1), f"t{i}") for i in range(n)]


def expected(rows: list[tuple], cuts: list[tuple[int, int]], full: int) -> set[tuple]:
    """One window after another, as a plain loop."""
    found: dict = {}
    for start, until in cuts:
        at = start
        while at < until:
            end = min(at + DAY, until)
            for topic in sorted({r[0] for r in rows}):
                inside = [r for r in rows if r[0] == topic and at <= r[2] < end]
                for r in sorted(inside, key=lambda r: (-r[2], r[3])):
                    found.setdefault((topic, r[1]), (topic, r[1], r[2], r[3], at, end, len(inside) >= full))
            at = end
    return set(found.values())


def read(spark, path: str) -> list[tuple]:
    us = [F.unix_micros(c) for c in ("seen_at", "window_start", "window_end")]
    return [tuple(r) for r in spark.read.parquet(path).select("topic", "url", us[0], "title", us[1], us[2], "saturated").collect()]


@pytest.mark.parametrize("stops", [[9], [3, 9], [2.5, 2.5, 9]])
def test_windows_go_on_from_their_cursor(spark, tmp_path, stops):
    """Stopped and started again, with more time each run; the last run goes past the last article."""
    rows = articles(1, 300, 8)
    df = spark.createDataFrame(rows, "topic string, url string, us long, title string").select("topic", "url", F.timestamp_micros("us").alias("seen_at"), "title")
    df.write.parquet(f"{tmp_path}/landed")
    cuts, at, batches = [], START, 0
    for stop in stops:
        until = START + int(stop * DAY)
        job = windows.follow_windows(spark, lambda s: s.read.parquet(f"{tmp_path}/landed"), f"{tmp_path}/out", f"{tmp_path}/state", START, until, per_batch=2, full=20)
        job.processAllAvailable()
        batches = job.lastProgress.batchId if job.lastProgress else batches
        job.stop()
        cuts.append((at, until))
        at = max(at, until)
    got = read(spark, f"{tmp_path}/out")
    assert len(got) == len(set(got)) and set(got) == expected(rows, cuts, 20)
    assert batches >= 4 and {r[-1] for r in got} == {True, False}


def test_a_batch_that_is_run_again_changes_nothing(spark, tmp_path):
    rows = articles(2, 60, 4)
    df = spark.createDataFrame(rows, "topic string, url string, us long, title string").select("topic", "url", F.timestamp_micros("us").alias("seen_at"), "title")
    write = windows.window_sink(lambda _: df, f"{tmp_path}/out", 5)
    asked = lambda a, b: spark.createDataFrame([(START + i * DAY, START + (i + 1) * DAY) for i in range(a, b)], "a long, b long").select(F.timestamp_micros("a").alias("window_start"), F.timestamp_micros("b").alias("window_end"))
    write(asked(0, 2), 0)
    write(asked(2, 4), 1)
    before = sorted(read(spark, f"{tmp_path}/out"))
    write(asked(2, 4), 1)
    assert sorted(read(spark, f"{tmp_path}/out")) == before and set(before) == expected(rows, [(START, START + 4 * DAY)], 5)
    write(asked(0, 0), 2)
    assert sorted(read(spark, f"{tmp_path}/out")) == before


def test_activity_equals_the_batch_version(spark, tmp_path):
    """Landed in pieces, out of order within the watermark; days that are missing, short, and of two areas."""
    from quaylight.operators import sensors as se
    from quaylight.streaming import activity

    rng = random.Random(5)
    rows = []
    for d in range(16):
        for area in ("east", "west"):
            if (area, d) == ("west", 8):
                continue  # a missing day
            hours = 3 if (area, d) == ("east", 12) else 20
            rows += [(area, (START // DAY + d) * DAY + rng.randint(0, hours * 3_600_000_000), 100 + rng.randint(0, 9 + d), rng.choice([0.2, 3.0, None])) for _ in range(40)]
    schema = "area string, at timestamp, mmsi long, sog double"
    rows.sort(key=lambda r: r[1] + rng.randint(0, DAY // 3))
    landed = f"{tmp_path}/landed"
    made = lambda part: spark.createDataFrame(part, "area string, us long, mmsi long, sog double").select("area", F.timestamp_micros("us").alias("at"), "mmsi", "sog")
    cut = len(rows) // 3
    for part in (rows[:cut], rows[cut : 2 * cut], rows[2 * cut :]):
        made(part).coalesce(1).write.mode("append").parquet(landed)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(landed)
        job = activity.follow_activity(stream, f"{tmp_path}/out", f"{tmp_path}/state", before=3)
        job.awaitTermination()
    got = {(r.area, r.day): r for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    whole = made(rows)
    last = {area: max(d for a, d in got if a == area) for area in ("east", "west")}
    checked = 0
    for area in ("east", "west"):
        daily = se.daily_activity(whole.where(F.col("area") == area))
        ratio = {r.target: r for r in se.activity_ratio(daily, daily.select(F.col("day").alias("target")), 3).collect()}
        for d in daily.collect():
            if d.day > last[area]:
                continue  # not passed by the watermark yet
            r = got[area, d.day]
            assert (r.vessels, r.positions, round(r.hours, 9), r.slow_share) == (d.vessels, d.positions, round(d.hours, 9), d.slow_share)
            assert (r.usable_vessels, r.ratio, r.error) == (ratio[d.day].vessels, ratio[d.day].ratio, ratio[d.day].error)
            checked += 1
    assert checked == len(got) >= 24 and any(r.ratio for r in got.values()) and any(r.error for r in got.values())


def test_activity_keeps_few_states(spark, tmp_path):
    """r5: state partitions follow the cores, not the shuffles of the session, whose settings are put back; both runs give each day once."""
    from quaylight.streaming import activity

    shuffles, provider = "spark.sql.shuffle.partitions", "spark.sql.streaming.stateStore.providerClass"
    was, store = spark.conf.get(shuffles), spark.conf.get(provider)
    spark.conf.set(shuffles, "32")
    try:
        for days in (range(0, 6), range(6, 12)):
            rows = [(f"a{i % 5}", (START // DAY + d) * DAY + i * DAY // 50, i, 0.5) for d in days for i in range(50)]
            spark.createDataFrame(rows, "area string, us long, mmsi long, sog double").select("area", F.timestamp_micros("us").alias("at"), "mmsi", "sog").coalesce(1).write.mode("append").parquet(f"{tmp_path}/landed")
            stream = spark.readStream.schema("area string, at timestamp, mmsi long, sog double").parquet(f"{tmp_path}/landed")
            activity.follow_activity(stream, f"{tmp_path}/out", f"{tmp_path}/state", before=3).awaitTermination()
        assert spark.conf.get(shuffles) == "32" and spark.conf.get(provider) == store
    finally:
        spark.conf.set(shuffles, was)
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    first = min(r.day for r in got)
    assert sorted((r.area, (r.day - first).days, r.vessels, r.positions) for r in got) == [(f"a{k}", d, 10, 10) for k in range(5) for d in range(10)]
    assert all((r.ratio == 1.0) == ((r.day - first).days >= 3) for r in got)
    states = [p for p in tmp_path.glob("state/**/state/*/*") if p.name.isdigit()]
    assert 0 < len(states) <= 8 + activity.FEW


def test_days_of_a_batch_are_written_once(spark, tmp_path):
    """A batch that is run again takes the place of its folder; vessels without a number count as positions only."""
    from quaylight.streaming import activity

    at = lambda us: (us, us + DAY)
    rows = [(at(START), "x", 1, 2, 5, 9, 1, 2), (at(START), "x", None, 3, 4, 8, 0, 0), (at(START), None, 1, 1, 6, 6, 0, 1)]
    made = spark.createDataFrame([(*w, *r) for w, *r in rows], "s long, e long, area string, mmsi long, positions long, first long, last long, slow long, known long")
    batch = made.select(F.struct(F.timestamp_micros("s").alias("start"), F.timestamp_micros("e").alias("end")).alias("w"), *made.columns[2:])
    for _ in range(2):
        activity.keep_days(f"{tmp_path}/days")(batch, 0)
    got = spark.read.schema(activity.DAYS).option("recursiveFileLookup", True).parquet(f"{tmp_path}/days")
    assert {tuple(r) for r in got.select("area", F.unix_micros("at"), *got.columns[2:]).collect()} == {("x", START, 1, 5, 4, 9, 1, 2), (None, START, 1, 1, 6, 6, 0, 1)} and got.count() == 2


def test_an_earlier_checkpoint_is_refused(spark, tmp_path):
    from quaylight.streaming import activity

    (tmp_path / "state/offsets").mkdir(parents=True)
    (tmp_path / "landed").mkdir()
    stream = spark.readStream.schema("area string, at timestamp, mmsi long, sog double").parquet(f"{tmp_path}/landed")
    with pytest.raises(RuntimeError, match="earlier form"):
        activity.follow_activity(stream, f"{tmp_path}/out", f"{tmp_path}/state")


def test_activity_of_nothing_landed(spark, tmp_path):
    from quaylight.streaming import activity

    (tmp_path / "landed").mkdir()
    stream = spark.readStream.schema("area string, at timestamp, mmsi long, sog double").parquet(f"{tmp_path}/landed")
    activity.follow_activity(stream, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert not list((tmp_path / "out").glob("*.parquet"))
