"""Registered queries of streams that run in several micro-batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as fe
from ..session import shared_folder
from ..sources.buckets import BucketTable
from ..streaming import activity, jobs, windows
from .bindings import DAY, NOW
from .queries import MEASURED, query, r6

#: Windows begin at START; a first run asks up to STOP, in the middle of a day, a second one up to the end of January.
START, STOP, LAST, FULL = NOW - 19 * DAY, NOW - 19 * DAY + 10 * DAY + DAY // 2, NOW + 12 * DAY, 60
AT = f"(case when us < {STOP} then {START} else {STOP} end)"
WINDOWED = f"""r as (select id, 't' || (id % 4) as topic, 'https://news.example/' || (id % 997) as url, US[observed_at] as us from {{signals}}),
w as (select *, {AT} + (us - {AT}) // {DAY} * {DAY} as ws from r where us >= {START} and us < {LAST}),
x as (select *, least(ws + {DAY}, case when us < {STOP} then {STOP} else {LAST} end) as we from w),
c as (select topic, ws, count(*) >= {FULL} as saturated from x group by 1, 2)"""


@query(f"""with {WINDOWED} select topic, url, arg_min(id, (ws, -us, id)) as id, min(ws) as window_start_us, arg_min(we, (ws, -us, id)) as window_end_us, arg_min(saturated, (ws, -us, id)) as saturated
from x join c using (topic, ws) group by topic, url""")
def r2_cursor_windows(signals):
    """Daily windows asked by a stream that is stopped once and started again from its cursor."""
    spark, folder = signals.sparkSession, shared_folder(signals.sparkSession, "windows")
    rows = signals.select(F.concat(F.lit("t"), (F.col("id") % 4).cast("string")).alias("topic"), F.concat(F.lit("https://news.example/"), (F.col("id") % 997).cast("string")).alias("url"), F.col("observed_at").cast("timestamp").alias("seen_at"), F.lpad(F.col("id").cast("string"), 19, "0").alias("title"))
    rows.write.parquet(f"{folder}/landed")
    for until in (STOP, LAST):
        job = windows.follow_windows(spark, lambda s: s.read.schema(rows.schema).parquet(f"{folder}/landed"), f"{folder}/out", f"{folder}/state", START, until, per_batch=4, full=FULL)
        job.processAllAvailable()
        job.stop()
    got = spark.read.parquet(f"{folder}/out")
    return got.select("topic", "url", F.col("title").cast("long").alias("id"), F.unix_micros("window_start").alias("window_start_us"), F.unix_micros("window_end").alias("window_end_us"), "saturated")


#: Positions of three areas come in three landings; what is up to half a day older than the rest of a landing is within the watermark.
AREA = "'a' || (mmsi // 7 % 3)"
DAYS = f"""p as (select *, {AREA} as area, "at"::date as day from {{positions}}),
d as (select area, day, count(distinct mmsi) as vessels, count(*) as positions, (max(US["at"]) - min(US["at"])) / 3.6e9 as h, avg((sog < 1)::int) as slow from p group by 1, 2),
t as (select area, day as target, unnest(range(0, 8)) as back from d), m as (select t.area, target, back, vessels, h from t left join d on d.area = t.area and d.day = t.target - t.back::int),
s as (select area, target, max(case when back = 0 then vessels end) as own, median(case when back > 0 then vessels::double end) as b, sum((vessels is null or h < 4)::int) as bad from m group by 1, 2)"""


@query(f"""with {DAYS} select d.area, d.day::varchar as day, vessels, positions, round(h, 6) as hours, round(slow, 6) as slow_share,
case when bad = 0 then round(own / b, 6) end as ratio, case when bad > 0 then 'missing coverage' end as error
from d join s on s.area = d.area and s.target = d.day where d.day + 1 <= (select max("at") - interval 1 day from p)""")
def r5_stateful_activity(positions):
    """Vessels, hours, slow share and ratio of each area and day that the watermark has passed."""
    spark, folder = positions.sparkSession, shared_folder(positions.sparkSession, "activity")
    rows = positions.select(F.concat(F.lit("a"), (F.floor(F.col("mmsi") / 7) % 3).cast("string")).alias("area"), F.col("at").cast("timestamp").alias("at"), "mmsi", "sog")
    came = F.unix_micros("at") + (F.col("mmsi") % 5) * (DAY // 10)
    first, last = rows.agg(F.min(came), F.max(came)).first()
    for part in range(3):
        part_rows = rows.where(F.least(F.floor((came - first) * 3 / (last - first)), F.lit(2)) == part)
        part_rows.write.mode("append").parquet(f"{folder}/landed")
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/landed")
        activity.follow_activity(stream, f"{folder}/out", f"{folder}/state", before=7).awaitTermination()
    got = spark.read.schema(activity.ACTIVITY).parquet(f"{folder}/out")
    return got.select("area", F.col("day").cast("string").alias("day"), "vessels", "positions", r6("hours"), r6("slow_share"), r6("ratio"), "error")


#: Two landings of signals, by the time that they were ingested; snapshots of the end of each.
FIRST = NOW - 6 * DAY


def landed_twice(signals, after=lambda number, table: None) -> str:
    """Both landings through one stream that is started for each; `after` is called when one is in the table."""
    spark, folder = signals.sparkSession, shared_folder(signals.sparkSession, "late")
    known = F.unix_micros(F.col("ingested_at").cast("timestamp")) <= FIRST
    for number, part in enumerate((known, ~known)):
        signals.where(part).coalesce(1).write.mode("append").parquet(f"{folder}/landed")
        stream = jobs.landed(spark, f"{folder}/landed", signals.schema)
        stream.writeStream.foreachBatch(jobs.keep_late(f"{folder}/table")).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
        after(number, spark.read.parquet(f"{folder}/table"))
    return f"{folder}/table"


@query(f"select id, US[ingested_at] > {FIRST} and US[observed_at] < (select max(US[observed_at]) - {DAY} from {{signals}} where US[ingested_at] <= {FIRST}) as late from {{signals}}")
def r4_late_rows(signals):
    """Every row is kept; those of the second landing that the watermark of the first has passed are late."""
    return signals.sparkSession.read.parquet(landed_twice(signals)).select("id", "late")


def known_sql(at: int) -> str:
    """Values and counts of news of the real companies at a time, in SQL."""
    measured = MEASURED.replace(str(NOW), str(at))
    values = "max(case when source_type = 'news' then value end)", "max(case when source_type = 'news' then count end)"
    return f"""select {at} as as_of_us, c.id, coalesce(round(v, 6), 0) as news_value, coalesce(round(k, 6), 0) as news_count from {{companies}} c
      left join (with {measured} select company_id, {values[0]} as v, {values[1]} as k from f group by 1) f on f.company_id = c.id where not c.is_synthetic and US[c.created_at] <= {at}"""


@query(f"{known_sql(FIRST)} union all {known_sql(NOW)}")
def r4_late_snapshots(signals, companies, relationships, links):
    """Snapshots of both landings' ends. The first is recorded again once the late rows are in: its content id is the same, so nothing is written."""
    path = shared_folder(signals.sparkSession, "snapshots")
    at = lambda us: F.timestamp_micros(F.lit(us))

    def record(number: int, table) -> None:
        for us in (FIRST, NOW)[: number + 1]:
            fe.record_snapshot(companies, table.drop("late", "batch"), relationships, links, at(us), path, most=10_000_000)

    landed_twice(signals, record)
    got = signals.sparkSession.read.parquet(path)
    return got.select(F.unix_micros("as_of").alias("as_of_us"), "id", r6("news_value"), r6("news_count"))


@query("select id, round(severity, 6) as severity from {signals}")
def r3_bucket_merge(signals):
    """Replays of all files into a table of buckets: the first row of a key stays, and the second run writes nothing."""
    spark, folder = signals.sparkSession, shared_folder(signals.sparkSession, "buckets")
    rows = signals.select("id", "severity", "ingested_at")
    later = rows.select("id", (F.col("severity") + 1).alias("severity"), (F.col("ingested_at") + F.expr("interval 1 hour")).alias("ingested_at"))
    rows.unionByName(later).write.parquet(f"{folder}/landed")
    table = BucketTable(spark, f"{folder}/table", rows.schema, "id", 8)
    for run in range(2):
        stream = jobs.landed(spark, f"{folder}/landed", rows.schema)
        stream.writeStream.foreachBatch(jobs.merge_buckets(table)).option("checkpointLocation", f"{folder}/state{run}").trigger(availableNow=True).start().awaitTermination()
    return table.read().select("id", r6("severity"))


@query("select id, case when id % 3 = 0 then 'moved' else name end as name, id % 2 = 1 or id % 3 = 0 as is_synthetic from {companies}")
def j17_bucket_upsert(companies):
    """A table of buckets after three upserts, of which the last one repeats the second."""
    spark = companies.sparkSession
    rows = companies.select("id", "name", (F.col("id") % 2 == 1).alias("is_synthetic"))
    moved = rows.where("id % 3 = 0").select("id", F.lit("moved").alias("name"), F.lit(True).alias("is_synthetic"))
    table = BucketTable(spark, shared_folder(spark, "companies"), rows.schema, "id", 8)
    for part in (rows, moved, moved):
        table.upsert(part)
    return table.read()
