"""Vessel activity of each area and day on an unbounded stream, with its ratio to the days before."""

from __future__ import annotations

from collections.abc import Iterator
from statistics import median

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from .jobs import stateful, stores

ACTIVITY = "area string, day date, vessels long, positions long, hours double, slow_share double, usable_vessels long, ratio double, error string"
DAYS = "area string, at timestamp, vessels long, positions long, first long, last long, slow long, known long"
DAY_MS = 86_400_000
#: State partitions of the second job, which gets one row of an area and day.
FEW = 4


def vessel_days(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """(w, area, mmsi, positions, first, last, slow, known) of each vessel, area and UTC day that the watermark has passed, from positions (area, at, mmsi, sog). Rows later than `late` are gone."""
    us = F.unix_micros("at")
    slow = F.coalesce((F.col("sog") < 1).cast("long"), F.lit(0))
    kept = stream.withWatermark("at", late)
    return kept.groupBy(F.window("at", "1 day").alias("w"), "area", "mmsi").agg(F.count("*").alias("positions"), F.min(us).alias("first"), F.max(us).alias("last"), F.sum(slow).alias("slow"), F.count("sog").alias("known"))


def day_totals(vessels: DataFrame) -> DataFrame:
    """DAYS (`at` begins the day) of all vessels of some days. A busy area is spread over its vessels, of which only one row for each day meets here."""
    day = vessels.groupBy("w", "area").agg(F.count("mmsi").alias("vessels"), F.sum("positions").alias("positions"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("slow").alias("slow"), F.sum("known").alias("known"))
    return day.select("area", F.col("w.start").alias("at"), "vessels", "positions", "first", "last", "slow", "known")


def keep_days(path: str):
    """A foreachBatch sink of `vessel_days`: totals of the days that a batch ends.

    All vessels of a day leave the stream in the batch whose watermark passes its end, so their sum
    needs no state. A batch is a folder, overwritten when it is run again.
    """

    def write(batch: DataFrame, number: int) -> None:
        day_totals(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


class Activity(StatefulProcessor):
    """Keeps each area's last days (vessels and hours) and gives every finished day with its ratio, or an error where a day before it is missing or short.

    Finished days come in order over batches, and are sorted within one. An area that stays silent
    for longer than the days that count is forgotten by a timer.
    """

    def __init__(self, before: int, least_hours: float):
        self.before, self.least_hours = before, least_hours

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.days = handle.getMapState("days", "day int", "vessels long, hours double")
        self.newest = handle.getValueState("newest", "day int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came = pd.concat(list(rows)).sort_values("at")  # a day is one row
        out = []
        kept = {k[0]: v for k, v in self.days.iterator()}
        for r in came.itertuples():
            day = int(r.at.value // 1000 // (DAY_MS * 1000))
            hours = (r.last - r.first) / 3.6e9
            kept[day] = int(r.vessels), float(hours)
            self.days.updateValue((day,), kept[day])
            for old in [d for d in kept if d < day - self.before]:
                self.days.removeKey((old,))
                del kept[old]
            span = [kept.get(day - back) for back in range(self.before + 1)]
            good = all(v is not None and v[1] >= self.least_hours for v in span)
            usual = median(v[0] for v in span[1:]) if good else None
            out.append((key[0], (pd.Timestamp(0) + pd.Timedelta(days=day)).date(), r.vessels, r.positions, hours, r.slow / r.known if r.known else None, r.vessels if good else None, r.vessels / usual if usual else None, None if good else "missing coverage"))
            if not self.newest.exists() or self.newest.get()[0] < day:
                self.newest.update((day,))
                self.handle.registerTimer((day + self.before + 2) * DAY_MS)
        made = pd.DataFrame(out, columns=[c.split()[0] for c in ACTIVITY.split(", ")])
        made["usable_vessels"] = made["usable_vessels"].astype("Int64")
        yield made

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        newest = self.newest.get() if self.newest.exists() else None
        if newest and (newest[0] + self.before + 2) * DAY_MS <= expiredTimerInfo.getExpiryTimeInMs():
            self.days.clear()
            self.newest.clear()
        return iter([])

    def close(self) -> None:
        pass


def activity(days: DataFrame, before: int = 7, least_hours: float = 4.0) -> DataFrame:
    """ACTIVITY of each area and day of a stream of DAYS, whose later batches bring later days."""
    if not 3 <= before <= 30:
        raise ValueError("3 to 30 days")
    return days.withWatermark("at", "0 seconds").groupBy("area").transformWithStateInPandas(Activity(before, least_hours), ACTIVITY, "Append", "EventTime")


def follow_activity(stream: DataFrame, path: str, checkpoint: str, before: int = 7, least_hours: float = 4.0, late: str = "1 day", partitions: int | None = None) -> StreamingQuery:
    """Sum up the days that what has landed since the last run ends, then start the job over these days; it ends by itself.

    Days go from the first job (`partitions` of state, or as many as `stores` says) to the second one by a
    table beside their checkpoints. It is read once the first has ended, so no batch there is written again after that.
    """
    spark, days = stream.sparkSession, f"{checkpoint}/finished"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = at(days).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(at(f"{checkpoint}/offsets")):
        raise RuntimeError("the checkpoint is of the earlier form, one job for all: start with a new one")
    files.mkdirs(at(days))  # nothing may have landed
    with stateful(spark, partitions or stores(spark)):
        first = vessel_days(stream, late).writeStream.foreachBatch(keep_days(days)).outputMode("append").option("checkpointLocation", f"{checkpoint}/days").trigger(availableNow=True).start()
    first.awaitTermination()
    with stateful(spark, min(FEW, partitions or stores(spark))):
        out = activity(spark.readStream.schema(DAYS).option("recursiveFileLookup", True).parquet(days), before, least_hours)
        return out.writeStream.outputMode("append").option("checkpointLocation", f"{checkpoint}/areas").trigger(availableNow=True).format("parquet").option("path", path).start()
