"""Daily query windows with a cursor: a streaming source whose offset is how far has been asked, and what is done with each window."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

DAY = 86_400_000_000
EPOCH = datetime(1970, 1, 1, tzinfo=UTC)
SCHEMA = "window_start timestamp, window_end timestamp"


class Window(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class WindowReader(DataSourceStreamReader):
    """Offsets are microseconds. A batch takes the next `per_batch` windows [cursor, cursor + 1 day), the last one up to `until`."""

    def __init__(self, start: int, until: int, per_batch: int):
        self.start, self.until, self.per_batch = start, max(start, until), per_batch
        self.cursor: int | None = None  # known from the checkpoint once a batch was planned

    def initialOffset(self) -> dict:
        return {"cursor": self.start}

    def latestOffset(self) -> dict:
        at = self.start if self.cursor is None else self.cursor
        return {"cursor": max(at, min(self.until, at + self.per_batch * DAY))}

    def partitions(self, start: dict, end: dict) -> list[Window]:
        self.cursor = end["cursor"]
        return [Window(at, min(at + DAY, end["cursor"])) for at in range(start["cursor"], end["cursor"], DAY)]

    def read(self, partition: Window) -> Iterator[tuple]:
        yield tuple(EPOCH + timedelta(microseconds=t) for t in (partition.start, partition.end))


class DayWindows(DataSource):
    """format("day_windows") with options start, until (microseconds) and per_batch."""

    @classmethod
    def name(cls) -> str:
        return "day_windows"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> WindowReader:
        return WindowReader(int(self.options["start"]), int(self.options["until"]), int(self.options.get("per_batch", "7")))


def collected(articles: DataFrame, start: int, end: int, full: int = 250) -> DataFrame:
    """Articles (topic, url, seen_at, ...) of the windows from start to end, the first window's of each topic and url, with their window and whether it was saturated.

    In a window the newest article of a url comes first, of equally new ones the least title.
    The bounds on seen_at reach the scan.
    """
    at = lambda us: F.timestamp_micros(F.lit(us))
    rows = articles.where((F.col("seen_at") >= at(start)) & (F.col("seen_at") < at(end)))
    index = F.floor((F.unix_micros(F.col("seen_at").cast("timestamp")) - start) / DAY)
    rows = rows.withColumn("window_start", F.timestamp_micros(start + index * DAY)).withColumn("window_end", F.timestamp_micros(F.least(start + (index + 1) * DAY, F.lit(end))))
    counts = rows.groupBy("topic", "window_start").agg((F.count("*") >= full).alias("saturated"))
    order = F.struct("window_start", -F.unix_micros(F.col("seen_at").cast("timestamp")), "title")
    rest = [c for c in rows.columns if c not in ("topic", "url")]
    first = rows.groupBy("topic", "url").agg(F.min_by(F.struct(*rest), order).alias("_r")).select("topic", "url", "_r.*")
    return first.join(counts.hint("merge"), ["topic", "window_start"])


def window_sink(articles: Callable[[SparkSession], DataFrame], path: str, full: int = 250):
    """A foreachBatch sink of DayWindows: what each window's query finds, appended once.

    A batch is a folder of its own, overwritten when it is run again; urls that an earlier batch
    has for a topic stay as they are there.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        bounds = batch.agg(*[F.unix_micros(f(c)) for f, c in ((F.min, "window_start"), (F.max, "window_end"))]).first()  # windows of a batch follow one another
        if bounds[0] is None:
            return
        rows = collected(articles(spark), bounds[0], bounds[1], full)
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            before = spark.read.option("basePath", path).parquet(path).where(F.col("batch") < number)
            rows = rows.join(before.select("topic", "url").distinct().hint("merge"), ["topic", "url"], "left_anti")
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def follow_windows(spark: SparkSession, articles: Callable[[SparkSession], DataFrame], path: str, checkpoint: str, start: int, until: int, per_batch: int = 7, full: int = 250) -> StreamingQuery:
    """Start the job from where its checkpoint ends (or from start) up to until; processAllAvailable() waits for it."""
    spark.dataSource.register(DayWindows)
    stream = spark.readStream.format("day_windows").options(start=str(start), until=str(until), per_batch=str(per_batch)).load()
    return stream.writeStream.foreachBatch(window_sink(articles, path, full)).option("checkpointLocation", checkpoint).start()
