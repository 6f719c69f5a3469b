"""Incremental jobs with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.buckets import BucketTable

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stores(spark: SparkSession) -> int:
    """State partitions of a new job: two for each core, or those of the session's shuffles where they are fewer.

    Each of them is loaded and committed in each batch, whatever it holds, and a store of RocksDB
    may be larger than memory: their number follows the cluster, not the size of the tables.
    """
    return min(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


@contextmanager
def stateful(spark: SparkSession, partitions: int) -> Iterator[None]:
    """Settings that a query started inside takes along: the RocksDB store and its partitions. A query that goes on keeps those of its first start."""
    set_to = {"spark.sql.streaming.stateStore.providerClass": ROCKS, "spark.sql.shuffle.partitions": str(partitions)}
    was = {k: spark.conf.get(k, None) for k in set_to}
    try:
        for k, v in set_to.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def once(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append", name: str | None = None) -> StreamingQuery:
    """Run over what has landed since the last run, then stop; scheduled again for the next files."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    writer = writer.queryName(name) if name else writer
    return writer.format("parquet").option("path", sink).start()


def distinct_events(stream: DataFrame, key: str, at: str, late: str = "1 day") -> DataFrame:
    """Replays of a key within the watermark change nothing."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def window_volume(stream: DataFrame, at: str, late: str = "1 day", full: int = 250, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows in each UTC day window, and whether it is saturated."""
    counts = stream.withWatermark(at, late).groupBy(F.window(at, "1 day").alias("w"), *by).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("window_start"), *by, "n", (F.col("n") >= full).alias("saturated"))


def daily_vessels(stream: DataFrame, at: str = "at", vessel: str = "mmsi", late: str = "1 day") -> DataFrame:
    """Distinct vessels of each UTC day: the first position of a vessel in a day window, then counts (a stream counts no distinct values)."""
    day = stream.withWatermark(at, late).groupBy(F.window(at, "1 day").alias("w"), F.col(vessel)).agg(F.count("*").alias("positions"))
    return day.groupBy("w").agg(F.count("*").alias("vessels"), F.sum("positions").alias("positions")).select(F.to_date("w.start").alias("day"), "vessels", "positions")


def merge_new(path: str, key: str = "id"):
    """A foreachBatch sink: rows whose key is not in the table are appended; the first row of a key stays."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rows = batch.groupBy(key).agg(F.min_by(F.struct(*[c for c in batch.columns if c != key]), "ingested_at").alias("_r")).select(key, "_r.*").select(*batch.columns)
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            rows = rows.join(spark.read.parquet(path).select(key), key, "left_anti")
        rows.write.mode("append").parquet(path)

    return write


def merge_buckets(table: BucketTable, order: str = "ingested_at", update: bool = False):
    """A foreachBatch sink into a BucketTable: keys that it lacks are added, the first row of a key stays; with update the last row of a key takes its place.

    Only the buckets of a batch's keys are read, and a replayed batch writes nothing.
    """

    def write(batch: DataFrame, _: int) -> None:
        rest = F.struct(*[c for c in table.schema.names if c != table.key])
        pick = F.max_by if update else F.min_by
        one = batch.groupBy(table.key).agg(pick(rest, order).alias("_r")).select(table.key, "_r.*")
        (table.upsert if update else table.insert)(one)

    return write


def keep_late(path: str, at: str = "observed_at", delay: str = "1 day"):
    """A foreachBatch sink that keeps every row, with `late`: whether it is older than the newest row of earlier batches less `delay`.

    The watermark is a maximum over the earlier batches' folders. Late rows are never dropped: what
    was known at a time follows from ingested_at, so that they are in no snapshot of a time before
    they came, and in the next one. A batch is a folder, overwritten when it is run again.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        mark = None
        if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            before = spark.read.option("basePath", path).parquet(path).where(F.col("batch") < number)
            mark = before.agg(F.unix_micros((F.max(at).cast("timestamp") - F.expr(f"interval {delay}")).cast("timestamp"))).first()[0]
        late = F.lit(False) if mark is None else F.coalesce(F.col(at) < F.timestamp_micros(F.lit(mark)), F.lit(False))
        batch.withColumn("late", late).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def quarantined(bad: str, good: str):
    """A foreachBatch sink: rows with a `reason` go to one table, all others to the other, without it; one query for each source keeps failures apart.

    A batch is a folder in each table, overwritten when it is run again.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.where(F.col("reason").isNotNull()).write.mode("overwrite").parquet(f"{bad}/batch={number}")
        batch.where(F.col("reason").isNull()).drop("reason").write.mode("overwrite").parquet(f"{good}/batch={number}")

    return write


def isolated(jobs: dict[str, Callable[[], StreamingQuery]]) -> dict[str, str | None]:
    """Start each source's job and wait for it: the message of the failure for each source, null where all went well. A failed source stops no other."""
    started, failures = {}, {}
    for name, start in jobs.items():
        try:
            started[name] = start()
        except Exception as e:  # the failure of one source is its result
            failures[name] = str(e)
    for name, running in started.items():
        try:
            running.awaitTermination()
            failures[name] = None
        except Exception as e:
            failures[name] = str(e)
    return failures


def landed(spark: SparkSession, folder: str, schema, pattern: str | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).parquet(folder)
