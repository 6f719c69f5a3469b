"""Contiguous shards of nearly equal byte size from prefix sums.

Documents are put in one global order: (first byte of md5(text), first byte of md5(doc_id),
md5(text), doc_id). The two leading bytes name one of 65,536 cells, so the order is made without
sampling and a retried task sees the same cells. Sizes are summed per cell with map-side
combining, the cell totals (at most 65,536 rows, whatever the input) are turned into prefix sums,
and a running sum inside each cell gives every document its global byte offset. Shard k takes the
documents whose midpoint lies in the k-th of n equal byte ranges, so shards are contiguous in that
order and their sizes differ by about one document. A group of equal texts shares its first byte
but is spread over 256 cells, so no task gets a whole group.

Defined results: a null text counts 0 bytes (size 1) and crc32 0; an empty table gives an empty
result; repeated rows each get their own slot; a null doc_id is ordered as the empty string.
Extra columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

CELLS = 65_536


def assign(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, position (global byte offset), shard and slot for each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    hashed = F.md5(text)
    by_id = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
        hashed.alias("_h"),
        F.conv(F.concat(hashed.substr(1, 2), by_id.substr(1, 2)), 16, 10).cast("int").alias("_cell"),
    )
    sums = rows.groupBy("_cell").agg(F.sum("size").alias("_b"), F.count("*").alias("_n"))
    before = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    starts = sums.select(
        "_cell",
        F.coalesce(F.sum("_b").over(before), F.lit(0)).alias("_b0"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
        F.sum("_b").over(whole).alias("_total"),
    )
    inside = Window.partitionBy("_cell").orderBy("_h", "doc_id")
    placed = (
        rows.withColumn("_r", F.row_number().over(inside) - 1)
        .withColumn("_s", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .join(F.broadcast(starts), "_cell")  # at most CELLS rows
        .withColumn("position", F.col("_b0") + F.col("_s"))
        .withColumn("_rank", F.col("_n0") + F.col("_r"))
        .withColumn("shard", F.least(F.lit(shards - 1), F.floor(shards * (2 * F.col("position") + F.col("size")) / (2 * F.col("_total"))).cast("int")))
    )
    # The first rank of each shard: one row a shard.
    first = placed.groupBy("shard").agg(F.min("_rank").alias("_first"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "position", "shard", (F.col("_rank") - F.col("_first")).alias("slot")
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents").select("doc_id", "text"), 16).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "position"
    )
