"""Running sums and order statistics over whole tables, without a task for each group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut


def running(df: DataFrame, by: list[str], order: list[Column], sums: dict[str, str]) -> DataFrame:
    """df with, for each name: column of sums, the sum over the rows of the same `by` up to this one in `order`, and `<name>_total` over all of them.

    Two levels: rows are dealt to ranges of (by, order), whatever the size of a group, and written;
    sums inside a range are added to the totals of the ranges before it, of which there is one row
    for each range and group. So no task holds more than a range. Rows must differ in `order`.
    """
    block, key = "_block", F.struct(*by, "_block")
    dealt = cut(df.repartitionByRange(*[F.col(c) for c in by], *order).withColumn(block, F.spark_partition_id())).withColumn("_key", key)
    so_far = Window.partitionBy("_key").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = dealt.groupBy("_key", *by, block).agg(*[F.sum(c).alias(f"_of_{n}") for n, c in sums.items()])
    group = Window.partitionBy(*by)
    before = group.orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_key", *[F.coalesce(F.sum(f"_of_{n}").over(before), F.lit(0)).alias(f"_before_{n}") for n in sums], *[F.sum(f"_of_{n}").over(group).alias(f"{n}_total") for n in sums])
    met = dealt.withColumns({f"_in_{n}": F.sum(c).over(so_far) for n, c in sums.items()}).join(starts.hint("merge"), "_key")
    return met.select(*df.columns, *[(F.col(f"_before_{n}") + F.col(f"_in_{n}")).alias(n) for n in sums], *[f"{n}_total" for n in sums])


def exact_quantile(df: DataFrame, by: list[str], value: str, q: float) -> DataFrame:
    """(by, quantile): the q-quantile of value, interpolated between neighbours; nulls do not count.

    Equal values are counted before they are sorted, and the two neighbours are picked by their rank.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    ranked = running(counts, by, [F.col("_v")], {"_seen": "_n"})
    at = (F.col("_seen_total") - 1) * F.lit(q)
    pick = lambda rank: F.min(F.when(F.col("_seen") > rank, F.col("_v")))
    two = ranked.groupBy(*by).agg(pick(F.floor(at)).alias("_lo"), pick(F.ceil(at)).alias("_hi"), F.max(at - F.floor(at)).alias("_part"))
    return two.select(*by, (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_part")).alias("quantile"))
