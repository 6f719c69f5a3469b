"""Vessel activity and pixel change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import ndvi
from .ranks import exact_quantile


def daily_activity(positions: DataFrame) -> DataFrame:
    """Each UTC day: distinct vessels, positions, hours covered (rounded, and as they are) and share of slow positions."""
    at = F.unix_micros(F.col("at").cast("timestamp"))
    return positions.groupBy(F.to_date("at").alias("day")).agg(
        F.count_distinct("mmsi").alias("vessels"),
        F.count("*").alias("positions"),
        F.round((F.max(at) - F.min(at)) / 3.6e9, 2).alias("span_hours"),
        ((F.max(at) - F.min(at)) / 3.6e9).alias("hours"),
        F.avg((F.col("sog") < 1).cast("double")).alias("slow_share"),
    )


def activity_ratio(daily: DataFrame, targets: DataFrame, before: int = 7, least_hours: float = 4.0) -> DataFrame:
    """targets (target date): vessels of the day over the median of the `before` days ahead of it, or an error where a day is missing or short."""
    if not 3 <= before <= 30:
        raise ValueError("3 to 30 days")
    wanted = targets.select("target", F.explode(F.sequence(F.lit(0), F.lit(before))).alias("back")).withColumn("day", F.date_sub("target", F.col("back")))
    met = wanted.join(daily.hint("merge"), "day", "left")
    bad = F.count_if(F.col("vessels").isNull() | (F.col("hours") < least_hours))
    own = F.max(F.when(F.col("back") == 0, F.col("vessels")))
    usual = F.median(F.when(F.col("back") > 0, F.col("vessels").cast("double")))
    sums = met.groupBy("target").agg(own.alias("vessels"), usual.alias("baseline"), bad.alias("bad_days"))
    ok = F.col("bad_days") == 0
    return sums.select("target", F.when(ok, F.col("vessels")).alias("vessels"), F.when(ok, F.try_divide(F.col("vessels"), F.col("baseline"))).alias("ratio"), F.when(~ok, "missing coverage").alias("error"))


def optical_valid(scl: Column, mask: Column, bands: list[Column]) -> Column:
    good = scl.isin(4, 5, 6, 7) & (mask == 1)
    for b in bands:
        good = good & ~F.isnan(b) & b.between(0, 1.5)
    return F.coalesce(good, F.lit(False))


def scaled(raw: Column, scale: float, offset: float) -> Column:
    return raw * scale + offset


def night_valid(raw: Column, fill: Column, quality: Column, n: Column, scaled: Column) -> Column:
    return F.coalesce(~F.isnan(raw) & (raw != fill) & (quality == 0) & n.between(3, 31) & (scaled >= 0), F.lit(False))


def aligned(before: DataFrame, after: DataFrame, values: list[str], least: float = 0.5) -> DataFrame:
    """Pixels (scene_id, row, col, valid, values) valid on both sides, with the share of common ones; scenes under `least` are left out."""
    side = lambda df, p: df.select("scene_id", "row", "col", F.col("valid").alias(f"{p}_valid"), *[F.col(v).alias(f"{p}_{v}") for v in values])
    met = side(before, "before").join(side(after, "after"), ["scene_id", "row", "col"])
    both = F.col("before_valid") & F.col("after_valid")
    share = met.groupBy("scene_id").agg(F.avg(both.cast("double")).alias("valid_share")).where(F.col("valid_share") >= least)
    return met.where(both).join(share, "scene_id")


def surface_change(pixels: DataFrame) -> DataFrame:
    """From aligned red and near bands: mean change (at most 1) and change of vegetation index."""
    diff = (F.abs(F.col("after_red") - F.col("before_red")) + F.abs(F.col("after_near") - F.col("before_near"))) / 2
    veg = ndvi(F.col("after_red"), F.col("after_near")) - ndvi(F.col("before_red"), F.col("before_near"))
    return pixels.groupBy("scene_id").agg(F.least(F.lit(1.0), F.avg(diff)).alias("surface_change"), F.avg(veg).alias("ndvi_change"), F.max("valid_share").alias("valid_share"))


def radiance_change(pixels: DataFrame) -> DataFrame:
    """From aligned radiance: means, the bright level (0.98 quantile of both sides, 0.1 at least) and the relative decrease (null from a dark start)."""
    both = pixels.select("scene_id", F.explode(F.array("before_radiance", "after_radiance")).alias("v"))
    bright = exact_quantile(both, ["scene_id"], "v", 0.98).select("scene_id", F.greatest(F.lit(0.1), F.col("quantile")).alias("bright_level"))
    sums = pixels.groupBy("scene_id").agg(F.avg("before_radiance").alias("before"), F.avg("after_radiance").alias("after"))
    drop = F.when(F.col("before") > 0.1, (F.col("before") - F.col("after")) / F.col("before"))
    return sums.join(bright.hint("merge"), "scene_id").withColumn("relative_decrease", drop)
