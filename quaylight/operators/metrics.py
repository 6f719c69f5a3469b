"""Exact metrics of binary and numeric predictions, as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import running


def confusion(df: DataFrame, by: list[str], y: str = "y", p: str = "p", at: float = 0.5) -> DataFrame:
    """n, positives, precision, recall and f1 at a threshold; 0 where undefined."""
    hit = (F.col(p) >= at).cast("long")
    sums = df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.col(y).cast("long")).alias("positives"), F.sum(hit * F.col(y)).cast("double").alias("tp"), F.sum(hit).alias("predicted"))
    part = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return sums.select(*by, "n", "positives", part(F.col("tp"), F.col("predicted")).alias("precision"), part(F.col("tp"), F.col("positives")).alias("recall"), part(2 * F.col("tp"), F.col("predicted") + F.col("positives")).alias("f1"))


def by_score(df: DataFrame, by: list[str], y: str, p: str) -> DataFrame:
    """One row for each distinct score: pos, n; then running counts from the highest score down, over ranges of scores."""
    steps = df.groupBy(*by, p).agg(F.sum(F.col(y).cast("long")).alias("pos"), F.count("*").alias("n"))
    return running(steps, by, [F.desc(p)], {"tp": "pos", "seen": "n"})


def ranking(df: DataFrame, by: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """roc_auc and average_precision of each group, from one pass over its scores; null with a single class.

    The area under the ROC curve is exact, ties at half; average precision is the sum of precision
    times gained recall over distinct scores.
    """
    s = by_score(df, by, y, p)
    neg = F.col("n") - F.col("pos")
    # Positives strictly above, for each negative of this score, and half of those of the same score.
    wins = F.sum(neg * (F.col("tp") - F.col("pos") + 0.5 * F.col("pos")))
    total = F.sum("pos")
    ap = F.try_divide(F.sum(F.col("tp") / F.col("seen") * F.col("pos")), total)
    return s.groupBy(*by).agg(F.try_divide(wins, total * F.sum(neg)).alias("roc_auc"), F.when((total > 0) & (F.sum("n") > total), ap).alias("average_precision"))


def roc_auc(df: DataFrame, by: list[str], y: str = "y", p: str = "p") -> DataFrame:
    return ranking(df, by, y, p).drop("average_precision")


def average_precision(df: DataFrame, by: list[str], y: str = "y", p: str = "p") -> DataFrame:
    return ranking(df, by, y, p).drop("roc_auc")


def brier(df: DataFrame, by: list[str], y: str = "y", p: str = "p") -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier"))


def constant_brier(df: DataFrame, split: str = "split", y: str = "y", train: str = "train") -> DataFrame:
    """The Brier score on each split of predicting the prevalence of the training split."""
    rate = df.where(F.col(split) == train).agg(F.avg(y).alias("_rate"))
    return df.crossJoin(F.broadcast(rate)).groupBy(split).agg(F.avg(F.pow(F.col("_rate") - F.col(y), 2)).alias("constant_brier"))  # one row


def regression(df: DataFrame, by: list[str], y: str, p: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.abs(F.col(p) - F.col(y))).alias("mae"), F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("mse"))


def regression_baselines(df: DataFrame, y: str, local: str, split: str = "split", train: str = "train") -> DataFrame:
    """On each split the mean absolute error of predicting the training mean, and of the local input."""
    mean = df.where(F.col(split) == train).agg(F.avg(y).alias("_mean"))
    met = df.crossJoin(F.broadcast(mean))  # one row
    return met.groupBy(split).agg(F.avg(F.abs(F.col("_mean") - F.col(y))).alias("constant_mae"), F.avg(F.abs(F.col(local) - F.col(y))).alias("local_mae"))


def across_seeds(runs: DataFrame) -> DataFrame:
    """Mean and population deviation of f1 and brier for each (architecture, ablation)."""
    return runs.groupBy("architecture", "ablation").agg(*[f(m).alias(f"{m}_{n}") for m in ("f1", "brier") for f, n in ((F.avg, "mean"), (F.stddev_pop, "sd"))])


def recommended(runs: DataFrame) -> DataFrame:
    """The full run with the least validation Brier score, first on ties."""
    return runs.where("ablation = 'full'").agg(F.min_by("run_id", F.struct("validation_brier", "run_id")).alias("run_id"))


def histogram(df: DataFrame, score: Column, buckets: int = 10) -> DataFrame:
    at = F.least(F.greatest(F.floor(score * buckets), F.lit(0)), F.lit(buckets - 1)).cast("long")
    return df.groupBy(at.alias("bucket")).agg(F.count("*").alias("n"))


def split_problems(df: DataFrame, least: int = 20) -> DataFrame:
    """Splits that are too small or have one class; empty if all is well. df (split, y)."""
    sums = df.groupBy("split").agg(F.count("y").alias("n"), F.sum("y").alias("positives"))
    names = df.sparkSession.createDataFrame([("train",), ("validation",), ("test",)], "split string")
    return names.join(sums, "split", "left").where((F.coalesce("n", F.lit(0)) < least) | (F.coalesce("positives", F.lit(0)) == 0) | (F.col("positives") == F.col("n")))
