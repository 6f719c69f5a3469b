"""A company's past as model input, and models whose checkpoint the validation split picks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import mean_neighbours

#: Steps of the optimiser that are checkpoints of a logistic model.
LOGISTIC_STEPS = (1, 2, 4, 8, 16, 32)


def history_columns(columns: Iterable[str], steps: int) -> list[str]:
    """The columns that `history` makes of these, the past ones last."""
    columns, past = list(columns), range(1, steps)
    return [f"{c}_lag0" for c in columns] + [f"{c}_lag{k}" for c in columns for k in past] + [f"present_lag{k}" for k in past] + [f"{c}_trend" for c in columns]


def history(frames: DataFrame, columns: Iterable[str], steps: int, by: tuple[str, ...] = ("id",)) -> DataFrame:
    """A row for each key of the last frame: every column now and in each earlier frame, presence then, and the column's trend.

    frames (by, step 0 .. steps - 1, columns), one row for each key and step. An earlier frame
    without the key gives 0 and present_lag 0; a null value is 0 as well. The trend is the slope of
    least squares over the frames that have the key, 0 with fewer than two. Keys that the last
    frame does not have go: only its universe is predicted. One shuffle, combined before it.
    """
    columns, last = list(columns), steps - 1
    step = F.col("step").cast("double")
    value = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns}
    at = lambda k, v: F.coalesce(F.max(F.when(F.col("step") == last - k, v)), F.lit(0.0))
    sums = {"_n": F.count("step"), "_t": F.sum(step), "_tt": F.sum(step * step)}
    for c in columns:
        sums |= {f"{c}_lag{k}": at(k, value[c]) for k in range(steps)} | {f"_v_{c}": F.sum(value[c]), f"_tv_{c}": F.sum(step * value[c])}
    sums |= {f"present_lag{k}": at(k, F.lit(1.0)) for k in range(steps)}
    wide = frames.where(F.col("step").between(0, last)).groupBy(*by).agg(*[v.alias(k) for k, v in sums.items()]).where("present_lag0 = 1")
    slope = lambda c: F.coalesce(F.try_divide(F.col("_n") * F.col(f"_tv_{c}") - F.col("_t") * F.col(f"_v_{c}"), F.col("_n") * F.col("_tt") - F.col("_t") * F.col("_t")), F.lit(0.0))
    return wide.withColumns({f"{c}_trend": slope(c) for c in columns}).select(*by, *history_columns(columns, steps))


def example_frames(examples: DataFrame, nodes: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Frames (example_id, step, id, columns) of examples (example_id, frames: ordered snapshot ids) from nodes (snapshot_id, id, columns)."""
    listed = examples.select("example_id", F.posexplode("frames").alias("step", "snapshot_id"))
    return listed.join(nodes.select("snapshot_id", "id", *columns).hint("merge"), "snapshot_id").drop("snapshot_id")


def with_neighbours(rows: DataFrame, edges: DataFrame, columns: list[str], by: tuple[str, ...] = ("id",)) -> DataFrame:
    """rows with mean_<column> over the incoming neighbours (edges by[:-1], src, dst), 0 without any."""
    *outer, own = by
    key = lambda c: F.struct(*outer, F.col(c).alias(own))
    keyed = rows.withColumn("_key", key(own))
    means = mean_neighbours(keyed.select(F.col("_key").alias("id"), *columns), edges.select(key("src").alias("src"), key("dst").alias("dst")), columns)
    return keyed.join(means.withColumnRenamed("id", "_key").hint("merge"), "_key").drop("_key")


def classifier(architecture: str, features: list[str], seed: int, rounds: int = 10) -> Pipeline:
    """A pipeline that learns y from features: `logistic` by so many steps of the optimiser, `trees` by so many boosted trees."""
    join = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep")
    if architecture == "logistic":
        made = LogisticRegression(featuresCol="_x", labelCol="y", regParam=0.01, maxIter=rounds, tol=0.0)
    else:
        made = GBTClassifier(featuresCol="_x", labelCol="y", maxIter=rounds, maxDepth=3, seed=seed)
    return Pipeline(stages=[join, made])


def staged_brier(rows: DataFrame, stages: str = "stages", y: str = "y") -> DataFrame:
    """(step, brier) of rows whose array `stages` has the probability after each step; steps from 1. One aggregate, no row is multiplied."""
    n = rows.agg(F.max(F.size(stages))).first()[0] or 0  # one row
    if n <= 0:
        return rows.sparkSession.createDataFrame([], "step int, brier double")
    sums = rows.agg(F.array(*[F.avg(F.pow(F.get(stages, F.lit(k)) - F.col(y), 2)) for k in range(n)]).alias("b"))
    return sums.select(F.posexplode("b").alias("step", "brier")).select((F.col("step") + 1).alias("step"), "brier")


def tree_stages(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """rows with `stages`: the probability after the first tree, the first two, and so on, in one pass."""
    join, boosted = model.stages
    out = join.transform(rows)
    names = []
    for i, tree in enumerate(boosted.trees):
        names.append(f"_tree{i}")
        out = tree.setFeaturesCol("_x").setPredictionCol(names[-1]).transform(out)
    margin, stages = F.lit(0.0), []
    for weight, name in zip(boosted.treeWeights, names, strict=True):
        margin = margin + weight * F.col(name)
        stages.append(1 / (1 + F.exp(-2 * margin)))
    return out.select(*rows.columns, F.array(*stages).alias("stages"))


def predictions(model, rows: DataFrame) -> DataFrame:
    """rows with p, the probability of y = 1. A model may give p itself (a rule in SQL), else a probability vector."""
    out = model.transform(rows)
    if "p" not in out.columns or "p" in rows.columns:
        out = out.withColumn("p", vector_to_array("probability")[1])
    return out.drop("_x", "rawPrediction", "probability", "prediction")


def fit_checkpoint(train: DataFrame, validation: DataFrame, features: list[str], architecture: str, seed: int, rounds: int = 10) -> tuple[PipelineModel, int, list[tuple[int, float]]]:
    """(model, its step, Brier score on validation after each checkpoint): the first step with the least score is kept.

    Trees are grown once and every prefix of the ensemble is scored in one pass; the kept prefix is
    grown again, which gives the same trees as boosting is sequential and seeded, so that it is a
    plain model to save. A logistic model's optimiser is stopped at each of LOGISTIC_STEPS.
    """
    if architecture == "trees":
        whole = classifier(architecture, features, seed, rounds).fit(train)
        scores = [(r["step"], r["brier"]) for r in staged_brier(tree_stages(whole, validation)).orderBy("step").collect()]
        step = min(scores, key=lambda s: (s[1], s[0]))[0]
        return (whole if step == rounds else classifier(architecture, features, seed, step).fit(train)), step, scores
    best, scores = None, []
    for step in [s for s in LOGISTIC_STEPS if s <= rounds] or [rounds]:
        model = classifier(architecture, features, seed, step).fit(train)
        brier = predictions(model, validation).agg(F.avg(F.pow(F.col("p") - F.col("y"), 2))).first()[0]
        scores.append((step, brier))
        if best is None or brier < best[0]:
            best = (brier, step, model)
    return best[2], best[1], scores
