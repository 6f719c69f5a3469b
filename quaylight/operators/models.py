"""Training, selecting and applying node-risk models with Spark ML."""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder
from .features import ablate, last_of_day
from .history import fit_checkpoint, history, predictions, with_neighbours
from .metrics import brier, confusion, constant_brier, ranking


def eligibility(least: int = 20) -> Column:
    """The first reason why a model (columns as below) must not be used; null for a usable one.

    schema_ok, basis_ok, ablation, lineage_ok, steps, validation_brier, constant_brier and for each
    split <split>_n and <split>_positives.
    """
    sizes = F.lit(True)
    for s in ("train", "validation", "test"):
        sizes = sizes & (F.col(f"{s}_n") >= least) & F.col(f"{s}_positives").between(F.lit(1), F.col(f"{s}_n") - 1)
    rules = [
        (F.col("schema_ok") & F.col("basis_ok"), "schema or basis"),
        (F.col("ablation") == "full", "not the full model"),
        (F.col("lineage_ok"), "lineage"),
        (F.col("steps").between(2, 30), "steps"),
        (sizes, "split sizes or classes"),
        (F.col("validation_brier") < F.col("constant_brier"), "no better than a constant"),
    ]
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(reason)) for ok, reason in rules])


def fit_and_select(rows: DataFrame, features: list[str], architectures=("logistic", "trees"), seeds=(42,), ablations=("full", "no_news", "no_vision", "no_temporal"), rounds: int = 10) -> tuple[DataFrame, PipelineModel]:
    """rows (split, y, features): metrics of each run on each split, and the full model with the least validation Brier score.

    In each run the validation split picks the checkpoint (best_step); the test split is read only
    once a run's model is chosen, and never selects. Input rows are read many times: cache them or
    write them first.
    """
    every, best, key = None, (float("inf"), None), ["architecture", "seed", "ablation", "best_step"]
    for architecture, seed, ablation in product(architectures, seeds, ablations):
        data = ablate(rows, ablation)
        train, validation = (data.where(F.col("split") == s) for s in ("train", "validation"))
        model, step, scores = fit_checkpoint(train, validation, features, architecture, seed, rounds)
        run = {"architecture": architecture, "seed": seed, "ablation": ablation, "best_step": step}
        scored = predictions(model, data).select("split", F.col("y").cast("double").alias("y"), "p", *[F.lit(v).alias(k) for k, v in run.items()])
        least = min(b for _, b in scores)
        if ablation == "full" and least < best[0]:
            best = (least, model)
        every = scored if every is None else every.unionByName(scored)
    by, path = [*key, "split"], shared_folder(rows.sparkSession, "scored")
    every.write.parquet(path)  # so that no metric scores the rows again
    every = rows.sparkSession.read.schema(every.schema).parquet(path)
    found = confusion(every, by)
    for metric in (ranking, brier):
        found = found.join(metric(every, by), by, "left")
    return found, best[1]


def score_current(model: PipelineModel, nodes: DataFrame, evidence: DataFrame, model_id: str, snapshot_id: str, basis: str, now: Column) -> DataFrame:
    """Score rows of companies with evidence, with their lineage."""
    scored = predictions(model, nodes).join(evidence.withColumnRenamed("company_id", "id").hint("merge"), "id")
    return scored.select(F.col("id").alias("company_id"), F.col("p").alias("score"), "evidence_count", F.lit(model_id).alias("model_version_id"), F.lit(snapshot_id).alias("graph_snapshot_id"), F.lit(basis).alias("input_basis"), now.alias("computed_at"))


def score_live(versions: DataFrame, snapshots: DataFrame, nodes: DataFrame, evidence: DataFrame, load: Callable[[str], PipelineModel], basis: str, now: Column, columns: list[str], edges: DataFrame | None = None, neighbours: tuple[str, ...] = ()) -> tuple[str, DataFrame | None]:
    """(status, score rows): skipped without an eligible active version or without as many consecutive last days as it has steps.

    snapshots (snapshot_id, as_of); nodes (snapshot_id, id, columns); evidence (company_id,
    evidence_count); load gives the model of a version's id, which learnt from `history` of columns
    over the version's steps, with the neighbours' means of `neighbours` over edges (src, dst) of
    the last snapshot. All of these days' frames are the input.
    """
    active = versions.where("is_active").withColumn("_reason", eligibility()).limit(1).collect()
    if not active or active[0]["_reason"]:
        return "skipped: no eligible active model", None
    steps = active[0]["steps"]
    month = snapshots.where((F.col("as_of") <= now) & (F.col("as_of") >= now - F.make_interval(days=F.lit(30))))
    days = sorted((r["day"], r["snapshot_id"]) for r in last_of_day(month).collect())[-steps:]  # 31 rows at most
    if len(days) < steps or (days[-1][0] - days[0][0]).days != len(days) - 1:
        return "skipped: too few consecutive days", None
    step = F.coalesce(*[F.when(F.col("snapshot_id") == sid, F.lit(i)) for i, (_, sid) in enumerate(days)])
    frames = nodes.withColumn("step", step).where(F.col("step").isNotNull())
    rows = history(frames, columns, steps)
    if edges is not None:
        rows = with_neighbours(rows, edges, list(neighbours))
    return "scored", score_current(load(active[0]["id"]), rows, evidence, str(active[0]["id"]), days[-1][1], basis, now)


def activate(models: DataFrame, chosen: str) -> DataFrame:
    """Exactly one active row, refused for a model with a blocking reason."""
    reason = models.where(F.col("id") == chosen).select(eligibility().alias("r")).first()
    if reason is None or reason["r"]:
        raise ValueError(f"not eligible: {reason and reason['r']}")
    return models.withColumn("is_active", F.col("id") == chosen)


def models_view(models: DataFrame, basis: str, most: int = 100) -> DataFrame:
    """The newest models of a basis, with what blocks them."""
    return models.where(F.col("data_basis") == basis).withColumn("reason", eligibility()).orderBy(F.desc("trained_at"), F.desc("id")).limit(most)


def observed_inputs(companies: DataFrame, severity: DataFrame, members: DataFrame) -> DataFrame:
    """Companies of components with observed nodes: severity, zero where missing, with a flag."""
    kept = companies.join(members.select("id"), "id", "left_semi")
    met = kept.join(severity.withColumnRenamed("company_id", "id"), "id", "left")
    return met.withColumn("missing", F.col("severity").isNull()).withColumn("severity", F.coalesce("severity", F.lit(0.0)))


def experiment_report(runs: DataFrame, rows: DataFrame | None = None, snapshots: DataFrame | None = None) -> DataFrame:
    """Mean and deviation of each (architecture, ablation) on the test split, and the recommended architecture.

    With rows (split, y), the Brier scores of predicting the training prevalence too; with snapshots
    (split, snapshot_id), the ids of each split's snapshots, one for each day.
    """
    test = runs.where("split = 'test'").groupBy("architecture", "ablation").agg(F.avg("f1").alias("f1_mean"), F.stddev_pop("f1").alias("f1_sd"), F.avg("brier").alias("brier_mean"))
    best = runs.where("split = 'validation' and ablation = 'full'").agg(F.min_by("architecture", F.struct("brier", "architecture", "seed")).alias("_best"))
    if rows is not None:
        base = constant_brier(rows).agg(*[F.max(F.when(F.col("split") == s, F.col("constant_brier"))).alias(f"{s}_constant_brier") for s in ("validation", "test")])
        test = test.crossJoin(F.broadcast(base))  # one row
    if snapshots is not None:
        ids = snapshots.agg(*[F.array_sort(F.collect_set(F.when(F.col("split") == s, F.col("snapshot_id")))).alias(f"{s}_snapshots") for s in ("train", "validation", "test")])
        test = test.crossJoin(F.broadcast(ids))  # one row
    return test.crossJoin(F.broadcast(best)).withColumn("recommended", (F.col("architecture") == F.col("_best")) & (F.col("ablation") == "full")).drop("_best")  # one row
