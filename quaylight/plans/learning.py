"""Registered queries of model inputs with history, staged model selection and scoring."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import features as fe
from ..operators import history as hi
from ..operators import models as mo
from ..session import parts, shared_folder
from .bindings import DAY, NOW
from .coverage import RUNS, experiment_runs
from .queries import SEQ, SPLIT, now, query, r6

STEPS = 5
#: Frames of the last five days: each company's signals and largest severity of a day.
FRAMES = f"""f as (
  select company_id as id, ((US[observed_at] - {NOW - STEPS * DAY}) // {DAY})::int as step, count(*)::double as n, max(severity) as severity
  from {{signals}} where company_id is not null and US[observed_at] >= {NOW - STEPS * DAY} and US[observed_at] < {NOW} group by 1, 2
),
grid as (select id, step from (select id from f where step = {STEPS - 1}), (select unnest(range({STEPS}))::int as step)),
w as (select grid.id, grid.step, coalesce(n, 0) as n, coalesce(severity, 0) as severity, (f.id is not null)::int::double as present from grid left join f using (id, step))"""


def frames(signals: DataFrame) -> DataFrame:
    step = F.floor((F.unix_micros(F.col("observed_at").cast("timestamp")) - (NOW - STEPS * DAY)) / DAY).cast("int")
    rows = signals.where("company_id is not null").withColumn("step", step).where(F.col("step").between(0, STEPS - 1))
    return rows.groupBy(F.col("company_id").alias("id"), "step").agg(F.count("*").cast("double").alias("n"), F.max("severity").alias("severity"))


def lags(zero_past: bool) -> str:
    """The lag columns in SQL, with zeros for the past where asked."""
    out = []
    for c in ("n", "severity", "present"):
        for k in range(c == "present", STEPS):
            value = f"lag({c}, {k}, 0) over (partition by id order by step)" if not (zero_past and k) else "0.0::double"
            out.append(f"{value} as {c}_lag{k}")
    return ", ".join(out)


def slope(c: str) -> str:
    return f"(select id, round(case when count(*) > 1 then regr_slope({c}, step) else 0 end, 6) as {c}_trend from w where present = 1 group by id)"


def rounded(rows: DataFrame) -> DataFrame:
    return rows.select(*[r6(c) if c.endswith("_trend") else c for c in rows.columns])


@query(f"with {FRAMES} select * from (select id, {lags(False)} from w qualify step = {STEPS - 1}) join {slope('n')} using (id) join {slope('severity')} using (id)")
def m7_history(signals):
    """Five days of each company as model input: lags, presence and trends."""
    return rounded(hi.history(frames(signals), ["n", "severity"], STEPS))


@query(f"with {FRAMES} select *, 0.0::double as n_trend, 0.0::double as severity_trend from (select id, {lags(True)} from w qualify step = {STEPS - 1})")
def m6_no_temporal(signals):
    """The last frame alone; the ablation of the whole history gives the same rows."""
    alone = hi.history(fe.last_frame_only(frames(signals)), ["n", "severity"], STEPS)
    ablated = fe.ablate(hi.history(frames(signals), ["n", "severity"], STEPS), "no_temporal")
    return alone.intersect(ablated.select(alone.columns))


@query(f"""with {FRAMES}, h as (select id, {lags(False)} from w qualify step = {STEPS - 1}),
m as (select e.dst as id, avg(h.n_lag0) as m0, avg(h.n_lag1) as m1 from (select distinct src, dst from {{edges}}) e join h on h.id = e.src group by e.dst)
select h.id, round(coalesce(m0, 0), 6) as mean_n_lag0, round(coalesce(m1, 0), 6) as mean_n_lag1 from h left join m using (id)""")
def m7_neighbour_history(signals, edges):
    """Means of the suppliers' counts of today and yesterday."""
    rows = hi.history(frames(signals), ["n", "severity"], STEPS)
    got = hi.with_neighbours(rows, edges.select("src", "dst").distinct(), ["n_lag0", "n_lag1"])
    return got.select("id", r6("mean_n_lag0"), r6("mean_n_lag1"))


@query("""with s as (select 100 * y as y, [abs(round(100 * p) - 10 * k) for k in range(1, 7)] as stages from {predictions} where split = 'validation'),
b as (select k + 1 as step, avg((stages[k + 1] - y) ** 2) as brier from s, (select unnest(range(6)) as k) group by 1)
select step::int as step, brier, step = (select arg_min(step, brier) from b) as chosen from b""")
def m7_staged_brier(predictions):
    """Brier scores of the validation split after each of six stages (in hundredths, so that sums are exact), and the one that is kept."""
    rows = predictions.where("split = 'validation'").select((100 * F.col("y")).alias("y"), F.transform(F.sequence(F.lit(1), F.lit(6)), lambda k: F.abs(F.round(100 * F.col("p")) - 10 * k)).alias("stages"))
    scores = hi.staged_brier(rows)
    best = scores.agg(F.min_by("step", F.struct("brier", "step")).alias("_best"))
    return scores.crossJoin(F.broadcast(best)).select("step", "brier", (F.col("step") == F.col("_best")).alias("chosen"))  # one row


@query()
def m7_fit_and_select(companies, signals, relationships, links):
    """Runs on assembled features with G6 sums; the outcome is a warning sensor reading in the week after."""
    spark, path = companies.sparkSession, shared_folder(companies.sparkSession, "examples")
    made = fe.assemble(companies, signals, relationships, links, now())
    features = [f"{s}_{t}" for s in fe.SOURCES for t in fe.STATS]
    late = F.unix_micros(F.col("observed_at").cast("timestamp")).between(NOW, NOW + 7 * DAY)
    warned = signals.where(late & (F.col("source_type") == "viirs")).select(F.col("company_id").alias("id")).distinct().withColumn("y", F.lit(1))
    edges = made["edges"].select(F.col("supplier_id").alias("src"), F.col("customer_id").alias("dst"))
    nodes = made["nodes"].select("id", *features)
    nodes.write.parquet(f"{path}/nodes")  # neighbours' means read them three times
    rows = hi.with_neighbours(spark.read.schema(nodes.schema).parquet(f"{path}/nodes"), edges, ["news_value", "news_count"])
    rows = rows.join(warned.hint("merge"), "id", "left").na.fill({"y": 0}).withColumn("split", F.when(F.col("id") % 5 < 3, "train").when(F.col("id") % 5 == 3, "validation").otherwise("test"))
    rows.repartition(parts(companies), "id").sortWithinPartitions("id").write.parquet(f"{path}/rows")  # a file is one task of every fit
    used = [*features, "mean_news_value", "mean_news_count"]
    runs, _ = mo.fit_and_select(spark.read.schema(rows.schema).parquet(f"{path}/rows"), used, ablations=("full", "no_news", "no_vision"), rounds=6)
    return runs.select("architecture", "ablation", "best_step", "split", "n", "positives", r6("f1"), r6("roc_auc"), r6("brier"))


@query(f"""with {SEQ}, l as (select day, sid, row_number() over (order by day desc) as back from d),
f as (select s.id, 3 - l.back as step, s.shock * (4 - l.back) as x, l.sid from {{suppliers}} s, l where l.back <= 3 and (s.id + l.back) % 4 <> 1 ),
u as (select id from f where step = 2),
g as (select u.id, coalesce(a.x, 0) as x2, coalesce(b.x, 0) as x1, coalesce(c.x, 0) as x0, (b.id is not null)::int as p1, (c.id is not null)::int as p0
  from u left join f a on a.id = u.id and a.step = 2 left join f b on b.id = u.id and b.step = 1 left join f c on c.id = u.id and c.step = 0)
select g.id as company_id, (select sid from l where back = 1) as graph_snapshot_id, 'm1' as model_version_id, n as evidence_count,
  round(1 / (1 + exp(-(x2 - 0.5 * x1 + 0.25 * x0 + 0.125 * p1 - 0.25 * p0))), 6) as score
from g join (select company_id, count(*) as n from {{signals}} group by company_id) s on s.company_id = g.id""")
def m8_score_live(suppliers, signals, snapshots):
    """Scores from three days' frames, by a rule over lags and presence that stands for a trained model."""
    spark = suppliers.sparkSession
    evidence = signals.where("company_id is not null").groupBy("company_id").agg(F.count("*").alias("evidence_count"))
    rule = SQLTransformer(statement="select *, 1 / (1 + exp(-(x_lag0 - 0.5D * x_lag1 + 0.25D * x_lag2 + 0.125D * present_lag1 - 0.25D * present_lag2))) as p from __THIS__")
    sizes = {f"{s}_{n}": v for s in ("train", "validation", "test") for n, v in (("n", 30), ("positives", 10))}
    facts = {"id": "m1", "is_active": True, "schema_ok": True, "basis_ok": True, "ablation": "full", "lineage_ok": True, "steps": 3, "validation_brier": 0.1, "constant_brier": 0.25, **sizes}
    version = spark.range(1).select(*[F.lit(v).alias(k) for k, v in facts.items()])
    last = fe.last_of_day(snapshots).orderBy(F.desc("day")).limit(3).select("snapshot_id", "day")
    back = last.crossJoin(F.broadcast(last.agg(F.max("day").alias("_end")))).select("snapshot_id", (F.date_diff("_end", "day") + 1).alias("back"))  # one row
    nodes = suppliers.crossJoin(F.broadcast(back)).where((F.col("id") + F.col("back")) % 4 != 1).select("snapshot_id", "id", (F.col("shock") * (4 - F.col("back"))).alias("x"))  # three rows
    status, got = mo.score_live(version, snapshots, nodes, evidence, lambda _: PipelineModel([rule]), "observed", F.lit("2024-01-31").cast("timestamp"), ["x"])
    assert got is not None, status
    return got.select("company_id", "graph_snapshot_id", "model_version_id", "evidence_count", r6("score"))


@query(f"""with {SPLIT}, {RUNS}, k as (select example_id, s.split from s left join m on m.split = case s.split when 'train' then 'validation' when 'validation' then 'test' end where m.st is null or label_end < m.st)
select distinct architecture, ablation, {", ".join(f"(select string_agg(example_id, ',' order by example_id) from k where split = '{s}') as {s}_snapshots" for s in ("train", "validation", "test"))} from runs2 where split = 'test'""")
def m10_report_snapshots(lineitem, snapshots):
    """The report names the snapshots of each split."""
    rows = fe.last_of_day(snapshots).select(F.col("snapshot_id").alias("example_id"), "as_of", F.expr("as_of - interval 2 days as start"), F.expr("as_of + interval 3 days as label_end"), F.expr("as_of + interval 3 days as label_available"), F.array("snapshot_id").alias("frames"))
    report = mo.experiment_report(experiment_runs(lineitem), snapshots=fe.split_snapshots(fe.temporal_split(rows)))
    return report.select("architecture", "ablation", *[F.array_join(f"{s}_snapshots", ",").alias(f"{s}_snapshots") for s in ("train", "validation", "test")])

