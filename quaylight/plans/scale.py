"""Registered queries of operators whose work must not meet in one task: boxes of any size, rankings, paging, merges; and whole compositions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence as ev
from ..operators import extraction as ex
from ..operators import metrics as me
from ..operators import relational as re_
from ..schemas import EVENT_RULES, HEDGED
from ..session import shared_folder
from .coverage import TITLE, headlines, quoted
from .queries import query, r6

#: Boxes from a few metres to a continent, around the positions' place; some are points, some upside down.
SIDE = "power(2.0, id % 17 - 12)"
BOXES = f"boxes as (select id as box_id, 33.74 - {SIDE} * (1 + id % 3) as south, 33.74 + {SIDE} * (1 - 3 * (id % 11 = 5)::int) as north, -118.26 - {SIDE} as west, -118.26 + {SIDE} * (1 + id % 2) as east from {{locations}})"


@query(f"with {BOXES} select box_id, count(*) as n, sum(mmsi)::bigint as vessels from {{positions}} p join boxes b on p.lat between south and north and p.lon between west and east group by box_id")
def j7_mixed_boxes(positions, locations):
    side = F.pow(F.lit(2.0), F.col("id") % 17 - 12)
    north = 1 - 3 * (F.col("id") % 11 == 5).cast("int")
    boxes = locations.select(F.col("id").alias("box_id"), (33.74 - side * (1 + F.col("id") % 3)).alias("south"), (33.74 + side * north).alias("north"), (-118.26 - side).alias("west"), (-118.26 + side * (1 + F.col("id") % 2)).alias("east"))
    return re_.sums_in_boxes(positions, boxes, {"vessels": "mmsi"})


RANKED = "s as (select l_linenumber % 3 as split, l_extendedprice as p, sum((l_returnflag = 'R')::int) as pos, count(*) as n from lineitem group by 1, 2), c as (select *, sum(pos) over w as tp, sum(n) over w as seen from s window w as (partition by split order by p desc))"


@query(f"with {RANKED} select split, round(sum((n - pos) * (tp - pos + 0.5 * pos)) / (sum(pos) * sum(n - pos)), 6) as roc_auc, round(sum(tp / seen * pos) / sum(pos), 6) as average_precision from c group by split")
def a11_continuous_scores(lineitem):
    """Both ranking metrics over nearly as many scores as rows."""
    rows = lineitem.select((F.col("l_linenumber") % 3).alias("split"), F.col("l_extendedprice").alias("p"), (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return me.ranking(rows, ["split"]).select("split", r6("roc_auc"), r6("average_precision"))


@query("select n // 40 + 1 as page, id from (select id, row_number() over (order by observed_at desc, id desc) - 1 as n from {signals} where company_id = 7) where n < 200")
def t1_seek_pages(signals):
    """Five pages of a company's signals, each from where the one before ended."""
    rows, after, out = signals.where("company_id = 7").select("id", "observed_at"), None, None
    for number in range(1, 6):
        page = re_.page_after(rows, [("observed_at", True), ("id", True)], after, 40)
        last = page.orderBy("observed_at", "id").first()  # the last row of a page
        marked = page.select(F.lit(number).cast("long").alias("page"), "id")
        out = marked if out is None else out.unionByName(marked)
        if last is None:
            break
        after = last.asDict()
    return out


LAST = "arg_max({}, (created_at, id))"


@query(f"""with e as (select supplier_id, customer_id, {LAST.format('criticality')} as criticality, string_agg(source_signal_id, ',' order by created_at, id) filter (source_signal_id is not null) as evidence from {{relationships}} where status = 'approved' group by 1, 2)
select 'node' as kind, id::varchar as a, null::varchar as b, name as label from {{companies}}
union all select 'affected', company_id::varchar, id::varchar, null from {{signals}} where company_id is not null
union all select 'edge', supplier_id::varchar, customer_id::varchar, round(criticality, 4)::varchar || ':' || coalesce(evidence, '') from e""")
def g9_projection(companies, signals, relationships):
    """The whole derived graph: nodes, links from companies to their signals, and edges with their evidence."""
    made = ev.projection(companies, signals, relationships)
    text = lambda c: F.col(c).cast("string")
    nodes = made["nodes"].select(F.lit("node").alias("kind"), text("id").alias("a"), F.lit(None).cast("string").alias("b"), F.col("name").alias("label"))
    links = made["affected"].select(F.lit("affected").alias("kind"), text("src").alias("a"), text("dst").alias("b"), F.lit(None).cast("string").alias("label"))
    label = F.concat(F.round("criticality", 4).cast("string"), F.lit(":"), F.array_join(F.transform("evidence_ids", lambda x: x.cast("string")), ","))
    edges = made["edges"].select(F.lit("edge").alias("kind"), text("src").alias("a"), text("dst").alias("b"), label.alias("label"))
    return nodes.unionByName(links).unionByName(edges)


#: Each title has the embedding of its company's number, each rule one of the first five.
HITS = " union all ".join(f"select id, {i} as i, '{n}' as event_type, {s}::double as severity from t where regexp_matches(title, {quoted(p)})" for i, (n, p, s) in enumerate(EVENT_RULES))


@query(f"""with v as (select vec_id, embedding::double[] as v from embeddings), n as (select max(vec_id) + 1 as n from v), t as (select id, {TITLE} as title from {{companies}}),
h as ({HITS}), s as (select h.*, greatest(0.0, least(1.0, list_dot_product(a.v, b.v))) as near from h, n join v a on a.vec_id = h.id % n.n join v b on b.vec_id = h.i),
best as (select id, arg_max(event_type, (near, -i)) as event_type, arg_max(severity, (near, -i)) as severity from s group by id)
select t.id, case when best.id is null or regexp_matches(title, {quoted(HEDGED)}) then 'other' else event_type end as event_type, case when best.id is not null and not regexp_matches(title, {quoted(HEDGED)}) then severity end as severity from t left join best on best.id = t.id""")
def e2_nearest_description(companies, embeddings):
    """Of several rules that match a title, the one whose description's vector is nearest."""
    n = embeddings.agg((F.max("vec_id") + 1).alias("_n"))
    own = embeddings.select(F.col("vec_id").alias("_v"), F.col("embedding").alias("vector"))
    titles = headlines(companies).crossJoin(F.broadcast(n)).withColumn("_v", F.col("id") % F.col("_n")).join(own.hint("merge"), "_v").select("id", "title", "vector")  # one row
    names = F.array(*[F.lit(name) for name, _, _ in EVENT_RULES])
    rules = embeddings.where(F.col("vec_id") < len(EVENT_RULES)).select(F.get(names, F.col("vec_id").cast("int")).alias("event_type"), F.col("embedding").alias("vector"))
    return ex.classify_events(titles, rules).select("id", "event_type", "severity")


@query("""select id, case when errors = 0 then 'success' when productive > 0 then 'partial' else 'failed' end as status, errors::bigint as errors from {runs} where id in (select id from {runs} order by id limit 3)""")
def k6_audit_run(runs):
    """The audit of the first three runs: a row at the start, one at the end, the last one counts."""
    spark, path = runs.sparkSession, shared_folder(runs.sparkSession, "audit")
    for r in runs.orderBy("id").limit(3).collect():
        status = spark.range(1).select(ev.run_status(F.lit(r["errors"]), F.lit(r["productive"]))).first()[0]
        ev.audit_run(spark, path, r["id"], "running", f"{r['id']} 00:00:00")
        ev.audit_run(spark, path, r["id"], status, f"{r['id']} 23:00:00", r["errors"])
    return ev.latest_runs(spark.read.parquet(path)).select("id", "status", F.col("errors").cast("long").alias("errors"))
