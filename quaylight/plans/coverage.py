"""More registered queries: sources, sinks, checks, text rules, extraction, streams and compositions over the bound tables.

Landed files are derived from the given tables, written to the shared folder and read back by the
library's own readers; the SQL states what they must give from the tables alone.
"""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as ft
from ..functions import values as fv
from ..operators import evidence as ev
from ..operators import extraction as ex
from ..operators import features as fe
from ..operators import graph as gr
from ..operators import metrics as me
from ..operators import models as mo
from ..operators import phrases as ph
from ..operators import relational as re_
from ..operators import sensors as se
from ..schemas import ABLATIONS, EVENT_RULES, FEATURE_SCHEMA, HEDGED, RELATION_CUE, RELATION_NEGATED, SOURCES, TARGET
from ..session import shared_folder
from ..sources import files, sinks
from ..streaming import jobs
from .bindings import DAY, NOW
from .queries import BOX, INSIDE, SEQ, SPLIT, VALID, now, query, r6, us


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def landed(df: DataFrame, name: str, kind: str = "parquet", **options) -> str:
    path = shared_folder(df.sparkSession, name)
    df.write.options(**options).format(kind).save(path)
    return path


UUID = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)"


def uuid_sql(name: str) -> str:
    h = f"sha1(unhex('{ft.NAMESPACE_URL}') || encode({name}))"
    return UUID.replace("(h,", f"({h},")


# --- sources and sinks ---------------------------------------------------------------------------


@query(f"select count(distinct case when {VALID} and {INSIDE} then concat_ws('|', mmsi, \"at\", lat, lon) end) as accepted, sum((not ({VALID}))::int)::bigint as invalid, sum(({VALID} and not ({INSIDE}))::int)::bigint as outside from (select case when mmsi % 10 = 0 then -1 else mmsi end as mmsi, * exclude mmsi from {{positions}})")
def s1_positions_csv(positions):
    text = positions.select(F.when(F.col("mmsi") % 10 == 0, "bad").otherwise(F.col("mmsi").cast("string")).alias("MMSI"), F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("BaseDateTime"), F.col("lat").cast("string").alias("LAT"), F.col("lon").cast("string").alias("LON"), F.col("sog").cast("string").alias("SOG"))
    return files.read_positions_csv(positions.sparkSession, landed(text, "csv", "csv", header=True), BOX)[1]


@F.pandas_udf(T.BinaryType())
def to_wkb(lat: pd.Series, lon: pd.Series) -> pd.Series:
    """A little-endian WKB point, as position files hold it."""
    return pd.Series([struct.pack("<BIdd", 1, 1, x, y) for y, x in zip(lat, lon, strict=True)])


def position_files(positions: DataFrame) -> str:
    """Position files, a folder for each day."""
    path = shared_folder(positions.sparkSession, "positions")
    rows = positions.select(F.col("mmsi").alias("MMSI"), F.col("at").alias("Base_Date_Time"), to_wkb("lat", "lon").alias("geometry"), F.col("sog").alias("SOG"), F.to_date("at").cast("string").alias("d"))
    rows.write.partitionBy("d").parquet(path)
    return path


DAYS = [f"2024-01-{d:02d}" for d in range(1, 31)]


@query(f"select count(*) filter (where {VALID} and {INSIDE}) as positions, count(distinct mmsi) filter (where {VALID} and {INSIDE}) as vessels from (select distinct mmsi, \"at\", lat, lon, sog from {{positions}} where \"at\"::date = date '2024-01-10')")
def s2_positions_parquet(positions):
    got, _ = files.read_positions_parquet(positions.sparkSession, f"{position_files(positions)}/d=2024-01-10", "2024-01-10", BOX)
    return got.agg(F.count("*").alias("positions"), F.count_distinct("mmsi").alias("vessels"))


@query(f"select cast(\"at\"::date as string) as day, count(distinct concat_ws('|', mmsi, \"at\", lat, lon)) filter ({VALID}) as accepted, count(*) filter (not ({VALID})) as invalid, 0::bigint as outside, count(distinct concat_ws('|', mmsi, \"at\", lat, lon)) filter ({VALID}) as positions from {{positions}} group by 1")
def s15_bbox_subset_job(positions):
    spark, path = positions.sparkSession, position_files(positions)
    whole = {"west": -180.0, "south": -90.0, "east": 180.0, "north": 90.0}
    return files.bbox_subset_job(spark, {day: f"{path}/d={day}" for day in DAYS}, whole, shared_folder(spark, "subset")).select("day", "accepted", "invalid", "outside", "positions")


@query("select lpad(c_custkey::string, 10, '0') as cik, upper('t' || c_custkey) as ticker, c_name as name from customer")
def s3_company_directory(customer):
    record = F.struct(F.col("c_custkey").alias("cik_str"), F.concat(F.lit("t"), F.col("c_custkey").cast("string")).alias("ticker"), F.col("c_name").alias("title"))
    texts = customer.groupBy(F.floor(F.col("c_custkey") / 50)).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("c_custkey").cast("string"), record)))).alias("value"))
    return files.read_company_directory(texts)


FORM = "case o_orderkey % 5 when 0 then '10-K' when 1 then '20-F' when 2 then '8-K' when 3 then '40-F' else '10-Q' end"
ACCESSION = "lpad(cast(o_custkey as string), 10, '0') || '-24-' || lpad(cast(o_orderkey % 1000000 as string), 6, '0')"
DOCUMENT = "case when o_orderkey % 7 = 0 then 'bad name.htm' else 'd' || cast(o_orderkey as string) || '.htm' end"


@query(f"select {FORM} as form, {ACCESSION} as accession, {DOCUMENT} as document, cast(o_orderdate::date as string) as filing_date from orders where {FORM} in ('10-K', '20-F', '40-F') and o_orderkey % 7 <> 0")
def s4_filing_index(orders):
    rows = orders.select("o_custkey", F.expr(FORM).alias("f"), F.expr(ACCESSION).alias("a"), F.expr(DOCUMENT).alias("d"), F.to_date("o_orderdate").cast("string").alias("t"))
    one = rows.groupBy("o_custkey").agg(*[F.collect_list(c).alias(n) for c, n in (("f", "form"), ("a", "accessionNumber"), ("d", "primaryDocument"), ("t", "filingDate"))])
    got = files.read_filing_index(one.select(F.to_json(F.struct("form", "accessionNumber", "primaryDocument", "filingDate")).alias("value")))
    return got.withColumn("filing_date", F.col("filing_date").cast("string"))


@query("select page_id::string as title, epoch_us(timestamp '2024-01-01' + to_hours((page_id % 900)::int)) as seen_at_us from pages where page_id % 5 <> 0 and page_id % 900 between 24 and 600")
def s5_articles(pages):
    article = F.struct(F.when(F.col("page_id") % 5 == 0, " ").otherwise(F.col("page_id").cast("string")).alias("title"), "url", F.date_format(F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=(F.col("page_id") % 900).cast("int")), "yyyyMMdd'T'HHmmss'Z'").alias("seendate"))
    texts = pages.groupBy(F.floor(F.col("page_id") / 50)).agg(F.to_json(F.struct(F.collect_list(article).alias("articles"))).alias("value"))
    got = files.read_articles(texts, F.lit("2024-01-02").cast("timestamp"), F.lit("2024-01-26").cast("timestamp"))
    return got.select("title", us("seen_at"))


@query("select n_name as company, r_name as region from nation join region on r_regionkey = n_regionkey")
def s6_catalog(nation, region):
    """A curated catalog is one file by nature: here the nations and regions (30 records)."""
    rows = lambda df, name: df.agg(F.collect_list(F.struct(*df.columns)).alias(name))
    path = landed(rows(nation, "companies").crossJoin(rows(region, "locations")).coalesce(1), "catalog", "json")  # one row each
    tables = files.read_catalog(nation.sparkSession, path, {"companies": ["n_name"], "locations": ["r_name"]})
    return tables["companies"].join(tables["locations"], F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("company"), F.col("r_name").alias("region"))


PROBLEM = f"""case when doc_id % 11 in (1, 2) then 'label' when doc_id % 11 = 3 then 'times' when doc_id % 11 = 4 then 'review' when doc_id % 11 = 5 then 'target' when doc_id % 11 = 6 then 'source' when doc_id % 11 = 7 then 'horizon' else 'valid' end"""


def outcome_labels(labels: DataFrame) -> str:
    """JSON lines of outcome labels; every rule is broken by some."""
    m = F.col("doc_id") % 11
    at = lambda days: F.date_format(F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(days=days), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    label = F.when(m == 1, "0.0").when(m == 2, "true").otherwise(F.col("toxic").cast("string"))
    rest = F.to_json(F.struct(
        F.col("doc_id").cast("string").alias("company_id"), F.lit("s").alias("snapshot_id"), F.when(m == 5, "another").otherwise(TARGET).alias("target"), at(F.lit(1)).alias("as_of"),
        at(F.when(m == 7, 9).otherwise(8)).alias("outcome_end"), at(F.when(m == 3, 7).otherwise(10)).alias("available_at"), F.when(m == 4, " ").otherwise("me").alias("reviewed_by"),
        F.when(m == 6, "http://h.example").otherwise("https://h.example/x").alias("source_url"), F.lit("why").alias("rationale"),
    ))
    return landed(labels.select(F.concat(F.lit('{"label":'), label, F.lit(","), F.substring(rest, 2, 1_000_000)).alias("value")), "labels", "text")


@query(f"select {PROBLEM} as problem, count(*) as n, sum(case when {PROBLEM} = 'valid' then toxic end)::bigint as positives from labels where toxic is not null group by 1")
def s7_outcome_labels(labels):
    rows = files.read_outcome_labels(labels.sparkSession, outcome_labels(labels.where("toxic is not null")))
    problem = F.coalesce(fe.label_problem(now()), F.lit("valid"))
    return rows.groupBy(problem.alias("problem")).agg(F.count("*").alias("n"), F.sum(F.when(problem == "valid", F.col("label").cast("long"))).alias("positives"))


@query(f"select count(*) filter (doc_id % 11 in (0, 8, 9, 10)) as valid, count(*) filter (doc_id % 11 in (1, 2)) as labels_broken, 0::bigint as repeated from labels where toxic is not null")
def p12_label_rules(labels):
    rows = files.read_outcome_labels(labels.sparkSession, outcome_labels(labels.where("toxic is not null"))).withColumn("problem", fe.label_problem(now()))
    good = fe.checked_labels(rows.where("problem is null").drop("problem"), now())
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return one(good, "valid").crossJoin(one(rows.where("problem = 'label'"), "labels_broken")).crossJoin(one(fe.duplicate_labels(rows), "repeated"))  # one row each


@query("select count(*) as n, round(sum(red), 4) as red from {pixels_before} where scene_id = '3'")
def s8_pixels(pixels_before):
    got = files.read_pixels(pixels_before.sparkSession, landed(pixels_before, "pixels"), "3")
    return got.agg(F.count("*").alias("n"), F.round(F.sum("red"), 4).alias("red"))


HASHED = "h as (select industry as key, sha256(to_json({'country': country, 'id': id, 'industry': industry, 'name': name})) as j from {companies})"


@query(f"with {HASHED} select key as industry, sha256(concat_ws('|', count(*)::string, " + ", ".join(f"sum(('0x' || substr(j, {1 + 15 * i}, 15))::hugeint)::string" for i in range(4)) + ")) as snapshot_id from h group by key")
def s9_content_ids(companies):
    return sinks.content_id(companies.select("name", "id", "industry", "country").repartition(7), "industry")


@query()
def s9_snapshot_ids(companies, signals, relationships, links):
    nodes = fe.assemble(companies, signals, relationships, links, now())["nodes"].withColumn("as_of", F.date_format("as_of", "yyyy-MM-dd"))
    return sinks.content_id(nodes, "as_of")


@query("select company_id, count(*) * 2 as n, round(max(score), 6) as most from {scores} group by company_id")
def s10_append_scores(scores):
    path = shared_folder(scores.sparkSession, "scores")
    for _ in range(2):
        sinks.append_scores(scores, path)
    return scores.sparkSession.read.schema(scores.schema).parquet(path).groupBy("company_id").agg(F.count("*").alias("n"), F.round(F.max("score"), 6).alias("most"))


RUNS = "runs2 as (select l_returnflag as architecture, case when l_linenumber % 3 = 0 then 'no_news' else 'full' end as ablation, l_linenumber as seed, case l_suppkey % 3 when 0 then 'train' when 1 then 'validation' else 'test' end as split, l_quantity / 50 as f1, l_discount as brier from lineitem)"


def experiment_runs(lineitem: DataFrame) -> DataFrame:
    kind = F.when(F.col("l_linenumber") % 3 == 0, "no_news").otherwise("full")
    split = F.element_at(F.array(*map(F.lit, ("train", "validation", "test"))), (F.col("l_suppkey") % 3 + 1).cast("int"))
    return lineitem.select(F.col("l_returnflag").alias("architecture"), kind.alias("ablation"), F.col("l_linenumber").alias("seed"), split.alias("split"), (F.col("l_quantity") / 50).alias("f1"), F.col("l_discount").alias("brier"))


@query(f"with {RUNS} select architecture, ablation, round(avg(f1), 6) as f1_mean, count(*) as runs from runs2 group by 1, 2")
def s11_report(lineitem):
    runs = experiment_runs(lineitem)
    path = shared_folder(lineitem.sparkSession, "report")
    sinks.write_report(runs, me.across_seeds(runs), path)
    spark = lineitem.sparkSession
    summary = spark.read.schema("architecture string, ablation string, f1_mean double").json(f"{path}/summary")
    listed = spark.read.schema("architecture string, ablation string").json(f"{path}/runs").groupBy("architecture", "ablation").agg(F.count("*").alias("runs"))
    return summary.join(listed, ["architecture", "ablation"]).select("architecture", "ablation", r6("f1_mean"), "runs")


@query("select cik, ticker, name from {companies} where id % 2 = 0")
def s14_directory_fallback(companies):
    known = companies.select(F.when(F.col("id") % 2 == 0, F.col("cik")).alias("cik"), "ticker", "name")
    return files.directory_fallback(companies.where("id < 0").select("cik", "ticker", "name"), known)


# --- checks ----------------------------------------------------------------------------------------


@query("select l_linenumber, count(*) filter (case when l_partkey % 9 in (4, 5, 6, 7) and l_suppkey % 2 = 1 and l_quantity / 30 between 0 and 1.5 then true else false end) as optical, count(*) filter (l_quantity <> 7 and l_suppkey % 3 = 0 and l_partkey % 40 between 3 and 31 and l_quantity * 0.1 - 1 >= 0) as night from lineitem group by 1")
def p16_valid_pixels(lineitem):
    raw = F.col("l_quantity")
    optical = se.optical_valid(F.col("l_partkey") % 9, F.col("l_suppkey") % 2, [raw / 30])
    night = se.night_valid(raw, F.lit(7.0), F.col("l_suppkey") % 3, F.col("l_partkey") % 40, se.scaled(raw, 0.1, -1.0))
    return lineitem.groupBy("l_linenumber").agg(F.count_if(optical).alias("optical"), F.count_if(night).alias("night"))


@query("select round(sum(l_quantity * 0.1 - 1), 4) as scaled from lineitem")
def f23_scale_offset(lineitem):
    return lineitem.agg(F.round(F.sum(se.scaled(F.col("l_quantity"), 0.1, -1.0)), 4).alias("scaled"))


@query("select case when source_type = 'viirs' and id % 2 = 0 then 'source' when id % 13 = 0 then 'severity' when observed_at is null then 'time' else 'accepted' end as reason, count(*) as n from {signals} group by 1")
def p21_signal_check(signals):
    rows = signals.withColumn("source_type", F.when((F.col("source_type") == "viirs") & (F.col("id") % 2 == 0), "radio").otherwise(F.col("source_type"))).withColumn("severity", F.when(F.col("id") % 13 == 0, F.lit(1.5)).when(F.col("id") % 17 == 0, None).otherwise(F.col("severity")))
    good, bad = re_.checked(rows, re_.signal_problem())
    return good.agg(F.lit("accepted").alias("reason"), F.count("*").alias("n")).unionByName(bad.groupBy("reason").agg(F.count("*").alias("n")))


@query("select split, n, positives from (select split, count(y) as n, sum(y)::bigint as positives from {predictions} group by split) where n < 150 or positives = 0 or positives = n")
def a26_split_gate(predictions):
    return me.split_problems(predictions, 150)


@query("select topic, sum(n)::bigint as articles, count(*) filter (n >= 20) as capped_windows from (select source_type as topic, date_trunc('day', observed_at) as w, count(*) as n from {signals} group by 1, 2) group by topic")
def a20_topic_summary(signals):
    return ev.topic_summary(ev.window_counts(signals.select(F.col("source_type").alias("topic"), F.col("observed_at").alias("seen_at")), 20))


@query("select split, round(avg(abs(p - y)), 6) as mae, round(avg((p - y) ** 2), 6) as mse, round(avg(abs(r - y)), 6) as constant_mae, round(avg(abs(p / 2 - y)), 6) as local_mae from {predictions}, (select avg(y) as r from {predictions} where split = 'train') group by split")
def a14_regression(predictions):
    rows = predictions.withColumn("shock", F.col("p") / 2)
    both = me.regression(rows, ["split"], "y", "p").join(me.regression_baselines(rows, "y", "shock"), "split")
    return both.select("split", r6("mae"), r6("mse"), r6("constant_mae"), r6("local_mae"))


@query("select topic, url, arg_min(page_id, struct_pack(w := page_id % 30, t := page_id)) as page_id from (select page_id % 3 as topic, substr(url, 1, 20) as url, page_id from pages) group by 1, 2")
def w5_first_by_url(pages):
    rows = pages.select((F.col("page_id") % 3).alias("topic"), F.substring("url", 1, 20).alias("url"), (F.col("page_id") % 30).alias("window_start"), F.col("page_id").alias("title"))
    return ev.first_by_url(rows).select("topic", "url", F.col("title").alias("page_id"))


@query("select (select count(*) from {edges}) > 1000 as refused, (select count(*) from {suppliers}) as nodes")
def t9_guard(edges, suppliers):
    try:
        re_.guarded(edges, 1000, "edges")
        refused = False
    except ValueError:
        refused = True
    return re_.guarded(suppliers, 1_000_000, "nodes").agg(F.lit(refused).alias("refused"), F.count("*").alias("nodes"))


@query("select true as same, not exists (select 1 from {suppliers} where id % 2 = 1) as same_as_even")
def g10_same_ids(suppliers):
    one, even = gr.same_ids(suppliers, suppliers.repartition(3)), gr.same_ids(suppliers, suppliers.where("id % 2 = 0"))
    return suppliers.sparkSession.range(1).select(F.lit(one).alias("same"), F.lit(even).alias("same_as_even"))


# --- text ------------------------------------------------------------------------------------------


@query("select c_custkey as id, case when len(t) between 1 and 5 and len(list_filter(t, lambda x: not regexp_full_match(x, '[A-Z0-9.\\-]{1,10}'))) = 0 then array_to_string(t, ',') end as tickers from (select c_custkey, list_filter(list_distinct_ordered, lambda x: x <> '') as t from (select c_custkey, case when c_custkey % 4 = 0 then ['AB' || c_custkey % 7] when c_custkey % 4 = 1 then ['T' || c_custkey, 'X.Y'] when c_custkey % 4 = 2 then ['A', 'B', 'C', 'D', 'E', 'F'] else ['BAD TICKER'] end as list_distinct_ordered from customer))")
def p19_ticker_lists(customer):
    k = F.col("c_custkey").cast("string")
    given = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit(" ab"), (F.col("c_custkey") % 7).cast("string"), F.lit(",AB"), (F.col("c_custkey") % 7).cast("string"), F.lit(",")))
    given = given.when(F.col("c_custkey") % 4 == 1, F.concat(F.lit("t"), k, F.lit(", x.y ,T"), k)).when(F.col("c_custkey") % 4 == 2, "a,b,c,d,e,f").otherwise("bad ticker")
    return customer.select(F.col("c_custkey").alias("id"), F.array_join(ft.ticker_list(F.split(given, ",")), ",").alias("tickers"))


TITLES = ["Strike at {}", "Flood hits {}", "No strike at {}", "War closes {}", "{} files for insolvency", "Regulator may visit {}", "Recall by {}", "{} opens a plant", "Sanctions and a strike at {}"]
TITLE = "case id % 9 " + " ".join(f"when {i} then " + " || ".join(x for x in (f"'{a}'" if a else "", "name", f"'{b}'" if b else "") if x) for i, (a, b) in enumerate(t.split("{}") for t in TITLES)) + " end"
MATCHED = "case when regexp_matches(title, " + quoted(HEDGED) + ") then 'other' " + " ".join(f"when regexp_matches(title, {quoted(p)}) then '{n}'" for n, p, _ in EVENT_RULES) + " else 'other' end"


def headlines(companies: DataFrame) -> DataFrame:
    return companies.select("id", F.expr(TITLE).alias("title"))


@query(f"select id, event_type, case event_type {' '.join(f'''when '{n}' then {s}::double''' for n, _, s in EVENT_RULES)} end as severity from (select id, {MATCHED} as event_type from (select id, {TITLE} as title from {{companies}}))")
def e2_classify_events(companies):
    return ex.classify_events(headlines(companies)).select("id", "event_type", "severity")


@query(f"select count(*) filter (regexp_matches(title, {quoted(HEDGED)})) as hedged, count(*) as titles from (select {TITLE} as title from {{companies}})")
def f8_hedged_headlines(companies):
    return headlines(companies).agg(F.count_if(F.col("title").rlike(HEDGED)).alias("hedged"), F.count("*").alias("titles"))


FILING = ["We purchase components from {}.", "{} supplies raw material to us.", "We may purchase parts from {}.", "We sell parts to {}.", "{} is a competitor that sells goods.", "Our suppliers include {}.", "The weather near {} was fine.", "{} provides transport for our plants."]
SENTENCE = "case o_orderkey % 8 " + " ".join(f"when {i} then " + " || ".join(x for x in (f"'{a}'" if a else "", "name", f"'{b}'" if b else "") if x) for i, (a, b) in enumerate(t.split("{}") for t in FILING)) + " end"


def filings(orders: DataFrame, companies: DataFrame) -> DataFrame:
    """A filing for each order: its customer files, and names the company of the next number."""
    named = companies.select((F.col("id") - 1).alias("o_custkey"), "name", F.lpad((F.col("id") - 1).cast("string"), 10, "0").alias("filer_cik"))
    return orders.join(named.hint("merge"), "o_custkey").select(F.col("o_orderkey").alias("doc_id"), "filer_cik", F.concat(F.lit("Hello there. "), F.expr(SENTENCE), F.lit(" The end.")).alias("text"))


FOUND = f"""w as (select o_orderkey as doc_id, o_orderkey % 8 as k, lpad((c.id - 1)::string, 10, '0') as filer, c.cik, c.name, 'Hello there. ' || {SENTENCE} || ' The end.' as text from orders join {{companies}} c on c.id = o_custkey + 1),
found as (select doc_id, case when k = 3 then filer else cik end as supplier_cik, case when k = 3 then cik else filer end as customer_cik, case k when 7 then 'logistics' when 1 then 'raw_material' else 'component' end as relationship_type, 0.95::double as confidence, 'pending' as status from w where k in (0, 1, 3, 5, 7))"""


@query(f"with {FOUND} select * from found")
def e1_supplier_mentions(orders, companies):
    return ex.supplier_mentions(filings(orders, companies), companies.select("cik", "name")).select("doc_id", "supplier_cik", "customer_cik", "relationship_type", "confidence", "status")


@query(f"with {FOUND} select doc_id, cik, 1.0::double as confidence from w")
def e4_mentions(orders, companies):
    got = ex.mentions_of(filings(orders, companies).select("doc_id", "text"), "text", companies.select("cik", "name"))
    return got.groupBy("doc_id", "cik").agg(F.max("confidence").alias("confidence"))


#: A name of 1 to 10 words for each customer, in words that only it has, and a document's text with two of them planted.
NAME = "array_to_string(list_transform(range(1, 2 + c_custkey % 10), lambda i: c_mktsegment || c_custkey || 'x' || i), ' ')"
LOW = "trim(regexp_replace(regexp_replace(lower({}), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"


@query(f"""with d as (select c_custkey as cik, {LOW.format(NAME)} as alias, {NAME} as name from customer), n as (select max(cik) + 1 as n from d),
t as (select doc_id, ' ' || {LOW.format("substr(text, 1, length(text) // 2) || ' ' || a.name || '! ' || substr(text, length(text) // 2 + 1) || ' (' || b.name || ')'")} || ' ' as low
  from documents, n join d a on a.cik = doc_id % n join d b on b.cik = doc_id * 7 % n where text is not null)
select doc_id, lpad(cik::varchar, 10, '0') as cik, alias as phrase from t join d on contains(low, ' ' || alias || ' ') where length(alias) >= 5""")
def e4_planted_phrases(documents, customer):
    """Names of 1 to 10 words, planted in whole documents, found as phrases."""
    name = F.array_join(F.transform(F.sequence(F.lit(1), (F.col("c_custkey") % 10 + 1).cast("int")), lambda i: F.concat("c_mktsegment", F.col("c_custkey").cast("string"), F.lit("x"), i.cast("string"))), " ")
    names = customer.select(F.col("c_custkey").alias("k"), name.alias("name"))
    n = names.agg((F.max("k") + 1).alias("n"))
    half = F.floor(F.length("text") / 2).cast("int")
    rows = documents.where(F.col("text").isNotNull()).crossJoin(F.broadcast(n)).select("doc_id", "text", (F.col("doc_id") % F.col("n")).alias("a"), (F.col("doc_id") * 7 % F.col("n")).alias("b"))  # one row
    for c in ("a", "b"):
        rows = rows.join(names.select(F.col("k").alias(c), F.col("name").alias(f"{c}_name")).hint("merge"), c)
    planted = F.concat(F.substr("text", F.lit(1), half), F.lit(" "), F.col("a_name"), F.lit("! "), F.substr("text", half + 1), F.lit(" ("), F.col("b_name"), F.lit(")"))
    known = names.select(ft.normalize_name(F.col("name")).alias("phrase"), F.lpad(F.col("k").cast("string"), 10, "0").alias("cik")).where(F.length("phrase") >= 5)
    return ph.find_phrases(rows.select("doc_id", ft.normalize_name(planted).alias("low")), "low", known, "cik")


@query(f"with {FOUND}, n as (select doc_id, count(*) as candidates from found group by doc_id) select {uuid_sql('concat(' + quoted('filing:') + ', w.doc_id)')} as id, 'sec_filing' as source_type, sha256(text) as text_sha256, coalesce(candidates, 0) as candidates from w left join n on n.doc_id = w.doc_id")
def e5_filing_evidence(orders, companies):
    rows = filings(orders, companies)
    return ex.filing_evidence(rows, ex.supplier_mentions(rows, companies.select("cik", "name")))


@query(f"select count(*) filter (regexp_matches(s, {quoted(RELATION_CUE)})) as cues, count(*) filter (regexp_matches(s, {quoted(RELATION_NEGATED)})) as doubtful, count(*) as n from (select {SENTENCE} as s from orders join {{companies}} on id = o_custkey + 1)")
def f6_relation_cues(orders, companies):
    rows = filings(orders, companies).select(F.split("text", "(?<=[.]) ")[1].alias("s"))
    return rows.agg(F.count_if(F.col("s").rlike(RELATION_CUE)).alias("cues"), F.count_if(F.col("s").rlike(RELATION_NEGATED)).alias("doubtful"), F.count("*").alias("n"))


VECTORS = "e as (select vec_id, embedding::double[] as a from embeddings), p as (select e.vec_id, e.a, f.a as b from e join e f on f.vec_id = e.vec_id - e.vec_id % 50)"


@query(f"with {VECTORS} select vec_id, round(case when vec_id % 3 = 0 then 0 else greatest(0.0, least(1.0, list_dot_product(a, b))) end, 5) as relevance from p")
def e3_relevance(embeddings):
    other = embeddings.select(F.col("vec_id").alias("_o"), F.col("embedding").alias("name_vector"))
    rows = embeddings.withColumn("_o", F.col("vec_id") - F.col("vec_id") % 50).join(other.hint("merge"), "_o")
    title = F.when(F.col("vec_id") % 3 == 0, "The acmes of steel").when(F.col("vec_id") % 3 == 1, "Big news: ACME, again").otherwise("Acme Inc. opens")
    got = ex.relevance(rows.select("vec_id", title.alias("title"), F.lit("Acme Inc.").alias("name"), F.col("embedding").alias("title_vector"), "name_vector"))
    return got.select("vec_id", F.round("relevance", 5).alias("relevance"))


@query(f"select {uuid_sql('concat_ws(' + quoted('|') + ', ' + quoted('news') + ', id, ' + quoted('https://h.example/') + ' || id)')} as id, id as company_id, case when id % 9 in (0, 8) then 0.7::double end as severity from {{companies}} where id % 10 >= 2")
def e6_news_evidence(companies):
    events = ex.classify_events(headlines(companies)).withColumn("severity", F.when(F.col("event_type") == "strike", F.col("severity")))
    rows = events.select(F.col("id").alias("company_id"), F.concat(F.lit("https://h.example/"), F.col("id").cast("string")).alias("url"), "title", ((F.col("id") % 10) / 10).alias("relevance"), "event_type", "severity", now().alias("seen_at"))
    return ex.news_evidence(rows).select("id", "company_id", "severity")


@query(f"select {uuid_sql('concat_ws(' + quoted('|') + ', ' + quoted('context') + ', topic, url)')} as id, extracted from (select distinct (page_id % 3)::string as topic, url, to_json({{'origin': 'geopolitical_context', 'topic': (page_id % 3)::string, 'title': 'x', 'url': url, 'eligible_for_scoring': false}}) as extracted from pages)")
def e7_context_rows(pages):
    rows = pages.select((F.col("page_id") % 3).cast("string").alias("topic"), "url", F.lit("x").alias("title"), now().alias("seen_at")).dropDuplicates(["topic", "url"])
    return ex.context_rows(rows).select("id", "extracted")


@query(f"select {uuid_sql('concat(' + quoted('sensor:') + ', sha256(to_json({' + quoted('location_id') + ': id, ' + quoted('source') + ': ' + quoted('ais') + '})))')} as id, id as location_id, null::double as severity from {{locations}}")
def e8_sensor_observations(locations):
    metrics = locations.select(F.col("id").alias("location_id"), F.lit("ais").alias("source"), (F.col("radius_km") / 10).alias("vessel_activity_ratio"))
    return ex.sensor_observations(metrics, ["source", "location_id"]).select("id", "location_id", "severity")


@query("select o_orderkey as id, case o_orderkey % 3 when 1 then US[o_orderdate] else US[o_orderdate] end as at_us, case when o_orderkey % 3 = 0 then null when o_orderkey % 3 = 1 then US[o_orderdate] else US[o_orderdate] - 7200000000 end as strict_us from orders where o_orderkey % 3 < 2 union all select o_orderkey, US[o_orderdate] - 7200000000, US[o_orderdate] - 7200000000 from orders where o_orderkey % 3 = 2")
def f19_parse_utc(orders):
    text = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.element_at(F.array(F.lit(""), F.lit("Z"), F.lit("+02:00")), (F.col("o_orderkey") % 3 + 1).cast("int")))
    return orders.select(F.col("o_orderkey").alias("id"), F.unix_micros(fv.parse_utc(text)).alias("at_us"), F.unix_micros(fv.parse_utc(text, naive=False)).alias("strict_us"))


@query("select id, sha256(to_json({'meta': {'source': name}, 'rows': [{'id': id}], 'value': id})) as identity from {suppliers}")
def f21_identity(suppliers):
    rows = suppliers.select("id", F.struct(F.col("name").alias("source"), F.rand().alias("downloaded_at")).alias("meta"), F.array(F.struct(F.col("id"), F.rand().alias("downloaded_at"))).alias("rows"), F.col("id").alias("value"), F.rand().alias("downloaded_at"))
    return rows.select("id", F.sha2(sinks.canonical_json(rows.drop("id"), ("downloaded_at",)), 256).alias("identity"))


@query("select doc_id, sha256(substr(coalesce(text, ''), greatest(instr(lower(coalesce(text, '')), 'token') - 500, 1)::bigint, 1200)) as excerpt_sha256 from documents where doc_id is not null")
def f24_excerpts(documents):
    return documents.select("doc_id", F.sha2(ft.excerpt(F.coalesce("text", F.lit("")), F.lit("TOKEN")), 256).alias("excerpt_sha256"))


@query("select id, nullif(trim(regexp_replace(case when id % 5 = 0 then '()[]' else name || ' (' || industry || ')' end, '[^A-Za-z0-9_ &.-]', ' ', 'g')), '') as phrase from {companies}")
def f25_phrases(companies):
    given = F.when(F.col("id") % 5 == 0, "()[]").otherwise(F.concat("name", F.lit(" ("), "industry", F.lit(")")))
    return companies.select("id", ft.sanitize_phrase(given).alias("phrase"))


@query(f"select o_orderkey as id, 'https://www.sec.gov/Archives/edgar/data/' || o_custkey || '/' || replace({ACCESSION}, '-', '') || '/' || {DOCUMENT} as url from orders")
def f26_archive_urls(orders):
    return orders.select(F.col("o_orderkey").alias("id"), ft.archive_url(F.lpad(F.col("o_custkey").cast("string"), 10, "0"), F.expr(ACCESSION), F.expr(DOCUMENT)).alias("url"))


@query("select distinct d::string as day, (d - 37)::string as recent_start, (d - 7)::string as recent_end, (date_trunc('month', d)::date - interval 2 month)::date::string as month_before, (date_trunc('month', d)::date - interval 1 month)::date::string as month_after from (select o_orderdate::date as d from orders)")
def f18_default_windows(orders):
    day = F.to_date("o_orderdate")
    names = ("recent_start", "recent_end", "month_before", "month_after")
    return orders.select(day.cast("string").alias("day"), *[c.cast("string").alias(n) for c, n in zip(fv.default_windows(day), names, strict=True)]).distinct()


# --- features, splits and models ---------------------------------------------------------------------


FRAMES = "f as (select (\"at\"::date - date '2024-01-01') // 10 as step, mmsi as id, round(sum(sog), 4) as v from {positions} group by 1, 2)"


def activity_frames(positions: DataFrame) -> DataFrame:
    step = F.floor(F.datediff(F.to_date("at"), F.lit("2024-01-01")) / 10).cast("int").alias("step")
    return positions.groupBy(step, F.col("mmsi").alias("id")).agg(F.round(F.sum("sog"), 4).alias("v"))


@query(f"with {FRAMES} select s.step::int as step, u.id, f.id is not null as present, coalesce(f.v, 0) as v from (select distinct step from f) s cross join (select id from f where step = (select max(step) from f)) u left join f on f.step = s.step and f.id = u.id")
def j18_align(positions):
    return fe.align(activity_frames(positions), ["v"])


@query(f"with {FRAMES} select s.step::int as step, count(*) as ids, count(f.id) as present from (select distinct step from f) s cross join (select id from f where step = (select max(step) from f)) u left join f on f.step = s.step and f.id = u.id group by 1")
def m3_temporal_frames(positions):
    frames = activity_frames(positions).withColumn("as_of", F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(days=F.col("step") * 10))
    return fe.temporal_frames(frames, ["v"]).groupBy("step").agg(F.count("*").alias("ids"), F.count_if("present").alias("present"))


@query(f"select (select count(*) from {{companies}} where not is_synthetic and created_at <= MICROS({NOW})) as rows, 1::bigint as snapshots, '{FEATURE_SCHEMA}' as feature_schema")
def m2_record_snapshot(companies, signals, relationships, links):
    path = shared_folder(companies.sparkSession, "snapshots")
    for _ in range(2):  # the second writes nothing
        rows = fe.record_snapshot(companies, signals, relationships, links, now(), path, most=10_000_000)
    return rows.agg(F.count("*").alias("rows"), F.count_distinct("snapshot_id").alias("snapshots"), F.max("feature_schema").alias("feature_schema"))


@query(f"with {SPLIT} select s.split, count(*) as examples, count(distinct example_id) as snapshots from s left join m on m.split = case s.split when 'train' then 'validation' when 'validation' then 'test' end where m.st is null or label_end < m.st group by s.split")
def m5_gated_split(snapshots):
    """Each example has twenty labels of both classes, so the gate passes; U7 lists the snapshots of each part."""
    rows = fe.last_of_day(snapshots).select(F.col("snapshot_id").alias("example_id"), "as_of", F.expr("as_of - interval 2 days as start"), F.expr("as_of + interval 3 days as label_end"), F.expr("as_of + interval 3 days as label_available"), F.array("snapshot_id").alias("frames"), F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: F.struct(i.alias("company_id"), (i % 2).alias("label"))).alias("labels"))
    split = fe.gated(fe.temporal_split(rows))
    ids = fe.split_snapshots(split).groupBy("split").agg(F.count("*").alias("snapshots"))
    return split.groupBy("split").agg(F.count("*").alias("examples")).join(ids, "split")


@query(f"with {SPLIT} select distinct s.split, example_id as snapshot_id from s left join m on m.split = case s.split when 'train' then 'validation' when 'validation' then 'test' end where m.st is null or label_end < m.st")
def u7_split_snapshots(snapshots):
    rows = fe.last_of_day(snapshots).select(F.col("snapshot_id").alias("example_id"), "as_of", F.expr("as_of - interval 2 days as start"), F.expr("as_of + interval 3 days as label_end"), F.expr("as_of + interval 3 days as label_available"), F.array("snapshot_id").alias("frames"))
    return fe.split_snapshots(fe.temporal_split(rows))


@query("select l_returnflag as flag, round(sum(l_discount), 4) as news_value, 0.0::double as satellite_value, round(sum(l_tax), 4) as ais_value, 0.0::double as viirs_age from lineitem group by 1")
def m6_ablate(lineitem):
    nodes = lineitem.select("l_returnflag", *[F.col(c).alias(f"{s}_{t}") for s, c in (("news", "l_discount"), ("satellite", "l_quantity"), ("viirs", "l_quantity"), ("ais", "l_tax")) for t in fe.STATS])
    got = fe.ablate(nodes, ABLATIONS[1])
    return got.groupBy(F.col("l_returnflag").alias("flag")).agg(*[F.round(F.sum(c), 4).alias(c) for c in ("news_value", "satellite_value", "ais_value", "viirs_age")])


CHOSEN = "case when schema_ok and basis_ok and ablation = 'full' and lineage_ok and steps between 2 and 30 and validation_positives between 1 and 29 and validation_brier < constant_brier then id end"


@query(f"select id, id = (select min({CHOSEN}) from {{models}}) as is_active from {{models}} where (select min({CHOSEN}) from {{models}}) is not null")
def m9_activate(models):
    usable = models.where(mo.eligibility().isNull()).agg(F.min("id").alias("id")).first()["id"]
    return mo.activate(models, usable).select("id", "is_active") if usable is not None else models.where("false").select("id", "is_active")


@query(f"with {RUNS}, best as (select arg_min(architecture, struct_pack(a := brier, b := architecture, c := seed)) as b from runs2 where split = 'validation' and ablation = 'full') select architecture, ablation, round(avg(f1), 6) as f1_mean, round(stddev_pop(f1), 6) as f1_sd, round(avg(brier), 6) as brier_mean, architecture = (select b from best) and ablation = 'full' as recommended, (select round(avg((r - y) ** 2), 6) from {{predictions}}, (select avg(y) as r from {{predictions}} where split = 'train') where split = 'test') as test_constant_brier from runs2 where split = 'test' group by 1, 2")
def m10_experiment_report(lineitem, predictions):
    got = mo.experiment_report(experiment_runs(lineitem), predictions.select("split", "y"))
    return got.select("architecture", "ablation", r6("f1_mean"), r6("f1_sd"), r6("brier_mean"), "recommended", r6("test_constant_brier"))


@query("select id, coalesce(round(m.severity, 6), 0) as severity, m.severity is null as missing from {suppliers} s left join (select company_id, max(severity) as severity from {signals} group by company_id) m on m.company_id = s.id where s.id in (select src from {edges} union select dst from {edges})")
def m11_observed_inputs(suppliers, signals, edges):
    severity = signals.where("company_id is not null").groupBy("company_id").agg(F.max("severity").alias("severity"))
    members = gr.observed_components(edges, edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct())
    return mo.observed_inputs(suppliers.select("id"), severity, members).select("id", r6("severity"), "missing")


# --- the evidence store and its jobs ----------------------------------------------------------------


@query("select id, case when id % 2 = 0 then name else 'catalog ' || name end as name, 'company' as kind from {companies} union all select id, case when id % 3 = 0 then 'moved' else name end, 'location' from {locations}")
def k1_install_catalog(companies, locations):
    there = {"companies": companies.where("id % 2 = 0").select("id", "name"), "locations": locations.select("id", "name")}
    catalog = {"companies": companies.select("id", F.concat(F.lit("catalog "), "name").alias("name")), "locations": locations.where("id % 3 = 0").select("id", F.lit("moved").alias("name"))}
    for _ in range(2):  # running it again changes nothing
        there = ev.install_catalog(there, catalog)
    return there["companies"].withColumn("kind", F.lit("company")).unionByName(there["locations"].withColumn("kind", F.lit("location")))


PAIR = uuid_sql("concat_ws('|', 'relationship', supplier_id, customer_id, source_signal_id)")


@query(f"select id, case when k % 2 = 0 then 'approved' else 'pending' end as status from (select {PAIR} as id, min(supplier_id) as k from {{relationships}} group by 1)")
def k3_save_relationships(relationships):
    keys = relationships.select("supplier_id", "customer_id", "source_signal_id")
    none = keys.where("false").select(F.lit("").alias("id"), *keys.columns, F.lit("").alias("status"))
    first = ev.save_relationships(none, keys.where("supplier_id % 2 = 0")).withColumn("status", F.lit("approved"))
    return ev.save_relationships(first, keys).select("id", "status")


@query("select id, case when errors = 0 then 'success' when productive > 0 then 'partial' else 'failed' end as status, errors::bigint as errors from {runs}")
def k6_audit_runs(runs):
    start = runs.select("id", F.lit("running").alias("status"), F.col("started_us").alias("written_at"), F.lit(0).cast("long").alias("errors"))
    end = runs.select("id", ev.run_status(F.col("errors"), F.col("productive")).alias("status"), F.col("finished_us").alias("written_at"), F.col("errors").cast("long").alias("errors"))
    path = shared_folder(runs.sparkSession, "audit")
    for rows in (start, end):
        rows.write.mode("append").parquet(path)
    return ev.latest_runs(runs.sparkSession.read.schema(start.schema).parquet(path)).select("id", "status", "errors")


@query("select id, case when errors > 0 then 'failed' else 'success' end as status, case when errors > 0 then 7 else finished_us end as finished_us from {runs}")
def r6_close_abandoned(runs):
    open_ = runs.select("id", F.when(F.col("errors") > 0, "running").otherwise("success").alias("status"), F.timestamp_micros("finished_us").alias("finished_at"))
    return ev.close_abandoned(open_, F.timestamp_micros(F.lit(7))).select("id", "status", F.unix_micros("finished_at").alias("finished_us"))


# --- streams ------------------------------------------------------------------------------------------


def streamed(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as landed files and a stream over them, with the folder of its state."""
    spark, path = df.sparkSession, landed(df, name)
    return jobs.landed(spark, path, df.schema), shared_folder(spark, f"{name}-job")


@query("select source_type, count(*) as n, round(sum(severity), 4) as severity from {signals} group by source_type")
def r1_once(signals):
    stream, folder = streamed(signals, "signals")
    for _ in range(2):  # nothing new has landed the second time
        jobs.once(stream, f"{folder}/out", f"{folder}/state").awaitTermination()
    got = signals.sparkSession.read.schema(signals.schema).parquet(f"{folder}/out")
    return got.groupBy("source_type").agg(F.count("*").alias("n"), F.round(F.sum("severity"), 4).alias("severity"))


@query("select id, round(severity, 6) as severity from {signals}")
def r3_merge_new(signals):
    rows = signals.select("id", "severity", "ingested_at")
    later = rows.select("id", (F.col("severity") + 1).alias("severity"), (F.col("ingested_at") + F.expr("interval 1 hour")).alias("ingested_at"))
    stream, folder = streamed(rows.unionByName(later), "replayed")
    for k in range(2):  # a replay of all files changes nothing
        stream.writeStream.foreachBatch(jobs.merge_new(f"{folder}/table")).option("checkpointLocation", f"{folder}/state{k}").trigger(availableNow=True).start().awaitTermination()
    return signals.sparkSession.read.schema(rows.schema).parquet(f"{folder}/table").select("id", r6("severity"))


#: A day leaves the append-mode stream once the watermark, a day behind the last position, is past its end.
@query("select cast(\"at\"::date as string) as day, count(distinct mmsi) as vessels, count(*) as positions from {positions} group by 1 having max(\"at\"::date) + 1 <= (select max(\"at\") - interval 1 day from {positions})")
def r5_stream_daily_vessels(positions):
    stream, folder = streamed(positions, "stream")
    jobs.once(jobs.daily_vessels(stream), f"{folder}/out", f"{folder}/state").awaitTermination()
    return positions.sparkSession.read.schema("day date, vessels long, positions long").parquet(f"{folder}/out").select(F.col("day").cast("string").alias("day"), "vessels", "positions")


@query("select date_trunc('day', observed_at)::date::string as day, count(*) as n from {signals} group by 1 having max(date_trunc('day', observed_at)) + interval 1 day <= (select max(observed_at) - interval 1 day from {signals})")
def r2_stream_volume(signals):
    stream, folder = streamed(signals.select("id", "observed_at"), "volume")
    jobs.once(jobs.window_volume(stream, "observed_at"), f"{folder}/out", f"{folder}/state").awaitTermination()
    return signals.sparkSession.read.schema("window_start timestamp, n long, saturated boolean").parquet(f"{folder}/out").select(F.to_date("window_start").cast("string").alias("day"), "n")


def isolated_counts(signals: DataFrame) -> DataFrame:
    """One job for each source; the one of `viirs` fails and the others still commit what they take and what they refuse."""
    spark = signals.sparkSession
    bad, good = shared_folder(spark, "quarantine"), shared_folder(spark, "accepted")
    rows = signals.select("id", "source_type", F.when(F.col("severity") > 0.9, "severity").alias("reason"))

    def job(source: str):
        def start():
            stream, folder = streamed(rows.where(F.col("source_type") == source), f"source-{source}")
            if source == "viirs":
                raise RuntimeError("the source is down")
            sink = jobs.quarantined(f"{bad}/{source}", f"{good}/{source}")
            return stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()

        return start

    count = lambda path, schema, name: spark.read.schema(schema).parquet(path).agg(F.count("*").alias(name))
    found = None
    for source, failure in jobs.isolated({s: job(s) for s in SOURCES}).items():
        if failure is None:
            n = count(f"{bad}/{source}", rows.schema, "quarantined").crossJoin(count(f"{good}/{source}", rows.drop("reason").schema, "accepted"))  # one row each
        else:
            n = spark.range(1).select(F.lit(0).cast("long").alias("quarantined"), F.lit(0).cast("long").alias("accepted"))
        row = n.select(F.lit(source).alias("source_type"), F.lit("committed" if failure is None else "failed").alias("outcome"), "quarantined", "accepted")
        found = row if found is None else found.unionByName(row)
    return found


@query("select source_type, case when source_type = 'viirs' then 'failed' else 'committed' end as outcome, case when source_type = 'viirs' then 0 else count(*) filter (severity > 0.9) end as quarantined from {signals} where source_type is not null group by source_type")
def r7_isolated_sources(signals):
    return isolated_counts(signals).drop("accepted")


@query("select source_type, case when source_type = 'viirs' then 0 else count(*) filter (severity > 0.9) end as quarantined, case when source_type = 'viirs' then 0 else count(*) filter (coalesce(severity <= 0.9, true)) end as accepted from {signals} where source_type is not null group by source_type")
def r7_both_sinks(signals):
    return isolated_counts(signals).drop("outcome")
