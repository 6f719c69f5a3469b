"""The reference tables as views over the given tables, in SQL that Spark and DuckDB both run.

MICROS(x) makes a timestamp of microseconds, US[x] the microseconds of a timestamp; {name} is a
given table or another binding.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..session import parts

DAY = 86_400_000_000
#: 2024-01-20 00:00 UTC, the moment that the queries take as now.
NOW = 1_705_708_800_000_000

VIEWS = {
    "companies": f"""select c_custkey as id, c_name as name, concat('C', cast(c_custkey as string)) as ticker, lpad(cast(c_custkey as string), 10, '0') as cik,
        c_mktsegment as industry, cast(c_nationkey as string) as country, c_custkey % 10 = 9 as is_synthetic,
        MICROS(1700000000000000 + (c_custkey % 90) * {DAY}) as created_at from {{customer}}""",
    "scores": """select o_orderkey as id, o_custkey as company_id, o_orderkey % 3 as model_version_id, 'observed' as input_basis,
        least(1.0, o_totalprice / 499979) as score, MICROS(US[o_orderdate]) as computed_at from {orders}""",
    "signals": f"""select event_id as id, case when event_id % 7 = 0 then null else user_id end as company_id, case when event_id % 7 = 0 then user_id % 20 end as location_id,
        case event_type when 'view' then 'news' when 'click' then 'news' when 'signup' then 'satellite' when 'error' then 'viirs' else 'ais' end as source_type,
        least(1.0, value / 500) as severity,
        concat('{{{{"origin":"', case when event_type in ('signup', 'error', 'purchase') then 'location_observation' when event_id % 3 = 0 then 'geopolitical_context' else 'headline' end,
          '","provenance":"file-', cast(event_id % 50 as string), '","topic":"t', cast(event_id % 4 as string), '","eligible_for_scoring":', case when event_id % 11 = 0 then 'false' else 'true' end,
          ',"surface_change":0.', lpad(cast(event_id % 100 as string), 2, '0'), ',"relative_radiance_decrease":0.', lpad(cast(event_id % 90 as string), 2, '0'),
          ',"vessel_activity_ratio":1.', lpad(cast(event_id % 80 as string), 2, '0'), '}}}}') as extracted,
        MICROS(US[ts]) as observed_at, MICROS(US[ts] + (event_id % 5) * {DAY}) as ingested_at from {{events}}""",
    "positions": """select 100000000 + user_id * 7 as mmsi, MICROS(US[ts]) as at, 33.70 + cast(event_id % 100 as double) / 1000 as lat,
        -118.30 + cast(event_id % 77 as double) / 1000 as lon, value as sog from {events}""",
    "relationships": f"""select l_orderkey * 10 + l_linenumber as id, min(l_suppkey) as supplier_id, min(o_custkey) as customer_id, min(l_orderkey % 10000) as source_signal_id,
        case min(l_linenumber % 4) when 0 then 'raw_material' when 1 then 'component' when 2 then 'logistics' else 'manufacturing' end as relationship_type,
        max(l_discount) * 10 as criticality, max(l_tax) * 10 as confidence, case max(l_returnflag) when 'R' then 'approved' when 'A' then 'pending' else 'rejected' end as status,
        case min(l_linenumber % 3) when 0 then 'sec_filing' when 1 then 'public_source' else 'synthetic' end as provenance,
        MICROS(1704067200000000 + min((l_orderkey * 10 + l_linenumber) % 20) * {DAY}) as created_at, MICROS(1704067200000000 + min((l_orderkey * 10 + l_linenumber) % 23) * {DAY}) as reviewed_at
        from {{lineitem}} join {{orders}} on l_orderkey = o_orderkey group by l_orderkey, l_linenumber""",
    "locations": """select s_suppkey as id, s_name as name, cast(s_suppkey * 37 % 1600 as double) / 10 - 80 as lat, cast(s_suppkey * 91 % 3590 as double) / 10 - 179 as lon,
        cast(1 + s_suppkey % 19 as double) as radius_km from {supplier}""",
    "links": f"""select c_custkey as company_id, c_custkey % 20 as location_id, case when c_custkey % 13 = 0 then '' else 'https://example.org' end as source_url,
        MICROS(1704067200000000 + (c_custkey % 30) * {DAY}) as available_at from {{customer}}""",
    "edges": """select a.l_suppkey as src, b.l_suppkey as dst, max(a.l_discount) * 10 as criticality, max(a.l_tax) * 10 as w from {lineitem} a join {lineitem} b
        on a.l_orderkey = b.l_orderkey and a.l_linenumber + 1 = b.l_linenumber where a.l_suppkey <> b.l_suppkey group by a.l_suppkey, b.l_suppkey""",
    "suppliers": "select s_suppkey as id, s_name as name, round((s_acctbal + 1000) / 11000, 6) as shock, s_nationkey % 7 = 0 as is_synthetic from {supplier}",
    "predictions": """select case when l.doc_id % 5 < 3 then 'train' when l.doc_id % 5 = 3 then 'validation' else 'test' end as split, l.toxic as y, cast(d.n_chars % 100 as double) / 100 as p,
        l.doc_id from {labels} l join {documents} d on l.doc_id = d.doc_id""",
    "cases": f"""select o_orderkey as id, o_custkey as company_id, case when o_orderstatus = 'F' then 'historical' else 'ongoing' end as reported_status, cast(o_orderdate as date) as event_start,
        MICROS(1702000000000000 + (o_orderkey % 60) * {DAY}) as published_at from {{orders}}""",
    "snapshots": """select concat('s', cast(max(event_id) as string)) as snapshot_id, MICROS(max(US[ts])) as as_of from {events} group by floor(US[ts] / 21600000000)""",
    "runs": """select cast(cast(ts as date) as string) as id, min(US[ts]) as started_us, max(US[ts]) as finished_us, sum(case when event_type = 'error' then 1 else 0 end) as errors,
        sum(case when event_type = 'purchase' then 1 else 0 end) as productive from {events} group by cast(ts as date)""",
    "models": f"""select s_suppkey as id, case when s_suppkey % 4 = 0 then 'simulated' else 'real' end as data_basis, s_suppkey % 9 <> 0 as schema_ok, true as basis_ok,
        case when s_suppkey % 5 = 0 then 'no_news' else 'full' end as ablation, s_suppkey % 7 <> 0 as lineage_ok, 1 + s_suppkey % 31 as steps, 90 as train_n, 40 as train_positives,
        30 as validation_n, s_suppkey % 8 as validation_positives, 30 as test_n, 10 as test_positives, round(s_acctbal / 10000, 6) as validation_brier, 0.25 as constant_brier,
        MICROS(1704067200000000 + (s_suppkey * 13 % 50) * {DAY}) as trained_at, false as is_active from {{supplier}}""",
    "pixels_before": "select cast(l_linenumber as string) as scene_id, l_orderkey as row, min(l_partkey % 10) as col, min(l_quantity) / 50 as red, min(l_extendedprice) / 100000 as near, min(l_quantity) > 5 as valid from {lineitem} group by l_linenumber, l_orderkey",
    "pixels_after": "select cast(l_linenumber as string) as scene_id, l_orderkey as row, min(l_partkey % 10) as col, max(l_discount) * 10 as red, max(l_tax) * 10 as near, max(l_quantity) < 48 as valid from {lineitem} group by l_linenumber, l_orderkey",
}
#: The table of a view, and its key, whose rows are dealt to `parts` before they are joined and grouped.
DEALT = {"relationships": ("lineitem", "l_orderkey")}
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def bound(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = re.sub(r"US\[(\w+(?:\.\w+)?)\]", r"unix_micros(cast(\1 as timestamp))", VIEWS[name]).replace("MICROS(", "timestamp_micros(")
    used = [t for t in TABLES if f"{{{t}}}" in text]
    given = {t: bound(spark, sf_dir, t) for t in used}
    if name in DEALT:
        large, key = DEALT[name]
        given[large] = given[large].repartition(parts(*given.values()), key)
    return spark.sql(text, **given)


def duck(sql: str) -> str:
    """sql for DuckDB: {name} of bindings become common tables, the rest the given views."""
    names = [n for n in VIEWS if f"{{{n}}}" in sql]
    views = {n: VIEWS[n].replace("{{", "{").replace("}}", "}") for n in names}
    text = "with recursive " + ", ".join(f"{n} as ({v})" for n, v in views.items()) + (", " if names and sql.lstrip().lower().startswith("with ") else " ") if names else ""
    body = re.sub(r"^\s*with\s+", "", sql, flags=re.I) if names and sql.lstrip().lower().startswith("with ") else sql
    text += body
    for n in [*VIEWS, *TABLES]:
        text = text.replace(f"{{{n}}}", n)
    return re.sub(r"US\[([\w\"]+(?:\.\w+)?)\]", r"epoch_us(\1)", text).replace("MICROS(", "make_timestamp(")
