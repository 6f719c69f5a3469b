"""Registered queries of the evidence store kept in tables of hash buckets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..schemas import TS, S, schema
from ..session import shared_folder
from ..sources.evidence_tables import EvidenceTables
from .bindings import DAY, NOW
from .coverage import PAIR, landed, uuid_sql
from .queries import query


def opened(df, name: str, **schemas) -> EvidenceTables:
    return EvidenceTables(df.sparkSession, shared_folder(df.sparkSession, name), schemas, 8)


@query("""select id, case when id % 2 = 0 then name else 'catalog ' || name end as name, 'company' as kind from {companies}
union all select id, case when id % 3 = 0 then 'moved' else name end, 'location' from {locations}""")
def k1_install_tables(companies, locations):
    """A catalog installed over what is there, and once more: companies stay, locations are replaced."""
    companies, locations = companies.select("id", "name"), locations.select("id", "name")
    store = opened(companies, "catalog", companies=companies.schema, locations=locations.schema)
    store.install({"companies": companies.where("id % 2 = 0"), "locations": locations})
    moved = locations.where("id % 3 = 0").withColumn("name", F.lit("moved"))
    for _ in range(2):
        store.install({"companies": companies.withColumn("name", F.concat(F.lit("catalog "), "name")), "locations": moved})
    kind = lambda name: store.read(name).withColumn("kind", F.lit(name))
    return kind("companies").withColumn("kind", F.lit("company")).unionByName(kind("locations").withColumn("kind", F.lit("location")))


INDUSTRY = "case when substr(id::varchar, 1, 2) in ('35', '36') then 'Electronics' when substr(id::varchar, 1, 2) in ('13', '29', '49') then 'Energy' else 'Other' end"


@query(f"""select id::varchar as id, cik, case when id % 3 = 0 then 'changed ' || name else name end as name, case when id % 3 = 0 then {INDUSTRY} else industry end as industry,
    case when id % 3 = 0 then null else country end as country from {{companies}}
union all select {uuid_sql("'company:N' || cik")}, 'N' || cik, name, {INDUSTRY}, null from {{companies}} where id % 5 = 0""")
def k2_company_tables(companies):
    """Profiles of known and of new companies over a table of companies, twice: only the rows of their CIKs change."""
    rows = companies.select(F.col("id").cast("string").alias("id"), "name", "cik", "industry", "country")
    store = opened(rows, "profiles", companies=rows.schema)
    store.install({"companies": rows})
    sic = F.col("id").cast("string").alias("sic")
    known = companies.where("id % 3 = 0").select("cik", F.concat(F.lit("changed "), "name").alias("name"), sic)
    new = companies.where("id % 5 = 0").select(F.concat(F.lit("N"), "cik").alias("cik"), "name", sic)
    for _ in range(2):
        store.upsert_companies(known.unionByName(new))
    return store.read("companies").select("id", "cik", "name", "industry", "country")


FIRST, SECOND = NOW + 11 * DAY, NOW + 12 * DAY


@query(f"""select id, case when k % 3 = 0 then 'rejected' when k % 4 = 0 then 'approved' else 'pending' end as status,
    case when k % 3 = 0 then {SECOND} when k % 4 = 0 then {FIRST} end::bigint as reviewed_us from (select {PAIR} as id, min(supplier_id) as k from {{relationships}} group by 1)""")
def k4_reviewed_tables(relationships):
    """Found relationships saved and reviewed in two rounds; what is found again stays as it was reviewed."""
    found = relationships.select("supplier_id", "customer_id", "source_signal_id")
    kinds = found.schema
    found = found.sparkSession.read.schema(kinds).parquet(landed(found, "found"))  # each merge reads them twice
    store = opened(found, "reviews", relationships=schema(id=S, **{f.name: f.dataType for f in kinds}, status=S, reviewed_at=TS))
    for part, rule, status, us in (("supplier_id % 2 = 0", "supplier_id % 4 = 0", "approved", FIRST), ("true", "supplier_id % 3 = 0", "rejected", SECOND)):
        store.save_relationships(found.where(part))
        chosen = store.read("relationships").where(rule)
        store.review(chosen.select("id", F.lit(status).alias("status"), F.timestamp_micros(F.lit(us)).alias("decided_at")))
    return store.read("relationships").select("id", "status", F.unix_micros("reviewed_at").alias("reviewed_us"))
