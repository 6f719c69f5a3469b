"""The evidence store: merges, reviews, projections, purges and audit rows. All return new tables; nothing is overwritten in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import uuid5
from ..functions.values import sic_to_industry
from ..session import parts
from .relational import newest, oldest, real_relationships


def insert_only(there: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """there, plus new rows whose key is not there; of several new rows with a key the earliest ingested."""
    n = parts(there, new)
    new = new.repartition(n, key)
    first = oldest(new, [key], ["ingested_at"]) if "ingested_at" in new.columns else new.dropDuplicates([key])
    return there.unionByName(first.join(there.select(key).repartition(n, key), key, "left_anti").select(*there.columns))


def upsert(there: DataFrame, new: DataFrame, key: str = "id", keep: list[str] | None = None) -> DataFrame:
    """there with non-key columns replaced where new has the key, plus what is new; `keep` columns stay as they were."""
    kept = set(keep or [])
    side = new.select(key, *[F.col(c).alias(f"_{c}") for c in new.columns if c != key], F.lit(True).alias("_new"))
    met = there.withColumn("_old", F.lit(True)).join(side, key, "full")
    pick = lambda c: F.when(F.col("_new") & (F.lit(c not in kept) | F.col("_old").isNull()), F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
    return met.select(key, *[pick(c) if c in new.columns else F.col(c) for c in there.columns if c != key]).select(*there.columns)


def upsert_company(companies: DataFrame, profiles: DataFrame) -> DataFrame:
    """profiles (cik, name, sic) met by CIK: ids stay, name and industry are replaced, the country becomes unknown; new CIKs get derived ids."""
    new = profiles.select("cik", F.col("name").alias("_name"), sic_to_industry(F.col("sic")).alias("_industry"))
    met = companies.join(new, "cik", "full")
    fresh = F.col("_name").isNotNull()
    return met.select(
        F.coalesce("id", uuid5(F.concat(F.lit("company:"), "cik"))).alias("id"),
        F.when(fresh, F.col("_name")).otherwise(F.col("name")).alias("name"),
        "cik",
        F.when(fresh, F.col("_industry")).otherwise(F.col("industry")).alias("industry"),
        F.when(~fresh, F.col("country")).alias("country"),
    )


def relationship_id() -> Column:
    """An id derived from the parties and the signal."""
    return uuid5(F.concat_ws("|", F.lit("relationship"), "supplier_id", "customer_id", "source_signal_id"))


def derived_relationships(found: DataFrame, schema: T.StructType) -> DataFrame:
    """found as pending rows of a schema, with their derived id; what found lacks is null."""
    named = found.withColumn("id", relationship_id()).withColumn("status", F.lit("pending"))
    return named.select(*[F.col(f.name).cast(f.dataType) if f.name in named.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])


def save_relationships(there: DataFrame, found: DataFrame) -> DataFrame:
    """Derived id, pending, insert-only: what was reviewed stays reviewed."""
    return insert_only(there, derived_relationships(found, there.schema))


def review(relationships: DataFrame, decisions: DataFrame) -> DataFrame:
    """The last decision (id, status, decided_at) of each relationship takes effect."""
    n = parts(relationships, decisions)
    last = newest(decisions.where(F.col("status").isin("approved", "rejected")).repartition(n, "id"), ["id"], ["decided_at", "status"])
    last = last.select("id", F.col("status").alias("_s"), F.col("decided_at").alias("_at"))
    met = relationships.repartition(n, "id").join(last, "id", "left")
    return met.withColumns({"status": F.coalesce("_s", "status"), "reviewed_at": F.coalesce("_at", "reviewed_at")}).select(*relationships.columns)


def project_edges(relationships: DataFrame) -> DataFrame:
    """One edge for each pair from approved rows in (created_at, id) order: the last attributes win, evidence is collected in order."""
    row = F.struct("created_at", "id", "source_signal_id")
    last = F.max_by(F.struct("relationship_type", "criticality", "confidence", "provenance"), F.struct("created_at", "id"))
    kept = relationships.where("status = 'approved'").groupBy("supplier_id", "customer_id").agg(last.alias("_a"), F.array_sort(F.collect_list(row)).alias("_e"))
    ids = F.filter(F.transform("_e", lambda e: e["source_signal_id"]), lambda x: x.isNotNull())
    return kept.select(F.col("supplier_id").alias("src"), F.col("customer_id").alias("dst"), "_a.*", ids.alias("evidence_ids"))


def projection(companies: DataFrame, signals: DataFrame, relationships: DataFrame) -> dict[str, DataFrame]:
    """The derived graph, recomputed whole from the evidence."""
    return {
        "nodes": companies.select("id", "name", "industry", "is_synthetic"),
        "affected": signals.where(F.col("company_id").isNotNull()).select(F.col("company_id").alias("src"), F.col("id").alias("dst")),
        "edges": project_edges(relationships),
    }


def graph_counts(companies: DataFrame, signals: DataFrame, relationships: DataFrame) -> DataFrame:
    one = lambda df, name: df.agg(F.count("*").alias(name))
    pairs = relationships.where("status = 'approved'").select("supplier_id", "customer_id").repartition(parts(relationships), "supplier_id", "customer_id").distinct()
    return one(companies, "companies").crossJoin(one(signals, "signals")).crossJoin(one(pairs, "edges"))  # one row each


def purge(tables: dict[str, DataFrame], basis: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables without synthetic companies, their dependents and scores of another basis; a preview of the counts, which reads each table once)."""
    gone = tables["companies"].where("is_synthetic").select("id")
    keys = {"signals": ["company_id"], "relationships": ["supplier_id", "customer_id"], "company_locations": ["company_id"], "risk_scores": ["company_id"]}
    left = {"companies": tables["companies"].where(~F.col("is_synthetic"))}
    for name, columns in keys.items():
        if name in tables:
            df = tables[name]
            for c in columns:
                df = df.join(gone.select(F.col("id").alias(c)), c, "left_anti")
            left[name] = (df.where(F.col("input_basis") == basis) if name == "risk_scores" else df).select(*tables[name].columns)
    counts, once = None, gone.distinct()
    for name in left:
        columns, stays = keys.get(name, []), F.lit(True)
        if name == "companies":
            stays = ~F.col("is_synthetic")
        elif name == "risk_scores":
            stays = F.col("input_basis") == basis
        met, n = tables[name], parts(tables[name])
        for i, c in enumerate(columns):
            met = met.repartition(n, c).join(once.select(F.col("id").alias(c), F.lit(True).alias(f"_gone{i}")).hint("merge"), c, "left")
            stays = stays & F.col(f"_gone{i}").isNull()
        row = met.agg((F.count("*") - F.count_if(stays)).alias("removed")).select(F.lit(name).alias("table"), "removed")
        counts = row if counts is None else counts.unionByName(row)
    return left, counts


def run_status(errors: Column, productive: Column) -> Column:
    return F.when(errors == 0, "success").when(productive > 0, "partial").otherwise("failed")


def audit_run(spark: SparkSession, path: str, run: str, status: str, at: str, errors: int = 0, summary: str | None = None) -> None:
    """Append a row of a run: at its start with status `running`, at its end with the outcome."""
    row = spark.range(1).select(F.lit(run).alias("id"), F.lit(status).alias("status"), F.lit(at).cast("timestamp").alias("written_at"), F.lit(errors).alias("errors"), F.lit(summary).cast("string").alias("summary"))
    row.write.mode("append").parquet(path)


def latest_runs(audit: DataFrame) -> DataFrame:
    """Runs append a row at the start and one at the end; the last row counts."""
    return newest(audit, ["id"], ["written_at"])


def close_abandoned(runs: DataFrame, now: Column) -> DataFrame:
    return runs.withColumn("finished_at", F.when(F.col("status") == "running", now).otherwise(F.col("finished_at"))).withColumn("status", F.when(F.col("status") == "running", "failed").otherwise(F.col("status")))


def first_by_url(articles: DataFrame) -> DataFrame:
    """Each (topic, url) once, from the earliest window."""
    return oldest(articles, ["topic", "url"], ["window_start", "title"])


def window_counts(articles: DataFrame, full: int = 250) -> DataFrame:
    """Articles of each topic and day window, and whether the window is saturated."""
    day = F.window("seen_at", "1 day")["start"].alias("window_start")
    return articles.groupBy("topic", day).agg(F.count("*").alias("n")).withColumn("saturated", F.col("n") >= full)


def topic_summary(windows: DataFrame) -> DataFrame:
    return windows.groupBy("topic").agg(F.sum("n").alias("articles"), F.count_if("saturated").alias("capped_windows"))


def install_catalog(there: dict[str, DataFrame], catalog: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Companies and evidence are only inserted, locations and cases replaced; running it again changes nothing."""
    merge = {"companies": insert_only, "signals": insert_only, "relationships": insert_only, "locations": upsert, "cases": upsert}
    return {name: merge[name](df, catalog[name]) if name in catalog else df for name, df in there.items()}


def coverage(signals: DataFrame, companies: DataFrame) -> DataFrame:
    """For each source: count and latest times, over signals of real companies or of locations."""
    real = companies.where(~F.col("is_synthetic")).select(F.col("id").alias("company_id"))
    kept = signals.where(F.col("company_id").isNull() & F.col("location_id").isNotNull()).unionByName(signals.join(real, "company_id", "left_semi").select(*signals.columns))
    return kept.groupBy("source_type").agg(F.count("*").alias("signals"), F.max("observed_at").alias("latest_observed"), F.max("ingested_at").alias("latest_ingested"))


def companies_with_recent_news(signals: DataFrame, companies: DataFrame, now: Column, days: int = 30) -> DataFrame:
    real = companies.where(~F.col("is_synthetic")).select(F.col("id").alias("company_id"))
    recent = signals.where((F.col("source_type") == "news") & (F.col("observed_at") >= now - F.make_interval(days=F.lit(days))))
    return recent.join(real, "company_id", "left_semi").agg(F.count_distinct("company_id").alias("companies"))


def valid_edges(relationships: DataFrame, companies: DataFrame, signals: DataFrame, as_of: Column) -> DataFrame:
    """Approved edges known at as_of, then the last row of each pair: an invalid later row does not hide a valid earlier one."""
    kept = real_relationships(relationships, companies.where(F.col("created_at") <= as_of)).where(
        (F.col("supplier_id") != F.col("customer_id")) & (F.col("status") == "approved") & (F.col("created_at") <= as_of) & (F.col("reviewed_at") <= as_of) & F.col("criticality").between(0, 1) & ~F.isnan("criticality")
    )
    visible = signals.where((F.col("ingested_at") <= as_of) & (F.col("observed_at") <= as_of)).select(F.col("id").alias("source_signal_id"))
    return newest(kept.join(visible, "source_signal_id", "left_semi").select(*relationships.columns), ["supplier_id", "customer_id"], ["created_at", "id"])
