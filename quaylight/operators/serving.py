"""Read queries of an analyst, composed of the other operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import k_hop
from .relational import by_id, cases_page, guarded, induced, list_companies, newest, of_company, page, real_relationships, with_latest_score, with_parties


def companies_page(companies: DataFrame, scores: DataFrame, number: int = 1, size: int = 50, **filters) -> tuple[DataFrame, DataFrame]:
    """(page with latest scores, total). The page is cut before scores are looked up."""
    kept = list_companies(companies, **filters)
    rows = page(kept, [F.col("name"), F.col("id")], number, size)
    return with_latest_score(rows, scores.join(F.broadcast(rows.select(F.col("id").alias("company_id"))), "company_id", "left_semi")), kept.agg(F.count("*").alias("total"))  # 100 rows at most


def company_detail(companies: DataFrame, scores: DataFrame, company, real_only: bool = False) -> DataFrame:
    return with_latest_score(by_id(companies, company, real_only=real_only), scores.where(F.col("company_id") == company))


def signals_page(signals: DataFrame, owner: str, value, source_type: str | None, number: int, size: int) -> DataFrame:
    found = signals.where(F.col(owner) == value)
    found = found.where(F.col("source_type") == source_type) if source_type else found
    return page(found, [F.desc("observed_at"), F.desc("id")], number, size)


def relationships_page(relationships: DataFrame, companies: DataFrame, signals: DataFrame, company, status: str | None, number: int, size: int) -> DataFrame:
    kept = of_company(real_relationships(relationships, companies), company, status)
    return page(with_parties(kept, companies, signals), [F.desc("created_at"), F.desc("id")], number, size)


def ego_graph(edges: DataFrame, companies: DataFrame, scores: DataFrame, centre, depth: int, direction: str, most: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(nodes with hops and latest score, links among them); refused where over `most` nodes are reached."""
    reached = guarded(k_hop(edges, centre, depth, direction), most, "reached nodes")
    own = scores.join(reached.select(F.col("id").alias("company_id")), "company_id", "left_semi")
    latest = newest(own.select("company_id", "computed_at", "id", "score"), ["company_id"], ["computed_at", "id"]).select(F.col("company_id").alias("id"), "score")
    return reached.join(companies, "id").join(latest, "id", "left").orderBy("hops", "id"), induced(edges, reached).orderBy("src", "dst")


def score_history(scores: DataFrame, company, since: Column | None = None, most: int = 100) -> DataFrame:
    found = scores.where(F.col("company_id") == company)
    found = found.where(F.col("computed_at") >= since) if since is not None else found
    return found.orderBy(F.desc("computed_at"), F.desc("id")).limit(most)


def context_page(signals: DataFrame, topic: str | None, number: int, size: int) -> DataFrame:
    """Context signals by a path in their JSON, with defaults for missing keys."""
    get = lambda k, d: F.coalesce(F.get_json_object("extracted", f"$.{k}"), F.lit(d))
    rows = signals.where(F.get_json_object("extracted", "$.origin") == "geopolitical_context").withColumns({"topic": get("topic", "unknown"), "title": get("title", "")})
    return page(rows.where(F.col("topic") == topic) if topic else rows, [F.desc("observed_at"), F.desc("id")], number, size)


def locations_page(locations: DataFrame, number: int, size: int) -> DataFrame:
    return page(locations, [F.col("name")], number, size)


def location_cases(cases: DataFrame, companies: DataFrame, now: Column, number: int, size: int) -> DataFrame:
    return cases_page(cases, companies, now, number, size)


def source_status(signals: DataFrame) -> DataFrame:
    return signals.where(F.col("location_id").isNotNull()).groupBy("source_type").agg(F.max("observed_at").alias("latest"))


def snapshots_list(snapshots: DataFrame, most: int = 1000) -> DataFrame:
    return snapshots.orderBy(F.desc("as_of")).limit(most)


def by_risk(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc_nulls_last("score"), "name")
