"""Readers of landed files."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import canonical_url
from ..functions.values import finite, parse_utc
from ..operators.sensors import daily_activity
from .sinks import fingerprint

POSITION_COLUMNS = ["MMSI", "BaseDateTime", "LAT", "LON", "SOG"]


def valid_position(mmsi: Column, lat: Column, lon: Column, sog: Column) -> Column:
    return F.coalesce(mmsi.between(100_000_000, 999_999_999) & lat.between(-90, 90) & lon.between(-180, 180) & sog.between(0, 80), F.lit(False))


def classify_positions(rows: DataFrame, box: dict[str, float]) -> DataFrame:
    """rows (mmsi, at, lat, lon, sog) with a column `quality`: accepted, invalid or outside."""
    valid = F.col("at").isNotNull() & valid_position(F.col("mmsi"), F.col("lat"), F.col("lon"), F.col("sog"))
    inside = F.col("lat").between(box["south"], box["north"]) & F.col("lon").between(box["west"], box["east"])
    return rows.withColumn("quality", F.when(~valid, "invalid").when(~inside, "outside").otherwise("accepted"))


def deduplicated_positions(classified: DataFrame) -> DataFrame:
    """Accepted positions, the first of each (mmsi, at, lat, lon)."""
    return classified.where("quality = 'accepted'").drop("quality").dropDuplicates(["mmsi", "at", "lat", "lon"])


def load_quality(classified: DataFrame) -> DataFrame:
    """accepted (after deduplication), invalid and outside counts in one pass."""
    key = F.when(F.col("quality") == "accepted", F.struct("mmsi", "at", "lat", "lon"))
    return classified.agg(F.count_distinct(key).alias("accepted"), F.count_if(F.col("quality") == "invalid").alias("invalid"), F.count_if(F.col("quality") == "outside").alias("outside"))


def read_positions_csv(spark: SparkSession, path: str, box: dict[str, float]) -> tuple[DataFrame, DataFrame]:
    """(positions, quality). All columns are read as text and matched by name; bad rows are counted, not fatal."""
    raw = spark.read.csv(path, header=True)
    if missing := set(POSITION_COLUMNS) - set(raw.columns):
        raise ValueError(f"missing columns: {sorted(missing)}")
    typed = raw.select(
        F.col("MMSI").try_cast("long").alias("mmsi"),
        parse_utc(F.col("BaseDateTime")).alias("at"),
        *[finite(F.col(c).try_cast("double")).alias(c.lower()) for c in ("LAT", "LON", "SOG")],
    )
    classified = classify_positions(typed, box)
    return deduplicated_positions(classified), load_quality(classified)


@F.pandas_udf(schemas.schema(lat=schemas.D, lon=schemas.D))
def wkb_point(wkb: pd.Series) -> pd.DataFrame:
    """A 21-byte point in either byte order; null otherwise. A batch's points are read as one array of records."""
    whole = wkb.str.len().eq(21).fillna(False).to_numpy(dtype=bool)
    packed = b"".join(wkb[whole])
    out = np.full((len(wkb), 2), np.nan)
    first, where = np.frombuffer(packed, np.uint8)[::21], np.flatnonzero(whole)
    for order, sign in (("<", 1), (">", 0)):
        points = np.frombuffer(packed, np.dtype([("o", "u1"), ("kind", f"{order}u4"), ("x", f"{order}f8"), ("y", f"{order}f8")]))
        mine = (first == sign) & (points["kind"] == 1)
        out[where[mine]] = np.stack([points["y"][mine], points["x"][mine]], axis=1)
    return pd.DataFrame(out, columns=["lat", "lon"])


def read_positions_parquet(spark: SparkSession, path: str, day: str, box: dict[str, float]) -> tuple[DataFrame, DataFrame]:
    """One UTC day. Column names are matched without case and underscores; only four columns are read and the day filter reaches the scan."""
    raw = spark.read.parquet(path)
    names = {c.lower().replace("_", ""): c for c in raw.columns}
    start = F.lit(day).cast("timestamp")
    day_rows = raw.where((F.col(names["basedatetime"]) >= start) & (F.col(names["basedatetime"]) < start + F.expr("interval 1 day")))
    typed = day_rows.select(
        F.col(names["mmsi"]).cast("long").alias("mmsi"),
        F.col(names["basedatetime"]).cast("timestamp").alias("at"),
        wkb_point(F.col(names["geometry"])).alias("p"),
        finite(F.col(names["sog"])).alias("sog"),
    ).select("mmsi", "at", "p.lat", "p.lon", "sog")
    classified = classify_positions(typed, box)
    return deduplicated_positions(classified), load_quality(classified)


def bbox_subset_job(spark: SparkSession, paths: dict[str, str], box: dict[str, float], out: str, least_hours: float = 4.0) -> DataFrame:
    """Daily files to typed positions in the box, written by day. Returns the manifest.

    Refuses unless the positions of every day cover `least_hours`, as a ratio of activity asks (activity_ratio).
    """
    days = [(day, *read_positions_parquet(spark, path, day, box)) for day, path in paths.items()]
    positions = reduce(DataFrame.unionByName, [p.withColumn("day", F.lit(day).cast("date")) for day, p, _ in days])
    positions.write.mode("overwrite").partitionBy("day").parquet(out)
    kept = spark.read.schema(positions.schema).parquet(out)
    print_ = fingerprint(F.sha2(F.to_json(F.struct("mmsi", "at", "lat", "lon", "sog")), 256))
    manifest = kept.groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("positions"), print_.alias("sha256"))
    quality = reduce(DataFrame.unionByName, [q.withColumn("day", F.lit(day)) for day, _, q in days])
    manifest = quality.join(manifest.hint("merge"), "day", "left")
    covered = daily_activity(kept).where(F.col("hours") >= least_hours).select(F.col("day").cast("string").alias("day"))
    if short := sorted(set(paths) - {r["day"] for r in covered.collect()}):  # a row for each day
        raise ValueError(f"no usable coverage on {short}")
    return manifest


def read_company_directory(texts: DataFrame) -> DataFrame:
    """texts (value: a JSON object of records) to cik, ticker, name."""
    rows = texts.select(F.explode(F.map_values(F.from_json("value", schemas.DIRECTORY))).alias("r"))
    return rows.select(F.lpad(F.col("r.cik_str").cast("string"), 10, "0").alias("cik"), F.upper("r.ticker").alias("ticker"), F.col("r.title").alias("name"))


def read_filing_index(texts: DataFrame) -> DataFrame:
    """Parallel arrays to one row for each annual filing with valid names."""
    rows = texts.select(F.from_json("value", schemas.FILING_INDEX).alias("f")).select(F.inline(F.arrays_zip("f.form", "f.accessionNumber", "f.primaryDocument", "f.filingDate")))
    rows = rows.toDF("form", "accession", "document", "filing_date")
    return rows.where(F.col("form").isin(schemas.ANNUAL_FORMS) & F.col("accession").rlike(r"^\d{10}-\d{2}-\d{6}$") & F.col("document").rlike(r"^[A-Za-z0-9._\-]+$")).withColumn("filing_date", F.to_date("filing_date"))


def latest_filing(recent: DataFrame, older: DataFrame, key: list[str]) -> DataFrame:
    """The latest filing of each key; older segments only where the recent one has none."""
    both = recent.withColumn("_p", F.lit(1)).unionByName(older.withColumn("_p", F.lit(0)))
    kept = [c for c in recent.columns if c not in key]
    return both.groupBy(*key).agg(F.max_by(F.struct(*kept), F.struct("_p", "filing_date", "accession")).alias("f")).select(*key, "f.*")


def read_articles(texts: DataFrame, since: Column, until: Column) -> DataFrame:
    """Articles with a title, a canonical URL and a time in [since, until]."""
    rows = texts.select(F.explode(F.from_json("value", schemas.ARTICLES)["articles"]).alias("a")).select("a.*")
    rows = rows.select(F.trim("title").alias("title"), canonical_url(F.col("url")).alias("url"), F.try_to_timestamp(F.col("seendate"), F.lit("yyyyMMdd'T'HHmmss'Z'")).alias("seen_at"))
    return rows.where((F.col("title") != "") & F.col("url").isNotNull() & F.col("seen_at").between(since, until))


def read_catalog(spark: SparkSession, path: str, columns: dict[str, list[str]] | None = None) -> dict[str, DataFrame]:
    """The arrays of a curated catalog file, a table each; refused where an expected table or column (table: columns) is missing."""
    whole = spark.read.json(path, multiLine=True)
    arrays = [f.name for f in whole.schema if f.dataType.typeName() == "array"]
    tables = {name: whole.select(F.inline(name)) for name in arrays}
    for name, wanted in (columns or {}).items():
        if name not in tables or not set(wanted) <= set(tables[name].columns):
            raise ValueError(f"the catalog's {name} lacks columns")
    return tables


def read_outcome_labels(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines to labels, each label as its JSON text where it is a number (so that 0.0 is no 0), else null. `features.checked_labels` holds them to the rules."""
    fields = ", ".join(f"{f.name} {'variant' if f.name == 'label' else f.dataType.simpleString()}" for f in schemas.LABELS)
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", fields).alias("r"), F.try_parse_json("value").alias("v"))
    kind = F.schema_of_variant(F.try_variant_get("v", "$.label", "variant"))
    text = F.regexp_extract(F.col("r.label").cast("string"), "^(.*)$", 1)
    exact = F.when(kind == "BIGINT", text).when(kind.startswith("DECIMAL") | (kind == "DOUBLE"), F.concat(text, F.lit(".")))
    return rows.select(*[exact.alias("label") if f.name == "label" else F.col(f"r.{f.name}") for f in schemas.LABELS])


def read_pixels(spark: SparkSession, path: str, scene: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("scene_id") == scene)


def read_universe(directory: DataFrame, preferred: list[str], limit: int, offset: int = 0) -> DataFrame:
    """Preferred tickers first in their order, then the rest by ticker; a slice."""
    order = F.array_position(F.array(*map(F.lit, preferred)) if preferred else F.array().cast("array<string>"), F.col("ticker"))
    return directory.orderBy(F.when(order > 0, order).otherwise(len(preferred) + 1), "ticker").offset(offset).limit(limit)


def directory_fallback(directory: DataFrame, known: DataFrame) -> DataFrame:
    """The directory, or the known companies with a CIK where it is empty."""
    return directory if directory.limit(1).count() else known.where(F.col("cik").isNotNull()).select(*directory.columns)
