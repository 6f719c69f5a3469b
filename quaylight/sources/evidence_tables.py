"""The evidence store kept as tables of hash buckets: each write reads and changes only the buckets of its rows.

The rules are those of `operators.evidence`; here they run against tables in place. Every write may be
run again after a crash: ids are derived from what is written, inserts leave what is there, and an
upsert of equal rows writes nothing. Rows with a null key are not written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import uuid5
from ..functions.values import sic_to_industry
from ..operators.evidence import derived_relationships, relationship_id
from ..operators.relational import newest, oldest
from ..schemas import schema
from .buckets import BucketTable

#: How a catalog's tables are merged; others are only inserted.
REPLACED = {"locations", "cases"}


def once(rows: DataFrame, key: str) -> DataFrame:
    """A row of each key: the earliest ingested, or the least where there is no such column or a tie."""
    order = (["ingested_at"] if "ingested_at" in rows.columns else []) + [F.to_json(F.struct(*rows.columns))]
    return oldest(rows, [key], order)


class EvidenceTables:
    """Tables by name, under one folder. Companies are found by CIK through a table of their own."""

    def __init__(self, spark: SparkSession, path: str, schemas: dict[str, T.StructType], buckets: int = 64):
        self.tables = {name: BucketTable(spark, f"{path}/{name}", s, "id", buckets) for name, s in schemas.items()}
        self.by_cik = BucketTable(spark, f"{path}/_company_by_cik", schema(cik=T.StringType(), id=T.StringType()), "cik", buckets)

    def read(self, name: str) -> DataFrame:
        return self.tables[name].read()

    def _index(self, companies: DataFrame) -> None:
        known = companies.where(F.col("cik").isNotNull()).groupBy("cik").agg(F.min(F.col("id").cast("string")).alias("id"))
        self.by_cik.insert(known)

    def install(self, catalog: dict[str, DataFrame]) -> dict[str, int]:
        """Companies and evidence are inserted, locations and cases replaced; the buckets written of each table."""
        written = {}
        for name, rows in catalog.items():
            table = self.tables[name]
            rows = once(rows.select(*table.schema.names), "id")
            written[name] = table.upsert(rows) if name in REPLACED else table.insert(rows)
            if name == "companies" and "cik" in table.schema.names:
                self._index(table.meeting(rows))  # those there, which may not be those of the catalog
        return written

    def upsert_companies(self, profiles: DataFrame) -> int:
        """profiles (cik, name, sic) by CIK: ids stay, name and industry are replaced, the country becomes unknown; new CIKs get derived ids.

        The table has the columns id (text), name, cik, industry and country. Of several profiles of a CIK the
        greatest name counts; profiles without CIK or name are left out. Companies are written before the
        table of CIKs: after a crash in between, a new CIK gets the same id again.
        """
        new = profiles.where(F.col("cik").isNotNull() & F.col("name").isNotNull()).groupBy("cik").agg(F.max(F.struct("name", "sic")).alias("p"))
        known = self.by_cik.meeting(new).withColumnRenamed("id", "_id")
        rows = new.join(known.hint("merge"), "cik", "left").select(
            F.coalesce("_id", uuid5(F.concat(F.lit("company:"), "cik"))).alias("id"), F.col("p.name").alias("name"), "cik", sic_to_industry(F.col("p.sic")).alias("industry"), F.lit(None).cast("string").alias("country")
        )
        written = self.tables["companies"].upsert(rows)
        self._index(rows)
        return written

    def save_relationships(self, found: DataFrame) -> int:
        """Derived id, pending, insert-only: what was reviewed stays reviewed."""
        table = self.tables["relationships"]
        # The id is made where the rows are dealt to, so that only the columns of found are shuffled.
        return table.insert(found, relationship_id(), lambda dealt: once(derived_relationships(dealt, table.schema), "id"))

    def review(self, decisions: DataFrame) -> int:
        """The last decision of each relationship takes effect; decisions on what is not there have none."""
        valid = decisions.where(F.col("status").isin("approved", "rejected")).select("id", "status", "decided_at")
        last = lambda dealt: newest(dealt, ["id"], ["decided_at", "status"]).withColumnRenamed("decided_at", "reviewed_at")
        return self.tables["relationships"].update(valid, last)
