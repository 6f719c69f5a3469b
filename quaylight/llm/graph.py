"""Connected components of an edge table, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, store


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, label) for every end of an edge; label is the least id that can be reached.

    Every round each node takes the least label among its neighbours and then the label of its
    label, so labels travel in doubling steps; it stops when a round changes nothing. Rounds are
    written to the shared folder, which cuts lineage; a round removes the one before. Joins are sort-merge joins on node ids, whose
    hot keys adaptive execution splits; the minimum is combined before it is shuffled. Nothing
    reaches the driver but the count of changes.
    """
    both = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    both = store(both.union(both.select("b", "a")).distinct(), "links")
    labels = store(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "label").hint("merge"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        met = labels.join(near.hint("merge"), "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("id").alias("label"), F.col("label").alias("up"))
        met = met.join(up.hint("merge"), "label", "left").select("id", "old", F.least("label", "up").alias("label"))
        nxt = store(met, "labels")
        changed = nxt.where("old <> label").limit(1).count()
        dropped(edges.sparkSession, labels)
        labels = nxt.select("id", "label")
        if not changed:
            dropped(edges.sparkSession, both)
            return labels
