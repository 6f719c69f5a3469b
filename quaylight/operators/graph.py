"""Graph operators on edges (src, dst, ...) and nodes (id, ...).

Loops run on the driver but only hold plans: each round is written to the checkpoint folder, so
lineage stays short and nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_folder


def cut(df: DataFrame) -> DataFrame:
    """df after a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def k_hop(edges: DataFrame, centre, depth: int, direction: str = "both", nodes: DataFrame | None = None) -> DataFrame:
    """(id, hops) within depth 1..5 of the centre. `upstream` follows edges backwards. With nodes, only those are entered or crossed."""
    if not 1 <= depth <= 5:
        raise ValueError("depth is 1 to 5")
    if nodes is not None:
        for end in ("src", "dst"):
            edges = edges.join(nodes.select(F.col("id").alias(end)), end, "left_semi")
    down, up = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")), edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))
    steps = {"downstream": down, "upstream": up, "both": down.union(up)}[direction].distinct()
    seen = edges.sparkSession.range(1).select(F.lit(centre).alias("id"), F.lit(0).alias("hops"))
    front = seen
    for hop in range(1, depth + 1):
        nxt = steps.join(front.select(F.col("id").alias("a")), "a").select(F.col("b").alias("id")).distinct()
        front = cut(nxt.join(seen, "id", "left_anti").withColumn("hops", F.lit(hop)))
        seen = seen.unionByName(front)
    return seen


def weak_components(edges: DataFrame) -> DataFrame:
    """(id, label): label is the least id of the undirected component; labels travel in doubling steps until nothing changes."""
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).where("a <> b")
    both = cut(both.union(both.select("b", "a")).distinct())
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        met = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("id").alias("label"), F.col("label").alias("up"))
        nxt = cut(met.join(up, "label", "left").select("id", "old", F.least("label", "up").alias("label")))
        labels = nxt.select("id", "label")
        if not nxt.where("old <> label").limit(1).count():
            return labels


def observed_components(edges: DataFrame, observed: DataFrame) -> DataFrame:
    """Members of components that hold an observed node (id); observed nodes without edges are their own component."""
    labels = weak_components(edges)
    alone = observed.join(labels, "id", "left_anti").select("id", F.col("id").alias("label"))
    kept = labels.join(labels.join(observed, "id", "left_semi").select("label").distinct(), "label", "left_semi")
    return kept.select("id", "label").unionByName(alone)


def propagate_risk(shocks: DataFrame, edges: DataFrame, rounds: int = 2, damping: float = 0.65) -> DataFrame:
    """(id, risk): 1 - (1 - shock) * product over suppliers of (1 - damping * criticality * risk), for some rounds.

    shocks (id, shock), edges (src supplier, dst customer, criticality). Products are combined before they are shuffled.
    """
    risk = shocks.select("id", F.col("shock").alias("risk"))
    for _ in range(rounds):
        keep = F.product(1 - damping * F.col("criticality") * F.col("risk")).alias("keep")
        reach = edges.join(risk.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(keep)
        risk = cut(shocks.join(reach, "id", "left").select("id", (1 - (1 - F.col("shock")) * F.coalesce("keep", F.lit(1.0))).alias("risk")))
    return risk


def gcn_propagate(nodes: DataFrame, edges: DataFrame, features: list[str]) -> DataFrame:
    """Symmetrically normalised weighted sums over incoming edges and self loops: sum of w / sqrt(d(src) d(dst)) * x(src)."""
    loops = nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("w"))
    all_ = edges.select("src", "dst", "w").unionByName(loops)
    degree = all_.groupBy(F.col("dst").alias("id")).agg(F.sum("w").alias("d"))
    scaled = nodes.join(degree, "id").select(F.col("id").alias("src"), *[(F.col(f) / F.sqrt("d")).alias(f) for f in features])
    sums = all_.join(scaled, "src").groupBy(F.col("dst").alias("id")).agg(*[F.sum(F.col("w") * F.col(f)).alias(f) for f in features])
    return sums.join(degree, "id").select("id", *[(F.col(f) / F.sqrt("d")).alias(f) for f in features])


def mean_neighbours(nodes: DataFrame, edges: DataFrame, features: list[str]) -> DataFrame:
    """Unweighted mean over incoming neighbours; 0 without any."""
    means = edges.join(nodes.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(*[F.avg(f).alias(f"mean_{f}") for f in features])
    return nodes.select("id").join(means, "id", "left").na.fill(0.0)


def edge_softmax(edges: DataFrame, score: Column) -> DataFrame:
    """edges with `weight`, the softmax of score among the edges of the same target."""
    own = Window.partitionBy("dst")
    shifted = edges.withColumn("_s", score).withColumn("_e", F.exp(F.col("_s") - F.max("_s").over(own)))
    return shifted.withColumn("weight", F.col("_e") / F.sum("_e").over(own)).drop("_s", "_e")


def real_subgraph(nodes: DataFrame, links: DataFrame, provenance: list[str]) -> tuple[DataFrame, DataFrame]:
    """Real nodes; links between them with real provenance and evidence."""
    real = nodes.where(~F.col("is_synthetic"))
    kept = links.where(F.col("provenance").isin(provenance) & (F.size("evidence_ids") > 0))
    for end in ("src", "dst"):
        kept = kept.join(real.select(F.col("id").alias(end)), end, "left_semi")
    return real, kept


def same_ids(a: DataFrame, b: DataFrame) -> bool:
    return not a.select("id").exceptAll(b.select("id")).limit(1).count() and not b.select("id").exceptAll(a.select("id")).limit(1).count()
