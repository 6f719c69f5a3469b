"""A prefix trie of conversations, its subtree totals rolled up by bands of depth.

Every conversation is first rebuilt (`rebuilt`): it takes its first turns from the conversation that
heads its hundred, then goes on with its own. A node of the trie is a distinct sequence of first
turns; it is named by its depth and two 64-bit values, the exclusive ors of hashes of each turn
with its place, so a prefix's name follows from its parent's and no sequence is ever built.

Subtree totals (`rollup`) go by bands of HEIGHT depths. A node adds its value to its ancestors within
its own band alone, at most HEIGHT rows. The tops of the bands then form a trie of their own, HEIGHT
times as flat, which is summed in the same way, and so on until one band holds all; finished totals
of band tops go back down, each to the HEIGHT nodes of the band above it. So a trie of depth D needs
2 * log(D) / log(HEIGHT) rounds, and no node makes more than 2 * HEIGHT rows in a round.

Hot keys: a conversation with a large share of all turns is cut by range partitions, whose counts
and hashes are prefix sums of two levels; its bands are separate keys. A first turn that many share
is a key of aggregates that combine before the shuffle, and of sort-merge joins that adaptive
execution splits. The list of members that end at a node is hashed as a stream: members are sorted
over all tasks and joined there to strings of at most CHUNK ids; a node's strings pass one task
after another, never all in memory (SHA-256 has no parallel form).

Defined results: rows without conv_id are no conversation and go; a null role or text is empty; null
turns come first, and equal turns of a conversation are in the order of a hash of role and text;
repeated rows are turns of their own; an empty table gives an empty result, without a root. Extra
columns are not read. `%` keeps the sign of the id, as in SQL.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, partitions_for, store, table

HEIGHT = 16
CHUNK = 4096
NODE = ["depth", "a", "b"]


def placed(conversations: DataFrame) -> DataFrame:
    """(conv_id, block, start, local, n, x, y, chars): each turn as two hashes, its number in its block and the turns before the block; n is the conversation's count."""
    spark = conversations.sparkSession
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turns = conversations.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", F.xxhash64(role, text).alias("x"), F.xxhash64(F.lit(7), text, role).alias("y"), F.length(text).cast("long").alias("chars"))
    turns = store(turns.repartitionByRange(partitions_for(spark), "conv_id", "turn", "x", "y").withColumn("block", F.spark_partition_id()), "turns")
    before = Window.partitionBy("conv_id").orderBy("block")
    blocks = (
        turns.groupBy("conv_id", "block")
        .agg(F.count("*").alias("_n"))
        .select("conv_id", "block", F.coalesce(F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"), F.sum("_n").over(Window.partitionBy("conv_id")).alias("n"))
    )
    local = F.row_number().over(Window.partitionBy("conv_id", "block").orderBy("turn", "x", "y"))
    return turns.withColumn("local", local).join(blocks.hint("merge"), ["conv_id", "block"])


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, total) for each conversation, and its rebuilt turns (conv_id, depth, a, b, pa, pb, chars, last).

    The first h turns are those of conversation c - c % 100 (all if it has fewer), h = crc32(c) % 6;
    c's own after its first h follow. a, b name the prefix of this depth, pa, pb the one before.
    """
    turns = store(placed(conversations).withColumn("pos", F.col("start") + F.col("local")).drop("start", "local"), "placed")
    head = turns.where("pos <= 5 and conv_id % 100 = 0").select(F.col("conv_id").alias("base"), "pos", "x", "y", "chars")
    convs = turns.groupBy("conv_id").agg(F.max("n").alias("n")).withColumn("h", F.crc32(F.col("conv_id").cast("string")) % 6).withColumn("base", F.col("conv_id") - F.col("conv_id") % 100)
    bases = convs.where("conv_id = base").select("base", F.col("n").alias("_of"))
    convs = convs.join(bases.hint("merge"), "base", "left").withColumn("taken", F.least("h", F.coalesce("_of", F.lit(0))))
    convs = store(convs.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total")), "convs")

    from_base = convs.where("h > 0").join(head.hint("merge"), "base").where("pos <= h").select("conv_id", F.lit(-1).alias("block"), F.col("pos").alias("depth"), "x", "y", "chars", "total")
    spans = turns.select("conv_id", "block").distinct().join(convs.hint("merge"), "conv_id").drop("base")
    own = turns.join(spans.hint("merge"), ["conv_id", "block"]).where("pos > h").select("conv_id", "block", (F.col("pos") - F.col("h") + F.col("taken")).alias("depth"), "x", "y", "chars", "total")
    rows = from_base.unionByName(own).select("conv_id", "block", "depth", "chars", (F.col("depth") == F.col("total")).alias("last"), F.xxhash64("depth", "x", "y").alias("ga"), F.xxhash64("y", "depth", "x").alias("gb"))
    rows = store(rows, "rebuilt")
    so_far = Window.partitionBy("conv_id", "block").orderBy("depth")
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("conv_id", "block").agg(F.bit_xor("ga").alias("_a"), F.bit_xor("gb").alias("_b"))
    blocks = blocks.select("conv_id", "block", *[F.coalesce(F.bit_xor(c).over(before), F.lit(0)).alias(c) for c in ("_a", "_b")])
    paths = rows.withColumns({"la": F.bit_xor("ga").over(so_far), "lb": F.bit_xor("gb").over(so_far)}).join(blocks.hint("merge"), ["conv_id", "block"])
    paths = paths.withColumns({"a": F.col("_a").bitwiseXOR(F.col("la")), "b": F.col("_b").bitwiseXOR(F.col("lb"))})
    paths = paths.select("conv_id", "depth", "a", "b", F.col("a").bitwiseXOR(F.col("ga")).alias("pa"), F.col("b").bitwiseXOR(F.col("gb")).alias("pb"), "chars", "last")
    return convs.select("conv_id", "total"), store(paths, "paths")


def nodes_of(convs: DataFrame, paths: DataFrame) -> DataFrame:
    """A row for each node: NODE, pa, pb, its least member conv_id, n_convs, n_children, leaf, saved."""
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(*[zero.alias(c) for c in NODE], zero.alias("pa"), zero.alias("pb"), "conv_id", "n_convs", zero.alias("chars"))
    under = paths.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *[F.first(c).alias(c) for c in ("pa", "pb", "chars")])
    nodes = store(root.unionByName(under), "nodes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n_children"))
    counted = nodes.join(children.hint("merge"), NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    return store(counted.withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("chars")}), "nodes")


def rollup(nodes: DataFrame, paths: DataFrame, values: list[str], height: int = HEIGHT) -> DataFrame:
    """NODE and the sums of values over each node's subtree, itself included."""
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    key, levels, step = nodes.select(*NODE, "conv_id"), [], 1
    one = F.struct(F.col("depth"), F.col("a"), F.col("b"))
    top = F.array(F.struct(*[F.lit(0).cast("long").alias(c) for c in NODE]))
    current = nodes.select(*NODE, "conv_id", *values)
    while True:
        # The nodes of a band on each conversation's path; at most height of them.
        band = (F.floor(F.col("depth") / (step * height))).cast("long")
        on_path = paths.where(F.col("depth") % step == 0).groupBy("conv_id", band.alias("band")).agg(F.collect_list(one).alias("in_band"))
        on_path = on_path.withColumn("in_band", F.when(F.col("band") == 0, F.concat(top, "in_band")).otherwise(F.col("in_band")))
        met = current.withColumn("band", band).join(on_path.hint("merge"), ["conv_id", "band"], "left")
        up = F.coalesce(F.filter("in_band", lambda x: x["depth"] <= F.col("depth")), top)  # a root without turns has no path
        sums = met.select(F.explode(up).alias("_to"), *values).groupBy(*[F.col(f"_to.{c}").alias(c) for c in NODE]).agg(*[F.sum(v).alias(v) for v in values])
        sums = store(sums.join(key.hint("merge"), NODE), "sums")
        levels.append((step, sums, on_path))
        if step * height > deepest:
            break
        step *= height
        current = sums.where(F.col("depth") % step == 0)
    whole = levels.pop()[1]
    for step, sums, on_path in reversed(levels):
        # Totals of band tops are whole: each goes to all nodes of the band above it.
        above = (F.floor(F.col("depth") / (step * height)) - 1).cast("long")
        tops = whole.where("depth > 0").select("conv_id", above.alias("band"), *values).join(on_path.hint("merge"), ["conv_id", "band"])
        more = tops.select(F.explode("in_band").alias("_to"), *values).groupBy(*[F.col(f"_to.{c}").alias(c) for c in NODE]).agg(*[F.sum(v).alias(f"_{v}") for v in values])
        both = sums.join(more.hint("merge"), NODE, "left")
        whole = store(both.select(*NODE, "conv_id", *[(F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values]), "totals")
        dropped(nodes.sparkSession, sums)
    return whole.select(*NODE, *values)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of a node's members, in order, as strings of at most CHUNK ids."""
    out: list[tuple] = []
    now, ids = None, []

    def flush() -> Iterator[pa.RecordBatch]:
        if out:
            cols = list(zip(*out, strict=True))
            out.clear()
            yield pa.record_batch([pa.array(c, pa.int64()) for c in cols[:4]] + [pa.array(cols[4], pa.string())], names=[*NODE, "least", "ids"])

    for batch in batches:
        for *node, conv in zip(*[batch.column(c).to_pylist() for c in [*NODE, "conv_id"]], strict=True):
            if node != now or len(ids) == CHUNK:
                if ids:
                    out.append((*now, ids[0], ",".join(map(str, ids))))
                now, ids = node, []
            ids.append(conv)
            if len(out) >= 1000:
                yield from flush()
    if ids:
        out.append((*now, ids[0], ",".join(map(str, ids))))
    yield from flush()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest a node of its strings in order; a node's strings may come in several batches."""
    now, digest = None, None

    def made(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [()] * 4
        return pa.record_batch([pa.array(c, pa.int64()) for c in cols[:3]] + [pa.array(cols[3], pa.string())], names=[*NODE, "ends_sha256"])

    for batch in batches:
        rows = []
        for *node, ids in zip(*[batch.column(c).to_pylist() for c in [*NODE, "ids"]], strict=True):
            if node != now:
                if now:
                    rows.append((*now, digest.hexdigest()))
                now, digest = node, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        yield made(rows)
    if now:
        yield made([(*now, digest.hexdigest())])


def ends(convs: DataFrame, paths: DataFrame) -> DataFrame:
    """NODE and the SHA-256 of the ids, ascending and joined by commas, of the conversations that end there."""
    n = partitions_for(convs.sparkSession)
    zero = F.lit(0).cast("long")
    last = paths.where("last").select(*NODE, "conv_id").unionByName(convs.where("total = 0").select(*[zero.alias(c) for c in NODE], "conv_id"))
    runs = last.repartitionByRange(n, *NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id").mapInArrow(_joined, "depth long, a long, b long, least long, ids string")
    return runs.repartition(n, *NODE).sortWithinPartitions(*NODE, "least").mapInArrow(_hashed, "depth long, a long, b long, ends_sha256 string")


def trie(conversations: DataFrame, height: int = HEIGHT) -> DataFrame:
    """A row for each node of the trie of rebuilt conversations; see op11_prefix_trie for the columns."""
    convs, paths = rebuilt(conversations)
    nodes = nodes_of(convs, paths)
    totals = rollup(nodes, paths, ["leaf", "saved"], height)
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    held = nodes.select(*NODE, "pa", "pb", "conv_id", "n_convs", "n_children").join(parents.hint("merge"), ["depth", "pa", "pb"], "left")
    empty = hashlib.sha256(b"").hexdigest()
    return (
        held.join(totals.hint("merge"), NODE)
        .join(store(ends(convs, paths), "ends").hint("merge"), NODE, "left")
        .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaf").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 for each node."""
    return trie(table(spark, sf_dir, "conversations"))


#: The remainder of crc32 (polynomial 0xEDB88320) of the id as text, by a fold over its characters' eight bits.
CRC = "xor(list_reduce([4294967295::bigint] || list_transform(string_split(c::varchar, ''), lambda s: ascii(s)::bigint), lambda r, s: list_reduce([xor(r, s)] || range(8), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295)"
OP11_SQL = f"""
with t as (select conv_id as c, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as p, coalesce(role, '') as r, coalesce(text, '') as x from conversations where conv_id is not null),
n as (select c, count(*) as n, c - c % 100 as b from t group by c),
g as (select *, {CRC} % 6 as h from n),
i as (select g.*, least(g.h, coalesce(m.n, 0)) as nb from g left join n m on m.c = g.b),
w as (
  select i.c, t.p as d, t.r, t.x from i join t on t.c = i.b and t.p <= i.h
  union all select i.c, t.p - i.h + i.nb, t.r, t.x from i join t on t.c = i.c and t.p > i.h
),
q as (select c, d, x, sha256(string_agg(sha256(r) || sha256(x), '') over (partition by c order by d)) as k from w),
s as (select c, d, x, k, lag(k, 1, '') over (partition by c order by d) as pk from q union all select c, 0, '', '', '' from i),
o as (select d, k, min(pk) as pk, min(c) as c, count(*) as n, min(length(x)) as len from s group by d, k),
kids as (select d - 1 as d, pk as k, count(*) as m from o where d > 0 group by all),
v as (select o.*, coalesce(m, 0) as m from o left join kids using (d, k)),
sub as (select s.d, s.k, sum((m = 0)::int) as leaves, sum((v.n - 1) * v.len) as saved from v join s on s.c = v.c and s.d <= v.d group by s.d, s.k),
z as (select c, max(d) as d from s group by c),
e as (select s.d, s.k, sha256(string_agg(s.c::varchar, ',' order by s.c)) as ends from s join z using (c, d) group by s.d, s.k)
select v.c as conv_id, v.d::bigint as depth, p.c as parent_conv_id, v.n::bigint as n_convs, v.m::bigint as n_children, sub.leaves::bigint as n_leaves, sub.saved::bigint as saved_tokens, coalesce(e.ends, sha256('')) as ends_sha256
from v join sub using (d, k) left join e using (d, k) left join o p on p.d = v.d - 1 and p.k = v.pk
"""
