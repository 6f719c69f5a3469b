"""Writers of snapshots, scores and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_folder


def without(value: Column, kind: T.DataType, drop: tuple[str, ...]) -> Column:
    """value with the fields of structs in name order and without those named in `drop`, at any depth."""
    if isinstance(kind, T.StructType):
        fields = sorted((f for f in kind if f.name not in drop), key=lambda f: f.name)
        return F.when(value.isNotNull(), F.struct(*[without(value[f.name], f.dataType, drop).alias(f.name) for f in fields]))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType | T.ArrayType):
        return F.transform(value, lambda x: without(x, kind.elementType, drop))
    return value


def canonical_json(df: DataFrame, drop: tuple[str, ...] = ()) -> Column:
    """JSON of a row with its fields in name order; `drop` leaves out, at any depth, what does not identify it."""
    kept = sorted((f for f in df.schema if f.name not in drop), key=lambda f: f.name)
    return F.to_json(F.struct(*[without(F.col(f.name), f.dataType, drop).alias(f.name) for f in kept]), {"ignoreNullFields": "false"})


def fingerprint(row_hash: Column) -> Column:
    """An aggregate: SHA-256 over a multiset of SHA-256 texts. Their four 60-bit pieces are summed, which combines in any order before the shuffle, so no task gathers the rows."""
    piece = lambda i: F.sum(F.conv(row_hash.substr(1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")).cast("string")
    return F.sha2(F.concat_ws("|", F.count("*").cast("string"), *[piece(i) for i in range(4)]), 256)


def content_id(df: DataFrame, key: str) -> DataFrame:
    """One SHA-256 for each key, over its rows in whatever order they come."""
    rows = df.withColumn("_j", F.sha2(canonical_json(df), 256))
    return rows.groupBy(key).agg(fingerprint(F.col("_j")).alias("snapshot_id"))


def write_snapshot(features: DataFrame, path: str, schema: str) -> DataFrame:
    """Append features (with as_of) under their content id; a snapshot that is there already is not written again.

    Features are worked out once, into the shared folder. Each snapshot is a folder of the table, so
    that whether it is there is a look at names: no earlier snapshot is read.
    """
    spark, draft = features.sparkSession, shared_folder(features.sparkSession, "snapshot")
    features.write.parquet(draft)
    rows = spark.read.schema(features.schema).parquet(draft)
    ids = content_id(rows, "as_of").withColumn("as_of_date", F.to_date("as_of"))
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def there(r) -> bool:
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/as_of_date={r['as_of_date']}/snapshot_id={r['snapshot_id']}")
        return folder.getFileSystem(conf).exists(folder)

    new = [r["snapshot_id"] for r in ids.collect() if not there(r)]  # one row for each as_of
    named = rows.join(F.broadcast(ids.where(F.col("snapshot_id").isin(new))), "as_of").withColumn("feature_schema", F.lit(schema))  # as many rows
    if new:
        named.write.mode("append").partitionBy("as_of_date", "snapshot_id").parquet(path)
    return spark.read.schema(named.schema).parquet(path)


def append_scores(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def write_report(runs: DataFrame, summary: DataFrame, path: str) -> None:
    runs.write.mode("overwrite").json(f"{path}/runs")
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")
