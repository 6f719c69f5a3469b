"""Tables that merges change in part: hash buckets of files, and a manifest that names the files that count.

A merge reads and writes only the buckets that its rows fall in, and only where something is new:
an insert adds files to them, an upsert writes them anew. What it wrote counts from the moment that
the next manifest has its name; a job that dies before leaves files that no manifest names, and the
table is what it was. A replay of what the table has adds nothing to it.

Rows are shuffled once, by key: a bucket has as many partitions as the size of the input asks for, so
that rows meet, are grouped and are written in tasks of a bounded share. Files carry Bloom filters of
the key, so that a look-up of few keys skips files as well as buckets. One writer at a time: a
second one that finished first makes the merge fail, and it can be run again.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import parts

#: A bucket of more file folders than this is written as one with the next insert.
FOLDERS = 8


class BucketTable:
    """A table of a schema with a unique, non-null key, in `buckets` parts; opened or begun at path."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str, buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, key, buckets

    # --- manifests: numbered files of {bucket: [folders]} -------------------------------------------

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _names(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def version(self) -> int:
        return max((int(n.removesuffix(".json")) for n in self._names(f"{self.path}/manifests") if n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict[int, list[str]]:
        """The folders of each bucket that has rows; a number for each bucket and folder reaches the driver, never rows."""
        version = self.version() if version is None else version
        if not version:
            return {}
        text = self.spark.read.text(f"{self.path}/manifests/{version}.json", wholetext=True).first()[0]
        found = {int(k): v for k, v in json.loads(text).items()}
        if any("/_part=" not in f for fs in found.values() for f in fs):
            raise RuntimeError(f"{self.path} has buckets of another hash; write its rows into a new table")
        return found

    def _switch(self, version: int, manifest: dict[int, list[str]]) -> None:
        fs, at = self._fs(f"{self.path}/manifests/{version + 1}.json")
        _, draft = self._fs(f"{self.path}/manifests/{uuid4().hex}.draft")
        out = fs.create(draft)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if fs.exists(at) or not fs.rename(draft, at):
            fs.delete(draft, False)
            raise RuntimeError("another merge was faster; run this one again")

    # --- rows ------------------------------------------------------------------------------------------

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.hash(key), F.lit(self.buckets)).cast("int")  # as partitions of a shuffle by key

    def read(self, buckets: list[int] | None = None, version: int | None = None) -> DataFrame:
        """The rows of all or some buckets, now or at an earlier version."""
        manifest = self.manifest(version)
        folders = [f"{self.path}/data/{f}" for b, fs in sorted(manifest.items()) if buckets is None or b in buckets for f in fs]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def look_up(self, keys: list) -> DataFrame:
        """The rows of a few keys: only their buckets are read, and the comparison reaches the files' Bloom filters."""
        rows = self.spark.createDataFrame([(k,) for k in keys], T.StructType([self.schema[self.key]]))
        buckets = [r["b"] for r in rows.select(self.bucket(F.col(self.key)).alias("b")).distinct().collect()]
        return self.read(buckets).where(F.col(self.key).isin(keys))

    def meeting(self, rows: DataFrame) -> DataFrame:
        """The table's rows whose key some of rows have; only their buckets are read."""
        keys = rows.select(self.key).where(F.col(self.key).isNotNull()).distinct()
        buckets = [r["b"] for r in keys.select(self.bucket(F.col(self.key)).alias("b")).distinct().collect()]  # a number a bucket at most
        return self.read(buckets).join(keys.hint("merge"), self.key, "left_semi").select(*self.schema.names)

    def _slots(self, *frames: DataFrame) -> int:
        """A multiple of the buckets: one for each, more where the files of frames are many."""
        return self.buckets * -(-parts(*frames, least=self.buckets) // self.buckets)

    def _dealt(self, rows: DataFrame, n: int, key: Column | None = None) -> DataFrame:
        """rows in n partitions by `key`, which is what their key is or will be. As n is a multiple of the buckets, a partition is part of one bucket."""
        return rows.repartition(n, F.col(self.key) if key is None else key)

    def _folders(self, tag: str) -> dict[int, str]:
        return {int(n.removeprefix("_part=")): f"{tag}/{n}" for n in self._names(f"{self.path}/data/{tag}") if n.startswith("_part=")}

    def _write(self, dealt: DataFrame, tag: str, by: tuple[str, ...] = ("_part",)) -> dict[int, str]:
        """Dealt rows as files, a folder for each bucket that has any; the folders by bucket."""
        out = dealt.withColumn("_part", self.bucket(F.col(self.key))).select(*self.schema.names, *by).sortWithinPartitions(*by, self.key).write.partitionBy(*by)
        # A filter is a megabyte unless it may adapt to its rows.
        out.option(f"parquet.bloom.filter.enabled#{self.key}", "true").option("parquet.bloom.filter.adaptive.enabled", "true").option("compression", "zstd").parquet(f"{self.path}/data/{tag}")
        return self._folders(tag)

    def _drop(self, tag: str) -> None:
        fs, p = self._fs(f"{self.path}/data/{tag}")
        fs.delete(p, True)

    def _touched(self, rows: DataFrame, key: Column | None = None) -> list[int]:
        key = F.col(self.key) if key is None else key
        return [r["b"] for r in rows.where(key.isNotNull()).select(self.bucket(key).alias("b")).distinct().collect()]  # a number a bucket at most

    def insert(self, rows: DataFrame, key: Column | None = None, made: Callable[[DataFrame], DataFrame] | None = None) -> int:
        """Add rows (a key once) whose key the table does not have; the number of buckets that were written.

        With `made`, rows may be anything of which the expression `key` will be the key: they are
        dealt to tasks by it, and made(dealt) gives the rows. Grouped by the key they are not shuffled again.
        """
        version, tag = self.version(), uuid4().hex
        manifest = self.manifest(version)
        old = self.read(self._touched(rows, key), version).select(self.key)
        n = self._slots(rows, old)
        dealt = self._dealt(rows, n, key)
        new = (made(dealt) if made else dealt).where(F.col(self.key).isNotNull())
        written = self._write(new.join(self._dealt(old, n).hint("merge"), self.key, "left_anti"), tag)
        if not written:
            self._drop(tag)
            return 0
        full = [b for b in written if len(manifest.get(b, [])) >= FOLDERS]
        merged = {b: [*manifest.get(b, []), f] for b, f in written.items()}
        if full:  # as one, so that reads do not open ever more files
            whole = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{f}" for b in full for f in merged[b]])
            merged |= {b: [f] for b, f in self._write(self._dealt(whole, self._slots(whole)), f"{tag}-whole").items()}
        self._switch(version, manifest | merged)
        return len(written)

    def upsert(self, rows: DataFrame) -> int:
        """Set the rows of these keys (a key once); buckets in which nothing differs stay as they are. The number of buckets that were written."""
        return self._merge(rows.select(*self.schema.names), None)

    def update(self, changes: DataFrame, made: Callable[[DataFrame], DataFrame]) -> int:
        """Set some columns of the rows that are there; the number of buckets that were written.

        changes has the key and is dealt to tasks by it; made(dealt) gives each key once with the
        columns to set, as in `insert`. A null sets nothing, and keys that are not there are left out.
        """
        return self._merge(changes, made)

    def _merge(self, rows: DataFrame, made: Callable[[DataFrame], DataFrame] | None) -> int:
        """Buckets of rows' keys are written beside the table in one pass; those in which a row differs are moved into it."""
        version, tag = self.version(), uuid4().hex
        manifest = self.manifest(version)
        old = self.read(self._touched(rows), version)
        n = self._slots(rows, old)
        dealt = self._dealt(rows.where(F.col(self.key).isNotNull()), n)
        new = made(dealt) if made else dealt
        rest = [c for c in self.schema.names if c != self.key]
        names = [c for c in rest if c in new.columns]
        packed = lambda df, columns, name: df.select(self.key, F.struct(F.lit(True).alias("_there"), *columns).alias(name))
        met = packed(self._dealt(old, n), rest, "_was").join(packed(new, names, "_is").hint("merge"), self.key, "left" if made else "full")
        value = lambda c: (F.coalesce(F.col(f"_is.{c}"), F.col(f"_was.{c}")) if made else F.when(F.col("_is").isNull(), F.col(f"_was.{c}")).otherwise(F.col(f"_is.{c}"))) if c in names else F.col(f"_was.{c}")
        whole = met.select("_was", *[F.col(c) if c == self.key else value(c).alias(c) for c in self.schema.names])
        differs = ~F.struct(F.lit(True), *rest).eqNullSafe(F.col("_was"))
        self._write(whole.withColumn("_changed", differs.cast("int")), f"{tag}-staged", ("_part", "_changed"))
        fs, _ = self._fs(self.path)
        at = lambda f: self._fs(f"{self.path}/data/{f}")[1]
        changed = {b: f for b, f in self._folders(f"{tag}-staged").items() if "_changed=1" in self._names(f"{self.path}/data/{f}")}
        if not changed:
            self._drop(f"{tag}-staged")
            return 0
        fs.mkdirs(at(tag))
        moved = {b: f"{tag}/_part={b}" for b in changed}
        for b, f in changed.items():
            if not fs.rename(at(f), at(moved[b])):
                raise RuntimeError(f"{f} could not be moved")
        self._switch(version, manifest | {b: [f"{f}/{part}" for part in self._names(f"{self.path}/data/{f}") if part.startswith("_changed=")] for b, f in moved.items()})
        self._drop(f"{tag}-staged")
        return len(changed)

    def clean(self, keep: int = 1) -> list[str]:
        """Remove folders that none of the last `keep` manifests names; their names. Readers of older versions must be gone."""
        last = self.version()
        named = {f.split("/")[0] for v in range(max(1, last - keep + 1), last + 1) for fs in self.manifest(v).values() for f in fs} if last else set()
        gone = [n for n in self._names(f"{self.path}/data") if n not in named]
        for tag in gone:
            self._drop(tag)
        return gone
