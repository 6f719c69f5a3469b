"""A session with the settings every job expects."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


#: Bytes of input files for each partition that `parts` counts.
SHARE = 4 << 20


def parts(*frames: DataFrame, least: int | None = None) -> int:
    """Partitions for a shuffle of frames: those of the session (or `least`), more where the share of their input files would pass SHARE.

    `repartition` by this number is kept as it is. Partitions that a join or a grouping makes by itself are merged by
    adaptive execution up to 64 MB of compressed rows, which may be a gigabyte of one task's memory.
    """
    spark = frames[0].sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)) for f in sorted({f for df in frames for f in df.inputFiles()})]
    size = sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in paths)
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")) if least is None else least, -(-size // SHARE))


def shared_folder(spark: SparkSession, name: str = "") -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share, or a new one of this name in it.

    A local master may do without the setting and gets a temporary folder; a cluster may not.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            base = known.get()
        elif spark.sparkContext.master.startswith("local"):
            base = tempfile.mkdtemp(prefix="spark-")
            spark.sparkContext.setCheckpointDir(base)
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    base = base.rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex}" if name else base
