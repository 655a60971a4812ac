"""Session construction and the few session-level settings the engine relies on.

Everything the engine computes is timezone sensitive (file timestamps, daily
metric periods, date macros), so the session zone is pinned to UTC.  Adaptive
query execution stays on: it coalesces small shuffle partitions, splits skewed
join partitions and turns joins into broadcasts only after it has measured the
actual size of a side at runtime.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # Parquet is the lake format; keep the vectorized reader and codegen paths.
    "spark.sql.parquet.compression.codec": "snappy",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # wide per-column projections (typing checks on every text column) generate methods larger
    # than the JVM compiles (8000 bytes of bytecode); such a stage would run interpreted, so
    # Spark is told to fall back to non-fused operators for it instead (12.1 s -> 8.7 s for
    # typed_roundtrip at sf0.1); stages with small methods keep whole-stage codegen
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # keyed streaming state (latest row per key, windowed sums) lives off-heap in RocksDB,
    # so its size is bounded by disk, not by executor memory
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(
    master: str | None = None,
    app_name: str = "lakeshore",
    shuffle_partitions: int | None = None,
    conf: dict[str, str] | None = None,
) -> SparkSession:
    """Return a session with the engine defaults applied.

    ``master`` is only set when given, so on a cluster the launcher decides.
    ``shuffle_partitions`` should be sized to the data: about one partition per
    128-256 MB of shuffled data on a cluster, the core count locally.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = dict(DEFAULT_CONF)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf or {})
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared folder there; it is used as is, and without one a
    cluster session is refused.  Only a local session (one machine, as in tests)
    may leave it out and gets a fresh scratch folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: executors need a shared folder for scratch tables")
        configured = tempfile.mkdtemp(prefix="lakeshore-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def compiled_stages(spark: SparkSession) -> None:
    """Keep wide typing projections out of methods that the JVM would interpret, in sessions of any origin.

    The limit of ``DEFAULT_CONF`` holds in a session that ``build_session`` did not make, too, unless it has its own.
    """
    key = "spark.sql.codegen.hugeMethodLimit"
    if key not in spark.conf.getAll:
        spark.conf.set(key, DEFAULT_CONF[key])


def materialize(df, name: str = "stage"):
    """Cut lineage with a written table: Parquet in the shared checkpoint folder, read back.

    Used where one expensive prefix (windows, joins, shuffles) feeds several
    outputs, so it is computed once.  Columnar, so later reads prune columns.
    """
    return written_once(df, name)[0]


def written_once(df, name: str):
    """``materialize`` for a table that its caller drops (``drop_path``) after use: its rows and its folder."""
    path = scratch_path(df.sparkSession, "materialized", f"{name}-{uuid.uuid4().hex[:12]}")
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path), path


def hadoop_path(spark: SparkSession, path: str):
    """A Hadoop path and its file system (the default one where the path names none)."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    p, fs = hadoop_path(spark, path)
    return fs.exists(p)


def drop_path(spark: SparkSession, path: str) -> None:
    p, fs = hadoop_path(spark, path)
    fs.delete(p, True)


def qualified(spark: SparkSession, path: str) -> str:
    """The path as listings and file attributes write it, with its file system."""
    p, fs = hadoop_path(spark, path)
    return fs.makeQualified(p).toString()


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """A path under the shared checkpoint folder, for written intermediate tables."""
    base = ensure_checkpoint_dir(spark)
    if base.startswith("file:"):
        base = base[len("file:"):]
    return os.path.join(base, "lakeshore", *parts)
