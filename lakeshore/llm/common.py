"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeshore.session import ensure_checkpoint_dir

#: words: maximal runs of anything but the six ASCII white-space characters
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path (a URI where the setting is one) in the folder that ``spark.checkpoint.dir`` names."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/lakeshore-llm/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_released(spark: SparkSession):
    """What is run inside gives its shuffle files back when it ends, not when the driver next collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Cut lineage with a Parquet table in the shared folder.

    Unlike a recomputed plan its size is known when the next plan is made, so Spark's own size
    threshold decides about broadcasts, and a lost executor costs only a re-read.  Nothing reads the
    shuffles behind the table again, so their files go.  ``compression`` is the session's if not given.
    """
    path = shared_path(df.sparkSession, name)
    with shuffles_released(df.sparkSession):
        df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once.

    Catalyst merges projections, and a column used inside a lambda would be computed again for each
    element; a lambda's own variable is not.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def word_count(text: Column) -> Column:
    """Number of words as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(*cols: Column | str) -> Column:
    """A number in [0, 1) that depends on the values alone, so that reruns and retried tasks agree."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 53)) / F.lit(float(1 << 53))


def text_batches(spark: SparkSession, rows: int = 512) -> None:
    """Whole texts go to Python in Arrow batches of few rows, so that a batch stays small in memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
