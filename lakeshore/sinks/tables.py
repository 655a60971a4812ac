"""Sinks: Parquet files, catalog tables, evolution, partitions, quarantine.

Tables are Parquet (Snappy) with string partition columns.  Ingest loads go to a
partition of their own batch and become visible, file by file, through the
ledger (``sinks.ledger``); rejects are replaced per file with dynamic partition overwrite.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from lakeshore.operators.typecast import added_columns, conform_to_schema


def _q(name: str) -> str:
    return ".".join(f"`{p}`" for p in name.split("."))


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """K1: Snappy Parquet; with ``partition_by`` an overwrite replaces only the touched partitions."""
    writer = df.write.mode(mode).option("compression", "snappy")
    if partition_by:
        writer = writer.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def string_partitions(df: DataFrame, partition_by: Sequence[str]) -> DataFrame:
    """K4: partition columns are always text."""
    return df.select(*[F.col(f"`{c}`").cast("string").alias(c) if c in partition_by else F.col(f"`{c}`")
                       for c in df.columns])


def create_table_with_properties(spark: SparkSession, name: str, schema: StructType,
                                 partition_by: Sequence[str] = (), properties: Mapping[str, str] | None = None,
                                 location: str | None = None) -> None:
    """K4: ``CREATE TABLE ... USING parquet PARTITIONED BY ... TBLPROPERTIES`` (no-op when it exists)."""
    cols = []
    for f in schema.fields:
        t = "string" if f.name in partition_by else f.dataType.simpleString()
        cols.append(f"`{f.name}` {t}")
    ddl = f"CREATE TABLE IF NOT EXISTS {_q(name)} ({', '.join(cols)}) USING parquet"
    if partition_by:
        ddl += " PARTITIONED BY (" + ", ".join(f"`{c}`" for c in partition_by) + ")"
    if location:
        ddl += f" LOCATION '{location}'"
    props = dict(properties or {})
    props.setdefault("parquet.compression", "SNAPPY")
    ddl += " TBLPROPERTIES (" + ", ".join(f"'{k}' = '{v}'" for k, v in props.items()) + ")"
    spark.sql(ddl)


def evolve_table(spark: SparkSession, name: str, df_schema: StructType) -> list[str]:
    """Add the batch's new columns to the table (add-only); returns the added names."""
    table_schema = spark.table(name).schema
    new = added_columns(df_schema, table_schema)
    if new:
        cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new)
        spark.sql(f"ALTER TABLE {_q(name)} ADD COLUMNS ({cols})")
    return [f.name for f in new]


def create_or_update_table(spark: SparkSession, df: DataFrame, name: str, partition_by: Sequence[str] = (),
                           properties: Mapping[str, str] | None = None, overwrite_partitions: bool = False,
                           location: str | None = None) -> None:
    """K2: append to a catalog table, creating it or evolving its columns first.

    Columns are matched by name; columns the table has but the batch lacks are
    written as NULL.  ``overwrite_partitions`` replaces only the partitions
    present in the batch (idempotent re-runs).
    """
    df = string_partitions(df, partition_by)
    if not spark.catalog.tableExists(name):
        data_cols = [f for f in df.schema.fields if f.name not in partition_by]
        part_cols = [StructType().add(c, StringType()).fields[0] for c in partition_by]
        create_table_with_properties(spark, name, StructType(data_cols + part_cols), partition_by, properties,
                                     location)
    else:
        evolve_table(spark, name, df.schema)
    target = spark.table(name).schema
    if any(f.name in df.columns and df.schema[f.name].dataType != f.dataType for f in target.fields):
        # a value that the table's type cannot hold fails the write; nothing is cut to fit
        df = conform_to_schema(df, target, strict=True).where(F.size("_bad_columns") == 0).drop("_bad_columns")
    have = set(df.columns)
    aligned = df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) if f.name in have
                          else F.lit(None).cast(f.dataType).alias(f.name) for f in target.fields])
    if not overwrite_partitions:
        aligned.write.insertInto(name)
        return
    with partition_overwrite(spark):
        aligned.write.insertInto(name, overwrite=True)


@contextmanager
def partition_overwrite(spark: SparkSession):
    """Inside, overwriting replaces only the batch's partitions, whatever the session's own mode is.

    Entered once around writes from several threads; inside it the setting is left alone.
    """
    key = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(key, None)
    if (before or "").lower() == "dynamic":
        yield
        return
    spark.conf.set(key, "dynamic")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


REJECT_SCHEMA = "record string, reason string, load_batch string, source_file string"


def write_rejects(df: DataFrame, path: str) -> None:
    """K6: rejected rows (source_file, record as JSON text, reason, load_batch if any), replacing those of the same files.

    One text column whatever the batch's types, so that all generations read as one table.
    """
    batch = F.col("load_batch") if "load_batch" in df.columns else F.lit(None)
    with partition_overwrite(df.sparkSession):
        (df.select(F.col("record").cast("string"), F.col("reason").cast("string"), batch.cast("string").alias("load_batch"),
                   F.col("source_file").cast("string"))
         .write.mode("overwrite").partitionBy("source_file").parquet(path))


def overwrite_table(spark: SparkSession, df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> None:
    """K3: replace the table (definition and data)."""
    writer = df.write.mode("overwrite").format("parquet").option("compression", "snappy")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.saveAsTable(name)


def add_partitions(spark: SparkSession, name: str, specs: Sequence[Mapping[str, str]]) -> None:
    """K5: register partitions (an empty value is the null partition); existing ones are ignored."""
    parts = ["PARTITION (" + ", ".join(f"`{k}` = " + (f"'{v}'" if v else "NULL") for k, v in spec.items()) + ")" for spec in specs]
    if parts:
        spark.sql(f"ALTER TABLE {_q(name)} ADD IF NOT EXISTS {' '.join(parts)}")


def recover_partitions(spark: SparkSession, name: str) -> None:
    """K5 for a whole location: discover every ``k=v`` folder."""
    spark.sql(f"ALTER TABLE {_q(name)} RECOVER PARTITIONS")


def with_sort_keys(df: DataFrame, keys: Mapping[str, Sequence[str]]) -> DataFrame:
    """K7: composite sort columns such as ``date#reason`` or ``pipeline#type``."""
    out = df
    for name, parts in keys.items():
        out = out.withColumn(name, F.concat_ws("#", *[F.col(p).cast("string") for p in parts]))
    return out


def append_rows(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """K7: append event / artifact rows."""
    writer = df.write.mode("append").option("compression", "snappy")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
