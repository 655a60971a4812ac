"""Mergeable column profiles (C1, C4): what a file's text says about each column, kept for later.

A profile is a few numbers per (file, column): the classes of its values, the exact range of its whole numbers (to 38
digits, beyond what a DOUBLE holds), the most digits behind a point, the longest text.  Profiles merge by bit_or, min, max
and sum, so the types that fit any set of files come from their profiles, without reading a file again: for new
columns, and for widening a table whose rejects show that its types are too narrow.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeshore.operators import typecast
from lakeshore.sinks.ledger import BATCH, LEDGER, LOADED
from lakeshore.sinks.tables import partition_overwrite

TABLE = "column_profiles"
SCHEMA = ("scope string, source_file string, name string, rows bigint, present bigint, mask int, low decimal(38,0), high decimal(38,0), "
          f"scale int, longest int, {BATCH} string")

_PLAIN = r"^\s*[+-]?\d+(\.\d*)?\s*$"


def _merge(prefix: str = "") -> list[Column]:
    c = lambda n: F.col(prefix + n)
    return [F.sum(c("rows")).alias("rows"), F.sum(c("present")).alias("present"), F.bit_or(c("mask")).alias("mask"), F.min(c("low")).alias("low"),
            F.max(c("high")).alias("high"), F.max(c("scale")).alias("scale"), F.max(c("longest")).alias("longest")]


def column_profiles(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One row per group of ``by`` and text column: ``name`` and the measures.  One aggregate, partial before its shuffle."""
    def measures(name: str) -> Column:
        text = F.col(f"`{name}`")
        # digits before the point, exact to 38 of them
        whole = F.when(text.rlike(_PLAIN), F.regexp_extract(text, r"[+-]?\d+", 0).try_cast("decimal(38,0)"))
        behind = F.when(text.rlike(_PLAIN), F.length(F.regexp_replace(F.regexp_extract(text, r"\.(\d*)", 1), "0+$", "")))
        return F.struct(F.lit(name).alias("name"), F.lit(1).cast("bigint").alias("rows"), text.isNotNull().cast("bigint").alias("present"),
                        typecast.value_class(text).alias("mask"), whole.alias("low"), whole.alias("high"), behind.cast("int").alias("scale"),
                        F.length(text).alias("longest"))
    if not columns:
        raise ValueError("no columns to profile")
    cells = df.select(*by, F.explode(F.array(*[measures(c) for c in columns])).alias("p"))
    return cells.groupBy(*by, F.col("p.name").alias("name")).agg(*_merge("p."))


def merge_profiles(profiles: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Profiles of the groups' parts as one profile per group and column."""
    return profiles.groupBy(*by, "name").agg(*_merge())


def profile_type() -> Column:
    """The type that holds every value of a (merged) profile exactly; text for anything mixed.

    Whole numbers beyond 64 bits are DECIMAL, so are plain fractions of at most 18 digits behind the point that a DOUBLE
    could not hold; a column without values is BIGINT, as in ``plan_types``.
    """
    mask = F.coalesce("mask", F.lit(0))
    has = lambda bit: mask.bitwiseAND(bit) != 0
    number = (mask != 0) & ~has(typecast._TEXT) & ~has(typecast._BOOL)
    bound = F.lit(str(1 << 63)).cast("decimal(38,0)")
    digits = F.greatest(F.length(F.abs("low").cast("string")), F.length(F.abs("high").cast("string")))
    small = (F.col("low") >= -bound) & (F.col("high") < bound)
    fractions = has(typecast._FRACTION)
    scale = F.coalesce("scale", F.lit(0))
    decimal = F.concat(F.lit("decimal(38,"), scale.cast("string"), F.lit(")"))
    return (F.when(mask == 0, "bigint").when(mask == typecast._BOOL, "boolean").when(~number, "string")
            .when((scale == 0) & small, "bigint").when((scale == 0) & (digits <= 38), "decimal(38,0)")
            .when(fractions & (digits + scale > 15) & (scale <= 18) & (digits + scale <= 38), decimal).otherwise("double"))


def create_profile_table(spark: SparkSession, database: str) -> None:
    spark.sql(f"CREATE TABLE IF NOT EXISTS `{database}`.`{TABLE}` ({SCHEMA}) "
              f"USING parquet PARTITIONED BY (scope, {BATCH})")


def store_profiles(spark: SparkSession, df: DataFrame, columns: Sequence[str], database: str, scope: str, batch: str) -> None:
    """Keep the profiles of a load's files (``source_file``) under its batch; they count once the batch is committed."""
    create_profile_table(spark, database)
    found = column_profiles(df, columns, ["source_file"])
    order = spark.table(f"{database}.{TABLE}").columns
    rows = found.withColumn("scope", F.lit(scope)).withColumn(BATCH, F.lit(batch)).withColumn("mask", F.col("mask").cast("int"))
    with partition_overwrite(spark):
        rows.select(*order).write.insertInto(f"{database}.{TABLE}", overwrite=True)


def stored_profiles(spark: SparkSession, database: str, scope: str) -> DataFrame:
    """The merged profile of each column over the newest versions of the scope's files."""
    newest = spark.table(f"{database}.{LEDGER}").where((F.col("scope") == scope) & (F.col("state") == LOADED)).groupBy("source_file").agg(
        F.max_by(BATCH, F.struct("version", BATCH)).alias(BATCH))
    mine = spark.table(f"{database}.{TABLE}").where(F.col("scope") == scope)
    return merge_profiles(mine.join(newest, ["source_file", BATCH], "left_semi"))


def stored_types(spark: SparkSession, database: str, scope: str) -> dict[str, str]:
    """Types that fit all that the scope's files hold now, from their profiles (name overrides, C2, win)."""
    rows = stored_profiles(spark, database, scope).select("name", profile_type().alias("type")).collect()      # one row a column
    return {r.name: typecast.name_override(r.name) or r.type for r in rows}
