"""Report documents: flatten, split into tables, fixed columns.

A report document is one row holding a specification struct and N arrays of
structs.  Each array becomes its own table ``{table}_{array}`` by ``explode``
+ ``select("c.*")`` (narrow: no shuffle).  All arrays come from one scan; the
caller persists the parsed documents when it materialises several tables.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

# The specification field of document reports.
REPORT_SPECIFICATION = "reportSpecification"


def with_fixed_column(df: DataFrame, name: str, value, cast: str = "timestamp") -> DataFrame:
    """One constant on every row, cast (the ingest timestamp by default)."""
    return df.withColumn(name, F.lit(value).cast(cast))


def drop_columns(df: DataFrame, names: Iterable[str] = (REPORT_SPECIFICATION,)) -> DataFrame:
    """P13."""
    return df.drop(*names)


def flatten_struct(df: DataFrame, col: str) -> DataFrame:
    """A struct column becomes its fields."""
    return df.select(f"`{col}`.*")


def keep_scalar_fields(df: DataFrame) -> DataFrame:
    """Drop every struct, array or map valued column."""
    scalar = [f.name for f in df.schema.fields if not isinstance(f.dataType, (StructType, ArrayType, MapType))]
    return df.select(*[F.col(f"`{c}`") for c in scalar])


def report_arrays(df: DataFrame) -> list[str]:
    """Array-of-struct columns of a document frame (plan time, from the schema).

    An array whose element type is not a struct (an empty array infers as
    ``array<string>``) yields no table.
    """
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, ArrayType) and isinstance(f.dataType.elementType, StructType)]


def explode_report(df: DataFrame, array_col: str, keep: Iterable[str] = ()) -> DataFrame:
    """G1 for one array: one row per element, element fields as columns (plus ``keep`` columns)."""
    keep = list(keep)
    return (df.select(*keep, F.explode(F.col(f"`{array_col}`")).alias("_elem"))
            .select(*keep, "_elem.*"))


def split_report(df: DataFrame, table: str, keep: Iterable[str] = ()) -> dict[str, DataFrame]:
    """G1: ``{table}_{array}`` -> exploded frame for every array of the documents."""
    body = drop_columns(df)
    return {f"{table}_{name}": explode_report(body, name, keep) for name in report_arrays(body)}
