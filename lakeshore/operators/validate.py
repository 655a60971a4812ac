"""Schema validation.

Comparing two schemas is plan-time work on metadata: the actual schema comes
from Parquet footers (S8), the expected one from the catalog table (S7).  The
result is returned as rows so it can be stored or joined like any other table.
All files of a prefix are checked by tasks that read their tails (``file_footers``).
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakeshore.sources.files import list_objects


def schema_pairs(schema: StructType, lower_names: bool = False) -> list[tuple[str, str]]:
    """Sorted (name, type) pairs; file schemas have lower-cased names (the catalog's convention)."""
    return sorted(((f.name.lower() if lower_names else f.name), f.dataType.simpleString()) for f in schema.fields)


def validate_schema(spark: SparkSession, expected: StructType, actual: StructType) -> DataFrame:
    """Rows (column, expected_type, actual_type, ok) over the union of column names, plus the verdict."""
    exp = dict(schema_pairs(expected, lower_names=True))
    act = dict(schema_pairs(actual, lower_names=True))
    rows = [(name, exp.get(name), act.get(name), exp.get(name) == act.get(name))
            for name in sorted(set(exp) | set(act))]
    return spark.createDataFrame(rows, "column string, expected_type string, actual_type string, ok boolean")


def schemas_match(expected: StructType, actual: StructType) -> bool:
    return schema_pairs(expected, True) == schema_pairs(actual, True)


FOOTER = "path string, columns array<struct<name: string, type: string>>, rows bigint"


def file_footers(objects: DataFrame) -> DataFrame:
    """S8 for every file of a listing (``path``): its columns with catalog types and its rows.

    Tasks read the tails of their files only; a file that is no Parquet has no columns (null).
    """
    def read(batches):
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import from_arrow_type

        from lakeshore.sources.admission import _store
        for batch in batches:
            out = []
            for path in batch["path"]:
                store, inner = _store(path)
                try:
                    with store.open_input_file(inner) as f:
                        footer = pq.ParquetFile(f)
                        # the old 96-bit time stamps are zoned, and Arrow's type does not tell
                        old = {c.path for c in map(footer.schema.column, range(len(footer.schema))) if c.physical_type == "INT96"}
                        columns = [{"name": c.name, "type": "timestamp" if c.name in old else from_arrow_type(c.type, prefer_timestamp_ntz=True).simpleString()}
                                   for c in footer.schema_arrow]
                        out.append((path, columns, footer.metadata.num_rows))
                except pa.ArrowInvalid:
                    out.append((path, None, None))
            yield pd.DataFrame(out, columns=["path", "columns", "rows"])

    spread = objects.select("path").repartition("path")       # a listing is few partitions
    return spread.mapInPandas(read, FOOTER)


def schema_deviations(footers: DataFrame, expected: StructType) -> DataFrame:
    """C9 for all files: one row per kind of deviation (column, expected_type, actual_type) with the number of
    files and rows that have it and one of their paths.  Aggregated; a prefix that conforms gives no row."""
    want = {f.name.lower(): f.dataType.simpleString() for f in expected.fields}
    known = F.create_map(*[x for k, v in want.items() for x in (F.lit(k), F.lit(v))]) if want else F.create_map().cast("map<string,string>")
    have = F.transform(F.coalesce("columns", F.array().cast("array<struct<name: string, type: string>>")),
                       lambda c: F.struct(F.lower(c["name"]).alias("column"), F.element_at(known, F.lower(c["name"])).alias("expected_type"),
                                          c["type"].alias("actual_type")))
    wanted = F.array(*[F.struct(F.lit(k).alias("column"), F.lit(v).alias("expected_type"), F.lit(None).cast("string").alias("actual_type"))
                       for k, v in want.items()]).cast("array<struct<column: string, expected_type: string, actual_type: string>>")
    missing = F.filter(wanted, lambda m: ~F.exists(have, lambda h: h["column"] == m["column"]))
    broken = F.array(F.struct(F.lit(None).cast("string").alias("column"), F.lit("parquet").alias("expected_type"), F.lit("no parquet").alias("actual_type")))
    odd = F.filter(have, lambda h: h["expected_type"].isNull() | (h["expected_type"] != h["actual_type"]))
    found = footers.select("path", "rows", F.explode(F.when(F.col("columns").isNull(), broken).otherwise(F.concat(odd, missing))).alias("d"))
    return found.groupBy("d").agg(F.count(F.lit(1)).alias("files"), F.sum("rows").alias("rows"), F.min("path").alias("example")).select(
        "d.*", "files", "rows", "example")


#: table property that switches the check on
VALIDATE = "validate_schema"


def validate_table_files(spark: SparkSession, name: str) -> DataFrame | None:
    """C9 over all files of a table whose property ``validate_schema`` is true; None where it is not switched on."""
    properties = {r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}
    if properties.get(VALIDATE, "false").lower() != "true":
        return None
    location = next(r.data_type for r in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect() if r.col_name == "Location")
    parts = {c.name for c in spark.catalog.listColumns(name) if c.isPartition}
    expected = StructType([f for f in spark.table(name).schema.fields if f.name not in parts])
    return schema_deviations(file_footers(list_objects(spark, location, "*.parquet")), expected)
