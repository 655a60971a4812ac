"""Fan-out load: files of many customers and tables with one scan and, as a rule, one write.

The files of a batch are read once, whatever their headers: cells are matched with their file's header line.
One aggregate types the new columns of all tables, and rows of all tables whose types agree on shared column
names are written by one job, ``partitionBy("table", ...)``; a Parquet table reads its own columns by name, so
columns of the others in a file cost nothing.  Only tables that disagree (``v`` a number here, text there) need a
further write.  The batch becomes visible as a whole through the ledger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lakeshore.operators import typecast
from lakeshore.plans.ingest import FILE_COLUMNS, PARTITION_COLUMNS, create_database, plan_files
from lakeshore.session import materialize, path_exists
from lakeshore.sinks.ledger import BATCH, commit, loads_name, new_batch, publish, written_files
from lakeshore.sinks.tables import (add_partitions, create_table_with_properties, evolve_table, partition_overwrite,
                                    write_rejects)
from lakeshore.sources.files import plain_path, read_csv_cells

FILTERED = "filtered"


def table_location(location_root: str, table: str) -> str:
    """Where the fan-out write puts a table's rows."""
    return f"{location_root.rstrip('/')}/table={table}"


def header_width(spark: SparkSession, paths: list[str]) -> int:
    """The most commas of any line that starts a file, plus one."""
    lines = spark.read.text(paths).where(F.col("_metadata.file_block_start") == 0).select(
        plain_path(F.col("_metadata.file_path")).alias("file"), F.monotonically_increasing_id().alias("seq"),
        F.regexp_count("value", F.lit(",")).alias("commas"))
    return (lines.groupBy("file").agg(F.min_by("commas", "seq").alias("commas")).agg(F.max("commas")).first()[0] or 0) + 1


def matched_rows(cells: DataFrame) -> DataFrame:
    """Every row below its file's header: ``fields`` (lower-case name -> text) and ``names`` as the header has them.

    Repeated names get their place behind them.
    """
    first = cells.groupBy("file_path").agg(F.min_by("cells", "seq").alias("header"), F.min("seq").alias("top"))
    header = F.filter("header", lambda x: x.isNotNull())
    names = F.transform(header, lambda name, k: F.when(
        F.size(F.filter(header, lambda x: F.lower(x) == F.lower(name))) > 1, F.concat(name, k.cast("string"))).otherwise(name))
    rows = cells.join(first.select("file_path", "top", "header", names.alias("names")), "file_path").where("seq > top")
    pairs = F.filter(F.arrays_zip(F.col("header").alias("h"), F.col("cells").alias("v")), lambda p: p["h"].isNotNull())
    texts = F.transform(pairs, lambda p: p["v"])
    return rows.select("file_path", "names", F.map_from_arrays(F.transform("names", F.lower), texts).alias("fields"))


def field(name: str) -> Column:
    """A field's text, null where it is a missing-value word."""
    text = F.col("fields")[name.lower()]
    return F.when(~text.isin(*typecast.NULL_TOKENS), text)


def unfiltered() -> Column:
    return F.coalesce(F.lower(F.col("fields")[FILTERED]) != "true", F.lit(True))


def column_verdicts(rows: DataFrame) -> dict[str, dict[str, typecast.ColumnVerdict]]:
    """C1 + F4 for all tables at once: what the unfiltered rows say about each (table, column).

    Collected: one row per column of the batch's tables.
    """
    cells = rows.where(unfiltered()).select("table", F.explode(F.arrays_zip("names", F.map_values("fields").alias("text"))).alias("c"))
    text = F.when(~F.col("c.text").isin(*typecast.NULL_TOKENS), F.col("c.text"))
    masks = cells.groupBy("table", F.lower("c.names").alias("key")).agg(
        F.min("c.names").alias("name"), F.bit_or(typecast.value_class(text)).alias("mask")).collect()
    out: dict[str, dict[str, typecast.ColumnVerdict]] = {}
    for r in masks:
        out.setdefault(r.table, {})[r.name] = typecast.ColumnVerdict(r.name, r.mask or 0)
    return out


def write_groups(schemas: dict[str, dict[str, str]]) -> list[list[str]]:
    """Tables that one write can hold: no column name with two types (names in any case)."""
    groups: list[tuple[dict[str, tuple[str, str]], list[str]]] = []
    for table in sorted(schemas):
        columns = {c.lower(): (c, t) for c, t in schemas[table].items()}
        for taken, tables in groups:
            if all(taken.get(k, v) == v for k, v in columns.items()):
                taken.update(columns)
                tables.append(table)
                break
        else:
            groups.append((dict(columns), [table]))
    return [tables for _, tables in groups]


def load_files(spark: SparkSession, objects: DataFrame, database: str, location_root: str,
               quarantine_path: str | None = None) -> dict[str, dict]:
    """Load a micro-batch of CSV files of any customers (see ``plan_files``) into their tables.

    As in ``ingest_workflow_results``: files that are wholly filtered load nothing, tables keep their types and
    get new columns, rows that do not fit go to quarantine, and a file that is loaded again replaces its rows.
    The number of files is the caller's bound (``max_files`` of the stream); their paths are the batch's plan.
    Returns per table the types of new columns, rows written and rejected.
    """
    create_database(spark, database, location_root)
    quarantine = quarantine_path or f"{location_root.rstrip('/')}/_quarantine"
    batch = new_batch()
    planned = materialize(plan_files(objects), "fan_out_plan")
    paths = [r.path for r in planned.select("path").collect()]
    if not paths:
        return {}
    gone = [p for p in paths if not path_exists(spark, p)]          # removed since: as if it had not landed
    if gone:
        paths = sorted(set(paths) - set(gone))
        planned = planned.where(~F.col("path").isin(gone))
        if not paths:
            return {}
    cells = materialize(read_csv_cells(spark, paths, header_width(spark, paths)), "fan_out_cells")
    files = planned.select(F.col("path").alias("file_path"), "table", *PARTITION_COLUMNS, *FILE_COLUMNS)
    rows = matched_rows(cells).join(files, "file_path")
    kept_files = materialize(rows.groupBy("file_path").agg(F.count_if(unfiltered()).alias("n")).where("n > 0").select("file_path"), "fan_out_kept")
    rows = rows.join(kept_files, "file_path", "left_semi")

    own = (*PARTITION_COLUMNS, *FILE_COLUMNS, BATCH)
    schemas, fresh = {}, {}
    for table, verdicts in column_verdicts(rows).items():
        name = f"{database}.{loads_name(table)}"
        have = {f.name: f.dataType.simpleString() for f in spark.table(name).schema} if spark.catalog.tableExists(name) else {}
        known = {c.lower() for c in have}
        fresh[table] = typecast.plan_types({c: v for c, v in verdicts.items() if c.lower() not in known})
        schemas[table] = {**{c: t for c, t in have.items() if c not in own}, **fresh[table]}
        schema = StructType([StructField(c, typecast.spark_type(t)) for c, t in schemas[table].items()]
                            + [StructField(c, StringType()) for c in (FILE_COLUMNS + PARTITION_COLUMNS + (BATCH,))])
        if have:
            evolve_table(spark, name, schema)
        else:
            create_table_with_properties(spark, name, schema, [*PARTITION_COLUMNS, BATCH], location=table_location(location_root, table))
    rejected: dict[str, int] = {}
    for tables in write_groups(schemas):
        rejected |= write_group(rows, {t: schemas[t] for t in tables}, location_root, quarantine, batch)
    folders: dict[str, list[dict[str, str]]] = {}
    for r in files.join(kept_files, "file_path", "left_semi").select("table", *PARTITION_COLUMNS).distinct().collect():
        folders.setdefault(r.table, []).append({c: r[c] for c in PARTITION_COLUMNS} | {BATCH: batch})     # tables x months
    for table in schemas:
        add_partitions(spark, f"{database}.{loads_name(table)}", folders[table])
        publish(spark, database, table)
    commit(spark, database, batch, planned.select(F.col("table").alias("scope"), "source_file"))
    counts = {r.table: r.n for r in spark.read.option("basePath", location_root).parquet(
        *[table_location(location_root, t) for t in schemas]).where(F.col(BATCH) == batch).groupBy("table").agg(
        F.count(F.lit(1)).alias("n")).collect()} if schemas else {}
    return {t: {"types": fresh[t], "records": counts.get(t, 0), "rejected": rejected.get(t, 0)}
            | dict(zip(("files_written", "bytes_written"), written_files(spark, database, t, batch))) for t in sorted(schemas)}


def write_group(rows: DataFrame, schemas: dict[str, dict[str, str]], location_root: str, quarantine: str, batch: str) -> dict[str, int]:
    """Rows of tables that agree on the types of their columns, in one job; rows that do not fit go to quarantine.

    Returns the number of those per table.
    """
    types = {c: t for schema in schemas.values() for c, t in schema.items()}
    rows = rows.where(F.col("table").isin(*schemas))
    typed = [typecast.cast_text(field(c), t).alias(c) for c, t in types.items()]
    bad = F.filter(F.array(*[F.when(field(c).isNotNull() & typecast.cast_text(field(c), t).isNull(), F.lit(c))
                             for c, t in types.items()]), lambda x: x.isNotNull())
    record = F.to_json(F.struct(*[field(c).alias(c) for c in types], *PARTITION_COLUMNS, *FILE_COLUMNS))
    out = rows.select(*typed, *FILE_COLUMNS, "table", *PARTITION_COLUMNS, F.lit(batch).alias(BATCH), bad.alias("_bad_columns"),
                      record.alias("_record"))
    fits = F.size("_bad_columns") == 0
    found = Observation(f"fan_out_{batch[:8]}_{min(schemas)}")
    seen = out.observe(found, *[F.count_if(~fits & (F.col("table") == t)).alias(t) for t in schemas])
    with partition_overwrite(rows.sparkSession):
        (seen.where(fits).drop("_bad_columns", "_record").write.mode("overwrite").option("compression", "snappy")
         .partitionBy("table", *PARTITION_COLUMNS, BATCH).parquet(location_root))
    counts = {t: n for t, n in found.get.items() if n}
    for table in counts:       # no second pass over the rows when all fit
        write_rejects(out.where(~fits & (F.col("table") == table)).select(
            "source_file", F.col("_record").alias("record"), F.array_join("_bad_columns", ",").alias("reason"), BATCH),
            f"{quarantine}/{table}")
    return counts
