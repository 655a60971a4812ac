"""Ingestion stream, quarantine and redrive.

New landing files are discovered by a streaming file source over the landing
prefix (``binaryFile`` with the content column pruned, so only the listing is
read).  Each micro-batch is a bounded set of new files (``maxFilesPerTrigger``)
handed to the batch ingest job; the streaming checkpoint makes each file
processed once, and a committed-batch marker makes a replayed batch a no-op.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lakeshore.functions import paths as P
from lakeshore.operators import typecast
from lakeshore.operators.batching import micro_batch_options, pending_files_ready
from lakeshore.plans.ingest import (Customer, ingest_flat_reports, ingest_report_documents,
                                    ingest_workflow_results)
from lakeshore.session import drop_path, qualified, written_once
from lakeshore.sources.admission import LandedFiles
from lakeshore.sources.files import CSV_GLOB, JSON_GLOB, list_objects
from lakeshore.sinks.ledger import (BATCH, REDRIVEN, commit, generation_of, is_ledgered, loads_name, new_batch,
                                    pending_rejects, read_rejects)
from lakeshore.sinks.tables import create_or_update_table, write_rejects
from lakeshore.streaming.state import init_log, read_log, run_available_now, write_batch_partition


BINARY_FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def landing_stream(spark: SparkSession, root: str, glob: str = CSV_GLOB, max_files: int = 100) -> DataFrame:
    """Stream of newly landed files (path, length, modificationTime)."""
    reader = (spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA).option("recursiveFileLookup", True)
              .option("pathGlobFilter", glob))
    for key, value in micro_batch_options(1, max_files).items():
        reader = reader.option(key, value)
    return reader.load(root).select("path", "length", "modificationTime")


def admitted_landing_stream(spark: SparkSession, root: str, log: str, min_files: int, max_files: int = 100,
                            max_wait: float | None = None, glob: str = "*.csv") -> DataFrame:
    """O3 in the source: newly landed files, in batches that start only when ``min_files`` wait or one has waited ``max_wait`` seconds."""
    spark.dataSource.register(LandedFiles)
    reader = spark.readStream.format("landed_files").option("path", qualified(spark, root)).option("log", qualified(spark, log))
    reader = reader.option("glob", glob).option("min_files", min_files).option("max_files", max_files)
    return (reader if max_wait is None else reader.option("max_wait", max_wait)).load().select("path", "length", "modificationTime")


PROCESSED_SCHEMA = "path string, batch_id bigint"


def ingest_stream(spark: SparkSession, root: str, database: str, customer: Customer, checkpoint: str,
                  location_root: str | None = None, quarantine_path: str | None = None,
                  max_files: int = 100, min_files: int = 1) -> list[dict]:
    """T1 + O3: run the CSV job on every batch of new files until the landing zone is drained.

    A run starts only when at least ``min_files`` landed files are not processed
    yet (checked before the stream starts: inside a batch its offsets would
    already be consumed); each micro-batch takes at most ``max_files`` files.
    """
    marker_path = f"{checkpoint}/_committed"
    processed_path = f"{checkpoint}/_files"
    init_log(spark, marker_path, "n bigint, batch_id bigint")
    init_log(spark, processed_path, PROCESSED_SCHEMA)
    if min_files > 1:
        processed = read_log(spark, processed_path, PROCESSED_SCHEMA)
        if not pending_files_ready(list_objects(spark, root, CSV_GLOB), processed, min_files):
            return []
    reports: list[dict] = []

    def handle(files: DataFrame, batch_id: int) -> None:
        done = read_log(spark, marker_path, "n bigint, batch_id bigint")
        if done is not None and done.where(F.col("batch_id") == batch_id).limit(1).count() > 0:
            return      # replay of a committed batch
        result = ingest_workflow_results(spark, root, database, customer, files=files,
                                         quarantine_path=quarantine_path, location_root=location_root)
        write_batch_partition(files.select("path"), processed_path, batch_id)
        write_batch_partition(spark.range(1).select(F.lit(len(result)).cast("bigint").alias("n")),
                              marker_path, batch_id)
        reports.append({"batch_id": batch_id, "tables": result})

    run_available_now(landing_stream(spark, root, CSV_GLOB, max_files), handle, checkpoint)
    return reports


def report_stream(spark: SparkSession, root: str, database: str, table: str, checkpoint: str,
                  documents: bool = False, location_root: str | None = None, max_files: int = 100,
                  timestamp: str | None = None) -> list[dict]:
    """T1 for report datasets: each micro-batch of new ``*.json`` / ``*.gz`` files is loaded by the
    flat-report job (one table) or, with ``documents=True``, split into one table per array."""
    marker_path = f"{checkpoint}/_committed"
    init_log(spark, marker_path, "n bigint, batch_id bigint")
    reports: list[dict] = []

    def handle(files: DataFrame, batch_id: int) -> None:
        done = read_log(spark, marker_path, "n bigint, batch_id bigint")
        if done.where(F.col("batch_id") == batch_id).limit(1).count() > 0:
            return      # replay of a committed batch
        paths = [r.path for r in files.select("path").collect()]      # bounded by max_files
        if not paths:
            return
        if documents:
            written = ingest_report_documents(spark, paths, database, table, timestamp, location_root)
            names = sorted(written)
        else:
            ingest_flat_reports(spark, paths, database, table, timestamp, location_root=location_root)
            names = [table]
        write_batch_partition(spark.range(1).select(F.lit(len(names)).cast("bigint").alias("n")),
                              marker_path, batch_id)
        reports.append({"batch_id": batch_id, "files": len(paths), "tables": names})

    run_available_now(landing_stream(spark, root, JSON_GLOB, max_files), handle, checkpoint)
    return reports


UNKEYED_SCHEMA = "path string, batch_id bigint"


def keyed_report_stream(spark: SparkSession, root: str, database: str, checkpoint: str, location_root: str | None = None,
                        manifest: DataFrame | None = None, max_files: int = 100) -> list[dict]:
    """T1 for reports that name their table (P4: ``team/dataset/table/file.ext`` below ``root``), with the time stamp of
    the manifest or of the file (S5).  Files whose key or extension is no report's are logged (``_unkeyed``)."""
    marker_path, unkeyed = f"{checkpoint}/_committed", f"{checkpoint}/_unkeyed"
    init_log(spark, marker_path, "n bigint, batch_id bigint")
    init_log(spark, unkeyed, UNKEYED_SCHEMA)
    prefix = qualified(spark, root).rstrip("/") + "/"
    reports: list[dict] = []

    def handle(files: DataFrame, batch_id: int) -> None:
        done = read_log(spark, marker_path, "n bigint, batch_id bigint")
        if done.where(F.col("batch_id") == batch_id).limit(1).count() > 0:
            return      # replay of a committed batch
        key = P.parse_report_key(F.substring(F.col("path"), F.lit(len(prefix) + 1), F.length("path")))
        named = files.select("path", key.alias("k")).select(
            "path", F.when((F.col("k.table") != "") & P.is_supported_report_file(F.element_at(F.split("path", r"\."), -1)),
                           P.sanitize_table_name(F.col("k.table"))).alias("table"))
        write_batch_partition(named.where("table IS NULL").select("path"), unkeyed, batch_id)
        tables: dict[str, list[str]] = {}
        for r in named.where("table IS NOT NULL").collect():          # bounded by max_files
            tables.setdefault(r.table, []).append(r.path)
        for table in sorted(tables):
            ingest_flat_reports(spark, tables[table], database, table, location_root=location_root, manifest=manifest)
        write_batch_partition(spark.range(1).select(F.lit(len(tables)).cast("bigint").alias("n")), marker_path, batch_id)
        reports.append({"batch_id": batch_id, "tables": sorted(tables)})

    run_available_now(landing_stream(spark, root, JSON_GLOB, max_files), handle, checkpoint)
    return reports


def redrive(spark: SparkSession, quarantine_path: str, database: str, table: str, next_path: str,
            scope: str | None = None) -> int:
    """Replay the rejected rows (see ``write_rejects``) of a table against its current schema.

    Rows that conform now are loaded; the rest go to ``next_path`` (a new quarantine generation; nothing
    is deleted).  Of a table with a ledger only rejects of the newest version of their file are replayed,
    and the ledger marks them as replayed: a second call loads nothing, and a corrected file takes its
    redriven rows with it.  In other tables replayed rows get a ``source_file`` partition of their own, named
    after their file and this quarantine, and replace it.  ``scope`` is the ledger's, where it is not the table
    (the prefix of report documents).  Returns the number of rows loaded.
    """
    ledgered = is_ledgered(spark, database, table)
    name = f"{database}.{loads_name(table) if ledgered else table}"
    target = spark.table(name).schema
    raw = StructType([StructField(f.name, StringType()) for f in target.fields])
    scope = scope or table
    rejects = pending_rejects(spark, database, scope, quarantine_path) if ledgered else read_rejects(spark, quarantine_path)
    rows = rejects.select(F.from_json("record", raw).alias("_r"), "record", F.col("source_file").alias("_file"),
                          F.col(BATCH).alias("_batch")).select("_r.*", F.col("record").alias("_record"), "_file", "_batch")
    conformed, scratch = written_once(typecast.conform_to_schema(rows, target), "redriven")
    try:
        good = conformed.where(F.size("_bad_columns") == 0)
        generation = generation_of(quarantine_path)
        partitions = [c.name for c in spark.catalog.listColumns(name) if c.isPartition]
        batch = new_batch()
        n = good.count()
        if n:
            if ledgered:
                out = good.withColumn("source_file", F.col("_file")).withColumn(BATCH, F.lit(batch))
            elif partitions:
                out = good.withColumn("source_file", F.concat("_file", F.lit("-redriven-"), F.lit(generation)))
            else:
                out = good
            create_or_update_table(spark, out.drop("_bad_columns", "_record", "_file", "_batch"), name, partitions,
                                   overwrite_partitions=bool(partitions))
        still_bad = conformed.where(F.size("_bad_columns") > 0)
        write_rejects(still_bad.select(F.col("_record").alias("record"), F.array_join("_bad_columns", ",").alias("reason"),
                                       F.col("_file").alias("source_file"), F.col("_batch").alias(BATCH)), next_path)
        if ledgered:
            commit(spark, database, batch, conformed.select(F.lit(scope).alias("scope"), F.col("_file").alias("source_file")),
                   REDRIVEN, generation)
        return n
    finally:
        drop_path(spark, scratch)
