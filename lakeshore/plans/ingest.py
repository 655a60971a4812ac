"""Batch ingest jobs: landing files -> typed, partitioned catalog tables.

``ingest_workflow_results`` is the CSV job (S1, P1-P6, F1-F4, C10, C1-C6, K2,
K4, A6): the landing listing is parsed into target tables (plan metadata: one
row per file), every table's files are read as ONE distributed scan, typed by
one aggregate job per table, conformed to the existing table and appended.
``ingest_flat_reports`` (S2, S4, S5, C7, P12, K2) and ``ingest_report_documents``
(S3, P13, P14, G1, C8, P12, K2) do the same for JSON reports.

The batch is the unit of work.  Its size is bounded by the caller (the
streaming trigger's ``maxFilesPerTrigger``, O3), so the per-batch file list is
bounded metadata, like Spark's own file index.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from lakeshore.functions import paths as P
from lakeshore.operators import filters, reports, typecast
from lakeshore.operators.aggregates import observe_job_totals
from lakeshore.operators.profiles import store_profiles
from lakeshore.session import compiled_stages, materialize
from lakeshore.sinks.ledger import BATCH, commit, create_ledger, loads_name, new_batch, publish, written_files
from lakeshore.sinks.tables import create_or_update_table, partition_overwrite, write_rejects
from lakeshore.sources.files import (CORRUPT, CSV_GLOB, JSON_GLOB, list_objects, plain_path, read_record_array_json,
                                     read_workflow_csv, with_file_attributes)

PARTITION_COLUMNS = ("customer_hash", "export_year", "export_month")
#: the landed file of a row; loading the file again replaces its rows (``sinks.ledger``)
FILE_COLUMNS = ("file_last_modified", "source_file")
#: the plan of a table's files (some hundred bytes each) is sent to every task up to so many of them
MAX_BROADCAST_FILES = 10_000


def create_database(spark: SparkSession, database: str, location_root: str | None = None) -> None:
    """The silver database with its ledger; placed next to its tables when they have an explicit location."""
    ddl = f"CREATE DATABASE IF NOT EXISTS `{database}`"
    if location_root:
        ddl += f" LOCATION '{location_root}/_database'"
    spark.sql(ddl)
    compiled_stages(spark)
    create_ledger(spark, database, location_root)


@dataclass
class Customer:
    """Customer configuration row (J1 dimension): table prefix, hash and out-of-box reports."""
    prefix: str
    customer_hash: str
    oob_reports: Sequence[str] = field(default_factory=tuple)


def plan_workflow_files(listing: DataFrame, root: str, customer: Customer) -> DataFrame:
    """P1-P6 + F1-F3 over a file listing (path, length, modificationTime): one row per loadable file."""
    rel = F.regexp_replace(F.col("path"), r"^.*?" + _escape(root.rstrip("/")) + "/", "")
    return plan_files(listing.select(
        "path", "length", "modificationTime", rel.alias("key"), F.lit(customer.prefix).alias("customer_prefix"),
        F.lit(customer.customer_hash).alias("customer_hash"),
        F.array(*[F.lit(x) for x in customer.oob_reports]).cast("array<string>").alias("oob_reports")))


def plan_files(objects: DataFrame) -> DataFrame:
    """P1-P6 + F1-F3: the loadable ones of files of any customers (path, length, modificationTime, key,
    customer_prefix, customer_hash, oob_reports) with their table and partition values."""
    wk = P.parse_workflow_key("key")
    parsed = objects.select("*", wk.workflow.alias("workflow"), wk.schedule.alias("schedule"),
                            wk.file_name.alias("file_name"))
    ft = P.parse_file_timestamp("file_name")
    parsed = parsed.select("*", ft.alias("ft"))
    prefix = P.table_prefix(F.col("workflow"), F.col("customer_prefix"), F.col("oob_reports"))
    version = P.parse_version(F.col("ft.basename"))
    table = P.derive_table_name(prefix, F.col("workflow"), F.col("schedule"), version)
    ext = F.regexp_extract(F.col("file_name"), r"\.([^./]+)$", 1)
    usable = (P.is_supported_workflow_file(F.col("workflow"), F.col("schedule"), ext)
              & ~P.is_interactive_result(F.col("workflow"))
              & P.not_in_list(F.col("workflow"), filters.EXCLUDED_WORKFLOWS))
    return parsed.where(usable).select(
        "path", "length", "workflow", "schedule", "file_name", table.alias("table"), "customer_hash",
        F.col("ft.year").alias("export_year"), F.col("ft.month").alias("export_month"),
        F.date_format("modificationTime", "yyyy-MM-dd-HH-mm-ss").alias("file_last_modified"),
        source_file(F.col("key"), F.col("file_name")).alias("source_file"))


def source_file(key, name):
    """A value that names one landed file: its name and a short hash of its whole key."""
    return F.concat(name, F.lit("-"), F.substring(F.sha1(key.cast("binary")), 1, 10))


def quarantine_root(spark: SparkSession, database: str, location_root: str | None, given: str | None) -> str:
    """Where rejected rows go: the given folder, else one beside the tables.  There always is one."""
    base = given or location_root or spark.catalog.getDatabase(database).locationUri
    return base.rstrip("/") if given else f"{base.rstrip('/')}/_quarantine"


def csv_header_groups(spark: SparkSession, source, table_files: DataFrame) -> tuple[DataFrame, list]:
    """The planned files of a table with their header line, computed in Spark (the first line of
    each file is the first row, in read order, of the split that starts the file).  Returns the
    (file, header) table, written once to the shared folder, and one row per distinct header
    (header, n files, first file): only the header variants reach the driver, not the files."""
    lines = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", CSV_GLOB).text(source)
             .select(plain_path(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.file_block_start").alias("start"),
                     F.monotonically_increasing_id().alias("seq"), "value"))
    heads = materialize(
        lines.where(F.col("start") == 0).groupBy("file").agg(F.min_by("value", "seq").alias("header"))
        .join(table_files.select(F.col("_path").alias("file")), "file", "left_semi"), "csv_heads")
    groups = heads.groupBy("header").agg(F.count(F.lit(1)).alias("n"), F.min("file").alias("first")).collect()
    return heads, sorted(groups, key=lambda g: g.first)


def _escape(text: str) -> str:
    return "".join("\\" + c if c in r".^$*+?{}[]\|()" else c for c in text)


def ingest_workflow_results(spark: SparkSession, root: str, database: str, customer: Customer,
                            files: DataFrame | None = None, strict: bool = False,
                            quarantine_path: str | None = None, location_root: str | None = None,
                            max_parallel_tables: int = 4, max_listed_files: int | None = None,
                            multi_line: bool = True, profiles: bool = False) -> dict[str, dict]:
    """The CSV job for one batch of landing files under ``root``.

    ``files`` is the batch's listing (a micro-batch of the ingest stream);
    without it the whole prefix is the batch.  Only one row per target table
    reaches the driver: a micro-batch's tables read exactly their files (the
    caller bounds the batch), a whole prefix reads each table's
    ``workflow=/schedule=`` folder and keeps the planned files with a join.
    ``max_listed_files`` reads larger tables of a micro-batch, and smaller header
    groups of a prefix, the other way.
    Per-file decisions (all rows filtered, F4) and the column verdicts are
    aggregated in Spark (per file, then across the kept files).

    Files of one table within one batch are read with one header, as one scan.
    A file that is loaded again replaces what it loaded before, also when no row
    of it is left: every planned file is entered in the ledger, after all writes
    of the batch, which then shows as a whole.  Rows that do
    not fit the table go to ``quarantine_path`` (default: ``_quarantine`` beside
    the tables) as text with their file and the reason, or fail the job with
    ``strict``; rows read = rows written + rows rejected, always.
    With ``profiles`` the columns of each file are profiled (``operators.profiles``), filtered rows too.
    Returns per table: the types chosen for new columns, rows written and
    rejected, files and bytes read (A6, observed in the write itself, no extra pass), files and bytes written.
    """
    create_database(spark, database, location_root)
    batch = new_batch()
    quarantine = quarantine_root(spark, database, location_root, quarantine_path)
    listing = files if files is not None else list_objects(spark, root, CSV_GLOB)
    planned = plan_workflow_files(filters.non_empty_objects(listing), root, customer)
    tables = (planned.groupBy("table").agg(
        F.collect_set(F.struct("workflow", "schedule")).alias("folders"),     # raw names that map to it
        F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))
        .collect())                                          # one row per target table

    def listed(n: int) -> bool:
        return files is not None if max_listed_files is None else n <= max_listed_files

    def load(t) -> dict | None:
        table_files = planned.where(F.col("table") == t.table).select(
            F.col("path").alias("_path"), *PARTITION_COLUMNS, *FILE_COLUMNS)
        if listed(t.files):
            source = [r._path for r in table_files.select("_path").collect()]    # bounded micro-batch
        else:
            source = [f"{root.rstrip('/')}/workflow={f.workflow}/schedule={f.schedule}" for f in t.folders]
        try:
            return load_source(t, table_files, source)
        except Exception as exc:         # files of this table disagree on their header
            if "CSVHeaderChecker" not in str(exc) and "CSV header" not in str(exc):
                raise
        merged = None
        heads, groups = csv_header_groups(spark, source, table_files)
        for g in groups:
            files_of = heads.where(F.col("header") == g.header).select(F.col("file").alias("_path"))
            if listed(g.n):                    # a bounded list of paths: read exactly those files
                part = load_source(t, table_files, [r._path for r in files_of.collect()], grouped=True)
            else:                              # too many to list: read the folders with this header's
                header = read_workflow_csv(spark, g.first, with_attributes=False).schema   # columns, keep
                part = load_source(t, table_files.join(files_of, "_path", "left_semi"),  # its files by join
                                   source, header, grouped=True)
            if part is not None:
                merged = part if merged is None else {
                    "types": {**merged["types"], **part["types"]},
                    "records": merged["records"] + part["records"], "rejected": merged["rejected"] + part["rejected"],
                    "files": t.files, "bytes_read": t.bytes}
        return merged

    def load_source(t, table_files, source, header: StructType | None = None, grouped: bool = False) -> dict | None:
        # the groups of a table add to one batch, one after the other
        # with a header schema, files are read positionally and their own header lines are not checked
        raw = read_workflow_csv(spark, source, schema=header, check_header=header is None, quote_parity=True,
                                multi_line=multi_line)
        # planned files only, with their partition values; their number is known, so the rows of a large file stay
        # in the tasks that read its parts (Spark takes the plan to be as large as the files that it lists)
        plan = F.broadcast(table_files) if t.files <= MAX_BROADCAST_FILES else table_files
        raw = raw.join(plan, F.col("file_path") == F.col("_path")).drop("_path")
        text_cols = [f.name for f in raw.schema.fields if isinstance(f.dataType, StringType)
                     and f.name not in ("file_path", *PARTITION_COLUMNS, *FILE_COLUMNS)]
        cleaned = typecast.null_tokens(raw, text_cols)
        keep = typecast.unfiltered("filtered") if "filtered" in cleaned.columns else None
        # columns that the table has keep its types: their text is cast straight to them ('007' in a
        # STRING column stays '007'); only columns that are new are inferred
        name = f"{database}.{loads_name(t.table)}"
        schema = spark.table(name).schema if spark.catalog.tableExists(name) else StructType()
        fresh = [c for c in text_cols if c not in schema.fieldNames()]
        if profiles and text_cols:
            cleaned = materialize(cleaned, "csv_text")          # files are parsed once, for the profiles and the load
            store_profiles(spark, cleaned, text_cols, database, t.table, batch)
        kept, types = cleaned, {}
        if fresh or keep is not None:
            verdicts, kept_files, dropped = typecast.derive_types_by_file(cleaned, fresh, "file_path", keep)
            if verdicts is None:
                return None     # every file of this table was empty or fully filtered: nothing to load (F4/F6)
            if dropped:
                kept = cleaned.join(kept_files, "file_path", "left_semi")
            types = typecast.plan_types(verdicts)
        # the untouched row, for quarantine and replay
        kept = kept.withColumn("_record", F.to_json(F.struct(*[
            F.col(f"`{c}`") for c in (*text_cols, *PARTITION_COLUMNS, *FILE_COLUMNS)])))
        typed = typecast.apply_types(kept, types)
        out = typed.drop("file_path", "file_size", "file_modification_time")
        out = typecast.conform_to_schema(out, schema, strict=strict)
        rejected = out.where(F.size("_bad_columns") > 0).select(
            F.col("_record").alias("record"), F.array_join("_bad_columns", ",").alias("reason"), "source_file",
            F.lit(batch).alias(BATCH))
        rejects = Observation(f"rejects_{t.table}_{uuid.uuid4().hex[:8]}")
        out = out.observe(rejects, F.count_if(F.size("_bad_columns") > 0).alias("rejected"))
        out = out.where(F.size("_bad_columns") == 0).drop("_bad_columns", "_record")
        out, obs = observe_job_totals(out, f"ingest_{t.table}_{uuid.uuid4().hex[:8]}")
        create_or_update_table(spark, out.withColumn(BATCH, F.lit(batch)), name, [*PARTITION_COLUMNS, BATCH],
                               {"customer_hash": customer.customer_hash}, overwrite_partitions=not grouped,
                               location=f"{location_root}/{t.table}" if location_root else None)
        n_rejected = rejects.get.get("rejected", 0)
        if n_rejected:       # no second pass over the data when every row fits
            write_rejects(rejected, f"{quarantine}/{t.table}")
        return {"types": types, "records": obs.get.get("records", 0), "rejected": n_rejected, "files": t.files,
                "bytes_read": t.bytes}

    # Tables of one batch are independent: their jobs are submitted from a few driver threads so
    # the cluster works on all of them at once instead of one table after another.
    results = {}
    items = sorted(tables, key=lambda t: t.table)
    workers = max(1, min(max_parallel_tables, len(items)))
    with partition_overwrite(spark), ThreadPoolExecutor(max_workers=workers) as pool:
        for t, result in zip(items, pool.map(load, items)):
            if result is not None:
                results[t.table] = result | dict(zip(("files_written", "bytes_written"), written_files(spark, database, t.table, batch)))
                publish(spark, database, t.table)
    commit(spark, database, batch, planned.select(F.col("table").alias("scope"), "source_file"))
    return results


def ingest_flat_reports(spark: SparkSession, paths: str | Sequence[str], database: str, table: str,
                        timestamp: str | None = None, partition_by: Sequence[str] = (),
                        location_root: str | None = None, quarantine_path: str | None = None,
                        manifest: DataFrame | None = None) -> DataFrame:
    """Flat report job: JSON arrays (optionally gzip) -> one table, with an ingest ``timestamp``.

    Mixed numeric fields are DOUBLE and numeric/text mixes STRING (C7) by
    Spark's JSON inference over the whole batch.  Without an explicit
    ``timestamp`` the one of the ``manifest`` (path, timestamp) counts, or else
    the file's modification time (S5).
    """
    create_database(spark, database, location_root)
    batch = new_batch()
    df = reserve_names(read_record_array_json(spark, paths), ("timestamp", "source_file", BATCH))
    df = df.withColumn("timestamp", F.lit(timestamp).cast("timestamp")) if timestamp else with_file_attributes(df, manifest)
    out = df.withColumn("source_file", report_file(F.col("file_path")))
    load_report(spark, out.drop("file_path", "file_size", "file_modification_time"), database, table, partition_by,
                location_root, quarantine_path, batch)
    publish(spark, database, table)
    commit(spark, database, batch, landed_reports(spark, paths, table))
    return spark.table(f"{database}.{table}")


def landed_reports(spark: SparkSession, paths: str | Sequence[str], scope: str) -> DataFrame:
    """The ledger's rows of a batch of report files, also of those without any record."""
    listing = list_objects(spark, paths if isinstance(paths, str) else list(paths), JSON_GLOB)
    return listing.select(F.lit(scope).alias("scope"), report_file(F.col("path")).alias("source_file"))


def reserve_names(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Fields of the records that bear a name of the job's own columns stay, as ``<name>_reported``."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`").alias(f"{c}_reported" if c.lower() in taken else c) for c in df.columns])


def report_file(path):
    return source_file(path, F.element_at(F.split(path, "/"), -1))


def load_report(spark: SparkSession, out: DataFrame, database: str, table: str, partition_by: Sequence[str],
                location_root: str | None, quarantine_path: str | None, batch: str) -> None:
    """Append report records (with their ``source_file``) under a batch that the caller commits.

    Broken files and records that do not fit the table's types go to quarantine as text.
    """
    name = f"{database}.{loads_name(table)}"
    schema = spark.table(name).schema if spark.catalog.tableExists(name) else StructType()
    fields = [c for c in out.columns if c not in (CORRUPT, "source_file", "timestamp")]
    broken = F.col(CORRUPT) if CORRUPT in out.columns else F.lit(None).cast("string")
    record = F.coalesce(broken, F.to_json(F.struct(*[F.col(f"`{c}`") for c in fields])))
    out = out.withColumn("_record", record).withColumn("_broken", broken.isNotNull()).drop(CORRUPT)
    out = typecast.conform_to_schema(out, schema)
    fits = (F.size("_bad_columns") == 0) & ~F.col("_broken")
    rejected = out.where(~fits).select(
        F.col("_record").alias("record"), "source_file", F.lit(batch).alias(BATCH),
        F.when(F.col("_broken"), F.lit("no JSON")).otherwise(F.array_join("_bad_columns", ",")).alias("reason"))
    rejects = Observation(f"rejects_{table}_{uuid.uuid4().hex[:8]}")
    out = out.observe(rejects, F.count_if(~fits).alias("rejected"))
    out = out.where(fits).drop("_bad_columns", "_record", "_broken").withColumn(BATCH, F.lit(batch))
    create_or_update_table(spark, out, name, [*partition_by, BATCH], overwrite_partitions=True,
                           location=f"{location_root}/{table}" if location_root else None)
    if rejects.get.get("rejected", 0):
        write_rejects(rejected, f"{quarantine_root(spark, database, location_root, quarantine_path)}/{table}")


def ingest_report_documents(spark: SparkSession, paths: str | Sequence[str], database: str, table_prefix: str,
                            timestamp: str | None = None, location_root: str | None = None,
                            quarantine_path: str | None = None) -> dict[str, DataFrame]:
    """Document report job: one table ``{prefix}_{array}`` per non-empty array of the documents (G1).

    The parsed documents are persisted once because each array is a separate write.  A document that is
    loaded again replaces its rows in all tables of the prefix, also in those whose array it lacks now.
    """
    create_database(spark, database, location_root)
    batch = new_batch()
    docs = reserve_names(read_record_array_json(spark, paths), ("source_file", BATCH)).withColumn(
        "source_file", report_file(F.col("file_path")))
    docs = docs.drop("file_path", "file_size").persist()
    try:
        if CORRUPT in docs.columns:
            broken = docs.where(F.col(CORRUPT).isNotNull()).select(
                F.col(CORRUPT).alias("record"), F.lit("no JSON").alias("reason"), "source_file", F.lit(batch).alias(BATCH))
            if not broken.isEmpty():
                write_rejects(broken, f"{quarantine_root(spark, database, location_root, quarantine_path)}/{table_prefix}")
            docs_ok = docs.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
        else:
            docs_ok = docs
        docs_ok = docs_ok.drop("file_modification_time")
        # an array that is empty in every document gives no table
        arrays = reports.report_arrays(reports.drop_columns(docs_ok))
        counts = docs_ok.agg(F.lit(0).alias("_"), *[F.sum(F.size(F.coalesce(f"`{a}`", F.array().cast(docs_ok.schema[a].dataType)))).alias(f"a{i}")
                                                  for i, a in enumerate(arrays)]).first()
        filled = {f"{table_prefix}_{a}" for i, a in enumerate(arrays) if counts[f"a{i}"]}
        tables = reports.split_report(docs_ok, table_prefix, keep=["source_file"])
        written = {}
        for name in sorted(filled):
            stamp = F.lit(timestamp).cast("timestamp") if timestamp else F.current_timestamp()
            out = reserve_names(tables[name], ("timestamp", BATCH)).withColumn("timestamp", stamp)
            load_report(spark, out, database, name, (), location_root, quarantine_path, batch)
            publish(spark, database, name, table_prefix)
            written[name] = spark.table(f"{database}.{name}")
        commit(spark, database, batch, landed_reports(spark, paths, table_prefix))
        return written
    finally:
        docs.unpersist()
