"""End-to-end ingest runs over landing files that Spark derives from the driver tables.

Each run writes its landing files with Spark writers into a fresh folder under
the shared checkpoint directory, runs the real ingest job into a fresh
database whose tables live next to it, and returns the loaded rows.
"""

from __future__ import annotations

import math
import os
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakeshore.operators import filters
from lakeshore.operators.history import latest_objects
from lakeshore.operators.profiles import column_profiles, merge_profiles, profile_type
from lakeshore.operators.validate import VALIDATE, validate_schema, validate_table_files
from lakeshore.plans.ingest import (PARTITION_COLUMNS, Customer, create_database, ingest_flat_reports,
                                    ingest_report_documents, ingest_workflow_results)
from lakeshore.plans.queries import CUSTOMER_PREFIX, FIXED_TIMESTAMP, run_id, table
from lakeshore.session import hadoop_path, scratch_path
from lakeshore.sinks.ledger import pending_rejects, widen
from lakeshore.sinks.tables import create_or_update_table, overwrite_table, recover_partitions, write_parquet
from lakeshore.sources.files import list_objects, parquet_schema
from lakeshore.streaming.ingest import redrive

ORDERS_PER_DOCUMENT = 500
#: documents of large tables hold several blocks of orders: at most so many documents, until one has so many lines
DOCUMENTS, LINES_PER_DOCUMENT = 300, 160_000


def document_of(li, orders: int = ORDERS_PER_DOCUMENT):
    """The landed document of a line: its block of orders, or of more blocks than documents the one it is dealt to."""
    block = F.floor(F.col("l_orderkey") / orders)
    size = li.agg(F.count(F.lit(1)).alias("lines"), F.count_distinct(block).alias("blocks")).first()
    documents = max(DOCUMENTS, math.ceil(size.lines / LINES_PER_DOCUMENT))
    return block if size.blocks <= documents else F.pmod(F.xxhash64(block), F.lit(documents))


def _run_dirs(spark: SparkSession, name: str) -> tuple[str, str, str]:
    rid = run_id()
    base = scratch_path(spark, "ingest", f"{name}-{rid}")
    return os.path.join(base, "landing"), os.path.join(base, "tables"), f"lake_{name}_{rid}"


# ---- CSV results -------------------------------------------------------------------

def csv_ingest(spark, sf_dir):
    """Orders landed as CSV results of three workflows; the 'P' workflow is all filtered and dropped."""
    landing, tables, db = _run_dirs(spark, "csv")
    o = table(spark, sf_dir, "orders")
    filtered = (F.when(F.col("o_orderstatus") == "P", "TRUE")
                .when(F.col("o_orderpriority") == "5-LOW", "true").otherwise("false"))
    (o.select(F.concat(F.lit("orders_"), F.lower("o_orderstatus")).alias("workflow"),
              F.lit("adhoc").alias("schedule"), "o_orderkey", "o_custkey", "o_totalprice",
              F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"), "o_orderpriority",
              filtered.alias("filtered"))
     .repartition(8).write.partitionBy("workflow", "schedule").option("header", True).csv(landing))
    result = ingest_workflow_results(spark, landing, db, Customer("acme", "c0ffee", ("orders_x",)),
                                     location_root=tables)
    frames = [spark.table(f"{db}.{name}").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority", "filtered",
        F.lit(name).alias("table_name")) for name in sorted(result)]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


SQL_CSV_INGEST = """
SELECT o_orderkey, o_custkey, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority,
       o_orderpriority = '5-LOW' AS filtered, 'acme_orders_' || lower(o_orderstatus) || '_adhoc' AS table_name
FROM orders WHERE o_orderstatus <> 'P'
"""


# ---- quarantine and redrive --------------------------------------------------------

def redrive_ingest(spark, sf_dir):
    """T2 with C5, K3, K6: finished orders land first with whole-number totals, so the table
    types the total BIGINT; the other orders follow with real totals.  Totals that a BIGINT
    would cut go to quarantine (never truncated).  The operator widens the table (a K3
    rewrite as DOUBLE) and redrives the quarantine into it: the table then holds every order."""
    landing, tables, db = _run_dirs(spark, "redrive")
    quarantine = os.path.join(os.path.dirname(landing), "quarantine")
    customer = Customer("acme", "c0ffee", ())
    o = table(spark, sf_dir, "orders")
    total = F.when(F.col("o_orderstatus") == "F", F.floor("o_totalprice").cast("string")) \
        .otherwise(F.col("o_totalprice").cast("string"))
    for batch, rows in (("b1", o.where(F.col("o_orderstatus") == "F")), ("b2", o.where(F.col("o_orderstatus") != "F"))):
        (rows.select(F.lit("orders").alias("workflow"), F.lit("adhoc").alias("schedule"), "o_orderkey",
                     "o_custkey", total.alias("o_totalprice"), "o_orderpriority")
         .repartition(4).write.partitionBy("workflow", "schedule").option("header", True)
         .csv(os.path.join(landing, batch)))
        ingest_workflow_results(spark, os.path.join(landing, batch), db, customer, quarantine_path=quarantine,
                                location_root=tables)
    narrow = spark.table(f"{db}.acme_orders_adhoc")
    overwrite_table(spark, narrow.withColumn("o_totalprice", F.col("o_totalprice").cast("double")),
                    f"{db}.orders_wide", [*PARTITION_COLUMNS, "source_file"])
    redrive(spark, os.path.join(quarantine, "acme_orders_adhoc"), db, "orders_wide",
            os.path.join(quarantine, "acme_orders_adhoc_2"))
    return spark.table(f"{db}.orders_wide").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")


SQL_REDRIVE_INGEST = """
SELECT o_orderkey, o_custkey,
       CASE WHEN o_orderstatus = 'F' THEN floor(o_totalprice) ELSE o_totalprice END AS o_totalprice, o_orderpriority
FROM orders
"""


# ---- drifting types, rejects and re-runs -------------------------------------------

def type_drift_ingest(spark, sf_dir):
    """Rows in = rows loaded + rows rejected, whatever drifts, and a re-run adds nothing.

    Finished orders land first: their codes are text and their totals whole numbers, which makes the
    columns STRING and BIGINT.  The others follow, twice, under a workflow name with a blank: codes of
    digits with leading zeros (they stay as they are), notes with line breaks, and real totals
    (whole ones load, others are rejected with their file)."""
    landing, tables, db = _run_dirs(spark, "drift")
    customer = Customer("acme", "c0ffee", ())
    o = table(spark, sf_dir, "orders")
    done = F.col("o_orderstatus") == "F"
    code = F.concat(F.when(done, F.lit("A")).otherwise(F.lit("00")), F.col("o_orderkey").cast("string"))
    total = F.when(done | (F.col("o_orderkey") % 2 == 0), F.floor("o_totalprice").cast("string")) \
        .otherwise(F.col("o_totalprice").cast("string"))
    for batch, rows in (("b1", o.where(done)), ("b2", o.where(~done)), ("b2", None)):
        path = os.path.join(landing, batch)
        if rows is not None:
            (rows.select(F.lit("my orders").alias("workflow"), F.lit("adhoc").alias("schedule"), "o_orderkey",
                         code.alias("code"), total.alias("total"),
                         F.concat(F.col("o_orderpriority"), F.lit("\n"), F.col("o_orderstatus")).alias("note"))
             .repartition(max(4, spark.sparkContext.defaultParallelism))        # such files are read whole
             .write.partitionBy("workflow", "schedule").option("header", True).csv(path))
        (name,) = ingest_workflow_results(spark, path, db, customer, location_root=tables)
    loaded = spark.table(f"{db}.{name}").select("o_orderkey", "code", F.col("total").cast("double").alias("total"), "note",
                                               F.lit("loaded").alias("state"))
    record = "o_orderkey string, code string, total string, note string"     # rejected CSV rows are kept as they were
    rejected = (spark.read.parquet(os.path.join(tables, "_quarantine", name))
                .select(F.from_json("record", record).alias("r"), F.col("reason").alias("state"))
                .select(F.col("r.o_orderkey").cast("bigint").alias("o_orderkey"), "r.code",
                        F.col("r.total").cast("double").alias("total"), "r.note", "state"))
    return loaded.unionByName(rejected)


SQL_TYPE_DRIFT_INGEST = """
WITH o AS (
  SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'A' ELSE '00' END || o_orderkey AS code,
         CASE WHEN o_orderstatus = 'F' OR o_orderkey % 2 = 0 THEN floor(o_totalprice) ELSE o_totalprice END AS total,
         o_orderpriority || chr(10) || o_orderstatus AS note
  FROM orders)
SELECT *, CASE WHEN total = floor(total) THEN 'loaded' ELSE 'total' END AS state FROM o
"""


def report_drift_ingest(spark, sf_dir):
    """Flat reports whose second batch, loaded twice, has fractions where the table has whole
    numbers, and a file that is no JSON: fractions and the broken file are rejected, all else loads."""
    landing, tables, db = _run_dirs(spark, "report_drift")
    li = table(spark, sf_dir, "lineitem")
    first, document = F.col("l_orderkey") % 2 == 0, document_of(li)
    sales = F.when(first | (F.col("l_linenumber") == 1), F.floor("l_extendedprice").cast("string")).otherwise(
        F.col("l_extendedprice").cast("string"))
    record = F.concat(F.lit('{"l_orderkey":'), F.col("l_orderkey").cast("string"), F.lit(',"l_linenumber":'),
                      F.col("l_linenumber").cast("string"), F.lit(',"sales":'), sales, F.lit("}"))
    for batch, keep in (("b1", first), ("b2", ~first), ("b2", None)):
        path = os.path.join(landing, batch)
        if keep is not None:
            (li.where(keep).groupBy(document.alias("doc"))
             .agg(F.concat(F.lit("["), F.array_join(F.collect_list(record), ","), F.lit("]")).alias("value"))
             .select("value").repartition(max(1, spark.sparkContext.defaultParallelism)).write.option("lineSep", "\n")
             .option("maxRecordsPerFile", 1).option("compression", "gzip").text(path))
            spark.range(1).select(F.lit('[{"l_orderkey":').alias("value")).write.mode("append").option(
                "compression", "gzip").text(path)
        ingest_flat_reports(spark, path, db, "lines", FIXED_TIMESTAMP, location_root=tables)
    loaded = spark.table(f"{db}.lines").select("l_orderkey", "l_linenumber", F.col("sales").cast("double").alias("sales"),
                                              F.lit("loaded").alias("state"))
    rejected = (spark.read.parquet(os.path.join(tables, "_quarantine", "lines"))
                .select(F.from_json("record", "l_orderkey bigint, l_linenumber bigint, sales double").alias("r"),
                        F.col("reason").alias("state")).select("r.*", "state"))
    return loaded.unionByName(rejected)


SQL_REPORT_DRIFT_INGEST = """
WITH l AS (
  SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
         CASE WHEN l_orderkey % 2 = 0 OR l_linenumber = 1 THEN floor(l_extendedprice) ELSE l_extendedprice END AS sales
  FROM lineitem)
SELECT *, CASE WHEN sales = floor(sales) THEN 'loaded' ELSE 'sales' END AS state FROM l
UNION ALL SELECT NULL, NULL, NULL, 'no JSON' FROM range(2)
"""


# ---- files that land again ----------------------------------------------------------

def land_file(df, folder: str, name: str) -> None:
    """One landed CSV file of that very name, replacing an older one (header only if there are no rows)."""
    scratch = f"{folder}/_{run_id()}"
    df.repartition(1).write.option("header", True).csv(scratch)       # one task writes, all read
    target, fs = hadoop_path(df.sparkSession, f"{folder}/{name}")
    (part,) = [f.getPath() for f in fs.globStatus(hadoop_path(df.sparkSession, f"{scratch}/part-*.csv")[0])]
    fs.delete(target, False)
    fs.rename(part, target)
    fs.delete(part.getParent(), True)


def reland_ingest(spark, sf_dir):
    """Files land again, and the table is what they say now.

    Four files of orders come first with whole totals (BIGINT), then two with real ones, whose fractions
    are rejected.  Then file 0 lands corrected, 1 without rows, 2 with all rows filtered, 3 as it was (with
    a new time stamp), and 4 with whole totals, so its rejects are void.  The total is widened and the
    quarantine replayed twice: only what file 5 still has in it loads, once.
    """
    landing, tables, db = _run_dirs(spark, "reland")
    customer = Customer("acme", "c0ffee", ())
    folder = os.path.join(landing, "workflow=orders", "schedule=adhoc")
    o = table(spark, sf_dir, "orders")

    def land(k: int, whole: bool = True, priority=F.col("o_orderpriority"), filtered: str = "false", keep=F.lit(True)):
        total = F.floor("o_totalprice").cast("string") if whole else F.col("o_totalprice").cast("string")
        land_file(o.where((F.col("o_orderkey") % 6 == k) & keep).select(
            "o_orderkey", total.alias("o_totalprice"), priority.alias("o_orderpriority"), F.lit(filtered).alias("filtered")),
            folder, f"2024-01-0{k + 1}-orders.csv")

    for files in ((0, 1, 2, 3), (4, 5)):
        with ThreadPoolExecutor(max_workers=4) as pool:
            list(pool.map(lambda k: land(k, whole=k < 4), files))
        (name,) = ingest_workflow_results(spark, landing, db, customer, location_root=tables)
    again = [dict(k=0, priority=F.lit("0-FIXED")), dict(k=1, keep=F.lit(False)), dict(k=2, filtered="true"), dict(k=3), dict(k=4)]
    with ThreadPoolExecutor(max_workers=4) as pool:
        list(pool.map(lambda how: land(**how), again))
    ingest_workflow_results(spark, landing, db, customer, location_root=tables)
    widen(spark, db, name, {"o_totalprice": "double"})
    quarantine = os.path.join(tables, "_quarantine", name)
    for k in (1, 2):
        redrive(spark, quarantine, db, name, f"{quarantine}_{k}")
    left = pending_rejects(spark, db, name, quarantine).select(
        F.lit(None).cast("bigint").alias("o_orderkey"), F.lit(None).cast("double").alias("o_totalprice"),
        F.col("reason").alias("o_orderpriority"))
    return spark.table(f"{db}.{name}").select("o_orderkey", "o_totalprice", "o_orderpriority").unionByName(left)


SQL_RELAND_INGEST = """
SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 5 THEN o_totalprice ELSE floor(o_totalprice) END AS o_totalprice,
       CASE WHEN o_orderkey % 6 = 0 THEN '0-FIXED' ELSE o_orderpriority END AS o_orderpriority
FROM orders WHERE o_orderkey % 6 NOT IN (1, 2)
"""


# ---- flat JSON array reports (gzip) ------------------------------------------------

def _line_record(sales_mixed: bool = True):
    sales = (F.when(F.col("l_linenumber") % 2 == 1, F.floor("l_extendedprice").cast("string"))
             .otherwise(F.col("l_extendedprice").cast("string"))) if sales_mixed \
        else F.col("l_extendedprice").cast("string")
    return F.concat(F.lit('{"l_orderkey":'), F.col("l_orderkey").cast("string"),
                    F.lit(',"l_linenumber":'), F.col("l_linenumber").cast("string"),
                    F.lit(',"sales":'), sales, F.lit(',"flag":"'), F.col("l_returnflag"), F.lit('"}'))


def land_line_reports(spark, sf_dir, landing: str) -> None:
    """Lineitem as gzip'd JSON-array reports, one file per block of orders (a bounded group) or more."""
    li = table(spark, sf_dir, "lineitem")
    docs = (li.groupBy(document_of(li).alias("doc"))
            .agg(F.concat(F.lit("["), F.array_join(F.collect_list(_line_record()), ","), F.lit("]")).alias("value")))
    docs.write.partitionBy("doc").option("compression", "gzip").text(landing)


def report_ingest(spark, sf_dir):
    """Lineitem landed as gzip'd JSON-array reports, one per block of orders; ``sales`` mixes int and double."""
    landing, tables, db = _run_dirs(spark, "flat")
    land_line_reports(spark, sf_dir, landing)
    loaded = ingest_flat_reports(spark, landing, db, "lineitem_report", FIXED_TIMESTAMP, location_root=tables)
    return loaded.select("l_orderkey", "l_linenumber", "sales", "flag",
                         F.col("timestamp").cast("timestamp_ntz").alias("timestamp"))


SQL_REPORT_INGEST = """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
       CASE WHEN l_linenumber % 2 = 1 THEN CAST(floor(l_extendedprice) AS DOUBLE) ELSE l_extendedprice END AS sales,
       l_returnflag AS flag, TIMESTAMP '2024-02-01 00:00:00' AS timestamp
FROM lineitem
"""


# ---- JSON report documents ---------------------------------------------------------

def land_line_documents(spark, sf_dir, landing: str) -> None:
    """Lineitem as gzip'd report documents: a specification and two arrays per block of orders."""
    li = table(spark, sf_dir, "lineitem")
    rec = _line_record()
    spec = F.concat(F.lit('{"reportType":"LINES","dataStartTime":"'),
                    F.min("l_shipdate").cast("string"), F.lit('"}'))
    docs = (li.groupBy(document_of(li).alias("doc"))
            .agg(F.concat(F.lit('{"reportSpecification":'), spec,
                          F.lit(',"dataByLine":['), F.array_join(F.collect_list(rec), ","),
                          F.lit('],"dataByReturn":['),
                          F.array_join(F.collect_list(F.when(F.col("l_returnflag") == "R", rec)), ","),
                          F.lit("]}")).alias("value")))
    docs.write.partitionBy("doc").option("compression", "gzip").text(landing)


def document_ingest(spark, sf_dir):
    """Report documents with a specification and two arrays, split into one table per array."""
    landing, tables, db = _run_dirs(spark, "doc")
    land_line_documents(spark, sf_dir, landing + "_json")
    written = ingest_report_documents(spark, landing + "_json", db, "lines_report", FIXED_TIMESTAMP,
                                      location_root=tables)
    frames = [df.select("l_orderkey", "l_linenumber", "sales", "flag", F.lit(name.lower()).alias("table_name"))
              for name, df in sorted(written.items())]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


SQL_DOCUMENT_INGEST = """
WITH l AS (
  SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
         CASE WHEN l_linenumber % 2 = 1 THEN CAST(floor(l_extendedprice) AS DOUBLE) ELSE l_extendedprice END AS sales,
         l_returnflag AS flag FROM lineitem)
SELECT *, 'lines_report_databyline' AS table_name FROM l
UNION ALL
SELECT *, 'lines_report_databyreturn' AS table_name FROM l WHERE flag = 'R'
"""

# ---- schema validation of the newest object of a table ------------------------------

def schema_validation(spark, sf_dir):
    """C9 with S6-S8, F9, W4, K4, K5: orders up to 2000 go through the catalog (a partitioned
    table with properties); the 2001 export lands later as plain files with an added column.
    The newest non-empty object under the table's location is checked against the catalog's
    data columns (partition columns live in folder names, not in the files)."""
    _, tables, db = _run_dirs(spark, "schema")
    create_database(spark, db, tables)
    location = os.path.join(tables, "orders")
    o = table(spark, sf_dir, "orders").withColumn("export_year", F.date_format("o_orderdate", "yyyy"))
    create_or_update_table(spark, o.where(F.col("export_year") < "2001"), f"{db}.orders", ["export_year"],
                           {"customer_hash": CUSTOMER_PREFIX}, location=location)
    later = o.where(F.col("export_year") >= "2001").withColumn(
        "o_discount", F.round(F.col("o_totalprice") * 0.05, 2))
    write_parquet(later, location, ["export_year"], mode="append")
    recover_partitions(spark, f"{db}.orders")
    newest = latest_objects(filters.non_empty_objects(list_objects(spark, location, "*.parquet")),
                            "modificationTime").first()
    partition_cols = {c.name for c in spark.catalog.listColumns(f"{db}.orders") if c.isPartition}
    catalog = spark.table(f"{db}.orders").schema
    expected = StructType([f for f in catalog.fields if f.name not in partition_cols])
    return validate_schema(spark, expected, parquet_schema(spark, newest.path))


SQL_SCHEMA_VALIDATION = """
WITH d AS (
  SELECT lower(column_name) AS name,
         CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double'
                          WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(column_type) END AS t
  FROM (DESCRIBE orders))
SELECT name AS "column", t AS expected_type, t AS actual_type, true AS ok FROM d
UNION ALL
SELECT 'o_discount', NULL, 'double', false
"""


def schema_census(spark, sf_dir):
    """C9, S8 over all files of a table, switched on by its property: orders before 2000 went through the catalog,
    the later files came with a further column, those of 2001 with a text priority and without the customer."""
    _, tables, db = _run_dirs(spark, "census")
    create_database(spark, db, tables)
    location = os.path.join(tables, "orders")
    o = table(spark, sf_dir, "orders").select(
        "*", F.lit(1).alias("priority"), F.date_format("o_orderdate", "yyyy").alias("export_year"))
    create_or_update_table(spark, o.where("export_year < '2000'"), f"{db}.orders", ["export_year"], {VALIDATE: "true"}, location=location)
    later = o.withColumn("o_discount", F.round(F.col("o_totalprice") * 0.05, 2))
    write_parquet(later.where("export_year = '2000'"), location, ["export_year"], mode="append")
    write_parquet(later.where("export_year > '2000'").withColumn("priority", F.col("priority").cast("string")).drop("o_custkey"),
                  location, ["export_year"], mode="append")
    return validate_table_files(spark, f"{db}.orders").select("column", "expected_type", "actual_type", "rows")


SQL_SCHEMA_CENSUS = """
WITH y AS (SELECT year(o_orderdate) AS y FROM orders),
d AS (
  SELECT 'o_discount' AS "column", NULL AS expected_type, 'double' AS actual_type, count(*) AS rows FROM y WHERE y >= 2000
  UNION ALL SELECT 'priority', 'int', 'string', count(*) FROM y WHERE y > 2000
  UNION ALL SELECT 'o_custkey', 'bigint', NULL, count(*) FROM y WHERE y > 2000)
SELECT * FROM d WHERE rows > 0
"""


def profile_types(spark, sf_dir):
    """The lines' columns as text, profiled per ship month and merged: exact ranges and the types that fit."""
    li = table(spark, sf_dir, "lineitem")
    columns = ["l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag"]
    text = li.select(F.date_format("l_shipdate", "yyyy-MM").alias("month"), *[F.col(c).cast("string").alias(c) for c in columns])
    merged = merge_profiles(column_profiles(text, columns, ["month"]))
    return merged.select("name", "rows", "present", F.col("low").cast("double").alias("low"), F.col("high").cast("double").alias("high"),
                         profile_type().alias("type"))


SQL_PROFILE_TYPES = """
SELECT 'l_orderkey' AS name, count(*) AS rows, count(l_orderkey) AS present, min(l_orderkey)::DOUBLE AS low, max(l_orderkey)::DOUBLE AS high,
       'bigint' AS type FROM lineitem
UNION ALL SELECT 'l_linenumber', count(*), count(l_linenumber), min(l_linenumber), max(l_linenumber), 'bigint' FROM lineitem
UNION ALL SELECT 'l_extendedprice', count(*), count(l_extendedprice), min(trunc(l_extendedprice)), max(trunc(l_extendedprice)), 'double' FROM lineitem
UNION ALL SELECT 'l_returnflag', count(*), count(l_returnflag), NULL, NULL, 'string' FROM lineitem
"""


INGEST_QUERIES = {
    "csv_ingest": csv_ingest,
    "report_ingest": report_ingest,
    "document_ingest": document_ingest,
    "schema_validation": schema_validation,
    "redrive_ingest": redrive_ingest,
    "type_drift_ingest": type_drift_ingest,
    "report_drift_ingest": report_drift_ingest,
    "reland_ingest": reland_ingest,
    "schema_census": schema_census,
    "profile_types": profile_types,
}
INGEST_ORACLE_SQL = {
    "csv_ingest": SQL_CSV_INGEST,
    "report_ingest": SQL_REPORT_INGEST,
    "document_ingest": SQL_DOCUMENT_INGEST,
    "schema_validation": SQL_SCHEMA_VALIDATION,
    "redrive_ingest": SQL_REDRIVE_INGEST,
    "type_drift_ingest": SQL_TYPE_DRIFT_INGEST,
    "report_drift_ingest": SQL_REPORT_DRIFT_INGEST,
    "reland_ingest": SQL_RELAND_INGEST,
    "schema_census": SQL_SCHEMA_CENSUS,
    "profile_types": SQL_PROFILE_TYPES,
}
