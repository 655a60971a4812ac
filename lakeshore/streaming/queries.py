"""Registered streaming runs: driver tables as file streams, run with ``availableNow``.

Each result must equal the batch answer to the same question, so each one
reuses the batch query's oracle SQL.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lakeshore.plans import queries as Q
from lakeshore.plans.ingest import Customer
from lakeshore.plans.ingest_queries import (SQL_CSV_INGEST, SQL_DOCUMENT_INGEST, SQL_REPORT_INGEST,
                                            land_line_documents, land_line_reports, document_of)
from lakeshore.session import scratch_path
from lakeshore.sinks.ledger import served_tables
from lakeshore.sources.files import CSV_GLOB, JSON_GLOB, list_objects
from lakeshore.streaming.ingest import ingest_stream, keyed_report_stream, report_stream
from lakeshore.streaming.lifecycle import lifetimes, run_events, runs_of, stream_lifetimes, stream_runs
from lakeshore.streaming.routing import routed_stream, unrouted_events
from lakeshore.streaming import state as S
from lakeshore.streaming.state import (current_from_log, run_available_now, stream_latest_per_key, stream_totals,
                                       stream_totals_of, write_batch_partition)


def _dirs(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, "streams", f"{name}-{Q.run_id()}")


def events_stream(spark: SparkSession, sf_dir: str, max_files: int = 1):
    schema = Q.table(spark, sf_dir, "events").schema
    return (spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
            .option("maxFilesPerTrigger", max_files).parquet(sf_dir))


def stream_daily_metrics(spark, sf_dir):
    """A5 as a stream over several micro-batches: daily sums, with rows that come days late in a log of corrections."""
    base = _dirs(spark, "daily")
    log = os.path.join(base, "log")
    # every tenth event comes with the last slice, up to weeks behind the watermark
    events = land_event_slices(spark, sf_dir, os.path.join(base, "landing"), late=True)
    stream_totals(events, "ts", {"day": F.to_date("ts"), "metric": F.col("event_type")},
                  {"total": F.sum(Q.money("value")), "datapoints": F.count(F.lit(1))}, log, os.path.join(base, "checkpoint"))
    res = stream_totals_of(spark, log, ["day", "metric"], ["total", "datapoints"])
    return res.where("metric <> 'heartbeat'").select("day", "metric", F.col("total").cast("double").alias("total"), "datapoints")


def stream_object_catalog(spark, sf_dir):
    """W1/T4 as a stream: latest row per user kept in the state store, change log per batch."""
    base = _dirs(spark, "catalog")
    log = os.path.join(base, "log")
    stream_latest_per_key(events_stream(spark, sf_dir), ["user_id"], ["ts", "event_id"], log,
                          os.path.join(base, "checkpoint"), F.col("event_type") == "error")
    return current_from_log(spark, log, ["user_id"], ["ts", "event_id"])


def stream_execution_status(spark, sf_dir):
    """T4: execution status polls (one per line item, in line order) -> latest status per execution."""
    base = _dirs(spark, "status")
    schema = Q.table(spark, sf_dir, "lineitem").schema
    polls = (spark.readStream.schema(schema).option("pathGlobFilter", "lineitem.parquet").parquet(sf_dir)
             .select(F.col("l_orderkey").alias("execution_id"), F.col("l_linenumber").alias("poll"),
                     F.when(F.col("l_linestatus") == "O", "RUNNING")
                     .when(F.col("l_returnflag") == "R", "FAILED").otherwise("SUCCEEDED").alias("status"),
                     F.col("l_shipdate").alias("updated"), F.col("l_partkey").alias("part"),
                     F.col("l_suppkey").alias("supp")))
    log = os.path.join(base, "log")
    order = ["poll", "updated", "part", "supp"]          # a total order within an execution
    stream_latest_per_key(polls, ["execution_id"], order, log, os.path.join(base, "checkpoint"))
    return current_from_log(spark, log, ["execution_id"], order)


SQL_STREAM_EXECUTION_STATUS = """
SELECT execution_id, poll, status, updated, part, supp FROM (
  SELECT l_orderkey AS execution_id, l_linenumber AS poll,
         CASE WHEN l_linestatus = 'O' THEN 'RUNNING' WHEN l_returnflag = 'R' THEN 'FAILED' ELSE 'SUCCEEDED' END AS status,
         l_shipdate AS updated, l_partkey AS part, l_suppkey AS supp,
         row_number() OVER (PARTITION BY l_orderkey
                            ORDER BY l_linenumber DESC, l_shipdate DESC, l_partkey DESC, l_suppkey DESC) AS rn
  FROM lineitem) WHERE rn = 1
"""


def stream_metric_alerts(spark, sf_dir):
    """T3 as a stream with counters, fired-ONCE keys and alerts as change logs."""
    base = _dirs(spark, "alerts")
    rules = spark.createDataFrame(Q.ALERT_RULES, "metric string, metric_type string, evaluation string, "
                                                 "threshold bigint, notify string")
    ev = events_stream(spark, sf_dir)
    updates = ev.select(F.col("event_type").alias("code"), F.date_format("ts", "yyyy-MM-dd").alias("date"),
                        F.floor("value").cast("bigint").alias("value"), F.col("event_id").alias("seq"), "ts")
    alerts = S.stream_metric_alerts(spark, updates, rules, os.path.join(base, "state"),
                                  os.path.join(base, "checkpoint"), ["ts", "seq"], F.date_trunc("hour", "ts"))
    return alerts.drop("batch_id")


def stream_csv_ingest(spark, sf_dir):
    """The CSV landing zone drained by the ingest stream, six files per micro-batch."""
    base = _dirs(spark, "csv")
    landing, tables = os.path.join(base, "landing"), os.path.join(base, "tables")
    db = f"lake_stream_{Q.run_id()}"
    o = Q.table(spark, sf_dir, "orders")
    filtered = (F.when(F.col("o_orderstatus") == "P", "TRUE")
                .when(F.col("o_orderpriority") == "5-LOW", "true").otherwise("false"))
    (o.select(F.concat(F.lit("orders_"), F.lower("o_orderstatus")).alias("workflow"),
              F.lit("adhoc").alias("schedule"), "o_orderkey", "o_custkey", "o_totalprice",
              F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"), "o_orderpriority",
              filtered.alias("filtered"))
     .repartition(8).write.partitionBy("workflow", "schedule").option("header", True).csv(landing))
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{db}`")
    ingest_stream(spark, landing, db, Customer("acme", "c0ffee"), os.path.join(base, "checkpoint"),
                  location_root=tables, max_files=6)
    names = served_tables(spark, db)
    frames = [spark.table(f"`{db}`.`{n}`").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority", "filtered",
        F.lit(n).alias("table_name")) for n in names]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def stream_report_ingest(spark, sf_dir):
    """T1 for flat reports: gzip'd JSON-array reports drained by the report stream, at most ten
    files per micro-batch; each batch infers its own schema and the table evolves and conforms."""
    base = _dirs(spark, "reports")
    landing, tables = os.path.join(base, "landing"), os.path.join(base, "tables")
    db = f"lake_reports_{Q.run_id()}"
    land_line_reports(spark, sf_dir, landing)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{db}`")
    report_stream(spark, landing, db, "lineitem_report", os.path.join(base, "checkpoint"),
                  location_root=tables, max_files=10, timestamp=Q.FIXED_TIMESTAMP)
    return spark.table(f"`{db}`.lineitem_report").select(
        "l_orderkey", "l_linenumber", "sales", "flag", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"))


def stream_document_ingest(spark, sf_dir):
    """T1 for report documents: each micro-batch of documents is split into one table per array."""
    base = _dirs(spark, "documents")
    landing, tables = os.path.join(base, "landing"), os.path.join(base, "tables")
    db = f"lake_documents_{Q.run_id()}"
    land_line_documents(spark, sf_dir, landing)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{db}`")
    report_stream(spark, landing, db, "lines_report", os.path.join(base, "checkpoint"), documents=True,
                  location_root=tables, max_files=10, timestamp=Q.FIXED_TIMESTAMP)
    names = served_tables(spark, db)
    frames = [spark.table(f"`{db}`.`{n}`").select("l_orderkey", "l_linenumber", "sales", "flag",
                                                   F.lit(n.lower()).alias("table_name")) for n in names]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def land_event_slices(spark: SparkSession, sf_dir: str, folder: str, slices: int = 4, late: bool = False):
    """Events as files that land one after the other in time, then a heartbeat far behind them that lets time pass.

    With ``late`` every tenth event comes with the last file.
    """
    ev = Q.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    cuts = ev.select(F.unix_micros("ts").alias("t")).approxQuantile("t", [k / slices for k in range(1, slices)], 0.01)
    place = sum((F.unix_micros("ts") > c).cast("int") for c in cuts)
    if late:
        place = F.when(F.col("event_id") % 10 == 0, slices - 1).otherwise(place)
    for k in range(slices):
        ev.where(place == k).coalesce(1).write.parquet(os.path.join(folder, f"part={k}"))
    beat = ev.groupBy().agg((F.max("ts") + F.expr("INTERVAL 1 DAY")).alias("ts")).select(
        F.lit(-1).cast("bigint").alias("event_id"), "ts", F.lit(None).cast(ev.schema["user_id"].dataType).alias("user_id"),
        F.lit("heartbeat").alias("event_type"), F.lit(0.0).alias("value"), F.lit(None).cast("string").alias("props"))
    beat.select(*ev.columns).write.parquet(os.path.join(folder, f"part={slices}"))
    return (spark.readStream.schema(ev.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(folder))


def stream_key_lifetimes(spark, sf_dir):
    """T4, W1, W5 over several micro-batches: users live while events come within two days, an error closes them; keys
    that end leave the state."""
    base = _dirs(spark, "lifetimes")
    events = land_event_slices(spark, sf_dir, os.path.join(base, "landing"))
    log = os.path.join(base, "log")
    stream_lifetimes(events, "user_id", "ts", "event_id", "2 days", log, os.path.join(base, "checkpoint"), ["event_type"],
                     F.col("event_type") == "error")
    return lifetimes(spark, log).where("key IS NOT NULL").select(
        F.col("key").cast("bigint").alias("user_id"), "first_ts", "last_ts", "updates",
        F.get_json_object("payload", "$.event_type").alias("event_type"), "state")


SQL_STREAM_KEY_LIFETIMES = """
WITH e AS (
  SELECT *, lag(ts) OVER w AS before, lag(event_type) OVER w AS kind_before FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (
  SELECT *, sum(CASE WHEN before IS NULL OR ts - before > INTERVAL 2 DAY OR kind_before = 'error' THEN 1 ELSE 0 END)
            OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS life FROM e),
l AS (
  SELECT user_id, life, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS updates,
         arg_max(event_type, (ts, event_id)) AS event_type FROM n GROUP BY user_id, life)
SELECT user_id, first_ts, last_ts, updates, event_type,
       CASE WHEN event_type = 'error' THEN 'closed'
            WHEN last_ts + INTERVAL 2 DAY < (SELECT max(ts) + INTERVAL 1 DAY FROM events) THEN 'expired'
            WHEN EXISTS (SELECT 1 FROM l AS m WHERE m.user_id = l.user_id AND m.life > l.life) THEN 'expired' ELSE 'live' END AS state
FROM l
"""


def stream_keyed_reports(spark, sf_dir):
    """Reports that name their table land twice; the later ones have a further field, which their tables
    get as a new column.  Returned lines have the manifest's time stamp, other reports that of their file."""
    base = _dirs(spark, "keyed")
    landing, db = os.path.join(base, "landing"), f"lake_keyed_{Q.run_id()}"
    li = Q.table(spark, sf_dir, "lineitem")
    document, tasks = document_of(li, 10_000), max(4, spark.sparkContext.defaultParallelism)
    returned = F.when(F.col("l_returnflag") == "R", "returned-lines").otherwise("lines")
    record = lambda more: F.concat(F.lit('{"l_orderkey":'), F.col("l_orderkey").cast("string"), F.lit(',"l_linenumber":'),
                                   F.col("l_linenumber").cast("string"), *more, F.lit("}"))
    for day, more in ((0, []), (1, [F.lit(',"flag":"'), F.col("l_returnflag"), F.lit('"')])):
        docs = (li.where(F.col("l_orderkey") % 2 == day).groupBy(returned.alias("table"), document.alias("doc"))
                .agg(F.concat(F.lit("["), F.array_join(F.collect_list(record(more)), ","), F.lit("]")).alias("value")))
        for name in ("lines", "returned-lines"):
            (docs.where(F.col("table") == name).select("value").repartition(tasks).write.mode("append").option("compression", "gzip")
             .option("maxRecordsPerFile", 1).text(os.path.join(landing, "team", "ds", name)))
        manifest = list_objects(spark, landing, JSON_GLOB).where(F.contains("path", F.lit("returned-lines"))).select(
            "path", F.lit(Q.FIXED_TIMESTAMP).alias("timestamp"))
        keyed_report_stream(spark, landing, db, os.path.join(base, "checkpoint"), os.path.join(base, "tables"), manifest)
    frames = [spark.table(f"`{db}`.`{t}`").select(
        F.lit(t).alias("table_name"), "l_orderkey", "l_linenumber", "flag",
        F.when(F.col("timestamp") == F.lit(Q.FIXED_TIMESTAMP).cast("timestamp"), "manifest").when(
            F.col("timestamp").isNotNull(), "file").alias("stamp")) for t in served_tables(spark, db)]
    return frames[0].unionByName(frames[1])


SQL_STREAM_KEYED_REPORTS = """
SELECT CASE WHEN l_returnflag = 'R' THEN 'returned_lines' ELSE 'lines' END AS table_name, l_orderkey,
       CAST(l_linenumber AS BIGINT) AS l_linenumber, CASE WHEN l_orderkey % 2 = 1 THEN l_returnflag END AS flag,
       CASE WHEN l_returnflag = 'R' THEN 'manifest' ELSE 'file' END AS stamp
FROM lineitem
"""


def _stream_runs(spark, sf_dir):
    base = _dirs(spark, "runs")
    events = land_event_slices(spark, sf_dir, os.path.join(base, "landing"))
    log = os.path.join(base, "log")
    stream_runs(events, "user_id", "ts", "event_id", "event_type", "signup", ("purchase", "error"), log, os.path.join(base, "checkpoint"))
    return run_events(spark, log).where("key IS NOT NULL")


def stream_run_history(spark, sf_dir):
    """W2 as a stream: runs opened and closed in event order by a state machine, equal to the batch run history."""
    runs = runs_of(_stream_runs(spark, sf_dir), ("purchase", "error"), "purchase")
    return runs.withColumn("user_id", F.col("key").cast("bigint")).drop("key")


def stream_rejected_updates(spark, sf_dir):
    """W3 as a stream: updates before any run or after its end."""
    return _stream_runs(spark, sf_dir).where("NOT accepted").select(
        F.col("seq").alias("event_id"), F.col("key").cast("bigint").alias("user_id"), "run_seq", F.col("status").alias("event_type"))


def stream_routed_ingest(spark, sf_dir):
    """T1 with J1, J2, P16-P18, W1: orders of five customers (one a region) land as CSV results of three workflows,
    an event file names some objects of all of them at a time.  One region's amounts are text (so not all tables fit
    one write), one has a further column; AFRICA has no pipeline, and 'P' results are deleted before they are read."""
    base = _dirs(spark, "routed")
    landing, events, checkpoint = (os.path.join(base, n) for n in ("landing", "events", "checkpoint"))
    db = f"lake_routed_{Q.run_id()}"
    o, c, n = (Q.table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    o = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    regions = [r.r_regionkey for r in Q.table(spark, sf_dir, "region").select("r_regionkey").collect()]
    for r in regions:
        amount = F.concat(F.lit("USD "), F.col("o_totalprice").cast("string")) if r == 2 else F.col("o_totalprice").cast("string")
        (o.where(F.col("n_regionkey") == r).select(
            F.concat(F.lit("orders "), F.lower("o_orderstatus")).alias("workflow"), F.lit("adhoc").alias("schedule"), "o_orderkey",
            amount.alias("amount"), *([F.col("o_orderpriority").alias("Priority")] if r == 3 else []))
         .repartition(4).write.partitionBy("workflow", "schedule").option("header", True).csv(f"{landing}/partner{r}-exports"))
    listing = list_objects(spark, landing, CSV_GLOB).select(
        F.regexp_extract("path", r"/(partner\d+-exports)/(.*)$", 1).alias("bucket"),
        F.regexp_extract("path", r"/(partner\d+-exports)/(.*)$", 2).alias("key"))

    def event(kind: str, time: str):
        return F.to_json(F.struct(F.lit(kind).alias("detail-type"), F.lit(time).alias("time"), F.struct(
            F.struct(F.col("bucket").alias("name")).alias("bucket"), F.struct(F.url_encode("key").alias("key")).alias("object")).alias("detail")))

    created, deleted = event("Object Created", "2024-01-05T10:00:00.0Z"), event("Object Deleted", "2024-01-05T11:00:00.0Z")
    gone = F.contains("key", F.lit("orders p"))
    told = listing.repartition(5, "key").select(F.explode(F.when(gone, F.array(deleted, created)).otherwise(F.array(created))).alias("value"))
    told.write.text(events)
    customers = Q.table(spark, sf_dir, "region").select(
        F.concat(F.lit("partner"), F.col("r_regionkey"), F.lit("-exports")).alias("hash_key"), F.lower(F.replace("r_name", F.lit(" "), F.lit("_"))).alias("customer_prefix"),
        F.concat(F.lit("hash"), F.col("r_regionkey")).alias("customer_hash"), F.array(F.lit("none")).alias("oob_reports"),
        F.lit("team").alias("team"), F.concat(F.lit("ds"), F.col("r_regionkey")).alias("dataset"))
    registry = Q.table(spark, sf_dir, "region").where("r_name <> 'AFRICA'").select(
        F.concat(F.lit("team-ds"), F.col("r_regionkey")).alias("name"), F.lit("results").alias("pipeline"))
    routed_stream(spark, events, landing, customers, registry, db, checkpoint, os.path.join(base, "tables"), max_files=2)
    number = F.regexp_replace("amount", "^USD ", "").cast("double")
    frames = [spark.table(f"`{db}`.`{t}`").select(
        F.lit(t).alias("table_name"), "o_orderkey", number.alias("amount"),
        (F.col("Priority") if t.startswith("europe_") else F.lit(None).cast("string")).alias("priority"), "customer_hash")
        for t in served_tables(spark, db)]
    out = unrouted_events(spark, checkpoint).select(
        F.col("reason").alias("table_name"), F.lit(None).cast("bigint").alias("o_orderkey"), F.lit(None).cast("double").alias("amount"),
        F.lit(None).cast("string").alias("priority"), F.regexp_extract("id", "^s3://([^/]*)/", 1).alias("customer_hash")).distinct()
    for f in frames:
        out = out.unionByName(f)
    return out


SQL_STREAM_ROUTED_INGEST = """
WITH o AS (
  SELECT o_orderkey, o_totalprice, o_orderstatus, o_orderpriority, r_regionkey, r_name
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT lower(replace(r_name, ' ', '_')) || '_orders_' || lower(o_orderstatus) || '_adhoc' AS table_name, o_orderkey, o_totalprice AS amount,
       CASE WHEN r_regionkey = 3 THEN o_orderpriority END AS priority, 'hash' || r_regionkey AS customer_hash
FROM o WHERE r_name <> 'AFRICA' AND o_orderstatus <> 'P'
UNION ALL
SELECT DISTINCT 'no pipeline', NULL, NULL, NULL, 'partner' || r_regionkey || '-exports' FROM o WHERE r_name = 'AFRICA'
"""


STREAM_QUERIES = {
    "stream_daily_metrics": stream_daily_metrics,
    "stream_object_catalog": stream_object_catalog,
    "stream_metric_alerts": stream_metric_alerts,
    "stream_csv_ingest": stream_csv_ingest,
    "stream_execution_status": stream_execution_status,
    "stream_report_ingest": stream_report_ingest,
    "stream_document_ingest": stream_document_ingest,
    "stream_routed_ingest": stream_routed_ingest,
    "stream_keyed_reports": stream_keyed_reports,
    "stream_key_lifetimes": stream_key_lifetimes,
    "stream_run_history": stream_run_history,
    "stream_rejected_updates": stream_rejected_updates,
}
STREAM_ORACLE_SQL = {
    "stream_daily_metrics": Q.SQL_DAILY_METRICS,
    "stream_object_catalog": Q.SQL_OBJECT_CATALOG,
    "stream_metric_alerts": Q.SQL_METRIC_ALERTS,
    "stream_csv_ingest": SQL_CSV_INGEST,
    "stream_execution_status": SQL_STREAM_EXECUTION_STATUS,
    "stream_report_ingest": SQL_REPORT_INGEST,
    "stream_document_ingest": SQL_DOCUMENT_INGEST,
    "stream_routed_ingest": SQL_STREAM_ROUTED_INGEST,
    "stream_keyed_reports": SQL_STREAM_KEYED_REPORTS,
    "stream_key_lifetimes": SQL_STREAM_KEY_LIFETIMES,
    "stream_run_history": Q.SQL_RUN_HISTORY,
    "stream_rejected_updates": Q.SQL_REJECTED_UPDATES,
}

__all__ = ["STREAM_QUERIES", "STREAM_ORACLE_SQL", "run_available_now", "write_batch_partition"]
