"""Routed ingest stream: object events in, tables of many customers out.

A micro-batch is a bounded number of event files.  Its events are normalized, catalogued and joined with the
customers' configuration and the dataset registry; the raw objects of registered datasets are then loaded by
one fan-out load, whatever customer and table they belong to.  Events that cannot be routed are logged with
the reason, never dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeshore.functions import paths as P
from lakeshore.functions.events import normalize_event
from lakeshore.operators.history import latest_per_key
from lakeshore.operators.lookups import customer_config_lookup, pipeline_lookup
from lakeshore.plans.fan_out import load_files
from lakeshore.session import qualified
from lakeshore.streaming.state import init_log, read_log, run_available_now, write_batch_partition

CATALOG = "id string, bucket string, key string, stage string, last_modified_date string, _deleted boolean, seq bigint, batch_id bigint"
UNROUTED = "id string, reason string, event string, batch_id bigint"


def routed_events(events: DataFrame, customers: DataFrame, registry: DataFrame) -> DataFrame:
    """Events (value, seq) with object id, stage, team, dataset, pipeline, the customer's configuration and, if
    they have nowhere to go, the ``reason``.

    ``customers``: hash_key (the bucket), customer_prefix, customer_hash, oob_reports, team, dataset;
    ``registry``: name (team-dataset), pipeline.
    """
    e = normalize_event("value", F.lit(0).cast("bigint"), strict=False)
    norm = events.select("value", "seq", e.alias("e")).select(
        "value", "seq", "e.bucket", P.decode_key(F.col("e.key")).alias("key"), "e.last_modified_date", "e.is_delete")
    norm = norm.select("*", P.classify_stage(F.col("bucket")).alias("stage"),
                       F.concat(F.lit("s3://"), F.col("bucket"), F.lit("/"), F.col("key")).alias("id"))
    parts = F.split(F.col("key"), "/")
    routed = pipeline_lookup(customer_config_lookup(norm, "bucket", customers), F.get(parts, 0), F.get(parts, 1), registry)
    reason = (F.when(F.col("id").isNull(), "no known event").when(F.col("is_delete") | (F.col("stage") != "raw"), None)
              .when(F.col("pipeline").isNull(), "no pipeline").when(F.col("cfg_customer_prefix").isNull(), "no customer"))
    return routed.withColumn("reason", reason)


def routed_stream(spark: SparkSession, events_root: str, lake_root: str, customers: DataFrame, registry: DataFrame,
                  database: str, checkpoint: str, location_root: str, max_files: int = 100) -> list[dict]:
    """Drain the event files under ``events_root`` (one JSON event a line), ``max_files`` a micro-batch.

    An object lies at ``lake_root/bucket/key``.  Of several events of one object in a batch the last counts;
    objects that it says are deleted are not loaded.  Returns the batches with their tables.
    """
    log = {name: f"{checkpoint}/_{name}" for name in ("committed", "catalog", "unrouted")}
    init_log(spark, log["committed"], "n bigint, batch_id bigint")
    init_log(spark, log["catalog"], CATALOG)
    init_log(spark, log["unrouted"], UNROUTED)
    reports: list[dict] = []

    def handle(batch: DataFrame, batch_id: int) -> None:
        done = read_log(spark, log["committed"], "n bigint, batch_id bigint")
        if done.where(F.col("batch_id") == batch_id).limit(1).count() > 0:
            return      # replay of a committed batch
        events = routed_events(batch.select("value", F.monotonically_increasing_id().alias("seq")), customers, registry).persist()
        try:
            write_batch_partition(events.where("reason IS NOT NULL").select("id", "reason", F.col("value").alias("event")),
                                  log["unrouted"], batch_id)
            last = latest_per_key(events.where("id IS NOT NULL"), ["id"], ["last_modified_date", "seq"])
            write_batch_partition(last.select("id", "bucket", "key", "stage", "last_modified_date",
                                              F.col("is_delete").alias("_deleted"), "seq"), log["catalog"], batch_id)
            objects = last.where("reason IS NULL AND stage = 'raw' AND NOT is_delete").select(
                F.concat_ws("/", F.lit(qualified(spark, lake_root).rstrip("/")), "bucket", "key").alias("path"), F.lit(None).cast("bigint").alias("length"),
                F.col("last_modified_date").try_cast("timestamp").alias("modificationTime"), "key",
                F.col("cfg_customer_prefix").alias("customer_prefix"), F.col("cfg_customer_hash").alias("customer_hash"),
                F.col("cfg_oob_reports").alias("oob_reports"))
            result = load_files(spark, objects, database, location_root)
        finally:
            events.unpersist()
        write_batch_partition(spark.range(1).select(F.lit(len(result)).cast("bigint").alias("n")), log["committed"], batch_id)
        reports.append({"batch_id": batch_id, "tables": result})

    stream = spark.readStream.option("maxFilesPerTrigger", max_files).text(events_root)
    run_available_now(stream, handle, checkpoint)
    return reports


def unrouted_events(spark: SparkSession, checkpoint: str) -> DataFrame:
    return read_log(spark, f"{checkpoint}/_unrouted", UNROUTED)
