"""Stateful streams: latest-row-per-key feeds and metric alerts (T3, T4, W1 streaming).

Sinks are change logs partitioned by ``batch_id`` and written with dynamic
partition overwrite, so a micro-batch that is replayed after a failure
replaces exactly its own output (exactly-once end to end with the streaming
checkpoint).  Current state is derived from a log with ``max_by`` aggregates,
which combine per partition before the shuffle, so a hot key costs one partial
row per partition.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from lakeshore.functions.dates import threshold_met
from lakeshore.operators.history import latest_per_key
from lakeshore.operators.lookups import bounded_broadcast
from lakeshore.operators.metrics import ALWAYS, ONCE, explode_metric_keys, watched_keys
from lakeshore.operators.sequence import keyed_running


def write_batch_partition(df: DataFrame, path: str, batch_id: int, extra_partitions: Sequence[str] = ()) -> None:
    """Idempotent micro-batch output: ``path/batch_id=N/...`` replaced on replay."""
    (df.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch_id", *extra_partitions).parquet(path))


def read_log(spark: SparkSession, path: str, schema: str | StructType | None = None,
             before_batch: int | None = None
             ) -> DataFrame | None:
    """A change log written by ``write_batch_partition`` (None while it does not exist yet)."""
    try:
        reader = spark.read
        if schema:
            reader = reader.schema(schema)
        df = reader.parquet(path)
    except Exception as exc:   # the first batch has no log yet
        if "PATH_NOT_FOUND" in str(exc) or "UNABLE_TO_INFER_SCHEMA" in str(exc):
            return None
        raise
    if before_batch is not None:
        df = df.where(F.col("batch_id") < before_batch)
    return df


def init_log(spark: SparkSession, path: str, schema: str | StructType) -> None:
    """Create a change log with its schema (an empty append, harmless when it exists), so the
    first micro-batch reads an empty log instead of a missing folder."""
    spark.createDataFrame([], schema).write.mode("append").parquet(path)


def run_available_now(stream: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str,
                      name: str | None = None, output_mode: str = "append") -> None:
    """Process everything available now through ``handler`` and stop (the scheduled-run trigger)."""
    writer = (stream.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint)
              .outputMode(output_mode).trigger(availableNow=True))
    if name:
        writer = writer.queryName(name)
    query = writer.start()
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


# ---- T4 / W1 streaming ----------------------------------------------------------------

def stream_latest_per_key(stream: DataFrame, keys: Sequence[str], order: Sequence[str], log_path: str,
                          checkpoint: str, is_delete: Column | None = None, snapshot_every: int = 20) -> None:
    """Status/catalog change feed: the state store keeps max_by(row, order) per key; each
    micro-batch appends the updated keys' latest rows to a change log, and every
    ``snapshot_every`` batches the full current table is written as a snapshot."""
    spark = stream.sparkSession
    payload = [c for c in stream.columns if c not in keys]
    flagged = stream.withColumn("_deleted", F.coalesce(is_delete, F.lit(False)) if is_delete is not None else F.lit(False))
    latest = flagged.groupBy(*keys).agg(
        F.max_by(F.struct(*[F.col(c) for c in payload + ["_deleted"]]),
                 F.struct(*[F.col(c) for c in order])).alias("_row"))
    # the snapshot log exists (empty) from the start, so reading it never meets a missing folder
    snapshot_schema = StructType([*latest.select(*keys, "_row.*").schema.fields]).add("batch_id", LongType())
    init_log(spark, f"{log_path}_snapshots", snapshot_schema)

    def handle(batch: DataFrame, batch_id: int) -> None:
        write_batch_partition(batch.select(*keys, "_row.*"), log_path, batch_id)
        if (batch_id + 1) % snapshot_every == 0:
            current = _log_rows(spark, log_path, keys, order, upto=batch_id)
            write_batch_partition(current.drop("batch_id"), f"{log_path}_snapshots", batch_id)

    run_available_now(latest, handle, checkpoint, output_mode="update")


def _log_rows(spark: SparkSession, log_path: str, keys: Sequence[str], order: Sequence[str],
              upto: int | None = None) -> DataFrame:
    """Latest row per key (deleted ones included) from the last snapshot and the deltas after it."""
    deltas = read_log(spark, log_path)
    snaps = read_log(spark, f"{log_path}_snapshots", deltas.schema) \
        if deltas is not None else None
    if upto is not None:
        deltas = deltas.where(F.col("batch_id") <= upto)
        snaps = snaps.where(F.col("batch_id") <= upto) if snaps is not None else None
    rows = deltas
    if snaps is not None:
        last = snaps.agg(F.max("batch_id").alias("b")).first().b
        if last is not None:
            rows = snaps.where(F.col("batch_id") == last).unionByName(deltas.where(F.col("batch_id") > last))
    latest = latest_per_key(rows.drop("batch_id"), list(keys), list(order))
    return latest.where(live()) if upto is not None else latest


def current_from_log(spark: SparkSession, log_path: str, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Latest live row per key: last snapshot plus later deltas (deleted keys dropped)."""
    return _log_rows(spark, log_path, keys, order).where(live()).drop("_deleted")


def live() -> Column:
    """Rows not flagged as deleted; a NULL flag (older logs) is not a deletion."""
    return ~F.coalesce(F.col("_deleted"), F.lit(False))


# ---- A5 streaming ---------------------------------------------------------------------

def stream_totals(stream: DataFrame, ts: str, keys: dict[str, Column], sums: dict[str, Column], log_path: str,
                  checkpoint: str, delay: str = "2 days") -> None:
    """A5 as a stream that drops nothing: partial sums of each micro-batch by key, in a log.

    Rows behind the watermark (the newest time of earlier batches less ``delay``) go to the side output, marked
    ``late``: corrections of totals that were final, folded in by ``stream_totals_of``.  ``sums`` are sums or
    counts per key, so partial sums add up; no state is held, whatever the delay.
    """
    spark = stream.sparkSession
    marks = f"{log_path}_watermarks"
    init_log(spark, marks, "newest timestamp, batch_id bigint")

    def handle(batch: DataFrame, batch_id: int) -> None:
        newest = read_log(spark, marks, "newest timestamp, batch_id bigint", before_batch=batch_id).agg(F.max("newest").alias("t")).first().t
        bound = F.lit(newest).cast("timestamp") - F.expr(f"INTERVAL {delay}")
        late = F.coalesce(F.col(ts) < bound, F.lit(False)) if newest is not None else F.lit(False)
        parts = batch.groupBy(late.alias("late"), *[c.alias(k) for k, c in keys.items()]).agg(
            F.max(ts).alias("_newest"), *[c.alias(n) for n, c in sums.items()]).persist()
        try:
            write_batch_partition(parts.drop("_newest"), log_path, batch_id)
            write_batch_partition(parts.agg(F.max("_newest").alias("newest")), marks, batch_id)
        finally:
            parts.unpersist()

    run_available_now(stream, handle, checkpoint)


def stream_totals_of(spark: SparkSession, log_path: str, keys: Sequence[str], sums: Sequence[str], late: bool | None = None) -> DataFrame:
    """Totals by key, corrections included (``late`` picks final totals or corrections alone)."""
    log = read_log(spark, log_path)
    if late is not None:
        log = log.where(F.col("late") == late)
    return log.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in sums])


# ---- T3 streaming ---------------------------------------------------------------------

COUNTER_SCHEMA = "root string, metric string, value bigint, batch_id bigint"
FIRED_SCHEMA = "root string, metric string, type string, threshold bigint, evaluation string, notify string, " \
               "batch_id bigint"


def previous_counters(spark: SparkSession, counters_path: str, snapshot_path: str, batch_id: int) -> DataFrame:
    """Counter values before ``batch_id``: the latest snapshot plus the per-batch values after it.

    Snapshots keep the read bounded by the snapshot interval instead of the age of the stream.
    """
    snaps = read_log(spark, snapshot_path, COUNTER_SCHEMA, before_batch=batch_id)
    last = snaps.agg(F.max("batch_id").alias("b")).first().b
    deltas = read_log(spark, counters_path, COUNTER_SCHEMA, before_batch=batch_id)
    if last is None:
        return deltas
    return snaps.where(F.col("batch_id") == last).unionByName(deltas.where(F.col("batch_id") > last))


def metric_alert_handler(spark: SparkSession, rules: DataFrame, state_dir: str, order: Sequence[str],
                         bucket_col: str, max_rules: int = 10_000, snapshot_every: int = 20
                         ) -> Callable[[DataFrame, int], None]:
    """foreachBatch handler: counters, ALWAYS/ONCE alerts with state in change logs.

    Every ``snapshot_every`` batches the full counter table is written as a snapshot.
    """
    counters_path, fired_path, alerts_path = (f"{state_dir}/counters", f"{state_dir}/fired",
                                              f"{state_dir}/alerts")
    snapshot_path = f"{state_dir}/counter_snapshots"
    init_log(spark, snapshot_path, COUNTER_SCHEMA)
    r = rules.select(F.col("metric").alias("_rule_metric"), F.col("metric_type").alias("_rule_type"),
                     "evaluation", "threshold", "notify")
    last = order[-1]

    def handle(batch: DataFrame, batch_id: int) -> None:
        keys = explode_metric_keys(batch)
        prev_log = previous_counters(spark, counters_path, snapshot_path, batch_id)
        prev = (prev_log.groupBy(F.col("root").alias("_root"), F.col("metric").alias("_metric"))
                .agg(F.max_by("value", "batch_id").alias("_prev")))
        known = F.col("root").eqNullSafe(F.col("_root")) & F.col("metric").eqNullSafe(F.col("_metric"))
        # every key is counted by a plain aggregate; only the keys that a rule watches are windowed
        counted = keys.groupBy("root", "metric").agg(F.sum("value").alias("_sum"))
        running = keyed_running(watched_keys(keys, rules), ["root", "metric"], list(order), F.col(bucket_col),
                                sums={"batch_value": F.col("value")})
        running = running.join(prev, known, "left").drop("_root", "_metric")
        running = running.withColumn("running_value", F.col("batch_value") + F.coalesce("_prev", F.lit(0)))
        running = running.persist()
        try:
            matched = running.join(bounded_broadcast(r, max_rules),
                                   (F.col("root") == F.col("_rule_metric")) & (F.col("type") == F.col("_rule_type")))
            hits = matched.where(threshold_met(F.col("running_value"), F.col("evaluation"), F.col("threshold")))
            cols = ["root", "metric", "type", "threshold", "evaluation", "notify",
                    F.col("running_value").alias("value"), last]
            always = hits.where(F.col("notify") == ALWAYS).select(*cols)
            rule_key = ["root", "metric", "type", "threshold", "evaluation", "notify"]
            once = (hits.where(F.col("notify") == ONCE).groupBy(*rule_key)
                    .agg(F.min_by(F.struct(F.col("running_value").alias("value"), F.col(last).alias(last)),
                                  F.struct(*[F.col(c) for c in order])).alias("_first"))
                    .select(*rule_key, "_first.*"))
            fired = read_log(spark, fired_path, FIRED_SCHEMA, before_batch=batch_id)
            if fired is not None:
                once = once.join(fired.drop("batch_id"), rule_key, "left_anti")
            once = once.persist()
            write_batch_partition(always.unionByName(once), alerts_path, batch_id)
            write_batch_partition(once.select(*rule_key), fired_path, batch_id)
            once.unpersist()
            counters = counted.join(prev, known, "left").select(
                "root", "metric", (F.col("_sum") + F.coalesce("_prev", F.lit(0))).alias("value"))
            write_batch_partition(counters, counters_path, batch_id)
            if (batch_id + 1) % snapshot_every == 0:
                current = (prev_log.unionByName(read_log(spark, counters_path, COUNTER_SCHEMA)
                                                .where(F.col("batch_id") == batch_id))
                           .groupBy("root", "metric").agg(F.max_by("value", "batch_id").alias("value")))
                write_batch_partition(current, snapshot_path, batch_id)
        finally:
            running.unpersist()

    return handle


def stream_metric_alerts(spark: SparkSession, updates: DataFrame, rules: DataFrame, state_dir: str,
                         checkpoint: str, order: Sequence[str], bucket: Column, snapshot_every: int = 20
                         ) -> DataFrame:
    """T3 as a stream; returns the alert log."""
    stream = updates.withColumn("_b", bucket)
    init_log(spark, f"{state_dir}/counters", COUNTER_SCHEMA)
    init_log(spark, f"{state_dir}/fired", FIRED_SCHEMA)
    run_available_now(stream, metric_alert_handler(spark, rules, state_dir, order, "_b",
                                                   snapshot_every=snapshot_every), checkpoint)
    schema = (f"root string, metric string, type string, threshold bigint, evaluation string, notify string, "
              f"value bigint, `{order[-1]}` bigint, batch_id bigint")
    alerts = read_log(spark, f"{state_dir}/alerts", schema)
    return alerts if alerts is not None else spark.createDataFrame([], schema)
