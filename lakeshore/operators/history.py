"""Keyed state over history: object catalog, run history, expiry.

Latest-row-per-key is written as ``max_by(struct, order)`` aggregates, not as
``row_number()`` windows: an aggregate is combined per partition before the
shuffle, so a key that holds a third of the rows still ships one partial row
per partition.  Run history keeps its per-run event list as rows (a child
table) instead of one array per run, so no run, however long, is ever
materialised as a single value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeshore.operators.sequence import keyed_running
from lakeshore.session import materialize as written_table


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Latest row per key (W1/W4/T4 core) via ``max_by`` over a struct of all columns."""
    payload = [c for c in df.columns if c not in keys]
    latest = df.groupBy(*keys).agg(
        F.max_by(F.struct(*[F.col(c) for c in payload]), F.struct(*[F.col(c) for c in order])).alias("_row"))
    return latest.select(*keys, "_row.*")


def object_catalog(events: DataFrame, key_col: str, order: Sequence[str], is_delete: Column) -> DataFrame:
    """Catalog of live objects; the last event per key wins and a delete removes the key."""
    flagged = events.withColumn("_deleted", F.coalesce(is_delete, F.lit(False)))     # unknown is not deleted
    latest = latest_per_key(flagged, [key_col], order)
    return latest.where(~F.col("_deleted")).drop("_deleted")


def run_history(events: DataFrame, pipeline_col: str, ts_col: str, order: Sequence[str], status_col: str,
                start_status: str, terminal_statuses: Sequence[str], success_status: str,
                bucket: Column, materialize: bool = True) -> dict[str, DataFrame]:
    """W2 + W3: runs of a pipeline from status events.

    A ``start_status`` event opens a new run; the first terminal status closes
    it.  Events before any start, or after the run closed, are rejected (W3).
    Returns ``runs`` (one row per run), ``history`` (accepted events with their
    position in the run) and ``rejected``.
    """
    is_start = (F.col(status_col) == start_status).cast("bigint")
    numbered = keyed_running(events, [pipeline_col], order, bucket, sums={"run_seq": is_start})
    if materialize:
        # the run numbering (bucketed windows, joins, two shuffles) feeds the run ends, the runs,
        # the history rows and the rejects: write it once to the shared checkpoint folder
        numbered = written_table(numbered, "run-numbered")
    terminal = F.col(status_col).isin(*terminal_statuses)
    order_struct = F.struct(*[F.col(c) for c in order])
    closing = (numbered.where(terminal & (F.col("run_seq") > 0))
               .groupBy(pipeline_col, "run_seq")
               .agg(F.min_by(F.struct(F.col(ts_col).alias("end_ts"), F.col(status_col).alias("end_status"),
                                      order_struct.alias("end_order")), order_struct).alias("_end"))
               .select(pipeline_col, "run_seq", "_end.*"))
    closing = closing.withColumnsRenamed({pipeline_col: "_close_key", "run_seq": "_close_seq"})
    tagged = numbered.join(closing, F.col(pipeline_col).eqNullSafe(F.col("_close_key"))
                           & (F.col("run_seq") == F.col("_close_seq")), "left").drop("_close_key", "_close_seq").withColumn(
        "_accepted", (F.col("run_seq") > 0) & (F.col("end_order").isNull() | (order_struct <= F.col("end_order"))))
    accepted = tagged.where("_accepted")
    runs = accepted.groupBy(pipeline_col, "run_seq").agg(
        F.min(ts_col).alias("start_ts"),
        F.max("end_ts").alias("end_ts"),
        F.count(F.lit(1)).alias("n_updates"),
        F.max_by(F.col(status_col), order_struct).alias("status"),
    )
    runs = runs.select(
        "*",
        F.col("end_ts").isNull().alias("active"),
        (F.col("status") == success_status).alias("success"),
        ((F.unix_micros(F.col("end_ts").cast("timestamp")) - F.unix_micros(F.col("start_ts").cast("timestamp")))
         / F.lit(1_000_000.0)).alias("duration_in_seconds"),
    )
    history = keyed_running(accepted.drop("end_ts", "end_status", "end_order", "_accepted"),
                            [pipeline_col, "run_seq"], order, bucket,
                            sums={"position": F.lit(1).cast("bigint")})
    rejected = tagged.where(~F.col("_accepted")).drop("end_ts", "end_status", "end_order", "_accepted")
    return {"runs": runs, "history": history, "rejected": rejected}


def pipeline_last_run(runs: DataFrame, pipeline_col: str) -> DataFrame:
    """Last completed run per pipeline: its id, end, status and duration."""
    done = runs.where(F.col("success"))
    return done.groupBy(pipeline_col).agg(
        F.max_by(F.struct("run_seq", "end_ts", "status", "duration_in_seconds"), F.col("end_ts")).alias("_last")
    ).select(pipeline_col, F.col("_last.run_seq").alias("last_run_seq"),
             F.col("_last.end_ts").alias("last_execution_ts"),
             F.col("_last.end_ts").cast("date").alias("last_execution_date"),
             F.col("_last.status").alias("last_execution_status"),
             F.col("_last.duration_in_seconds").alias("last_execution_duration_in_seconds"))


def with_expiry(df: DataFrame, ts_col: str, ttl_days: int) -> DataFrame:
    """Expiry epoch (seconds) = row time + ttl days."""
    return df.withColumn("ttl", F.unix_seconds(F.date_add(F.col(ts_col), ttl_days).cast("timestamp")))


def expire(df: DataFrame, now: Column, ttl_col: str = "ttl") -> DataFrame:
    """Rows whose expiry lies in the future."""
    return df.where(F.col(ttl_col) > F.unix_seconds(now.cast("timestamp")))


def latest_objects(df: DataFrame, order_col: str, newest_only: bool = True) -> DataFrame:
    """Objects by last-modified, newest first; only the newest one when asked (Q7: newest, not oldest)."""
    ordered = df.orderBy(F.col(order_col).desc())
    return ordered.limit(1) if newest_only else ordered
