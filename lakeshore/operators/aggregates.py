"""Grouped aggregates.

Every aggregate here is algebraic (sum, count, min/max, max_by, count_if) or
an exact distinct count, so Spark computes partial results before the shuffle
and a hot group costs one partial row per input partition, not its row count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from lakeshore.functions.dates import seconds_between
from lakeshore.functions.paths import table_and_partitions_of_key

# Conversion-time buckets (upper bound in seconds, label).
CONVERSION_BUCKETS = (
    (60, "1 | < 1 MIN"),
    (600, "2 | 1 - 10 MIN"),
    (1800, "3 | 10 - 30 MIN"),
    (3600, "4 | 30 - 60 MIN"),
    (7200, "5 | 1 - 2 HRS"),
    (43200, "6 | 2 - 12 HRS"),
    (86400, "7 | 12 - 24 HRS"),
    (604800, "8 | 1 - 7 DAYS"),
)
CONVERSION_OVERFLOW = "9 | 7+ DAYS"

# Execution states counted by the summary.
EXECUTION_STATES = ("RUNNING", "PENDING", "FAILED", "REJECTED", "CANCELLED", "SUCCEEDED")


def conversion_bucket(impression_ts: Column, conversion_ts: Column) -> Column:
    """A1 bucket label from whole elapsed seconds."""
    secs = seconds_between(impression_ts, conversion_ts)
    expr = None
    for bound, label in CONVERSION_BUCKETS:
        expr = F.when(secs <= bound, F.lit(label)) if expr is None else expr.when(secs <= bound, F.lit(label))
    return expr.otherwise(F.lit(CONVERSION_OVERFLOW))


def time_to_conversion(df: DataFrame, group_cols: Sequence[Column | str], impression_col: str,
                       conversion_col: str, purchases: Column, total_purchases: Column) -> DataFrame:
    """A1: purchases and brand purchases by group and conversion-time bucket."""
    return (df.groupBy(*group_cols, conversion_bucket(F.col(impression_col), F.col(conversion_col))
                       .alias("time_to_conversion"))
            .agg(F.sum(purchases).alias("purchases"), F.sum(total_purchases).alias("total_brand_purchases")))


def spend_and_reach(df: DataFrame, group_cols: Sequence[str], cost: Column, impressions: Column,
                    user_col: str, approximate: bool = False) -> DataFrame:
    """A2: spend, impressions and reach (distinct users) per group.

    Exact reach is a distinct count (Spark expands it into a two-level
    aggregate, still partial before the shuffle); ``approximate=True`` uses a
    HyperLogLog++ sketch whose state is fixed-size per group.
    """
    reach = F.approx_count_distinct(user_col) if approximate else F.count_distinct(F.col(user_col))
    return df.groupBy(*group_cols).agg(
        F.sum(cost).alias("spend"), F.sum(impressions).alias("impressions"), reach.alias("reach"))


def execution_summary(df: DataFrame, status_col: str = "status") -> DataFrame:
    """A3: one row of counts per execution state; ``running_or_pending`` drives back-pressure."""
    status = F.col(status_col)
    counts = [F.count_if(status == s).alias(f"{s.lower()}_executions") for s in EXECUTION_STATES]
    return df.agg(F.count(F.lit(1)).alias("total_executions"), *counts).withColumn(
        "total_running_or_pending", F.col("running_executions") + F.col("pending_executions"))


def daily_metric_totals(df: DataFrame, ts_col: str, metric_col: str, value: Column,
                        sub_col: str | None = None) -> DataFrame:
    """A5: per-day sums of a metric, optionally nested by sub-metric (a column, not a name suffix)."""
    keys = [F.window(ts_col, "1 day").start.cast("date").alias("day"), F.col(metric_col).alias("metric")]
    if sub_col:
        keys.append(F.col(sub_col).alias("sub_metric"))
    return df.groupBy(*keys).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("datapoints"))


def job_totals(df: DataFrame, group_cols: Sequence[str], file_col: str, bytes_col: Column) -> DataFrame:
    """A6 as a grouped report: files, bytes and records per group."""
    return df.groupBy(*group_cols).agg(
        F.count_distinct(F.col(file_col)).alias("files"), F.sum(bytes_col).alias("bytes_read"),
        F.count(F.lit(1)).alias("records"))


def observe_job_totals(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """A6 without a second pass: records are counted by the action that writes the data (bytes: ``ledger.written_files``)."""
    obs = Observation(name)
    return df.observe(obs, F.count(F.lit(1)).alias("records")), obs


def filtered_counts(df: DataFrame, group_cols: Sequence[str], unfiltered: Column) -> DataFrame:
    """Filtered and unfiltered rows per group."""
    return df.groupBy(*group_cols).agg(
        F.count_if(~unfiltered).alias("filtered_rows"), F.count_if(unfiltered).alias("unfiltered_rows"))


def distinct_keys(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Duplicate keys collapsed."""
    return df.select(*cols).dropDuplicates(list(cols))


def tables_touched(df: DataFrame, key_col: str) -> DataFrame:
    """A10: distinct (table, partition path) pairs of a batch of staged keys."""
    parts = table_and_partitions_of_key(key_col)
    return df.select(parts.table.alias("table"), parts.partitions.alias("partitions")).distinct()
