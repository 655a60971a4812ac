"""Skew-safe running aggregates and ``lag`` per key.

A plain ``Window.partitionBy(key).orderBy(ts)`` sends every row of a key to one
task; if one key holds a third of all rows, that task holds a third of the
data.  Here the ordered work is split by a *bucket* of the ordering column
(an hour, a day): rows are windowed per (key, bucket), which spreads a hot key
over as many tasks as it has buckets.  What crosses bucket borders, the
running total of earlier buckets and the last value of the previous bucket,
comes from a per-(key, bucket) aggregate (partial aggregation before the
shuffle, one row per bucket) windowed per key: that table is rows/bucket-size
smaller than the input.  The result is joined back on (key, bucket), the same
distribution the bucket window already has, so the rows are shuffled once; the
per-bucket side is partially aggregated before its own (small) shuffle.

The bucket expression must be monotone in the ordering (``date_trunc`` of the
leading order column is).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_B = "_seq_bucket"


def keyed_running(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column,
                  sums: Mapping[str, Column] | None = None,
                  lags: Mapping[str, Column] | None = None) -> DataFrame:
    """Add running sums (inclusive of the current row) and lagged values per key.

    ``order`` must be a total order within a key (add a unique tie-breaker).
    ``sums`` maps output name -> numeric expression; ``lags`` maps output
    name -> expression whose value on the previous row (NULL on the key's
    first row) is wanted.
    """
    sums = dict(sums or {})
    lags = dict(lags or {})
    order_cols = [F.col(c) for c in order]
    base = df.withColumn(_B, bucket)
    for name, expr in sums.items():
        base = base.withColumn(f"_v_{name}", expr)
    for name, expr in lags.items():
        base = base.withColumn(f"_l_{name}", expr)

    inner = Window.partitionBy(*keys, _B).orderBy(*order_cols)
    running = inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = base.withColumn("_seq_first", F.row_number().over(inner) == 1)
    for name in sums:
        local = local.withColumn(f"_loc_{name}", F.sum(f"_v_{name}").over(running))
    for name in lags:
        local = local.withColumn(f"_loc_{name}", F.lag(f"_l_{name}").over(inner))

    # One row per (key, bucket): totals and the bucket's last value of each lag input.  This
    # branch re-reads only the key, bucket, order and value columns and aggregates them before
    # its shuffle, so it ships one row per (key, bucket) and input partition: the rows
    # themselves are shuffled once, by the bucket window above.
    order_struct = F.struct(*order_cols)
    per_bucket = base.groupBy(*keys, _B).agg(
        *[F.sum(f"_v_{name}").alias(f"_tot_{name}") for name in sums],
        *[F.max_by(f"_l_{name}", order_struct).alias(f"_last_{name}") for name in lags],
        F.lit(1).alias("_seq_dummy"),
    )
    outer = Window.partitionBy(*keys).orderBy(_B)
    before = outer.rowsBetween(Window.unboundedPreceding, -1)
    carried = per_bucket.select(
        *keys, _B,
        *[F.coalesce(F.sum(f"_tot_{name}").over(before), F.lit(0)).alias(f"_pre_{name}") for name in sums],
        *[F.lag(f"_last_{name}").over(outer).alias(f"_prev_{name}") for name in lags],
    )
    # null-safe: a NULL key is a key like any other, and a NULL bucket a bucket
    carried = carried.select(*[F.col(c).alias(f"_k_{c}") for c in [*keys, _B]],
                             *[c for c in carried.columns if c not in (*keys, _B)])
    joined = local.join(carried, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in [*keys, _B]]))
    out_cols = [F.col(c) for c in df.columns]
    out_cols += [(F.col(f"_loc_{name}") + F.col(f"_pre_{name}")).alias(name) for name in sums]
    out_cols += [F.when(F.col("_seq_first"), F.col(f"_prev_{name}")).otherwise(F.col(f"_loc_{name}")).alias(name)
                 for name in lags]
    return joined.select(*out_cols)


def hour_bucket(ts: str) -> Column:
    return F.date_trunc("hour", F.col(ts))


def day_bucket(ts: str) -> Column:
    return F.date_trunc("day", F.col(ts))
