"""Packing by optimal length buckets (operator 3).

The histogram of all lengths is counted in Spark and kept bounded by its grid: lengths up to 4,096 are
exact, above that each octave has 2,048 steps (under 0.05 % of the length).  Dynamic programming over
it picks the bucket boundaries with the least padding.  Documents of a bucket then fill batches of
``budget`` padded tokens.  A bucket's documents are numbered without gathering them: they fall into
hashed slices of about ``slice_rows``, each numbered by itself and shifted by the sizes of those before.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeshore.llm.common import written

EXACT_BITS = 12
BUCKETS, BUDGET, SLICE_ROWS = 8, 65_536, 2_048
ADDED = ("bucket", "bucket_length", "batch", "slot")


def grid(length: Column) -> Column:
    """``length`` rounded up to the histogram's grid; exact up to 2 ** EXACT_BITS."""
    bits = F.length(F.bin(length))
    step = F.pow(F.lit(2.0), F.greatest(bits - EXACT_BITS, F.lit(0))).cast("long")
    return (F.ceil(length / step) * step).cast("long")


def boundaries(edges: np.ndarray, counts: np.ndarray, sums: np.ndarray, buckets: int) -> list[int]:
    """Ascending upper edges of at most ``buckets`` buckets with the least total padding.

    ``edges`` ascend; counts and sums are the documents and the tokens at each edge.  The padding of
    edges i+1..j in one bucket is edges[j] * documents - tokens, whose best split moves right with j, so
    each row of the table is filled by halving (divide and conquer).
    """
    n = len(edges)
    c = np.concatenate([[0], np.cumsum(counts)]).astype(float)
    s = np.concatenate([[0], np.cumsum(sums)]).astype(float)
    e = np.concatenate([[0], edges]).astype(float)
    best = e * c - s
    best[0] = 0.0
    cuts = []
    for _ in range(1, min(buckets, n)):
        new, cut = np.zeros(n + 1), np.zeros(n + 1, dtype=np.int64)
        todo = [(1, n, 0, n - 1)]
        while todo:
            lo, hi, a, b = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(a, min(b, j - 1) + 1)
            cost = best[i] + e[j] * (c[j] - c[i]) - (s[j] - s[i])
            k = int(np.argmin(cost))
            new[j], cut[j] = cost[k], i[k]
            todo += [(lo, j - 1, a, int(i[k])), (j + 1, hi, int(i[k]), b)]
        cuts.append(cut)
        best = new
    out, j = [], n
    for cut in reversed(cuts):
        out.append(int(edges[j - 1]))
        j = int(cut[j])
        if j == 0:
            break
    if j:
        out.append(int(edges[j - 1]))
    return sorted(set(out))


def bucket_edges(docs: DataFrame, length_col: str, buckets: int = BUCKETS) -> tuple[list[int], list[int]]:
    """Boundaries and documents of each bucket, from the whole table's histogram.

    The driver gets the histogram: at most 2 ** 12 + 2,048 rows an octave, however many documents.
    """
    hist = (docs.groupBy(grid(F.col(length_col)).alias("edge"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum(length_col).alias("tokens")).orderBy("edge").collect())
    if not hist:
        return [], []
    edges, n, tokens = (np.array([r[i] for r in hist], dtype=np.int64) for i in range(3))
    bounds = boundaries(edges, n, tokens, buckets)
    return bounds, [int(x) for x in np.bincount(np.searchsorted(bounds, edges), weights=n, minlength=len(bounds))]


def pack(docs: DataFrame, length_col: str, id_col: str = "doc_id", buckets: int = BUCKETS, budget: int = BUDGET,
         slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Add bucket (int, from 0), bucket_length, batch (within the bucket, from 0) and slot (in the batch).

    Every batch holds at most budget // bucket_length documents, so its padded size keeps the budget; a
    document longer than the budget is a batch of its own.  Lengths of null count as 0 and go with the
    shortest.  Repeated rows and ids are packed like any others.  An empty table gives an empty result.
    Other columns are carried along; one named like an added column is replaced.
    """
    columns = [c for c in docs.columns if c not in ADDED]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(id_col).alias("id"),
                       F.coalesce(F.col(length_col), F.lit(0)).cast("long").alias("length"))
    bounds, sizes = bucket_edges(rows, "length", buckets)
    bounds, sizes = bounds or [0], sizes or [0]
    bucket = F.lit(len(bounds) - 1)
    for i in reversed(range(len(bounds) - 1)):
        bucket = F.when(F.col("length") <= bounds[i], F.lit(i)).otherwise(bucket)
    of = lambda values: F.element_at(F.array(*[F.lit(int(v)).cast("long") for v in values]), F.col("bucket") + 1)
    slices = [max(1, -(-n // slice_rows)) for n in sizes]
    rows = (rows.withColumn("bucket", bucket).withColumn("bucket_length", of(bounds))
            .withColumn("fits", of([max(1, budget // max(b, 1)) for b in bounds]))
            .withColumn("slice", F.pmod(F.xxhash64("id", "length"), of(slices))))
    shift = Window.partitionBy("bucket").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("bucket", "slice").agg(F.count(F.lit(1)).alias("n"))
    starts = written(counts.withColumn("start", F.coalesce(F.sum("n").over(shift), F.lit(0)))
                     .select(F.col("bucket").alias("b"), F.col("slice").alias("s"), "start"), "pack-starts")
    nth = F.row_number().over(Window.partitionBy("bucket", "slice").orderBy("length", "id"))
    rows = rows.withColumn("nth", nth).join(starts, (F.col("bucket") == F.col("b")) & (F.col("slice") == F.col("s")))
    at = F.col("start") + F.col("nth") - 1
    return rows.select("row.*", "bucket", "bucket_length", F.floor(at / F.col("fits")).alias("batch"),
                       F.pmod(at, F.col("fits")).cast("int").alias("slot"))
