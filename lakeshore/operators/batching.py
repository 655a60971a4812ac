"""Sort, bounded take, micro-batch bounds and page union.

Per-group top-N is written as ``row_number() <= n``: Catalyst plans it with a
partial ``WindowGroupLimit`` before the shuffle, so each map task forwards at
most ``n`` rows per group and a hot group cannot flood one reducer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sort_by(df: DataFrame, cols: Sequence[Column | str]) -> DataFrame:
    """O1."""
    return df.orderBy(*cols)


def bounded_take(df: DataFrame, order: Sequence[Column], max_items: int) -> DataFrame:
    """O2: the first ``max_items`` rows in ``order``."""
    return df.orderBy(*order).limit(max_items)


def newest_per_group(df: DataFrame, group_cols: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """O2/W4 per group: the first ``n`` rows of every group, with their rank."""
    w = Window.partitionBy(*group_cols).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def micro_batch_options(min_items: int = 1, max_items: int = 100) -> dict[str, str]:
    """O3: file-source options bounding a micro-batch to ``max_items`` files.

    ``min_items`` is enforced by ``pending_files_ready`` before a run is
    started (inside the batch the offsets would already be consumed).
    """
    if min_items < 1 or max_items < min_items:
        raise ValueError("need 1 <= min_items <= max_items")
    return {"maxFilesPerTrigger": str(max_items)}


def pending_files_ready(listing: DataFrame, processed: DataFrame | None, min_items: int,
                        path_col: str = "path") -> bool:
    """O3 gate: at least ``min_items`` files are waiting (listing minus processed, a bounded count)."""
    pending = listing.select(path_col)
    if processed is not None:
        pending = pending.join(processed.select(path_col), path_col, "left_anti")
    return pending.limit(min_items).count() >= min_items


def union_pages(pages: Sequence[DataFrame]) -> DataFrame:
    """Concatenate result pages whose columns differ (missing columns become NULL)."""
    if not pages:
        raise ValueError("no pages")
    out = pages[0]
    for page in pages[1:]:
        out = out.unionByName(page, allowMissingColumns=True)
    return out
