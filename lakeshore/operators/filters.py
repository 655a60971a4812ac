"""Row and file filters.

Per-file decisions (F4, F6) are aggregates by file followed by a semi join, not
windows over the file: the aggregate is partial per partition, so even a file
that holds a third of a batch costs one partial row per partition, and AQE's
skew handling can split the semi join's large side.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeshore.functions.paths import not_in_list
from lakeshore.operators.typecast import unfiltered

# Workflows whose results are never loaded.
EXCLUDED_WORKFLOWS = ("standard_impressions_by_browser_family", "standard_impressions-by-browser-family")


def null_safe_semi(df: DataFrame, keys: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The rows of ``df`` whose key is in ``keys``; NULL is a key value like any other."""
    other = keys.select(*[F.col(c).alias(f"_semi_{c}") for c in cols])
    return df.join(other, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_semi_{c}")) for c in cols]), "left_semi")


def exclude_workflows(df: DataFrame, workflow_col: str = "workflow",
                      excluded: Sequence[str] = EXCLUDED_WORKFLOWS) -> DataFrame:
    """F2."""
    return df.where(not_in_list(F.col(workflow_col), excluded))


def files_with_unfiltered_rows(df: DataFrame, file_cols: Sequence[str], filtered_col: str = "filtered"
                               ) -> DataFrame:
    """the files (keys) that have at least one unfiltered row."""
    return (df.groupBy(*file_cols).agg(F.count_if(unfiltered(filtered_col)).alias("_unfiltered"))
            .where(F.col("_unfiltered") > 0).select(*file_cols))


def drop_all_filtered_files(df: DataFrame, file_cols: Sequence[str], filtered_col: str = "filtered") -> DataFrame:
    """keep every row of files that have some unfiltered row (Q2: filtered rows stay, flag kept)."""
    if filtered_col not in df.columns:
        return df
    return null_safe_semi(df, files_with_unfiltered_rows(df, file_cols, filtered_col), file_cols)


def unfiltered_rows(df: DataFrame, filtered_col: str = "filtered") -> DataFrame:
    """F5."""
    return df.where(unfiltered(filtered_col))


def drop_empty_files(df: DataFrame, file_cols: Sequence[str], files: DataFrame) -> DataFrame:
    """files with zero data rows (counted, not guessed from newlines, Q6) are dropped from ``files``."""
    present = df.select(*file_cols).distinct()
    return null_safe_semi(files, present, file_cols)


def recent(df: DataFrame, ts_col: str, now: dt.datetime, days: int = 1) -> DataFrame:
    """rows created within the last ``days`` before ``now``."""
    since = now - dt.timedelta(days=days)
    return df.where(F.col(ts_col) >= F.lit(since).cast(df.schema[ts_col].dataType))


def index_query(df: DataFrame, key: Column, attribute: Column, max_items: int | None = None,
                order: Sequence[Column] = ()) -> DataFrame:
    """F8/O2: key and attribute equality, at most ``max_items`` rows (always applied, Q18).

    With ``order`` the first rows in that order are returned (Catalyst plans a
    top-K: each task keeps ``max_items`` rows, one small final merge).
    """
    out = df.where(key & attribute)
    if order:
        out = out.orderBy(*order)
    return out.limit(max_items) if max_items is not None else out


def non_empty_objects(df: DataFrame, size_col: str = "length") -> DataFrame:
    """F9."""
    return df.where(F.col(size_col) > 0)
