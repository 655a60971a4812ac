"""Input parallelism for CPU-heavy narrow operators.

A scan yields one task per file split; a small table stored as one Parquet row group is one task, so
per-value work before the first shuffle would run on a single core.  Where inputs are such files, set
``spark.lakeshore.inputPartitions``; ``spread`` then deals them out.  A large lake has thousands of
splits: the setting stays unset and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

SETTING = "spark.lakeshore.inputPartitions"


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    partitions = partitions or int(df.sparkSession.conf.get(SETTING, "0"))
    return df.repartition(partitions) if partitions > 1 else df
