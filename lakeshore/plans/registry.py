"""Pluggable dataset transforms (D1) and per-record hooks.

A dataset registers two ``DataFrame -> DataFrame`` functions, one per stage
(light: parse and route; heavy: type and write), looked up by dataset name at
run time and applied with ``df.transform``.  Per-record logic that has no
native column expression is registered as an Arrow-batched pandas UDF; it runs
on executors over column batches, never row by row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

Transform = Callable[[DataFrame], DataFrame]
STAGES = ("light", "heavy")


@dataclass
class TransformRegistry:
    """Dataset name -> {stage -> transform}."""
    transforms: dict[str, dict[str, Transform]] = field(default_factory=dict)

    def register(self, dataset: str, light: Transform | None = None, heavy: Transform | None = None) -> None:
        entry = self.transforms.setdefault(dataset, {})
        if light is not None:
            entry["light"] = light
        if heavy is not None:
            entry["heavy"] = heavy

    def get(self, dataset: str, stage: str) -> Transform | None:
        if stage not in STAGES:
            raise ValueError(f"unknown stage {stage!r}")
        return self.transforms.get(dataset, {}).get(stage)

    def apply(self, df: DataFrame, dataset: str, stage: str, required: bool = False) -> DataFrame:
        fn = self.get(dataset, stage)
        if fn is None:
            if required:
                raise KeyError(f"no {stage} transform registered for dataset {dataset!r}")
            return df
        return df.transform(fn)


def record_function(fn: Callable[[pd.Series], pd.Series], return_type: DataType | str) -> Callable[..., Column]:
    """Wrap a vectorised per-record function (pandas Series in, Series out) as a column function."""
    return F.pandas_udf(fn, return_type)


def with_record_column(df: DataFrame, name: str, fn: Callable[..., Column], *inputs: str) -> DataFrame:
    """Add a column computed by a registered record function."""
    return df.withColumn(name, fn(*[F.col(c) for c in inputs]))
