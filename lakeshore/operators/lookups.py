"""Dimension lookups (J1-J3) and the size-checked broadcast they use.

Configuration tables (customer config, dataset registry) are small by nature,
but "small" is checked, not assumed: ``bounded_broadcast`` counts at most
``max_rows + 1`` rows of the dimension (a LIMIT job that stops early) and only
then hints a broadcast.  Beyond the bound the plain join is kept, so Spark
plans a shuffle join (and AQE may still switch to a broadcast once it has
measured the real size).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_MAX_BROADCAST_ROWS = 100_000


def has_at_most(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` has no more than ``max_rows`` rows (reads at most max_rows + 1)."""
    return df.limit(max_rows + 1).count() <= max_rows


def bounded_broadcast(df: DataFrame, max_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """``broadcast(df)`` when its row count is proven within ``max_rows``; ``df`` unchanged otherwise."""
    return F.broadcast(df) if has_at_most(df, max_rows) else df


def first_match(config: DataFrame, key_col: str) -> DataFrame:
    """One config row per key (the reference takes the first item of a query by key)."""
    return config.dropDuplicates([key_col])


def customer_config_lookup(objects: DataFrame, bucket_col: str, config: DataFrame,
                           max_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """Attach the customer config row whose ``hash_key`` is the object's bucket."""
    cfg = first_match(config, "hash_key")
    cfg = cfg.select(*[F.col(c).alias(f"cfg_{c}") for c in cfg.columns])
    return objects.join(bounded_broadcast(cfg, max_rows),
                        F.col(bucket_col) == F.col("cfg_hash_key"), "left").drop("cfg_hash_key")


def pipeline_lookup(objects: DataFrame, team: Column, dataset: Column, registry: DataFrame,
                    max_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """Pipeline of ``team-dataset``; when the key does not name a registered dataset,
    fall back to the team/dataset of the bucket's customer config (J1 columns ``cfg_team``,
    ``cfg_dataset`` must be present)."""
    reg = bounded_broadcast(first_match(registry, "name").select(
        F.col("name").alias("_reg_name"), F.col("pipeline").alias("_reg_pipeline")), max_rows)
    direct = objects.withColumn("_key_name", F.concat_ws("-", team, dataset)).join(
        reg, F.col("_key_name") == F.col("_reg_name"), "left")
    direct = direct.withColumn("_direct_hit", F.col("_reg_pipeline").isNotNull()).select(
        *objects.columns, F.col("_direct_hit"), F.col("_reg_pipeline").alias("_direct_pipeline"),
        team.alias("_key_team"), dataset.alias("_key_dataset"))
    reg2 = reg.select(F.col("_reg_name").alias("_fb_name"), F.col("_reg_pipeline").alias("_fb_pipeline"))
    fb = direct.join(reg2, F.concat_ws("-", F.col("cfg_team"), F.col("cfg_dataset")) == F.col("_fb_name"), "left")
    return fb.select(
        *objects.columns,
        F.when(F.col("_direct_hit"), F.col("_key_team")).otherwise(F.col("cfg_team")).alias("team"),
        F.when(F.col("_direct_hit"), F.col("_key_dataset")).otherwise(F.col("cfg_dataset")).alias("dataset"),
        F.when(F.col("_direct_hit"), F.col("_direct_pipeline")).otherwise(F.col("_fb_pipeline")).alias("pipeline"),
    )


def in_list(col: Column, values: Column) -> Column:
    """Membership of a value in a per-row list (e.g. the customer's out-of-box reports)."""
    return F.coalesce(F.array_contains(values, col), F.lit(False))
