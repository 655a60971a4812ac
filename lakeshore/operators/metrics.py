"""Hierarchical metric counters and threshold alerts.

A metric update ``A#B#C`` on day ``d`` adds its value to every prefix (A, A#B,
A#B#C) and, for each prefix, to four period keys: the prefix itself (ROOT),
``.Y<year>``, ``.M<year-month>`` and ``.D<date>``.  Counters are an aggregate
over the exploded updates: value = sum, version = number of updates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeshore.functions.dates import threshold_met
from lakeshore.operators.lookups import bounded_broadcast
from lakeshore.operators.sequence import keyed_running
from lakeshore.session import materialize as written_table

# Metric separator, period types and their key suffixes.
SEPARATOR = "#"
ROOT, YEARLY, MONTHLY, DAILY = "ROOT", "YEARLY", "MONTHLY", "DAILY"
ALWAYS, ONCE = "ALWAYS", "ONCE"


def metric_prefixes(code: Column) -> Column:
    """``A#B#C`` -> [A, A#B, A#B#C]; a repeated part is an error."""
    parts = F.split(code, SEPARATOR)
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)),
                           lambda i: F.array_join(F.slice(parts, 1, i), SEPARATOR))
    return F.when(F.size(F.array_distinct(parts)) == F.size(parts), prefixes).otherwise(
        F.raise_error(F.concat(F.lit("a metric code names a part twice: "), code)).cast("array<string>"))


def metric_periods(root: Column, date_text: Column) -> Column:
    """The four (root, metric, type) keys of one prefix on one ``YYYY-MM-DD`` date."""
    def key(suffix: Column | None, kind: str) -> Column:
        metric = root if suffix is None else F.concat(root, suffix)
        return F.struct(root.alias("root"), metric.alias("metric"), F.lit(kind).alias("type"))
    return F.array(
        key(None, ROOT),
        key(F.concat(F.lit(".Y"), F.substring(date_text, 1, 4)), YEARLY),
        key(F.concat(F.lit(".M"), F.substring(date_text, 1, 7)), MONTHLY),
        key(F.concat(F.lit(".D"), date_text), DAILY),
    )


def explode_metric_keys(updates: DataFrame, code_col: str = "code", date_col: str = "date") -> DataFrame:
    """Every update row once per (prefix x period) key; zero-valued updates are skipped."""
    return (updates.where(F.col("value") != 0)
            .withColumn("_prefix", F.explode(metric_prefixes(F.col(code_col))))
            .withColumn("_key", F.explode(metric_periods(F.col("_prefix"), F.col(date_col))))
            .select("*", "_key.root", "_key.metric", "_key.type")
            .drop("_prefix", "_key"))


def rollup_metrics(updates: DataFrame, code_col: str = "code", date_col: str = "date",
                   run_col: str = "run_id", order_col: str = "seq") -> DataFrame:
    """A4: counters per (root, metric, type) with value, version and the last run id.

    ``updates`` has the metric code, a ``YYYY-MM-DD`` date, an integer ``value``,
    the run that produced it and a total ``order_col`` for "last".
    """
    keys = explode_metric_keys(updates, code_col, date_col)
    # fixed-width aggregation buffers only (the date as DATE, not text): a hash aggregate with
    # partial aggregation before the shuffle, no sort
    return keys.groupBy("root", "metric", "type").agg(
        F.sum("value").alias("value"),
        F.count(F.lit(1)).alias("version"),
        F.max(F.to_date(date_col)).alias("_last_date"),
        F.max_by(F.col(run_col), F.col(order_col)).alias("last_pipeline_execution_id"),
    ).select("root", "metric", "type", "value", "version",
             F.date_format("_last_date", "yyyy-MM-dd").alias("last_updated_date"), "last_pipeline_execution_id")


def watched_keys(keys: DataFrame, rules: DataFrame) -> DataFrame:
    """The exploded update keys that some rule watches, so that no other key is windowed.

    All updates of a counter share its root and type, so a watched counter keeps all of them.
    """
    watched = rules.select(F.col("metric").alias("_watch"), F.col("metric_type").alias("_watch_type")).distinct()
    return keys.join(watched, (F.col("root") == F.col("_watch")) & (F.col("type") == F.col("_watch_type")), "left_semi")


def metric_alerts(updates: DataFrame, rules: DataFrame, bucket: Column, code_col: str = "code",
                  date_col: str = "date", order: Sequence[str] = ("seq",), max_rules: int = 10_000,
                  materialize: bool = True) -> DataFrame:
    """Alerts emitted by threshold rules as counters grow.

    The counter value after each update is a running sum per metric key
    (skew-safe, see ``keyed_running``).  ``rules`` = (metric, metric_type,
    evaluation, threshold, notify).  A rule applies to keys whose root equals
    its metric and whose type equals its type.  ALWAYS emits on every update
    that meets the threshold; ONCE only on the first one (real first-crossing
    semantics, Q8).  The rules table is broadcast only after its row count is
    proven to be at most ``max_rules``.
    """
    keys = watched_keys(explode_metric_keys(updates, code_col, date_col).withColumn("_b", bucket), rules)
    running = keyed_running(keys, ["root", "metric"], list(order), F.col("_b"),
                            sums={"running_value": F.col("value")})
    r = rules.select(F.col("metric").alias("_rule_metric"), F.col("metric_type").alias("_rule_type"),
                     "evaluation", "threshold", "notify")
    matched = running.join(bounded_broadcast(r, max_rules),
                           (F.col("root") == F.col("_rule_metric")) & (F.col("type") == F.col("_rule_type")))
    hits = matched.where(threshold_met(F.col("running_value"), F.col("evaluation"), F.col("threshold")))
    if materialize:
        # both alert kinds read the threshold hits: compute them once (shared checkpoint folder)
        hits = written_table(hits, "alert-hits")
    last = order[-1]
    cols = ["root", "metric", "type", "threshold", "evaluation", "notify",
            F.col("running_value").alias("value"), last]
    always = hits.where(F.col("notify") == ALWAYS).select(*cols)
    once = (hits.where(F.col("notify") == ONCE)
            .groupBy("root", "metric", "type", "threshold", "evaluation", "notify")
            .agg(F.min_by(F.struct(F.col("running_value").alias("value"), F.col(last).alias(last)),
                          F.struct(*[F.col(c) for c in order])).alias("_first"))
            .select("root", "metric", "type", "threshold", "evaluation", "notify", "_first.*"))
    return always.unionByName(once)
