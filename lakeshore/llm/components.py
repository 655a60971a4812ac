"""Connected components of an edge table by repeated joins; links never reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeshore.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for the nodes of undirected edges (a, b): comp is the smallest node in reach.

    Every round takes the smallest label among a node and its neighbours and then that label's own label
    (pointer jumping), so long chains shrink fast.  Both sides of a hot node's edges are aggregated on
    the map side.  Empty edges give an empty table.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
                   "component-edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                     .select("node", F.least("node", "m").alias("comp")), "component-labels")
    while True:
        of = labels.select(F.col("node").alias("b"), F.col("comp").alias("other"))
        near = both.join(of, "b").groupBy(F.col("a").alias("node")).agg(F.min("other").alias("other"))
        step = labels.join(near, "node").select("node", "comp", F.least("comp", "other").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("comp").alias("far"))
        step = step.join(jump, "low").select("node", F.least("low", "far").alias("comp"), (F.least("low", "far") != F.col("comp")).alias("moved"))
        step = written(step, "component-labels")
        labels = step.select("node", "comp")
        if step.filter("moved").isEmpty():
            return labels
