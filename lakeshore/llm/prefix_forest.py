"""Approximate nearest neighbours by a hash-prefix forest (operator 5).

A tree maps every vector to a string of locality-sensitive symbols (cross-polytope hashes: the axis on
which a random rotation of the vector is farthest out) and keeps the strings as a sorted array.  A query
descends in every tree to the range of its longest matching prefix; if all trees together give too few
candidates, all ascend by one symbol at the same time, until there are enough.  Candidates are scored
exactly, in double precision.

Rows are dealt by a hash into shards of about ``shard_rows``, each with a forest of its own, and the
queries visit them in blocks, so memory is bounded and no vector moves more than once for each block of
queries.  Equal vectors are one point that names its smallest ids: a vector in a third of all rows is
one point in one shard.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeshore.llm.common import written

TREES, SYMBOLS, AXES = 128, 5, 8
#: candidates asked for, as a share of a shard; measured on the test tables (README) for a recall of 0.9
SHARE = 0.3
SHARD_ROWS, QUERY_ROWS = 4_096, 4_096
#: approximate scores this close to the last one kept go on to exact scoring too
MARGIN = 1e-9
SEED = 20240229


def strings(x: np.ndarray, tree: int) -> np.ndarray:
    """Each row's symbols in one tree, packed into an int64 (the first symbol highest)."""
    rng = np.random.default_rng([SEED, tree, x.shape[1]])
    p = (x @ rng.standard_normal((x.shape[1], SYMBOLS * AXES))).reshape(len(x), SYMBOLS, AXES)
    axis = np.abs(p).argmax(2)
    side = np.take_along_axis(p, axis[:, :, None], 2)[:, :, 0] > 0
    symbol = axis * 2 + side
    return (symbol * (2 * AXES) ** np.arange(SYMBOLS - 1, -1, -1)).sum(1)


class Forest:
    """Sorted string arrays of all trees over unit vectors."""

    def __init__(self, x: np.ndarray, trees: int = TREES):
        self.x, self.order, self.keys = x, [], []
        for t in range(trees):
            s = strings(x, t)
            o = np.argsort(s, kind="stable")
            self.order.append(o)
            self.keys.append(s[o])

    def ranges(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[depth, tree, query] start and end of the rows that share the first SYMBOLS - depth symbols."""
        lo = np.empty((SYMBOLS + 1, len(self.keys), len(q)), dtype=np.int64)
        hi = np.empty_like(lo)
        for t, keys in enumerate(self.keys):
            s = strings(q, t)
            for up in range(SYMBOLS + 1):
                unit = (2 * AXES) ** up
                first = s // unit * unit
                lo[up, t] = np.searchsorted(keys, first, "left")
                hi[up, t] = np.searchsorted(keys, first + unit, "left")
        return lo, hi

    def candidates(self, q: np.ndarray, least: int):
        """For each query the rows in reach once all trees together offer ``least`` different ones."""
        lo, hi = self.ranges(q)
        least = min(least, len(self.x))
        enough = (hi - lo).sum(1) >= least  # the root offers every row in every tree
        up = np.argmax(enough, axis=0)
        for i in range(len(q)):
            for level in range(up[i], SYMBOLS + 1):
                seen = np.zeros(len(self.x), dtype=bool)
                for t, order in enumerate(self.order):
                    seen[order[lo[level, t, i]:hi[level, t, i]]] = True
                rows = np.flatnonzero(seen)
                if len(rows) >= least:
                    break
            yield rows


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; scaled by their largest component first, so that no square over- or underflows."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def cosine(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row by row in one order of summation, so that equal vectors have equal scores."""
    a, b = q / np.abs(q).max(), x / np.abs(x).max(1, keepdims=True)
    return (a * b).sum(1) / np.sqrt((a * a).sum() * (b * b).sum(1))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v (array<double>), dim of the vectors that take part; rows that repeat id and vector count once."""
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    v = v.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    v = v.filter(~F.exists("v", bad)).filter(F.exists("v", lambda x: x != 0.0))
    return v.select("id", "v", F.size("v").alias("dim")).distinct()


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id",
            vector_col: str = "embedding", trees: int = TREES, share: float = SHARE,
            shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k nearest found, ties to the smaller id.

    Vectors that are null, empty or zero, or hold null or non-finite components, take no part on either
    side, nor do null ids; vectors of another length than the query's are no candidates.  A query's own
    row is no candidate; equal vectors of other rows are.  With fewer than k candidates all are returned.
    Empty tables give an empty result.  Other columns are not read.
    """
    rows = usable(vectors, id_col, vector_col)
    # of equal vectors no answer needs more than the k + 1 smallest ids; the limit works on the map side too
    nth = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    points = (rows.withColumn("nth", nth).filter(F.col("nth") <= k + 1).groupBy("v", "dim")
              .agg(F.sort_array(F.collect_list("id")).alias("ids")))
    points = written(points, "forest-points")
    asked = written(usable(queries, id_col, vector_col), "forest-queries")
    shards = max(1, -(-points.count() // shard_rows))
    blocks = max(1, -(-asked.count() // query_rows))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = F.lit(None)
    index = points.select("dim", F.pmod(F.xxhash64("ids"), F.lit(shards)).cast("int").alias("shard"),
                          each(blocks).alias("block"), none.cast("long").alias("query_id"), "ids", "v")
    probe = asked.select("dim", each(shards).alias("shard"),
                         F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"),
                         F.col("id").alias("query_id"), none.cast("array<long>").alias("ids"), "v")

    def search(part: pd.DataFrame) -> pd.DataFrame:
        is_query = part["query_id"].notna().to_numpy()
        points_, queries_ = part[~is_query], part[is_query]
        out: list[tuple[int, float, list[int]]] = []
        if len(points_) and len(queries_):
            x, q = np.stack(points_["v"].to_numpy()), np.stack(queries_["v"].to_numpy())
            ids, qids = points_["ids"].tolist(), queries_["query_id"].astype("int64").tolist()
            forest = Forest(unit_rows(x), trees)
            unit = unit_rows(q)
            least = max(k + 1, int(share * len(x)))
            for i, rows_ in enumerate(forest.candidates(unit, least)):
                near = forest.x[rows_] @ unit[i]
                keep = min(len(rows_), k + 1)  # one may be the query's own
                if keep:
                    rows_ = rows_[near >= np.partition(near, len(near) - keep)[len(near) - keep] - MARGIN]
                best = [(-s, int(v)) for r, s in zip(rows_.tolist(), cosine(q[i], x[rows_]).tolist())
                        for v in ids[r] if v != qids[i]]
                out += [(qids[i], v, -s) for s, v in sorted(best)[:k]]  # ties to the smaller id
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype(
            {"query_id": "int64", "vec_id": "int64", "score": "float64"})

    found = (index.unionByName(probe).groupBy("dim", "shard", "block")
             .applyInPandas(search, "query_id long, vec_id long, score double"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return (found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
