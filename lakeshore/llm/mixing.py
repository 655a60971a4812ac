"""Mixing sources to target weights by pivotal dependent rounding (operator 1; DataFrame functions only).

A source of size S with target T wants every document T/S times.  The whole part is given to each;
the fractional parts are copy probabilities that go through pivotal rounding weighted by size: two
fractional documents swap word mass until one is taken or left, in either direction with the odds
that keep both expectations.  Words are conserved by each swap, so only the very last document of a
source, decided by its own probability, leaves the target, by less than its size.

The swaps run in a reduction tree: documents fall into blocks of about ``fan_in`` by a hash, a fold
over each block leaves one fractional residual, residuals form the blocks of the next level.  A hot
source has more blocks, not larger ones; the depth is the logarithm of the largest source.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeshore.llm.common import uniform, word_count, written

FAN_IN = 64
#: probabilities this near to 0 or 1 are whole; only rounding errors of the target division get there
EPS = 1e-12


def target_sizes(sources: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5,
                 cap: float = 2.0) -> DataFrame:
    """Add ``target`` to one row per source (source, source_size).

    Sources in code-point order (null last) take the weights in turn and share ``share`` times all
    sizes.  No target passes ``cap`` times its source; the excess is shared again by weight until it
    fits.  In order of cap/weight the capped sources come first, and a source is capped exactly when
    the level left by those before it reaches its own cap, so running sums find the final level at once.
    The windows see one row per source, never documents.
    """
    place = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(place) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    w = sources.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(float(cap)))
    w = w.withColumn("budget", F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share)))
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    level = ((F.col("budget") - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
             / F.sum("weight").over(after))
    w = w.withColumn("capped", level >= F.col("limit") / F.col("weight"))
    free = Window.partitionBy()
    used = F.sum(F.when(F.col("capped"), F.col("limit")).otherwise(0.0)).over(free)
    left = F.sum(F.when(~F.col("capped"), F.col("weight")).otherwise(0.0)).over(free)
    w = w.withColumn("used", used).withColumn("left", left)
    target = F.when(F.col("capped"), F.col("limit")).otherwise(
        (F.col("budget") - F.col("used")) * F.col("weight") / F.col("left"))
    return w.select("source", "source_size", target.alias("target"))


def _fold(items, level: int, seed: int):
    """One pass of pivotal swaps over an array of (o, h, id, size, p); indexes of the taken, and the residual.

    The array is ordered by falling size: a large fraction that is carried on becomes whole on the way, so what is
    left at the end tends to be one of the smallest.
    """
    def swap(acc, i):
        e = F.element_at(items, i)
        x, a, p, b = acc["x"], acc["size"], e["p"], e["size"].cast("double")
        up, down = F.least((1 - x) * a, p * b), F.least(x * a, (1 - p) * b)
        gains = uniform(e["h"], F.lit(level), F.lit(seed), F.lit("swap")) * (up + down) < down
        # the side that becomes whole leaves; the other one is carried on
        carry_leaves = F.when(gains, (1 - x) * a <= p * b).otherwise(x * a <= (1 - p) * b)
        new_x, new_p = F.when(gains, x + up / a).otherwise(x - down / a), F.when(gains, p - up / b).otherwise(p + down / b)
        taken = F.when(carry_leaves & gains, F.array(acc["at"])).when(
            ~carry_leaves & ~gains, F.array(i)).otherwise(F.array().cast("array<int>"))
        clip = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
        return F.struct(F.when(carry_leaves, i).otherwise(acc["at"]).alias("at"),
                        F.when(carry_leaves, clip(new_p)).otherwise(clip(new_x)).alias("x"),
                        F.when(carry_leaves, b).otherwise(a).alias("size"),
                        F.concat(acc["taken"], taken).alias("taken"))

    first = F.element_at(items, 1)
    start = F.struct(F.lit(1).alias("at"), first["p"].alias("x"), first["size"].cast("double").alias("size"),
                     F.array().cast("array<int>").alias("taken"))
    rest = F.when(F.size(items) > 1, F.sequence(F.lit(2), F.size(items))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(rest, start, swap)


def round_fractions(units: DataFrame, largest: int, seed: int = 0, fan_in: int = FAN_IN) -> DataFrame:
    """Decide fractional units (source, id, size > 0, p in (0, 1), n: units of the source).

    Returns the taken ones as (source, id, size).  ``largest`` is the largest n; it sets the depth.
    """
    pool = units.select("source", "id", "size", "p", F.xxhash64(F.lit(seed), "id", "size").alias("h"),
                        F.ceil(F.col("n") / fan_in).cast("long").alias("blocks"))
    taken: list[DataFrame] = []
    depth = max(1, math.ceil(math.log(max(largest, 2)) / math.log(fan_in) - 1e-9))
    for level in range(depth):
        last = level == depth - 1
        block = F.lit(0).cast("long") if last else F.pmod(F.xxhash64("h", F.lit(level)), F.col("blocks"))
        folded = (pool.withColumn("block", block).groupBy("source", "block", "blocks")
                  .agg(F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("o"), "h", "id", "size", "p"))).alias("items"))
                  .withColumn("end", _fold(F.col("items"), level, seed)))
        # each level is small and read twice (its taken units, its residuals)
        folded = written(folded, f"pivotal-{level}")
        at, x = F.col("end.at"), F.col("end.x")
        ids = F.col("end.taken")
        if last:
            # the one residual of a source follows its own probability
            own = uniform(F.element_at("items", at)["h"], F.lit(seed), F.lit("last")) < x
            ids = F.concat(ids, F.when(own, F.array(at)).otherwise(F.array().cast("array<int>")))
        else:
            pool = folded.select("source", F.element_at("items", at).alias("r"), x.alias("p"), "blocks").select(
                "source", "r.id", "r.size", "p", "r.h", F.ceil(F.col("blocks") / fan_in).cast("long").alias("blocks"))
        taken.append(folded.select("source", "items", F.explode(ids).alias("i"))
                     .select("source", F.element_at("items", F.col("i")).alias("r"))
                     .select("source", "r.id", "r.size"))
    out = taken[0]
    for t in taken[1:]:
        out = out.unionByName(t)
    return out


def unit_copies(docs: DataFrame, id_col: str, source_col: str, size_col: str, targets=target_sizes,
                seed: int = 0, fan_in: int = FAN_IN) -> DataFrame:
    """One row per unit (id, source, size): ``rows`` it has, ``copies`` of them all, source_size, target."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                       F.coalesce(F.col(size_col), F.lit(0)).cast("long").alias("size"))
    units = written(rows.groupBy("id", "source", "size").agg(F.count(F.lit(1)).alias("rows")), "mix-units")
    sources = units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"),
                                          F.count(F.lit(1)).alias("n"))
    sources = written(sources, "mix-sources")
    goal = written(targets(sources.select("source", "source_size"))
                   .join(sources.select(F.col("source").alias("s"), "n"), F.col("source").eqNullSafe(F.col("s")))
                   .withColumn("s", F.col("source")).drop("source"), "mix-targets")
    largest = goal.agg(F.max("n")).first()[0] or 0

    per_row = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    want = (units.join(goal, F.col("source").eqNullSafe(F.col("s"))).drop("s")
            .withColumn("want", F.col("rows") * per_row)
            .withColumn("whole", F.floor(F.col("want") + EPS))
            .withColumn("p", F.greatest(F.col("want") - F.col("whole"), F.lit(0.0))))
    fractional = want.filter((F.col("p") > EPS) & (F.col("size") > 0))
    chosen = (round_fractions(fractional.select("source", "id", "size", "p", "n"), largest, seed, fan_in)
              .select(F.col("source").alias("ts"), F.col("id").alias("ti"), F.col("size").alias("tz"),
                      F.lit(1).alias("one")))
    decided = want.join(chosen, F.col("source").eqNullSafe(F.col("ts")) & F.col("id").eqNullSafe(F.col("ti"))
                        & (F.col("size") == F.col("tz")), "left")
    return decided.select("id", "source", "size", "rows", "source_size", "target",
                          (F.col("whole") + F.coalesce(F.col("one"), F.lit(0))).alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", size_col: str = "size",
        targets=target_sizes, seed: int = 0, fan_in: int = FAN_IN) -> DataFrame:
    """Copies of every document so that each source comes near its target.

    Returns one row per input row: ``id_col``, ``source``, ``size`` (long), ``source_size`` (long),
    ``target`` (double), ``copies`` (int).  ``targets`` maps (source, source_size) to rows with
    ``target``.

    Rows that agree in id, source and size are one unit of several rows: their copies are spread
    evenly over them and only the unit's fraction is rounded, so rows may repeat without bound.
    Sizes of null count as 0; a document of size 0 gets its whole part only and takes no words.  Null
    ids and null sources are ordinary values.  An empty table gives an empty result.  Other columns,
    whatever their names, are not read.
    """
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1))
    return (unit_copies(docs, id_col, source_col, size_col, targets, seed, fan_in).withColumn("k", k)
            .select(F.col("id").alias(id_col), "source", "size", "source_size", "target",
                    (F.floor(F.col("copies") / F.col("rows"))
                     + (F.col("k") < F.pmod("copies", "rows")).cast("long")).cast("int").alias("copies")))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
                    targets=target_sizes, seed: int = 0) -> DataFrame:
    """The mixture itself: every input row, with all its columns, as often as :func:`mix` gives it copies.

    Size is the number of words.  Of rows that agree in id, source and size the first by text get the
    copies that do not go round.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    row = docs.select(F.struct(*columns).alias("row"), F.col(id_col).alias("_id"), F.col(source_col).alias("_source"),
                      F.col(text_col).alias("_text"), word_count(F.col(text_col)).alias("_size"))
    units = unit_copies(row.select("_id", "_source", "_size"), "_id", "_source", "_size", targets, seed)
    units = written(units, "mix-copies")
    both = row.join(units, F.col("_id").eqNullSafe(F.col("id")) & F.col("_source").eqNullSafe(F.col("source"))
                    & (F.col("_size") == F.col("size")))
    each, over = F.floor(F.col("copies") / F.col("rows")), F.pmod("copies", "rows")
    single = both.filter(F.col("rows") == 1).select("row", F.col("copies").alias("times"))
    turn = F.row_number().over(Window.partitionBy("_id", "_source", "_size").orderBy("_text"))
    many = both.filter(F.col("rows") > 1).select("row", (each + (turn <= over).cast("long")).alias("times"))
    return (single.unionByName(many).filter(F.col("times") > 0)
            .select("row", F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int"))).alias("_copy")).select("row.*"))
