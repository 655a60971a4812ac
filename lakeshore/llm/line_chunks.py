"""Line dedup over content-defined line chunks (operator 2; DataFrame functions only).

A text is cut into chunks of whole lines.  Where a chunk ends depends on the lines there alone: on a
rolling hash over the hashes of the last ``window`` lines, so an insertion moves only the boundaries
next to it.  A line of ``own_words`` words or more is a chunk by itself: a long paragraph is already a
passage, and would otherwise be hidden by a changed neighbour.

Chunks (128 bits of hash) that occur again anywhere are repeated; the first document by id keeps its
first occurrence.  Elsewhere a run of adjoining repeated chunks goes if it has ``min_words`` words
together; shorter ones stay, they are phrases rather than passages.

The first and last short lines of a passage share a chunk with whatever stands around them.  Passages
with short lines are therefore also found by their lines: by the shortest runs of lines of ``min_words``
words from each line on and up to each line.  A passage of ``min_words`` words that repeats line by line
is the union of such runs, and runs that meet an earlier place in one shift make one passage.

Before anything goes, the occurrences' bytes are compared; chunks and passages whose hashes meet but
whose bytes differ stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeshore.llm.common import WORD, let, written

WINDOW, DIVISOR, OWN_WORDS, MIN_WORDS = 2, 4, 12, 50
ADDED = ("n_lines", "lines_removed", "emptied")


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _ends(lines: Column, hashes: Column, words: Column, window: int, divisor: int, own_words: int) -> Column:
    """1-based numbers of the lines that end a chunk."""
    n = F.size(lines)
    long = lambda i: F.element_at(words, i) >= own_words
    rolled = lambda i: F.xxhash64(F.slice(hashes, F.greatest(i - (window - 1), F.lit(1)), F.least(i, F.lit(window))))
    return F.filter(F.sequence(F.lit(1), n), lambda i: F.when(i == n, F.lit(True)).otherwise(
        long(i) | long(i + 1) | (F.pmod(rolled(i), F.lit(divisor)) == 0)))


def chunks(docs: DataFrame, id_col: str, text_col: str, window: int = WINDOW, divisor: int = DIVISOR,
           own_words: int = OWN_WORDS) -> DataFrame:
    """One row per chunk: id, th (hash of the text), k, first and last line, h1, h2, words."""
    def parts(lines):
        facts = F.struct(F.transform(lines, lambda x: F.xxhash64(x)).alias("hashes"),
                         F.transform(lines, lambda x: F.regexp_count(x, F.lit(WORD))).alias("words"))
        return let(facts, lambda s: let(_ends(lines, s["hashes"], s["words"], window, divisor, own_words),
                                        lambda ends: F.transform(ends, lambda end, k: part(lines, s["words"], ends, end, k))))

    def part(lines, words, ends, end, k):
        start = F.when(k == 0, F.lit(1)).otherwise(F.element_at(ends, F.greatest(k, F.lit(1))) + 1)

        def facts(start):
            text = F.array_join(F.slice(lines, start, end - start + 1), "\n")
            count = F.aggregate(F.slice(words, start, end - start + 1), F.lit(0), lambda a, b: a + b)
            return let(text, lambda t: F.struct(
                start.alias("first"), end.alias("last"), F.xxhash64(t).alias("h1"),
                F.xxhash64(F.lit("second"), t).alias("h2"), count.alias("words")))
        return let(start, facts)

    d = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"),
                    let(_lines(F.col(text_col)), parts).alias("parts"))
    return (d.select("id", "th", F.posexplode("parts").alias("k", "p"))
            .select("id", "th", "k", "p.*"))


def _running(values: Column, block: int = 256) -> Column:
    """Sums up to each element, in blocks: a fold that grows an array copies it at every step."""
    def grow(start, xs):
        return F.aggregate(xs, F.array(start), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))

    def sums(blocks):
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda a, x: a + x))
        return let(grow(F.lit(0).cast("long"), totals), lambda before: F.flatten(F.transform(
            blocks, lambda b, k: F.slice(grow(F.element_at(before, k + 1), b), 2, block))))

    starts = F.sequence(F.lit(1), F.size(values), F.lit(block))
    return let(F.transform(starts, lambda i: F.slice(values, i, block)), sums)


def _below(sums: Column, bounds: Column) -> Column:
    """For each of the ascending bounds the number of ascending sums below it, by one sort of both."""
    both = F.array_sort(F.concat(F.transform(sums, lambda x: x * 2 + 1), F.transform(bounds, lambda x: x * 2)))
    return let(both, lambda s: F.transform(
        F.filter(F.sequence(F.lit(1), F.size(s)), lambda r: F.element_at(s, r) % 2 == 0), lambda r, t: r - t - 1))


def windows(docs: DataFrame, id_col: str, text_col: str, own_words: int = OWN_WORDS, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per shortest run of lines of ``min_words`` words that holds a short line: id, th, first, last, h1, h2.

    Runs of lines that are chunks by themselves need no row.
    """
    least = max(min_words, 1)

    def spans(words, sums):
        n, zero = F.size(words), F.array(F.lit(0).cast("long"))
        before = F.concat(zero, F.slice(sums, 1, F.size(sums) - 1))
        span = lambda a, b: F.struct(a.cast("int").alias("first"), b.cast("int").alias("last"))
        onward = F.transform(_below(sums, F.transform(before, lambda x: x + least)), lambda c, i: span(i + 1, c + 1))
        upto = F.transform(_below(before, F.transform(sums, lambda x: x - least + 1)), lambda c, j: span(c, j + 1))
        onward = F.filter(onward, lambda s: (s["last"] <= n) & (F.element_at(words, s["first"]) > 0))
        upto = F.filter(upto, lambda s: (s["first"] > 0) & (F.element_at(words, s["last"]) > 0))
        # as numbers, which Spark tells apart by a hash set
        codes = F.transform(F.concat(onward, upto), lambda s: s["first"].cast("long") * (1 << 32) + s["last"])
        found = F.transform(F.array_distinct(codes), lambda c: span(F.shiftright(c, 32), c % (1 << 32)))
        return F.filter(found, lambda s: F.exists(F.slice(words, s["first"], s["last"] - s["first"] + 1),
                                                  lambda w: (w > 0) & (w < own_words)))

    def runs(s):
        def run(p):
            return let(F.slice(s["hashes"], p["first"], p["last"] - p["first"] + 1), lambda h: F.struct(
                p["first"].alias("first"), p["last"].alias("last"), F.xxhash64(h).alias("h1"),
                F.xxhash64(F.lit("second"), h).alias("h2")))
        return F.transform(let(_running(F.transform(s["words"], lambda w: w.cast("long"))),
                               lambda sums: spans(s["words"], sums)), run)

    facts = let(_lines(F.col(text_col)), lambda lines: F.struct(
        F.transform(lines, lambda x: F.xxhash64(x)).alias("hashes"),
        F.transform(lines, lambda x: F.regexp_count(x, F.lit(WORD))).alias("words")))
    return (docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.explode(let(facts, runs)).alias("p"))
            .select("id", "th", "p.*"))


def repeated_passages(runs: DataFrame) -> DataFrame:
    """Marks (id, th, first, last, h1, h2, goes) of passages that an earlier document or place has line by line.

    h1 and h2 name the earlier place; the earlier text gets a mark there that does not go, for the
    comparison of bytes.  A repetition that overlaps the first occurrence in its own text stays.
    """
    seen = (runs.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("kid"))
            .filter(F.col("n") > 1).select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), "kid"))
    occ = written(runs.join(seen, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))).drop("g1", "g2")
                  .dropDuplicates(["id", "th", "first", "last"]), "line-windows-repeated")
    kept = F.col("id").eqNullSafe(F.col("kid"))
    place = (occ.filter(kept).groupBy("h1", "h2").agg(F.min(F.struct("th", "first")).alias("at"))
             .select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), "at"))
    occ = occ.join(place, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")))
    own = F.min("first").over(Window.partitionBy("id", "th", "h1", "h2"))
    occ = (occ.withColumn("own", own).filter(~kept | (F.col("first") > F.col("own") + F.col("last") - F.col("first")))
           .withColumn("kth", F.when(kept, F.col("th")).otherwise(F.col("at.th")))
           .withColumn("shift", F.col("first") - F.when(kept, F.col("own")).otherwise(F.col("at.first"))))
    order = Window.partitionBy("id", "th", "kid", "kth", "shift").orderBy("first", "last")
    reached = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    occ = occ.withColumn("new", F.when(F.col("first") > F.coalesce(reached, F.lit(-1)) + 1, 1).otherwise(0))
    occ = occ.withColumn("passage", F.sum("new").over(order))
    found = (occ.groupBy("id", "th", "kid", "kth", "shift", "passage")
             .agg(F.min("first").alias("first"), F.max("last").alias("last"))
             .withColumn("kfirst", F.col("first") - F.col("shift")).withColumn("klast", F.col("last") - F.col("shift")))
    at = ("kid", "kth", "kfirst", "klast")
    found = written(found.withColumn("h1", F.xxhash64(*at)).withColumn("h2", F.xxhash64(F.lit("second"), *at)), "line-passages")
    first = found.select(F.col("kid").alias("id"), F.col("kth").alias("th"), F.col("kfirst").alias("first"),
                         F.col("klast").alias("last"), "h1", "h2").distinct()
    return (found.select("id", "th", "first", "last", "h1", "h2", F.lit(True).alias("goes"))
            .union(first.withColumn("goes", F.lit(False))))


def repeated_runs(parts: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Marks (id, th, first, last, h1, h2, goes) of repeated chunks.

    ``goes``: not the kept occurrence, and in a run of adjoining such chunks of ``min_words`` words.
    """
    # counts and the keeper are combined on the map side, so a chunk in a third of all texts is one row a task
    seen = (parts.groupBy("h1", "h2")
            .agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("keeper"))
            .filter(F.col("n") > 1).select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), "keeper"))
    occ = (parts.join(seen, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))).drop("g1", "g2")
           .dropDuplicates(["id", "th", "k"]))  # rows that repeat id and text have the same chunks
    nth = F.row_number().over(Window.partitionBy("id", "th", "h1", "h2").orderBy("k"))
    occ = occ.withColumn("dup", ~(F.col("id").eqNullSafe(F.col("keeper")) & (nth == 1)))
    order = Window.partitionBy("id", "th", "dup").orderBy("k")
    occ = occ.withColumn("run", F.col("k") - F.row_number().over(order))
    in_run = F.sum("words").over(Window.partitionBy("id", "th", "dup", "run"))
    occ = occ.withColumn("goes", F.col("dup") & (in_run >= min_words))
    return occ.select("id", "th", "first", "last", "h1", "h2", "goes")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                divisor: int = DIVISOR, own_words: int = OWN_WORDS, min_words: int = MIN_WORDS) -> DataFrame:
    """All rows and columns of ``docs`` with ``text_col`` less its repeated passages.

    Three columns are added: n_lines, lines_removed (long), emptied (all that the text had went).
    Rows that share an id count as one document, which keeps its own first occurrences; rows of null
    id count as one document too, last in order.  Null texts stay null and empty texts empty, as one
    line without words.  Rows that repeat id and text get the same result.  An empty table stays
    empty.  Columns of any other name are carried along; one named like an added column is replaced.
    """
    parts = written(chunks(docs, id_col, text_col, window, divisor, own_words), "line-chunks")  # read twice, without texts
    runs = written(windows(docs, id_col, text_col, own_words, min_words), "line-windows")
    found = repeated_runs(parts, min_words).union(repeated_passages(runs))
    marks = written(found.groupBy("id", "th").agg(F.collect_list(F.struct("first", "last", "h1", "h2", "goes")).alias("marks")),
                    "line-marks").select(
        F.col("id").alias("mark_id"), F.col("th").alias("mark_th"), "marks")
    columns = [c for c in docs.columns if c not in ADDED]
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(id_col).alias("id"),
                      F.xxhash64(text_col).alias("th"))
    # the one shuffle of whole texts; both readers below share what it wrote, packed tighter than by
    # default: the table and the files of that shuffle are on disk together
    marked = written(row.join(marks, F.col("id").eqNullSafe(F.col("mark_id")) & (F.col("th") == F.col("mark_th")), "left")
                     .select("row", "marks"), "line-marked", "zstd")
    text = F.col("row").getField(text_col)

    cut = let(_lines(text), lambda lines: F.transform("marks", lambda m: F.struct(
        m["h1"].alias("h1"), m["h2"].alias("h2"),
        F.array_join(F.slice(lines, m["first"], m["last"] - m["first"] + 1), "\n").alias("bytes"))))
    differ = (marked.filter(F.col("marks").isNotNull()).select(F.explode(cut).alias("m")).select("m.*")
              .groupBy("h1", "h2").agg(F.min("bytes").alias("low"), F.max("bytes").alias("high"))
              .filter(F.col("low") != F.col("high")).select("h1", "h2"))
    differ = written(differ, "line-clashes")
    # 128-bit hashes of different bytes are not expected to meet in any corpus; if they do, those chunks stay
    clash = [(r.h1, r.h2) for r in differ.collect()]
    goes = lambda m: m["goes"]
    if clash:
        pairs = F.array(*[F.struct(F.lit(a), F.lit(b)) for a, b in clash])
        goes = lambda m: m["goes"] & ~F.array_contains(pairs, F.struct(m["h1"], m["h2"]))

    gone = F.array_distinct(F.flatten(F.transform(
        F.filter(F.coalesce("marks", F.array().cast(marked.schema["marks"].dataType)), goes),
        lambda m: F.sequence(m["first"], m["last"]))))
    none = F.array().cast("array<int>")
    rest = let(F.struct(_lines(text).alias("lines"), gone.alias("gone")), lambda s: F.struct(
        F.size(s["lines"]).cast("long").alias("n"), F.size(s["gone"]).cast("long").alias("gone"),
        F.when(F.size(s["gone"]) > 0, F.array_join(F.transform(
            F.array_except(F.sequence(F.lit(1), F.size(s["lines"])), F.coalesce(s["gone"], none)),
            lambda i: F.element_at(s["lines"], i)), "\n")).otherwise(text).alias("kept")))
    # materialised as one struct, so that its fields do not compute it again
    out = marked.select("row", F.explode(F.array(rest)).alias("new"))
    return out.select(
        *[F.col("new.kept").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in columns],
        F.col("new.n").alias("n_lines"), F.col("new.gone").alias("lines_removed"),
        ((F.col("new.gone") > 0) & ~F.coalesce(F.col("new.kept").rlike(WORD), F.lit(False))).alias("emptied"))
