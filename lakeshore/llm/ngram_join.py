"""N-gram Jaccard join with a count-vector R-tree (operator 7).

A document is the set of its 5-word shingles.  Two link when the Jaccard similarity of their sets is 0.8
or more; the result is every document's component.  No link between different texts is lost:

1. Equal texts become one.  Its shingles are put in one global order, rare ones first (a count sketch
   over all documents gives the order; any order is right, this one keeps buckets small).  Two sets that
   link share a shingle among the first 20 % + 1 of each, so they meet in such a shingle's bucket.
2. A bucket's most typical document is compared with the others, and links give first components.
3. Within each bucket only documents of different components are left to compare.  Shingles are hashed
   into groups, a document's group counts are a point, and an R-tree over a bucket's points is searched
   from each of them: the overlap with a point, or with anything in a box, is at most the sum of the
   coordinates' minima (of the box's upper corner).  What passes is verified on the sets themselves.

A single R-tree over all points cannot prune: shingles hash evenly, so points of one length lie within
the search radius of each other in every coordinate, and only the sum tells them apart.  Hence the
buckets; the tree works inside them and buckets of many rows are searched in pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeshore.llm.common import text_batches, written
from lakeshore.llm.components import components

WIDTH, PERCENT = 5, 80
#: groups of shingles; the tree's boxes use the sums of FOLD neighbouring groups
GROUPS, FOLD = 512, 8
SKETCH_BITS, SKETCH_BLOCK = 20, 1 << 16
#: rows of a bucket that one search holds; leaf size and fan-out of the tree
PIECE, LEAF, FAN = 4_096, 16, 16

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MULTIPLIER = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_MULTIPLIER), -1, 1 << 64))
_TURNS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63],
                  dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class _Powers:
    """Powers of the multiplier and of its inverse modulo 2 ** 64, as far as the longest text so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def to(self, n: int):
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            f = np.full(size, _MULTIPLIER, dtype=np.uint64)
            g = np.full(size, _INVERSE, dtype=np.uint64)
            f[0] = g[0] = 1
            self.up, self.down = np.multiply.accumulate(f), np.multiply.accumulate(g)
        return self.up[:n], self.down


def word_hashes(text: bytes, powers: _Powers) -> np.ndarray:
    """A 64-bit hash of every word of the lower-cased text, by differences of one running sum."""
    data = np.frombuffer(text.lower(), dtype=np.uint8)
    if not len(data):
        return np.zeros(0, dtype=np.uint64)
    inside = ~_SPACE[data]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    up, down = powers.to(len(data))
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
    return _mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _TURNS[0])


def shingles(words: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles; fewer words are one shingle, none are none."""
    n = len(words)
    if n >= WIDTH:
        s = np.zeros(n - WIDTH + 1, dtype=np.uint64)
        for k in range(WIDTH):
            s += words[k:n - WIDTH + 1 + k] * _TURNS[k]
        return np.unique(_mix(s))
    if n:
        return _mix((words * _TURNS[:n]).sum(keepdims=True) + np.uint64(n))
    return np.zeros(0, dtype=np.uint64)


def prefix_length(n: int) -> int:
    return n - -(-PERCENT * n // 100) + 1 if n else 0


def count_sketch(docs: DataFrame) -> np.ndarray:
    """About how many documents have a shingle, by the low bits of its hash; its size is fixed."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, cells = _Powers(), np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
        with np.errstate(over="ignore"):
            for b in batches:
                found = [shingles(word_hashes(t, powers)) for t in b.column(0).to_pylist() if t]
                if found:
                    low = np.concatenate(found) & np.uint64((1 << SKETCH_BITS) - 1)
                    cells += np.bincount(low.astype(np.int64), minlength=1 << SKETCH_BITS).astype(np.uint32)
        at = list(range((1 << SKETCH_BITS) // SKETCH_BLOCK))
        yield pa.RecordBatch.from_arrays(
            [pa.array(at, pa.int32()), pa.array([cells[i * SKETCH_BLOCK:(i + 1) * SKETCH_BLOCK].tobytes() for i in at], pa.binary())],
            names=["block", "cells"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for block, cells in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = np.frombuffer(cells, dtype=np.uint32)
                sums[block] = sums[block] + x if block in sums else x.astype(np.uint64)
                sums[block] = np.minimum(sums[block], 0xFFFFFFFF).astype(np.uint64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([x.astype(np.uint32).tobytes() for x in sums.values()], pa.binary())],
            names=["block", "cells"])

    schema = "block int, cells binary"
    parts = docs.select("text").mapInArrow(count, schema).repartition("block").mapInArrow(add, schema).collect()
    out = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
    for r in parts:
        out[r["block"] * SKETCH_BLOCK:(r["block"] + 1) * SKETCH_BLOCK] = np.frombuffer(r["cells"], dtype=np.uint32)
    return out


def points(docs: DataFrame) -> DataFrame:
    """Of every document (doc_id, text): n, h1, h2 (the word sequence's hash), typical, prefix, scale, counts.

    ``counts`` has a byte a group; the group's count is at most that times ``scale``.
    """
    spark = docs.sparkSession
    sketch = spark.sparkContext.broadcast(count_sketch(docs))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, seen = _Powers(), sketch.value
        with np.errstate(over="ignore"):
            for b in batches:
                out = []
                for t in b.column(1).to_pylist():
                    words = word_hashes(t, powers) if t else np.zeros(0, dtype=np.uint64)
                    s = shingles(words)
                    h = xxhash.xxh3_128_intdigest(words.tobytes())
                    df = seen[(s & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)]
                    first = s[np.lexsort((s, df))[:prefix_length(len(s))]]
                    counts = np.bincount((s >> np.uint64(55)).astype(np.int64), minlength=GROUPS)
                    scale = max(1, -(-int(counts.max()) // 255)) if len(s) else 1
                    out.append((len(s), np.int64(np.uint64(h >> 64).view(np.int64)), np.uint64(h & (2**64 - 1)).view(np.int64),
                                float(np.log1p(df).mean()) if len(s) else 0.0, first.view(np.int64), scale,
                                (-(-counts // scale)).astype(np.uint8).tobytes()))
                cols = list(zip(*out)) or [[]] * 7
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()),
                     pa.array(cols[3], pa.float64()), pa.array(list(cols[4]), pa.list_(pa.int64())), pa.array(cols[5], pa.int32()),
                     pa.array(cols[6], pa.binary())],
                    names=["doc_id", "n", "h1", "h2", "typical", "prefix", "scale", "counts"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        place, f"doc_id {kind}, n long, h1 long, h2 long, typical double, prefix array<long>, scale int, counts binary")


def needed(n1, n2):
    """Least overlap of two sets of these sizes that link: 100 * i >= 80 * (n1 + n2 - i)."""
    return -(-PERCENT * (n1 + n2) // (100 + PERCENT))


def fold(counts: np.ndarray) -> np.ndarray:
    return counts.reshape(len(counts), -1, FOLD).sum(2, dtype=np.int32)


class CountTree:
    """A packed R-tree over count vectors; only the upper corners and the sizes' bounds matter here.

    Boxes and the first look at a point use folded groups (sums of neighbours): their minima bound the
    overlap too, at an eighth of the work.
    """

    def __init__(self, counts: np.ndarray, sizes: np.ndarray):
        rough = fold(counts)
        wide = int(np.argmax(rough.var(0))) if len(counts) > 1 else 0
        self.order = np.lexsort((rough[:, wide], sizes))
        self.counts, self.rough, self.sizes = counts[self.order], rough[self.order], sizes[self.order]
        self.levels = []
        high, low_n, high_n, step = self.rough, self.sizes, self.sizes, LEAF
        while len(high) > 1:
            cut = np.arange(0, len(high), step)
            high = np.maximum.reduceat(high, cut, axis=0)
            low_n, high_n = np.minimum.reduceat(low_n, cut), np.maximum.reduceat(high_n, cut)
            self.levels.append((step, high, low_n, high_n))
            step = FAN

    def search(self, q: np.ndarray, n: int) -> np.ndarray:
        """Positions (as given) of the points whose overlap bound allows a link with (q, n)."""
        nodes, rough = None, fold(q[None, :])[0]
        for k in range(len(self.levels) - 1, -1, -1):
            step, high, low_n, high_n = self.levels[k]
            if nodes is None:
                nodes = np.arange(len(high))
            ok = (100 * low_n[nodes] <= 100 * 100 * n // PERCENT) & (100 * high_n[nodes] >= PERCENT * n)
            nodes = nodes[ok]
            ok = np.minimum(high[nodes], rough).sum(1) >= needed(n, low_n[nodes])
            nodes = nodes[ok]
            below = len(self.counts) if k == 0 else len(self.levels[k - 1][1])
            nodes = (nodes[:, None] * step + np.arange(step)).ravel()
            nodes = nodes[nodes < below]
        if nodes is None:
            nodes = np.arange(len(self.counts))
        for points_, query in ((self.rough, rough), (self.counts, q)):
            ok = np.minimum(points_[nodes], query).sum(1, dtype=np.int64) >= needed(n, self.sizes[nodes])
            nodes = nodes[ok]
        return self.order[nodes]


def bucket_pairs(row: np.ndarray, n: np.ndarray, comp: np.ndarray, side: np.ndarray, counts: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of a bucket (piece) in different components whose bound allows a link, smaller row first.

    ``side`` 0 and 1 are two pieces to compare with each other; 2 is one piece to compare with itself.
    """
    out = []
    if len(row) <= 2 * LEAF:
        i, j = np.triu_indices(len(row), 1)
        ok = (comp[i] != comp[j]) & ((side[i] == 2) | (side[i] != side[j]))
        i, j = i[ok], j[ok]
        ok = np.minimum(counts[i], counts[j]).sum(1, dtype=np.int64) >= needed(n[i], n[j])
        return [(min(a, b), max(a, b)) for a, b in zip(row[i[ok]].tolist(), row[j[ok]].tolist())]
    tree = CountTree(counts, n)
    for i in range(len(row)):
        if side[i] == 1:
            continue  # its partners on the other side find it
        j = tree.search(counts[i], int(n[i]))
        j = j[(comp[j] != comp[i]) & ((side[j] == 1) if side[i] == 0 else (j > i))]
        a = int(row[i])
        out += [(min(a, b), max(a, b)) for b in row[j].tolist()]
    return out


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, p, q, row, n, comp, side, scale, counts) sorted by bucket, p, q."""
    held: list[tuple] = []
    found: set[tuple[int, int]] = set()

    def solve():
        row, n, comp, side, scale, counts = zip(*[h[1:] for h in held])
        if len(row) > 1 and len(set(comp)) > 1:
            c = np.frombuffer(b"".join(counts), dtype=np.uint8).reshape(len(row), GROUPS)
            if max(scale) > 1:
                c = c.astype(np.int32) * np.array(scale, dtype=np.int32)[:, None]
            found.update(bucket_pairs(np.array(row), np.array(n), np.array(comp), np.array(side), c))

    def sent():
        pairs = sorted(found)
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())],
                                          names=["a", "b"])

    for b in batches:
        cols = [c.to_pylist() for c in b.columns]
        for s, p, q, *rest in zip(*cols):
            if held and held[0][0] != (s, p, q):
                solve()
                held = []
                if len(found) >= 50_000:
                    yield sent()
            held.append(((s, p, q), *rest))
    if held:
        solve()
    yield sent()


def shingle_sets(docs: DataFrame) -> DataFrame:
    """doc_id, h1, h2, shingles (their hashes) of every document (doc_id, text)."""
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers()
        with np.errstate(over="ignore"):
            for b in batches:
                h1, h2, out = [], [], []
                for t in b.column(1).to_pylist():
                    words = word_hashes(t, powers) if t else np.zeros(0, dtype=np.uint64)
                    h = xxhash.xxh3_128_intdigest(words.tobytes())
                    h1.append(np.uint64(h >> 64).view(np.int64))
                    h2.append(np.uint64(h & (2**64 - 1)).view(np.int64))
                    out.append(shingles(words).view(np.int64))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()),
                                                  pa.array(out, pa.list_(pa.int64()))], names=["doc_id", "h1", "h2", "shingles"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(sets, f"doc_id {kind}, h1 long, h2 long, shingles array<long>")


def probably_among(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose doc_id is in ``ids`` (i), and a few others: a bitmap of the ids' hashes decides.

    So no text is shuffled to find a small part of the documents.  The bitmap has 32 bits an id and 8 MB
    at most; a full one lets more documents pass, and the join that follows drops them.
    """
    bits = 1 << min(26, max(16, (32 * ids.count()).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    at = place("i") + 1
    parts = (ids.select(F.bitmap_bucket_number(at).alias("part"), F.bitmap_bit_position(at).alias("bit"))
             .groupBy("part").agg(F.bitmap_construct_agg("bit").alias("map")).collect())
    bitmap = np.zeros(-(-bits // 8), dtype=np.uint8)
    for r in parts:
        piece = np.frombuffer(bytes(r["map"]), dtype=np.uint8)
        start = (r["part"] - 1) * len(piece)
        bitmap[start:start + len(piece)] = piece[:len(bitmap) - start]
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    @F.pandas_udf("boolean")
    def has(p: pd.Series) -> pd.Series:
        p = p.to_numpy()
        return pd.Series((shared.value[p >> 3] >> (p & 7)) & 1 == 1)

    return docs.filter(has(place("doc_id")))


def links(pairs: DataFrame, reps: DataFrame, docs: DataFrame, name: str) -> DataFrame:
    """The pairs (a, b) of rows whose sets link, verified on the whole sets."""
    rows = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).distinct()
    asked = written(rows.join(reps.select("rep", "h1", "h2", "d0"), "rep"), f"{name}-asked")
    # the smallest id of each text finds its document again; its hash then picks the text.  A row that
    # repeats id and text only repeats links.
    found = shingle_sets(probably_among(docs, asked.select(F.col("d0").alias("i")).distinct()))
    asked = asked.select("rep", "d0", F.col("h1").alias("a1"), F.col("h2").alias("a2"))
    sets = written(found.join(asked, (F.col("h1") == F.col("a1")) & (F.col("h2") == F.col("a2"))
                              & F.col("doc_id").eqNullSafe(F.col("d0"))).select("rep", "shingles"), f"{name}-sets")
    one = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(one, "a").join(two, "b")
    same = F.size(F.array_intersect("x", "y"))
    return written(both.select("a", "b", F.size("x").alias("nx"), F.size("y").alias("ny"), same.alias("i"))
                   .filter(100 * F.col("i") >= PERCENT * (F.col("nx") + F.col("ny") - F.col("i"))).select("a", "b"), f"{name}-links")


def fitting(n1: str, n2: str):
    return 100 * F.least(n1, n2) >= PERCENT * F.greatest(n1, n2)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row.

    component_id is the smallest doc_id in reach by links, the row's own included.  Equal texts link
    (rows that repeat too); null texts and texts without words have no shingles and link with nothing.
    Rows that share an id may be in different components.  Null ids rank after all others: a
    component of null ids only has the null id.  An empty table gives an empty result.  Other columns
    are not read.
    """
    text_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    # the row number is fixed by writing it
    rows = written(points(docs).withColumn("row", F.monotonically_increasing_id()), "ngram-points")
    reps = written(rows.filter("n > 0").groupBy("h1", "h2")
                   .agg(F.min("row").alias("rep"), F.min("doc_id").alias("d0"), F.first("n").alias("n"),
                        F.count(F.lit(1)).alias("rows")), "ngram-texts")
    # one row per text goes on: the other rows of texts that repeat leave
    again = written(rows.select("h1", "h2", "row").join(reps.filter("rows > 1").select("h1", "h2", "rep"), ["h1", "h2"])
                    .filter("row != rep").select("row"), "ngram-copies")
    texts = rows.filter("n > 0").join(again, "row", "left_anti")

    members = texts.select("row", F.explode("prefix").alias("bucket"))
    shared = (members.groupBy("bucket")
              .agg(F.count(F.lit(1)).alias("k"), F.bit_xor(F.xxhash64("row")).alias("x"),
                   F.bit_xor(F.xxhash64(F.lit(1), "row")).alias("y")).filter("k > 1"))
    # near copies share many buckets of the same members: one of them is enough
    shared = shared.groupBy("k", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", "k")
    members = members.join(shared, "bucket")
    facts = rows.select("row", "n", "typical")
    members = written(members.join(facts, "row"), "ngram-members")
    vectors = rows.select("row", "scale", "counts")

    hub = members.groupBy("bucket").agg(F.max(F.struct("typical", "row", "n")).alias("hub"))
    star = (members.join(hub, "bucket").filter((F.col("row") != F.col("hub.row")))
            .select(F.least("row", "hub.row").alias("a"), F.greatest("row", "hub.row").alias("b"), "n", F.col("hub.n").alias("m"))
            .filter(fitting("n", "m")).select("a", "b").distinct())
    star = written(bounded(star, rows), "ngram-star")
    first = links(star, reps, docs, "ngram-first")
    comps = components(first)

    labelled = (members.filter("k > 2").join(comps.select(F.col("node").alias("row"), "comp"), "row", "left")
                .withColumn("comp", F.coalesce("comp", "row")))
    labelled = written(labelled, "ngram-labelled")
    mixed = (labelled.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
             .filter("low != high").select("bucket"))
    open_ = labelled.join(mixed, "bucket", "left_semi").join(vectors, "row")
    pieces = F.ceil(F.col("k") / PIECE).cast("int")
    own = F.pmod(F.xxhash64("row"), pieces).cast("int")
    # a piece meets itself and each other piece once
    others = F.transform(F.sequence(F.lit(0), pieces - 1), lambda o: F.struct(
        F.least(own, o).alias("p"), F.greatest(own, o).alias("q"),
        F.when(own == o, F.lit(2)).when(own < o, F.lit(0)).otherwise(F.lit(1)).alias("side")))
    dealt = (open_.withColumn("to", F.explode(others))
             .select("bucket", "to.p", "to.q", "row", "n", "comp", "to.side", "scale", "counts")
             .repartition("bucket", "p", "q").sortWithinPartitions("bucket", "p", "q"))
    rest = written(dealt.mapInArrow(_search, "a long, b long").distinct(), "ngram-rest")
    second = links(rest, reps, docs, "ngram-second")
    comps = components(first.unionByName(second))

    groups = reps.join(comps.select(F.col("node").alias("rep"), "comp"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    least = groups.groupBy("comp").agg(F.min("d0").alias("component_id"))
    groups = groups.join(least, "comp").select("h1", "h2", "component_id")
    return rows.select("doc_id", "n", "h1", "h2").join(groups, ["h1", "h2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def bounded(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (a, b) whose summed coordinate minima allow a link."""
    side = lambda c, x: rows.select(F.col("row").alias(c), F.col("n").alias(f"n{x}"), F.col("scale").alias(f"s{x}"),
                                    F.col("counts").alias(f"c{x}"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n1, s1, n2, s2 = (np.array(b.column(i)) for i in (2, 3, 5, 6))
            c1, c2 = (np.frombuffer(b"".join(b.column(i).to_pylist()), dtype=np.uint8).reshape(b.num_rows, GROUPS).astype(np.int32)
                      for i in (4, 7))
            ok = np.minimum(c1 * s1[:, None], c2 * s2[:, None]).sum(1) >= needed(n1, n2)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), b.column(1).filter(pa.array(ok))], names=["a", "b"])

    both = pairs.join(side("a", 1), "a").join(side("b", 2), "b").select("a", "b", "n1", "s1", "c1", "n2", "s2", "c2")
    return both.mapInArrow(keep, "a long, b long")
