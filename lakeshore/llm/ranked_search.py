"""Ranked lexical search by length buckets of impact vectors (operator 12).

A document is a sparse vector of integer term impacts, a query one of integer term weights; the score is
their inner product.  As in the LEMP family of algorithms, documents are ordered by the length of their
vectors and cut into buckets, and a query needs to look into a bucket only if |query| times the longest
vector of the bucket reaches the score of its tenth best document so far (Cauchy-Schwarz).  Inside a
bucket a query first visits only the postings of its heaviest terms, its *focus* coordinates; what the
other coordinates can add is bounded by the lengths of both rests (Cauchy-Schwarz again), and documents
that cannot reach the threshold go.  Survivors are scored in 64-bit integers.  Bounds are floating-point
numbers and are widened by a margin, so they only ever keep too much: the result is exact.

Spark: one pass over the texts writes each document's number of terms and the tf of the terms that any
query holds; aggregates over that table give N, L and df; a second pass over it searches.  A task orders
its documents block by block and carries its thresholds on from block to block, so vectors are never
shuffled and no length or copy is hot; only a task's ten best of each query are.  Queries come in groups
of a bounded number of terms, and every group searches all rows.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeshore.llm.common import text_batches, written

TOP = 10
#: distinct (query, term) pairs of one group of queries; a query with more is a group of its own
GROUP_TERMS = 200_000
#: documents and postings that a task orders at a time, and documents of a bucket
BLOCK_ROWS, BLOCK_POSTINGS, BUCKET_ROWS = 16_384, 2_000_000, 512
#: texts are cut into pieces of about so many bytes between two terms
PIECE = 1 << 20
#: a query's focus coordinates hold so much of its squared length
FOCUS = 0.75
#: relative margin of all bounds
MARGIN = 1e-9

#: ASCII bytes other than letters and digits separate terms; only A-Z is lower-cased
FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() and b < 0x80 else 0x20 for b in range(256)).lower()


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text in order, piece by piece."""
    text, start = text.translate(FOLD), 0
    while start < len(text):
        end = text.find(b" ", start + PIECE)
        end = len(text) if end < 0 else end
        yield text[start:end].split()
        start = end


# ---------------------------------------------------------------- queries

class Queries(NamedTuple):
    """A group of queries: ids, and each one's term numbers."""
    ids: list
    vocabulary: dict[bytes, int]
    terms: list[list[int]]


def query_groups(items: DataFrame, key: str, text: str) -> Iterator[Queries]:
    """Groups of queries of at most ``GROUP_TERMS`` (query, term) pairs.  Rows with one id are one query."""
    def words(batches):
        for batch in batches:
            sets = [list({x for piece in terms(t or b"") for x in piece}) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(sets, pa.list_(pa.binary()))], ["id", "terms"])

    kind = items.schema[key].dataType.simpleString()
    found = items.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").cast("binary").alias("text")).mapInArrow(
        words, f"id {kind}, terms array<binary>").select("id", F.explode("terms").alias("term")).distinct()
    merged = written(found.groupBy("id").agg(F.collect_list("term").alias("terms"), F.count(F.lit(1)).alias("n")), "search-queries")
    sizes = merged.groupBy(F.pmod(F.xxhash64("id"), F.lit(1 << 20)).alias("slot")).agg(F.sum("n").alias("n"))
    # slots of ids, joined to groups by size: at most 2^20 numbers reach the driver whatever the number of queries
    groups, start, held = [], 0, 0
    for r in sorted(sizes.collect(), key=lambda r: r.slot):
        if held and held + r.n > GROUP_TERMS:
            groups.append((start, r.slot))
            start, held = r.slot, 0
        held += r.n
    if held:
        groups.append((start, 1 << 20))
    slot = F.pmod(F.xxhash64("id"), F.lit(1 << 20))
    for lo, hi in groups:
        rows = merged.filter((slot >= lo) & (slot < hi)).select("id", "terms").collect()
        vocabulary = {t: k for k, t in enumerate(sorted({bytes(t) for r in rows for t in r.terms}))}
        yield Queries([r.id for r in rows], vocabulary, [[vocabulary[bytes(t)] for t in r.terms] for r in rows])


# ---------------------------------------------------------------- documents

def term_vectors(docs: DataFrame, key: str, text: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """One row per document with any term: doc_id, n (all terms, with repeats), and the numbers and tf of
    the terms in ``vocabulary``."""
    def count(batches):
        for batch in batches:
            ids, sizes, numbers, tfs, offsets = [], [], [], [], [0]
            for k, t in enumerate(batch.column(1).to_pylist()):
                n, found = 0, Counter()
                for piece in terms(t or b""):
                    n += len(piece)
                    found.update(piece)
                if not n:
                    continue
                for term in vocabulary.keys() & found.keys() if len(found) < len(vocabulary) else (v for v in vocabulary if v in found):
                    numbers.append(vocabulary[term])
                    tfs.append(found[term])
                ids.append(k), sizes.append(n), offsets.append(len(numbers))
            at = pa.array(offsets, pa.int32())
            yield pa.record_batch([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(sizes, pa.int64()),
                                   pa.ListArray.from_arrays(at, pa.array(numbers, pa.int32())),
                                   pa.ListArray.from_arrays(at, pa.array(tfs, pa.int32()))], ["doc_id", "n", "terms", "tfs"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("text")).mapInArrow(
        count, f"doc_id {kind}, n long, terms array<int>, tfs array<int>")


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, words: int) -> np.ndarray:
    """(10^9 tf) div (1000 tf + 8 m) with m = 10 + (90 n N) div L, in integers."""
    if len(n) and int(n.max()) * 90 * documents >= 1 << 62:
        m = np.array([10 + 90 * int(x) * documents // words for x in n], dtype=np.int64)
    else:
        m = 10 + 90 * n * documents // words
    return 1_000_000_000 * tf // (1_000 * tf + 8 * m)


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


# ---------------------------------------------------------------- search in a task

class Bucket:
    """Documents of similar length, with the postings of each term."""

    def __init__(self, ids, start, term, value, length):
        self.ids, self.longest, self.squares = ids, float(length[0]), length ** 2
        row = np.repeat(np.arange(len(ids)), np.diff(start))
        order = np.argsort(term, kind="stable")
        self.row, self.value = row[order], value[order]
        self.terms, self.at = np.unique(term[order], return_index=True)
        self.at = np.append(self.at, len(order))

    def postings(self, wanted: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, impacts and query weights of all postings of the wanted terms."""
        k = np.searchsorted(self.terms, wanted)
        hit = (k < len(self.terms)) & (self.terms[np.minimum(k, len(self.terms) - 1)] == wanted)
        k, weights = k[hit], weights[hit]
        size = self.at[k + 1] - self.at[k]
        if not size.sum():
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        # one range of positions after the other
        at = np.arange(size.sum()) + np.repeat(self.at[k] - np.append(0, np.cumsum(size)[:-1]), size)
        return self.row[at], self.value[at], np.repeat(weights, size)


class Query:
    """Terms by falling weight, the focus first; the ten best so far."""

    def __init__(self, number: int, term: np.ndarray, weights: np.ndarray, top: int = TOP):
        self.top = top
        order = np.argsort(-weights, kind="stable")
        self.number, self.term, self.weight = number, term[order], weights[order]
        squares = np.cumsum(self.weight.astype(float) ** 2)
        self.length = math.sqrt(squares[-1])
        self.focus = int(np.searchsorted(squares, FOCUS * squares[-1])) + 1
        self.rest = math.sqrt(max(0.0, squares[-1] - squares[min(self.focus, len(squares)) - 1]))
        self.best: list[tuple] = []

    def threshold(self) -> int:
        return self.best[0][0] if len(self.best) == self.top else 1

    def offer(self, score: int, doc) -> None:
        entry = (score, _Falling(doc), doc)
        if len(self.best) < self.top:
            heapq.heappush(self.best, entry)
        elif entry > self.best[0]:
            heapq.heapreplace(self.best, entry)


class _Falling:
    """Orders ids so that the largest, then null, comes first: the one to leave among equal scores."""
    __slots__ = ("key",)

    def __init__(self, doc):
        self.key = (doc is None, 0 if doc is None else doc)

    def __lt__(self, other):
        return self.key > other.key

    def __eq__(self, other):
        return self.key == other.key


def search_bucket(query: Query, bucket: Bucket) -> tuple[int, int]:
    """Offer the bucket's documents that can reach the query's threshold; how many were met and scored."""
    need = query.threshold() * (1 - MARGIN)
    if query.length * bucket.longest < need:
        return 0, 0
    row, value, w = bucket.postings(query.term[:query.focus], query.weight[:query.focus])
    size = len(bucket.ids)
    part = np.bincount(row, value * w, size)
    seen = np.bincount(row, value.astype(float) ** 2, size)
    bound = part + query.rest * np.sqrt(np.maximum(bucket.squares * (1 + MARGIN) - seen, 0))
    survivors = np.flatnonzero(bound >= need)
    if not len(survivors):
        return size, 0
    exact, kept = np.zeros(size, np.int64), np.zeros(size, bool)
    kept[survivors] = True
    for row, value, w in ((row, value, w), bucket.postings(query.term[query.focus:], query.weight[query.focus:])):
        hit = kept[row]
        np.add.at(exact, row[hit], value[hit] * w[hit])
    least = query.threshold()
    survivors = survivors[exact[survivors] >= least]
    for k in survivors[np.argsort(-exact[survivors], kind="stable")]:
        if exact[k] < query.threshold():
            break
        query.offer(int(exact[k]), bucket.ids[k])
    return size, len(survivors)


def blocks(batches, documents: int, words: int) -> Iterator[list[Bucket]]:
    """Blocks of documents as buckets by falling length."""
    held, rows, postings = [], 0, 0

    def cut():
        ids = [i for b in held for i in b.column(0).to_pylist()]
        n = np.concatenate([b.column(1).to_numpy(zero_copy_only=False) for b in held])
        size = np.concatenate([b.column(2).value_lengths().to_numpy(zero_copy_only=False) for b in held])
        term = np.concatenate([b.column(2).flatten().to_numpy(zero_copy_only=False) for b in held])
        tf = np.concatenate([b.column(3).flatten().to_numpy(zero_copy_only=False) for b in held]).astype(np.int64)
        value = impacts(tf, np.repeat(n, size), documents, words)
        start = np.append(0, np.cumsum(size))
        square = np.add.reduceat(np.append(value, 0).astype(float) ** 2, start[:-1]) * (size > 0) if len(size) else np.zeros(0)
        length = np.sqrt(square)
        order = np.argsort(-length, kind="stable")
        order = order[:int((size > 0).sum())]          # documents without any query term score 0
        out = []
        for k in range(0, len(order), BUCKET_ROWS):
            pick = order[k:k + BUCKET_ROWS]
            at = np.concatenate([np.arange(start[i], start[i + 1]) for i in pick])
            out.append(Bucket([ids[i] for i in pick], np.append(0, np.cumsum(size[pick])), term[at], value[at], length[pick]))
        return out

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows, postings = rows + b.num_rows, postings + len(b.column(2).flatten())
        if rows >= BLOCK_ROWS or postings >= BLOCK_POSTINGS:
            yield cut()
            held, rows, postings = [], 0, 0
    if held:
        yield cut()


def search(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", doc_text: str = "text", item_key: str = "item_id",
           item_text: str = "text", top: int = TOP) -> DataFrame:
    """The ``top`` best documents of each item: item_id, rank (from 1), doc_id, score.

    Terms are runs of anything but ASCII signs, white space and controls, A-Z lower-cased.  Null and empty
    texts have no terms; items without terms, and empty tables, give no rows.  Rows of items that share an
    id are one query, with the terms of all of them.  Every row of documents is a document of its own, so
    repeated rows rank one after the other; equal scores rank by id, null last.  Texts of any length are
    read whole, piece by piece.  Other columns are not read.
    """
    spark = docs.sparkSession
    text_batches(spark)
    kind, item_kind = docs.schema[doc_key].dataType, items.schema[item_key].dataType
    found = None
    for queries in query_groups(items, item_key, item_text):
        part = search_group(docs, queries, doc_key, doc_text, kind, item_kind, top)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], f"item_id {item_kind.simpleString()}, rank int, doc_id {kind.simpleString()}, score long")
    found = written(found, "search-found")
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.select("item_id", F.row_number().over(order).alias("rank"), "doc_id", "score")
    return ranked.filter(F.col("rank") <= top)


def search_group(docs: DataFrame, queries: Queries, doc_key: str, doc_text: str, kind, item_kind, top: int) -> DataFrame:
    """The best documents of each task for each query of a group."""
    spark = docs.sparkSession
    vectors = written(term_vectors(docs, doc_key, doc_text, queries.vocabulary), "search-vectors")
    totals = vectors.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
    df = {r.term: r.df for r in vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(
        F.count(F.lit(1)).alias("df")).collect()}          # at most the group's vocabulary
    documents, words, ids, of = totals.documents, totals.words, queries.ids, queries.terms
    schema = pa.schema([("query", pa.int64()), ("doc_id", _arrow(kind)), ("score", pa.int64())])

    def scan(batches):
        plan = []
        for k, wanted in enumerate(of):
            pairs = [(t, w) for t in wanted if t in df and (w := weight(documents, df[t])) > 0]
            if pairs:
                plan.append(Query(k, np.array([t for t, _ in pairs]), np.array([w for _, w in pairs], dtype=np.int64), top))
        for buckets in blocks(batches, documents, words):
            for query in plan:
                for bucket in buckets:
                    if query.length * bucket.longest < query.threshold() * (1 - MARGIN):
                        break          # all later buckets are shorter
                    search_bucket(query, bucket)
        best = [(q.number, doc, score) for q in plan for score, _, doc in q.best]
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*best), schema)] if best else
                              [pa.array([], f.type) for f in schema], schema=schema)

    found = vectors.mapInArrow(scan, f"query long, doc_id {kind.simpleString()}, score long")
    names = spark.createDataFrame(list(enumerate(ids)), f"query long, item_id {item_kind.simpleString()}")
    return found.join(F.broadcast(names), "query").select("item_id", "doc_id", "score")


def _arrow(kind):
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(kind)
