"""Toxicity by classifier chains (operator 10).

Categories are predicted one after the other.  Each has a linear (logistic) model over the words and word beginnings of
a text and over the log-odds that the earlier categories got.  In training those are out-of-fold
predictions, so a later model learns how far the earlier ones can be trusted on unseen texts.

The chain is fitted in one task on a bounded sample of labelled rows (``max_train``); the fitted chain
is at most ``max_features`` words and stems a category.  Scoring runs over all rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeshore.llm.common import text_batches, written

MAX_TRAIN, MAX_FEATURES, FOLDS = 10_000, 256, 5
#: a word must be in so many training texts, and its rate differ by so many standard errors, to be a feature
LEAST_DF, LEAST_Z = 3, 6.0
RIDGE = 0.3
THRESHOLD = 0.5

#: weak labels of the two narrower categories: a toxic row that has one of these words
SEEDS = {"insult": ("idiot", "moron", "loser", "clown", "scum"),
         "contempt": ("stupid", "pathetic", "worthless", "disgusting", "trash")}

_FOLD = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_WORDS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in _FOLD)


#: beginnings of words (bytes) that are features too, so that inflected forms count together
STEMS = (5, 6, 7)
#: a stem's feature for each of these numbers of different words that have it
STEM_WORDS = (1, 2, 4)


def words(text: bytes | None) -> set[bytes]:
    """Lower-cased runs of letters (and of anything outside ASCII)."""
    return set(text.translate(_WORDS).split()) if text else set()


def features(text: bytes | None, stems: frozenset[bytes] | None = None) -> set[bytes]:
    """The words and, as "number stem", the stems that so many of them begin with (of ``stems`` only, if given)."""
    found = words(text)
    if stems is None:
        count = Counter([w[:k] for w in found for k in STEMS if len(w) > k])
    else:
        count = Counter([w[:k] for w in found if w[:STEMS[0]] in stems for k in STEMS if len(w) > k])
    return found.union(b"%d %s" % (n, s) for s, k in count.items() for n in STEM_WORDS if k >= n)


def known_features(chain: list[Link]) -> tuple[frozenset[bytes], frozenset[bytes]]:
    """The features of a chain, and the shortest stems among them."""
    known = frozenset(w for x in chain for w in x.weights)
    return known, frozenset(w.partition(b" ")[2][:STEMS[0]] for w in known if b" " in w)


@dataclass
class Link:
    """One category's model: word weights, weights of the earlier categories' log-odds, intercept."""
    category: str
    weights: dict[bytes, float] = field(default_factory=dict)
    earlier: list[float] = field(default_factory=list)
    intercept: float = 0.0

    def log_odds(self, found: set[bytes], before: list[float]) -> float:
        # fsum: the order of a set must not show in the result
        return float(self.intercept + sum(w * b for w, b in zip(self.earlier, before))
                     + sum(sorted(self.weights[x] for x in found if x in self.weights)))


def chain_log_odds(chain: list[Link], found: set[bytes]) -> list[float]:
    out: list[float] = []
    for link in chain:
        out.append(link.log_odds(found, out))
    return out


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last column of x is the intercept (little ridge)."""
    penalty = np.full(x.shape[1], RIDGE)
    penalty[-1] = 1e-6
    beta = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        g = x.T @ (p - y) + penalty * beta
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, g)
        beta -= step
        if np.abs(step).max() < 1e-6:
            break
    return beta


def _fit_link(category: str, docs: list[np.ndarray], vocabulary: list[bytes], before: np.ndarray, y: np.ndarray,
              max_features: int) -> tuple[Link, np.ndarray]:
    """Features whose rate differs most between the classes, then the weights of them and of earlier categories.

    Returns the link, and its weight of every feature of the vocabulary.
    """
    n, n1 = len(docs), float(y.sum())
    link, weights = Link(category, earlier=[0.0] * before.shape[1]), np.zeros(len(vocabulary))
    if not 0 < n1 < n:
        link.intercept = float(np.log((n1 + 0.5) / (n - n1 + 0.5)))
        return link, weights
    flat, row = np.concatenate(docs), np.repeat(np.arange(n, dtype=np.int32), [len(d) for d in docs])
    df = np.bincount(flat, minlength=len(vocabulary))
    pos = np.bincount(flat[y[row]], minlength=len(vocabulary))
    rate = df / n
    z = np.abs(pos / n1 - (df - pos) / (n - n1)) / np.sqrt(np.maximum(rate * (1 - rate), 1e-9) * (1 / n1 + 1 / (n - n1)))
    good = np.flatnonzero((df >= LEAST_DF) & (z >= LEAST_Z))
    chosen = sorted(good.tolist(), key=lambda i: (-z[i], vocabulary[i]))[:max_features]
    at = np.full(len(vocabulary), -1)
    at[chosen] = np.arange(len(chosen))
    x = np.zeros((n, len(chosen) + before.shape[1] + 1))
    hit = at[flat] >= 0
    x[row[hit], at[flat[hit]]] = 1.0
    x[:, len(chosen):-1] = before
    x[:, -1] = 1.0
    beta = _logistic(x, y.astype(float))
    weights[chosen] = beta[:len(chosen)]
    link.weights = {vocabulary[i]: float(b) for i, b in zip(chosen, beta)}
    link.earlier = [float(b) for b in beta[len(chosen):-1]]
    link.intercept = float(beta[-1])
    return link, weights


def code(texts: list[set[bytes]] | list, read=lambda t: t) -> tuple[list[np.ndarray], list[bytes]]:
    """Feature numbers of every text (``read`` gives its features) and the features that are in LEAST_DF of them.

    A first pass counts hashes in a table of fixed size; only features whose count allows it get a number
    in the second one, so the many that occur once or twice are never held together.
    """
    counts = np.zeros(1 << 22, dtype=np.uint16)
    for t in texts:
        cells = np.fromiter({zlib.crc32(w) & 0x3FFFFF for w in read(t)}, dtype=np.int64)
        counts[cells] = np.minimum(counts[cells], 60_000) + 1
    number: dict[bytes, int] = {}
    coded = []
    for t in texts:
        own = [number.setdefault(w, len(number)) for w in sorted(read(t)) if counts[zlib.crc32(w) & 0x3FFFFF] >= LEAST_DF]
        coded.append(np.array(own, dtype=np.int32))
    return coded, list(number)


def fit(texts: list, labels: np.ndarray, folds: np.ndarray, categories: list[str],
        max_features: int = MAX_FEATURES, read=lambda t: t) -> list[Link]:
    """The chain over labelled feature sets (what ``read`` gives); ``labels`` has a column per category, in chain order."""
    coded, vocabulary = code(texts, read)
    chain: list[Link] = []
    before = np.zeros((len(texts), 0))  # out-of-fold log-odds of the categories so far
    for c, category in enumerate(categories):
        y = labels[:, c].astype(bool)
        out = np.zeros(len(texts))
        for f in np.unique(folds):
            train, test = np.flatnonzero(folds != f), np.flatnonzero(folds == f)
            if len(train):
                link, weights = _fit_link(category, [coded[i] for i in train], vocabulary, before[train], y[train], max_features)
                for i in test:
                    out[i] = link.intercept + weights[coded[i]].sum() + float(before[i] @ np.array(link.earlier))
        chain.append(_fit_link(category, coded, vocabulary, before, y, max_features)[0])
        before = np.column_stack([before, np.clip(out, -10, 10)])
    return chain


MODEL = "category string, word binary, weight double"


def fit_chain(labelled: DataFrame, categories: list[str], id_col: str = "doc_id", text_col: str = "text",
              max_train: int = MAX_TRAIN, max_features: int = MAX_FEATURES, folds: int = FOLDS) -> list[Link]:
    """Fit on about ``max_train`` labelled rows, taken by a hash of id and text (all rows if there are fewer).

    ``labelled`` has a 0/1 column for each category; rows with a null label do not train.  Texts with
    the same words count once.  Folds go by the words, so copies share a fold.
    """
    spark = labelled.sparkSession
    text_batches(spark)
    ready = written(labelled.filter(" and ".join(f"`{c}` is not null" for c in categories) or "true"), "toxic-sample")
    n = ready.count()
    draw = F.pmod(F.xxhash64(id_col, text_col), F.lit(1 << 40))
    sample = ready.filter(draw < int((1 << 40) * min(1.0, max_train / max(n, 1)))) if n > max_train else ready
    sample = sample.select(F.col(text_col).cast("binary").alias("t"), draw.alias("d"),
                           *[F.col(f"`{c}`").cast("int").alias(f"y{i}") for i, c in enumerate(categories)])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = {}
        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(b.num_columns)]
            for t, d, *y in zip(*cols):
                key = hashlib.sha256(b" ".join(sorted(words(t)))).digest()
                if key not in rows or d < rows[key][2]:
                    rows[key] = (t, y, d)
        keys = sorted(rows)
        fold = np.array([k[0] % folds for k in keys], dtype=int)
        chain = fit([rows[k][0] for k in keys], np.array([rows[k][1] for k in keys]).reshape(len(keys), len(categories)),
                    fold, categories, max_features, features)
        out = []
        for link in chain:
            out += [(link.category, w, v) for w, v in sorted(link.weights.items())]
            out += [(link.category, b" %d" % i, v) for i, v in enumerate(link.earlier)]
            out.append((link.category, b" ", link.intercept))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()),
                                          pa.array([r[1] for r in out], pa.binary()),
                                          pa.array([r[2] for r in out], pa.float64())], names=["category", "word", "weight"])

    model = sample.repartition(1).mapInArrow(train, MODEL).collect()
    chain = []
    for i, c in enumerate(categories):
        link = Link(c, earlier=[0.0] * i)
        for r in model:
            if r.category == c:
                w = bytes(r.word)
                if w == b" ":
                    link.intercept = r.weight
                elif w[:1] == b" ":
                    link.earlier[int(w)] = r.weight
                else:
                    link.weights[w] = r.weight
        chain.append(link)
    return chain


def score_chain(docs: DataFrame, chain: list[Link], id_col: str = "doc_id", text_col: str = "text",
                threshold: float = THRESHOLD) -> DataFrame:
    """One row per row: ``id_col``, p_<category> for each category, is_toxic (the last one's p >= threshold).

    Null texts are empty texts.  Repeated rows score alike.  An empty table gives an empty result.
    """
    text_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), *[T.StructField(f"p_{x.category}", T.DoubleType()) for x in chain],
                           T.StructField("is_toxic", T.BooleanType())])
    known, stems = known_features(chain)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            odds = np.array([chain_log_odds(chain, known & features(t, stems)) for t in b.column(1).to_pylist()],
                            dtype=float).reshape(b.num_rows, len(chain))
            p = 1 / (1 + np.exp(-np.clip(odds, -700, 700)))
            last = p[:, -1] if len(chain) else np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(p[:, i]) for i in range(len(chain))], pa.array(last >= threshold)],
                names=schema.names)

    return docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("_t")).mapInArrow(score, schema)


def has_word(text: Column, terms: tuple[str, ...]) -> Column:
    return F.lower(text).rlike(r"(?<![a-z])(" + "|".join(terms) + r")(?![a-z])")


def labelled_documents(docs: DataFrame, labels: DataFrame, seeds: dict[str, tuple[str, ...]] = SEEDS,
                       max_train: int = MAX_TRAIN) -> DataFrame:
    """doc_id, text and a 0/1 column per category of about ``max_train`` labelled documents, by a hash of the id.

    The ids are drawn before the texts are looked up, so at most that many go to every task and no text
    is shuffled.  Only ``toxic`` is labelled in the data (the largest of an id's labels counts); the seeded
    categories are weak labels within it.  Null ids and null labels do not train.
    """
    known = (labels.filter("doc_id is not null and toxic is not null")
             .groupBy(F.col("doc_id").alias("l_id")).agg(F.max("toxic").cast("int").alias("toxic")))
    known = written(known, "toxic-labels")
    n = known.count()
    if n > max_train:
        known = known.filter(F.pmod(F.xxhash64("l_id"), F.lit(1 << 40)) < int((1 << 40) * max_train / n))
    both = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("l_id")).drop("l_id")
    for name, terms in seeds.items():
        both = both.withColumn(name, ((F.col("toxic") == 1) & F.coalesce(has_word(F.col("text"), terms), F.lit(False))).cast("int"))
    return both.select("doc_id", "text", *seeds, "toxic")


def toxicity(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """Fit the chain on ``labels`` and score every row of ``docs``."""
    chain = fit_chain(labelled_documents(docs, labels, max_train=max_train), [*SEEDS, "toxic"], max_train=max_train)
    return score_chain(docs, chain)


def toxic_column(chain: list[Link], text: Column, threshold: float = THRESHOLD) -> Column:
    """The chain's last decision as a column, for filters that keep whole rows (Arrow batches)."""
    known, stems = known_features(chain)

    @F.pandas_udf("boolean")
    def decide(texts: pd.Series) -> pd.Series:
        odds = [chain_log_odds(chain, known & features(t, stems))[-1] if chain else -np.inf for t in texts]
        return pd.Series(1 / (1 + np.exp(-np.clip(np.array(odds, dtype=float), -700, 700))) >= threshold)

    return decide(text.cast("binary"))
