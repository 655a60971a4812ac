"""Subword lattice likelihood (operator 4).

A text is words and one end.  With a blank put before each word, a word's spelling has the summed
probability of all its segmentations into vocabulary pieces, each the product of its pieces'
probabilities: the forward recursion over a lattice of byte positions, in log space.  As only the first
piece of a word holds the blank, the marginal of a text is the product over its words and its end.

A piece has one probability for each place in a word (WHOLE, INITIAL, MIDDLE, FINAL).  At a word's start
the whole and initial ones sum to one, inside it the middle and final ones.  A word of the training
documents is an arc of its own too, of probability (c - d) / N; the discounts d of all of them are the
weight of the subword arcs, which so tell how new words are spelt.  All texts' probabilities sum to one.

The vocabulary is an existing tokenizer's (a file, never trained here); its scores start the
probabilities and a few rounds of expectation-maximisation fit them to the training documents' distinct
words.  Single bytes are pieces, so every text has a segmentation.

Words are counted over the whole corpus and scored once each.  A document's sum needs its words' values:
the most frequent ``top_words`` words go to every task, the others are joined by word.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeshore.llm.common import text_batches, written

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
ROUNDS = 3
WHOLE, INITIAL, MIDDLE, FINAL = range(4)
TOP_WORDS = 65_536
#: bytes up to which pieces are looked up, further if the vocabulary has longer ones; pseudo-counts of single bytes and of longer pieces
LONGEST, SMOOTH_BYTE, SMOOTH = 16, 0.05, 0.001
#: distinct words that a task holds before it sends its counts, words of a lattice batch
FLUSH, BATCH = 200_000, 4_096
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
LN10 = float(np.log(10.0))


def read_vocabulary(path: str = VOCABULARY) -> tuple[list[bytes], np.ndarray]:
    """Pieces as bytes (a blank first where a word starts) and their starting log probabilities.

    Scores that are ranks (a BPE file) become probabilities by Zipf's law; scores of a unigram file are
    log probabilities already.  Pieces with A-Z cannot match lower-cased words and are left out.
    """
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    start: dict[bytes, float] = {bytes([b]): -20.0 for b in range(256)}
    ranks = min(model.get_score(i) for i in range(model.get_piece_size()) if model.get_score(i) > -1e8) < -1000
    for i in range(model.get_piece_size()):
        if model.is_unknown(i) or model.is_control(i) or model.is_byte(i):
            continue
        piece, score = model.id_to_piece(i), model.get_score(i)
        data = piece.replace("▁", " ").encode("utf-8")
        if b" " in data[1:] or data != data.lower() or score < -1e8:
            continue
        start[data] = -float(np.log(-score + 10.0)) - 10.0 if ranks else score
    pieces = sorted(start)
    logp = np.array([start[p] for p in pieces])
    return pieces, logp - np.logaddexp.reduce(logp)


class Pieces:
    """Looks up substrings of many words at once by their rolling hashes."""

    def __init__(self, pieces: list[bytes]):
        self.n = len(pieces)
        with np.errstate(over="ignore"):
            self.longest = max(LONGEST, *map(len, pieces))
            self.power = np.ones(self.longest + 1, dtype=np.uint64)
            for i in range(1, self.longest + 1):
                self.power[i] = self.power[i - 1] * BASE
            sizes = np.array([len(p) for p in pieces])
            block = np.frombuffer(b"".join(p.ljust(self.longest, b"\0") for p in pieces), dtype=np.uint8).reshape(self.n, self.longest)
            h = np.zeros(self.n, dtype=np.uint64)
            for j in range(self.longest):
                h = np.where(j < sizes, h * BASE + (block[:, j].astype(np.uint64) + np.uint64(1)), h)
        assert len(np.unique(h)) == self.n
        # two tables: the few pieces whose slot is taken in the first are in the second
        self.hash = np.append(h, np.uint64(0))
        self.first = np.full(1 << 20, self.n, dtype=np.int32)
        slot = self._slot(h, 1)
        self.first[slot[::-1]] = np.arange(self.n - 1, -1, -1, dtype=np.int32)
        rest = np.flatnonzero(self.first[slot] != np.arange(self.n))
        self.turn = next(t for t in range(2, 1000) if len(np.unique(self._slot(h[rest], t))) == len(rest))
        self.second = np.full(1 << 20, self.n, dtype=np.int32)
        self.second[self._slot(h[rest], self.turn)] = rest

    @staticmethod
    def _slot(h: np.ndarray, turn: int) -> np.ndarray:
        factor = np.uint64(pow(int(BASE), 2 * turn + 1, 1 << 64) ^ 0x5851F42D4C957F2C)
        with np.errstate(over="ignore"):
            return (((h ^ (h >> np.uint64(29))) * factor) >> np.uint64(44)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece numbers, n where there is none."""
        k = self.first[self._slot(h, 1)]
        k2 = self.second[self._slot(h, self.turn)]
        return np.where(self.hash[k] == h, k, np.where(self.hash[k2] == h, k2, self.n))

    def lattice(self, words: np.ndarray) -> list[np.ndarray]:
        """[end - 1][word, length - 1]: the piece that ends there, for words of one length (rows of bytes)."""
        m, n = words.shape
        out = []
        with np.errstate(over="ignore"):
            h = np.zeros((m, n + 1), dtype=np.uint64)
            for j in range(n):
                h[:, j + 1] = h[:, j] * BASE + (words[:, j].astype(np.uint64) + np.uint64(1))
            for j in range(1, n + 1):
                longest = min(j, self.longest)
                starts = h[:, j - longest:j][:, ::-1]  # length 1 first
                out.append(self.find(h[:, j:j + 1] - starts * self.power[1:longest + 1]))
        return out


def _scores(ids: np.ndarray, j: int, n: int, logp: np.ndarray) -> np.ndarray:
    """Log probabilities of the pieces that end at j of n, by their place in the word."""
    out = logp[MIDDLE if j < n else FINAL][ids]
    if ids.shape[1] == j:  # the longest one starts the word
        out[:, -1] = logp[INITIAL if j < n else WHOLE][ids[:, -1]]
    return out


def forward(lattice: list[np.ndarray], logp: np.ndarray) -> np.ndarray:
    """[word, position]: log of the summed probability of all segmentations up to there."""
    m, n = len(lattice[0]), len(lattice)
    alpha = np.full((m, n + 1), -np.inf)
    alpha[:, 0] = 0.0
    for j in range(1, n + 1):
        ids = lattice[j - 1]
        terms = alpha[:, j - ids.shape[1]:j][:, ::-1] + _scores(ids, j, n, logp)
        top = terms.max(1)
        alpha[:, j] = top + np.log(np.exp(terms - top[:, None]).sum(1))
    return alpha


def expected(lattice: list[np.ndarray], logp: np.ndarray, weight: np.ndarray, into: np.ndarray) -> None:
    """Add the expected number of uses of each piece in each place, by word weight (forward-backward)."""
    alpha, n = forward(lattice, logp), len(lattice)
    beta = np.full_like(alpha, -np.inf)
    beta[:, n] = 0.0
    size = into.shape[1]
    for j in range(n, 0, -1):
        ids = lattice[j - 1]
        score = _scores(ids, j, n, logp)
        back = score + beta[:, j:j + 1]
        for k in range(ids.shape[1]):
            beta[:, j - 1 - k] = np.logaddexp(beta[:, j - 1 - k], back[:, k])
        use = np.exp(alpha[:, j - ids.shape[1]:j][:, ::-1] + back - alpha[:, n:n + 1]) * weight[:, None]
        starts = ids.shape[1] == j
        inner = slice(0, -1 if starts else None)
        into[MIDDLE if j < n else FINAL] += np.bincount(ids[:, inner].ravel(), weights=use[:, inner].ravel(), minlength=size)
        if starts:
            into[INITIAL if j < n else WHOLE] += np.bincount(ids[:, -1], weights=use[:, -1], minlength=size)


def by_length(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions and byte matrix (with the leading blank) of the words of each length, in bounded batches."""
    sizes = np.array([len(w) for w in words])
    order = np.argsort(sizes, kind="stable")
    ends = np.append(np.flatnonzero(np.diff(sizes[order])) + 1, len(order))
    a = 0
    for e in ends:
        n = int(sizes[order[a]]) + 1
        step = max(1, min(BATCH, (BATCH * 16) // n))
        for s in range(a, e, step):
            at = order[s:min(s + step, e)]
            yield at, np.frombuffer(b"".join([b" " + words[i] for i in at]), dtype=np.uint8).reshape(len(at), n)
        a = e


def _in_chunks(batches: Iterator[pa.RecordBatch], rows: int = 65_536) -> Iterator[list[list]]:
    """Columns of about ``rows`` rows, whatever the size of the Arrow batches."""
    held: list[list] = []
    for b in batches:
        cols = [c.to_pylist() for c in b.columns]
        if not held:
            held = cols
        else:
            for h, c in zip(held, cols):
                h += c
        if len(held[0]) >= rows:
            yield held
            held = []
    if held and held[0]:
        yield held


def count_words(docs: DataFrame) -> DataFrame:
    """word, c (occurrences in training documents) of every word of (text binary, held_out)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        train: Counter = Counter()
        other: set = set()

        def sent():
            words = list(train) + [w for w in other if w not in train]
            counts = list(train.values())
            counts += [0] * (len(words) - len(counts))
            train.clear()
            other.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(counts, pa.int64())], names=["word", "c"])

        for b in batches:
            for text, held in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if text:
                    (other if held else train).update(text.lower().split())
                if len(train) + len(other) >= FLUSH:
                    yield sent()
        yield sent()

    return docs.select("text", "held_out").mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _normalised(n: np.ndarray) -> np.ndarray:
    """Log probabilities [place, piece] (-inf for the missing piece) from (expected) counts."""
    start, inside = n[WHOLE].sum() + n[INITIAL].sum(), n[MIDDLE].sum() + n[FINAL].sum()
    logp = np.log(n / np.array([start, start, inside, inside])[:, None])
    return np.hstack([logp, np.full((4, 1), -np.inf)])


def fit_pieces(words: DataFrame, vocabulary: str = VOCABULARY, rounds: int = ROUNDS) -> tuple[list[bytes], np.ndarray]:
    """Pieces and their log probabilities by place, after ``rounds`` of expectation-maximisation.

    Every distinct training word counts once: the subword arcs spell words that are new.
    """
    pieces, first = read_vocabulary(vocabulary)
    logp = _normalised(np.tile(np.exp(first), (4, 1)))
    smooth = np.array([SMOOTH_BYTE if len(p) == 1 else SMOOTH for p in pieces])
    trained = words.filter(F.col("c") > 0).select("word")
    for _ in range(rounds):
        def step(batches: Iterator[pa.RecordBatch], logp=logp) -> Iterator[pa.RecordBatch]:
            table, into = Pieces(pieces), np.zeros((4, len(pieces) + 1))
            for (ws,) in _in_chunks(batches):
                for at, block in by_length(ws):
                    expected(table.lattice(block), logp, np.ones(len(at)), into)
            place, piece = np.nonzero(into[:, :-1])
            yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(piece, pa.int64()), pa.array(into[place, piece])],
                                             names=["place", "piece", "n"])

        # the driver gets four numbers a piece at most
        got = (trained.mapInArrow(step, "place long, piece long, n double").groupBy("place", "piece")
               .agg(F.sum("n").alias("n")).collect())
        n = np.tile(smooth, (4, 1))
        for r in got:
            n[r["place"], r["piece"]] += r["n"]
        logp = _normalised(n)
    return pieces, logp


def score_words(words: DataFrame, pieces: list[bytes], logp: np.ndarray, discount: float, total: float,
                spare: float) -> DataFrame:
    """word, c, lp: log10 of (c - discount) / total + spare * the spelling's marginal probability."""
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Pieces(pieces)
        for ws, cs in _in_chunks(batches):
            spelt = np.zeros(len(ws))
            for at, block in by_length(ws):
                spelt[at] = forward(table.lattice(block), logp)[:, -1]
            with np.errstate(divide="ignore"):
                known = np.log(np.maximum(np.array(cs, dtype=float) - discount, 0.0) / total)
            out = np.logaddexp(known, spelt + np.log(spare)) / LN10
            yield pa.RecordBatch.from_arrays([pa.array(ws, pa.binary()), pa.array(cs, pa.int64()), pa.array(out)],
                                             names=["word", "c", "lp"])
    return words.mapInArrow(score, "word binary, c long, lp double")


def frequent(words: DataFrame, most: int = TOP_WORDS) -> DataFrame:
    """The words of the highest counts, ``most`` at most: all words above a count that a histogram gives."""
    bits = F.length(F.bin("c"))
    # 64 steps an octave: bounded however large the corpus
    step = F.pow(F.lit(2.0), F.greatest(bits - 7, F.lit(0))).cast("long")
    level = (F.floor(F.col("c") / step) * step).cast("long")
    least, total = None, 0
    for r in words.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("level").desc()).collect():
        total += r["n"]
        if total > most:
            break
        least = r["level"]
    return words.filter(F.col("c") >= least) if least is not None else words.limit(0)


def score(docs: DataFrame, held_out, vocabulary: str = VOCABULARY, rounds: int = ROUNDS, id_col: str = "doc_id",
          text_col: str = "text", top_words: int = TOP_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    ``held_out`` is a boolean column expression; the other rows train.  Null texts are empty texts: one
    token, the end.  Rows that repeat count, and score, each by itself.  An empty table gives an empty
    result.  Other columns are not read.
    """
    spark = docs.sparkSession
    text_batches(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"),
                       F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    counted = written(count_words(rows), "lm-counts")
    train_docs = rows.filter(~F.col("held_out")).count()
    once = lambda k: F.count(F.when(F.col("c") == k, 1))
    n, v, n1, n2 = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1)), once(1), once(2)).first()
    # absolute discounting; without training words everything is spelt and an end has odds of 1 in 100
    discount = min(0.9, max(0.1, n1 / (n1 + 2 * n2))) if n1 else 0.5
    end_p = train_docs / (n + train_docs) if n and train_docs else 0.01
    spare = discount * v / (n + train_docs) if v else 1.0 - end_p
    pieces, logp = fit_pieces(counted, vocabulary, rounds)
    n, v = n + train_docs, v + (train_docs > 0)
    words = written(score_words(counted, pieces, logp, discount, float(max(n, 1)), spare), "lm-words")
    space = float(n + v + 1)
    top = spark.sparkContext.broadcast({bytes(r["word"]): (r["c"], r["lp"]) for r in frequent(words, top_words).collect()})
    # the end's terms
    end_base, end_lp, end_known = float(np.log10((train_docs + 1) / space)), float(np.log10(end_p)), int(train_docs > 0)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {w: (c > 0, float(np.log10((c + 1) / space)), lp) for w, (c, lp) in top.value.items()}
        for b in batches:
            total, found, base, lp, rest = [], [], [], [], []
            for text in b.column(2).to_pylist():
                ws = text.lower().split()
                nk, sb, sl, left = end_known, end_base, end_lp, []
                for w, k in Counter(ws).items():
                    t = known.get(w)
                    if t is None:
                        left.append({"word": w, "k": k})
                    else:
                        nk += k * t[0]
                        sb += k * t[1]
                        sl += k * t[2]
                total.append(len(ws) + 1)
                found.append(nk)
                base.append(sb)
                lp.append(sl)
                rest.append(left)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(total, pa.int64()), pa.array(found, pa.int64()), pa.array(base, pa.float64()),
                 pa.array(lp, pa.float64()), pa.array(rest, pa.list_(pa.struct([("word", pa.binary()), ("k", pa.int64())])))],
                names=["doc_id", "held_out", "n_tokens", "nk", "sb", "sl", "rest"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    part = rows.mapInArrow(add, f"doc_id {kind}, held_out boolean, n_tokens long, nk long, sb double, sl double, "
                                "rest array<struct<word:binary,k:long>>")
    # the row number is fixed by writing it; rows may repeat
    part = written(part.withColumn("row", F.monotonically_increasing_id()), "lm-documents")
    tail = (part.select("row", F.explode("rest").alias("w")).select("row", "w.word", "w.k")
            .join(words, "word")
            .groupBy("row").agg(
                F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("tk"),
                F.sum(F.col("k") * F.log10((F.col("c") + 1) / F.lit(space))).alias("tb"),
                F.sum(F.col("k") * F.col("lp")).alias("tl")))
    zero = F.lit(0.0)
    return part.drop("rest").join(tail, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("nk") + F.coalesce("tk", F.lit(0))).alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"), (F.col("sb") + F.coalesce("tb", zero)).alias("base_score"),
        (F.col("sl") + F.coalesce("tl", zero)).alias("score"))
