"""Document fingerprints by content-defined chunking (operator 6).

A gear hash rolls over the UTF-8 bytes; a chunk ends where its high bits are zero, with a harder mask
before the normal size and an easier one after it (normalised chunking), never under the least or over
the largest size.  The fingerprint is the set of chunk digests, each with its length; likeness is the
share of one set's length that the other contains.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAST, NORMAL, LARGEST = 16, 64, 512
#: zero bits asked for before and after the normal size: 2 more and 2 fewer than log2(NORMAL)
HARD_BITS, EASY_BITS = 8, 4
RANGES_PER_PARTITION = 8


def _gear() -> np.ndarray:
    """256 well mixed 32-bit numbers from a counter (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        z = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z >> np.uint64(32)).astype(np.uint32)


GEAR = _gear()


def gear_hashes(data: bytes) -> np.ndarray:
    """At each byte the sum of GEAR[byte] << age over the last 32 bytes, by doubling the window."""
    h = GEAR[np.frombuffer(data, dtype=np.uint8)]
    for k in (1, 2, 4, 8, 16):
        if len(h) <= k:
            break
        h[k:] += h[:-k] << np.uint32(k)
    return h


def cut_points(data: bytes) -> list[int]:
    """Ends of the chunks of ``data``."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    h = gear_hashes(data)
    easy = np.flatnonzero(h < np.uint32(1 << (32 - EASY_BITS)))
    hard = (easy[h[easy] < np.uint32(1 << (32 - HARD_BITS))] + 1).tolist()
    easy = (easy + 1).tolist()
    ends, start, ne, nh = [], 0, len(easy), len(hard)
    while n - start > LEAST:
        k = bisect_left(hard, start + LEAST)
        end = hard[k] if k < nh else n
        if end > start + NORMAL:
            k = bisect_left(easy, start + NORMAL)
            end = min(easy[k] if k < ne else n, start + LARGEST, n)
        ends.append(end)
        start = end
    if start < n:
        ends.append(n)
    return ends


def chunk_set(data: bytes) -> dict[int, int]:
    """Digest -> length of the distinct chunks."""
    out, start = {}, 0
    digest = xxhash.xxh3_64_intdigest
    for end in cut_points(data):
        out[digest(data[start:end])] = end - start
        start = end
    return out


def as_text(chunks: dict[int, int]) -> str:
    return " ".join([f"{d:016x}:{n}" for d, n in sorted(chunks.items())])


def likeness(a: dict[int, int], b: dict[int, int]) -> float:
    """The share of a's length that b contains; 1 for two empty texts, 0 if only one is empty."""
    if not a or not b:
        return float(not a and not b)
    return sum(n for d, n in a.items() if d in b) / sum(a.values())


RESULT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType()),
    T.StructField("edited_sha256", T.StringType()), T.StructField("fingerprint", T.StringType()),
    T.StructField("edited_fingerprint", T.StringType()), T.StructField("near_edited", T.DoubleType()),
    T.StructField("near_next", T.DoubleType())])
ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
                   ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
                   ("near_edited", pa.float64()), ("near_next", pa.float64())])
#: rows of a result batch, and bytes of text after which it is sent earlier
OUT_ROWS, OUT_BYTES = 2_000, 16_000_000


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (range, sentinel, id): each text against the next one of its range."""
    out: list[tuple] = []
    size, prev, done_range = 0, None, None
    for batch in batches:
        cols = [batch.column(i) for i in range(4)]
        for at in range(batch.num_rows):
            part, sentinel, doc_id, text = (c[at].as_py() for c in cols)
            if part == done_range:
                continue
            text = text or ""
            now = (part, doc_id, text, chunk_set(text.encode("utf-8", "surrogatepass")))
            if prev is not None:
                _, pid, ptext, pset = prev
                k = len(ptext) // 4
                edited = (ptext[:len(ptext) - k] + text[:k]).encode("utf-8", "surrogatepass")
                eset = chunk_set(edited)
                out.append((pid, len(ptext), hashlib.sha256(edited).hexdigest(), as_text(pset), as_text(eset),
                            likeness(pset, eset), likeness(pset, now[3])))
                size += len(ptext)
            prev = now
            if sentinel:
                prev, done_range = None, part
            if len(out) >= OUT_ROWS or size >= OUT_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), ARROW)], schema=ARROW)
                out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), ARROW)], schema=ARROW)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of every text, of its edited text, and both likenesses (the columns of RESULT).

    The edited text has its last quarter replaced by the start of the next document's.  Documents follow
    one another by id (null first), rows of the same id by a hash of their text; after the last comes
    the first, and a single document follows itself.  Null texts are empty texts; the fingerprint of an
    empty text is empty.  Repeated rows are rows like any others.  An empty table gives an empty result.
    Other columns are not read.

    Only one shuffle moves texts: into ranges of ids, each of which also gets the first document of the
    next range, so neighbours meet without a window over all rows.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), key.alias("key"), F.col(text_col).alias("text"))
    ranges = RANGES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    # ids alone are dealt into ranges to find where each begins; the driver gets one number a range
    starts = (rows.select("key").distinct().repartitionByRange(ranges, "key")
              .groupBy(F.spark_partition_id().alias("p")).agg(F.min("key").alias("first")).collect())
    first = np.sort(np.array([r["first"] for r in starts], dtype=np.int64))
    if not len(first):
        return spark.createDataFrame([], RESULT)
    count = len(first)

    @F.pandas_udf("struct<part:int,leads:boolean>")
    def place(k: pd.Series) -> pd.DataFrame:
        v = k.to_numpy(dtype=np.int64)
        part = np.searchsorted(first, v, side="right") - 1
        return pd.DataFrame({"part": part.astype(np.int32), "leads": first[part] == v})

    rows = rows.withColumn("at", place("key")).withColumn("th", F.xxhash64("text"))
    own = F.struct(F.col("at.part").alias("part"), F.lit(False).alias("sentinel"))
    ahead = F.struct(F.pmod(F.col("at.part") - 1, F.lit(count)).alias("part"), F.lit(True).alias("sentinel"))
    rows = rows.select("doc_id", "key", "th", "text", F.explode(
        F.when(F.col("at.leads"), F.array(own, ahead)).otherwise(F.array(own))).alias("to"))
    dealt = (rows.select("to.part", "to.sentinel", "doc_id", "text", "key", "th")
             .repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "part")
             .sortWithinPartitions("part", "sentinel", "key", "th"))
    return dealt.select("part", "sentinel", "doc_id", "text").mapInArrow(_compare, RESULT)
