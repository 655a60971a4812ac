"""A training-data pipeline over ``documents``: each stage applies one operator of lakeshore.llm.

Every stage works on all that its predecessor kept and returns the columns of documents; the last one
returns the layout of the batches.  Stages are pure functions of their input tables, so a stage that is
run again after a failure gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeshore.llm import line_chunks, mixing, ngram_join, packing, toxicity
from lakeshore.llm.common import table, text_batches, word_count, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain (fitted on the labelled ones) rejects go; null texts stay."""
    text_batches(spark)
    labelled = toxicity.labelled_documents(docs, table(spark, sf_dir, "labels"))
    chain = toxicity.fit_chain(labelled, [*toxicity.SEEDS, "toxic"])
    return docs.filter(~toxicity.toxic_column(chain, F.col("text")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has go; so does a document with nothing else in it.

    Documents that were empty before stay.  n_chars follows the text.
    """
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])      # names of any kind stay inside
    out = line_chunks.dedup_lines(docs.select(rest.alias("rest"), "doc_id", "text")).filter(~F.col("emptied"))
    columns = {c: F.col("rest").getField(c) for c in docs.columns if c != "text"} | {"text": F.col("text")}
    if "n_chars" in columns:
        changed = F.length("text").cast(docs.schema["n_chars"].dataType)
        columns["n_chars"] = F.when(F.col("lines_removed") > 0, changed).otherwise(columns["n_chars"])
    return out.select(*[columns[c].alias(c) for c in docs.columns])


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays, once.

    Rows that share an id stay together if one of them does; rows that also share the text become one.
    """
    groups = ngram_join.near_groups(docs)
    ids = groups.groupBy("doc_id").agg(F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("stays"),
                                       F.count(F.lit(1)).alias("rows"))
    ids = written(ids.filter("not stays or rows > 1").select(F.col("doc_id").alias("i"), "stays"), "pipeline-near-copies")
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))       # names of any kind stay inside
    same = F.col("row.doc_id").eqNullSafe(F.col("i"))
    single = row.join(ids, same, "left_anti")
    repeated = row.join(ids.filter("stays"), same, "left_semi").withColumn("id", F.col("row.doc_id"))
    first = repeated.withColumn("th", F.xxhash64("row.text")).dropDuplicates(["id", "th"]).select("row")
    return single.unionByName(first).select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it."""
    return mixing.mixed_documents(docs)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The batch and slot of every row of the mixture, by its number of words."""
    sized = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("n_tokens")), "pipeline-lengths")
    return packing.pack(sized, "n_tokens")


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_repeated_lines), ("ngram_join", keep_one_of_near_copies),
          ("mixing", mix_sources), ("packing", pack_batches)]

#: hashing boundaries, components and dynamic programming have no DuckDB SQL; the stages are tested against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
