"""The registered queries of this subpackage: one thin opN_<name> per operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeshore.llm import (chunk_prints, dialog_repair, lattice, line_chunks, mixing, ngram_join, packing, prefix_forest,
                           ranked_search, url_filters, wrappers, zip_warc)
from lakeshore.llm import toxicity as tox
from lakeshore.llm.common import table, text_batches, word_count, written
from lakeshore.llm.oracles import ORACLE_SQL  # noqa: F401  read by the entry


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return mixing.mix(sized).select("doc_id", "size", "source_size", "target",
                                    (F.col("copies") * F.col("size")).cast("long").alias("taken"), "source", "copies")


def op2_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return line_chunks.dedup_lines(docs.select("doc_id", "text"))


def op3_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # counted once: the plan of the packing reads the lengths several times
    sized = written(docs.select("doc_id", word_count(F.col("text")).alias("n_tokens")), "pack-lengths")
    return packing.pack(sized, "n_tokens")


def op4_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    return lattice.score(table(spark, sf_dir, "documents"), held_out)


def op5_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return prefix_forest.nearest(rows, rows.filter(F.col("vec_id") % 50 == 0))


def op6_chunk_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark)
    return chunk_prints.fingerprints(table(spark, sf_dir, "documents"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_groups(table(spark, sf_dir, "documents"))


def op8_zip_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zip_warc.round_trip(spark, table(spark, sf_dir, "pages"))


def op9_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(table(spark, sf_dir, "pages"))


def op10_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tox.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = url_filters.rule_table(spark, url_filters.SITE_RULES + url_filters.SPAM_RULES)
    judged = url_filters.judge(table(spark, sf_dir, "pages"), rules)
    return judged.select("page_id", "host", "path", F.when(F.col("tier") == 0, F.col("rule")).alias("rule"), "verdict")


def op12_norm_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_dialog_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialog_repair.damaged_and_audited(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (
    op1_mixing, op2_line_chunks, op3_length_buckets, op4_lattice_likelihood, op5_prefix_forest, op6_chunk_fingerprints,
    op7_ngram_join, op8_zip_warc, op9_wrapper_induction, op10_toxicity_chain,
    op11_url_filters, op12_norm_buckets, op13_dialog_repair)}
