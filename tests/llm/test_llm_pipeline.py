"""The pipeline's stages on planted cases, each judged on its own input."""

import random
from collections import Counter

import corpus_pipeline as P
from conftest import SF_SMALL
from pyspark.sql import functions as F


def test_stages_keep_columns_and_clean_documents(spark):
    rng = random.Random(4)
    line = lambda n: " ".join(f"t{rng.randrange(5000)}" for _ in range(n))
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    passage, text = line(70), line(150)
    near = text.split()
    near[10] = "changed"
    planted = [(9000, line(80)), (9001, line(50) + " idiot moron pathetic trash " + line(20)), (9002, f"{line(20)}\n{passage}"),
               (9003, f"{passage}\n{line(30)}"), (9004, text), (9005, " ".join(near)), (9006, None), (9007, "")]
    rows = spark.createDataFrame([(i, t, "en", "src1", len(t or "")) for i, t in planted], docs.schema)
    stage = dict(P.STAGES)
    table = docs.unionByName(rows)

    more = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("doc_id < 9000").unionByName(rows)
    out = stage["toxicity"](spark, more, "/root/testdata/sf0.1")
    assert out.columns == docs.columns
    left = {r.doc_id for r in out.collect()}
    assert 9001 not in left and {9000, 9002, 9003, 9004, 9005, 9006, 9007} <= left

    out = stage["line_dedup"](spark, table, SF_SMALL)
    got = {r.doc_id: r for r in out.collect()}
    assert out.columns == docs.columns
    assert passage in got[9002].text and passage not in got[9003].text and got[9003].n_chars == len(got[9003].text)
    assert got[9000].text == planted[0][1] and got[9006].text is None and got[9007].text == ""

    out = stage["ngram_join"](spark, table.unionByName(rows), SF_SMALL)
    n = Counter(r.doc_id for r in out.collect())
    assert out.columns == docs.columns and max(n.values()) == 1
    assert 9005 not in n and all(n[i] == 1 for i in (9000, 9001, 9002, 9003, 9004, 9006, 9007))

    out = stage["mixing"](spark, table, SF_SMALL)
    assert out.columns == docs.columns and max(Counter(r.doc_id for r in out.collect()).values()) <= 2


def test_pipeline_runs(spark):
    out = P.run(spark, SF_SMALL)
    assert {"doc_id", "n_tokens", "bucket", "batch", "slot"} <= set(out.columns) and out.count() > 0
    assert out.filter(F.col("n_tokens") > F.col("bucket_length")).count() == 0


def test_stages_carry_columns_of_any_name(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    clashing = ["i", "th", "_th", "id", "row", "rows", "rest", "stays", "emptied", "lines_removed", "n_lines", "times", "_copy", "size", "component_id", "h1"]
    more = docs.select("*", *[F.concat(F.lit(f"{c}-"), F.col("doc_id")).alias(c) for c in clashing])
    plain = {}
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, more, SF_SMALL)
        assert out.columns == more.columns
        got = out.collect()
        assert got and all(r[c] == f"{c}-{r.doc_id}" for r in got for c in clashing)
        plain[name] = Counter((r.doc_id, r.text, r.n_chars) for r in stage(spark, docs, SF_SMALL).collect())
        assert plain[name] == Counter((r.doc_id, r.text, r.n_chars) for r in got)
    assert P.pack_batches(spark, more, SF_SMALL).count() == docs.count()
