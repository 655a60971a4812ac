import json
import os

import pytest
from pyspark.sql import functions as F

from lakeshore.operators import batching, choices, history, lookups, metrics, reports
from lakeshore.operators.validate import schemas_match, validate_schema
from lakeshore.plans.ingest import ingest_flat_reports, ingest_report_documents


def test_metric_prefixes_periods_and_duplicates(spark):
    df = spark.createDataFrame([("A#B#C", "2024-02-29")], "code string, d string")
    assert df.select(metrics.metric_prefixes(F.col("code")).alias("p")).first().p == ["A", "A#B", "A#B#C"]
    keys = df.select(F.explode(metrics.metric_periods(F.lit("A#B"), F.col("d"))).alias("k")).select("k.*")
    assert [tuple(r) for r in keys.collect()] == [
        ("A#B", "A#B", "ROOT"), ("A#B", "A#B.Y2024", "YEARLY"),
        ("A#B", "A#B.M2024-02", "MONTHLY"), ("A#B", "A#B.D2024-02-29", "DAILY")]
    bad = spark.createDataFrame([("A#B#A",)], "code string")
    with pytest.raises(Exception):
        bad.select(metrics.metric_prefixes(F.col("code"))).collect()


def test_rollup_skips_zero_and_counts_versions(spark):
    upd = spark.createDataFrame([("M#N", "2024-01-01", 5, "r1", 1), ("M#N", "2024-01-02", 0, "r2", 2),
                                 ("M", "2024-01-02", 3, "r3", 3)],
                                "code string, date string, value bigint, run_id string, seq bigint")
    out = {(r.metric): (r.value, r.version, r.last_pipeline_execution_id)
           for r in metrics.rollup_metrics(upd).collect()}
    assert out["M"] == (8, 2, "r3")
    assert out["M#N"] == (5, 1, "r1")
    assert out["M.D2024-01-02"] == (3, 1, "r3")
    assert "M#N.D2024-01-02" not in out            # a zero value is not recorded


def test_alerts_once_and_always(spark):
    upd = spark.createDataFrame([("X", "2024-01-01", v, i, f"2024-01-01 0{i}:00:00") for i, v in
                                 enumerate([10, 20, 30, 40], start=1)],
                                "code string, date string, value bigint, seq bigint, ts string") \
        .withColumn("ts", F.col("ts").cast("timestamp"))
    rules = spark.createDataFrame([("X", "DAILY", ">=", 30, "ONCE"), ("X", "ROOT", ">", 50, "ALWAYS"),
                                   ("X", "DAILY", "=", 60, "ONCE")],
                                  "metric string, metric_type string, evaluation string, threshold bigint, "
                                  "notify string")
    out = metrics.metric_alerts(upd, rules, F.date_trunc("hour", "ts"), order=["ts", "seq"])
    got = sorted((r.type, r.threshold, r.value, r.seq) for r in out.collect())
    assert got == [("DAILY", 30, 30, 2), ("DAILY", 60, 60, 3), ("ROOT", 50, 60, 3), ("ROOT", 50, 100, 4)]


def test_object_catalog_deletes_and_latest(spark):
    ev = spark.createDataFrame([("k1", 1, "put", "a"), ("k1", 2, "put", "b"), ("k2", 1, "put", "c"),
                                ("k2", 2, "delete", None), ("k3", 1, "delete", None), ("k3", 2, "put", "d")],
                               "id string, t bigint, op string, v string")
    out = history.object_catalog(ev, "id", ["t"], F.col("op") == "delete")
    assert sorted((r.id, r.v) for r in out.collect()) == [("k1", "b"), ("k3", "d")]


def test_run_history_rejects_updates_after_close(spark):
    ev = spark.createDataFrame(
        [(1, "p", "RUNNING"), (2, "p", "STARTED"), (3, "p", "RUNNING"), (4, "p", "COMPLETED"), (5, "p", "RUNNING"),
         (6, "p", "STARTED"), (7, "p", "FAILED"), (8, "q", "STARTED")],
        "t bigint, pipe string, status string").withColumn("ts", F.timestamp_seconds("t"))
    res = history.run_history(ev, "pipe", "ts", ["t"], "status", "STARTED", ("COMPLETED", "FAILED", "CANCELED"),
                              "COMPLETED", F.date_trunc("day", "ts"))
    runs = sorted((r.pipe, r.run_seq, r.n_updates, r.status, r.active, r.success, r.duration_in_seconds)
                  for r in res["runs"].collect())
    assert runs == [("p", 1, 3, "COMPLETED", False, True, 2.0), ("p", 2, 2, "FAILED", False, False, 1.0),
                    ("q", 1, 1, "STARTED", True, False, None)]
    assert sorted(r.t for r in res["rejected"].collect()) == [1, 5]
    assert sorted((r.t, r.position) for r in res["history"].where("pipe = 'p'").collect()) == \
        [(2, 1), (3, 2), (4, 3), (6, 1), (7, 2)]
    last = history.pipeline_last_run(res["runs"], "pipe").collect()
    assert [(r.pipe, r.last_run_seq, r.last_execution_status) for r in last] == [("p", 1, "COMPLETED")]


def test_bounded_broadcast_checks_size(spark):
    small = spark.range(5)
    big = spark.range(50)
    assert lookups.has_at_most(small, 10) and not lookups.has_at_most(big, 10)
    joined = spark.range(100).join(lookups.bounded_broadcast(small, 10), "id")
    import contextlib
    import io
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        joined.explain()
    assert "BroadcastHashJoin" in buf.getvalue()
    assert joined.count() == 5


def test_newest_per_group_and_union_pages(spark):
    df = spark.createDataFrame([("a", i) for i in range(10)] + [("b", 1)], "g string, id bigint")
    top = batching.newest_per_group(df, ["g"], [F.col("id").desc()], 3)
    assert sorted((r.g, r.id, r.rank) for r in top.collect()) == [("a", 7, 3), ("a", 8, 2), ("a", 9, 1), ("b", 1, 1)]
    p1 = spark.createDataFrame([(1, "x")], "id bigint, a string")
    p2 = spark.createDataFrame([(2, [1])], "id bigint, tags array<int>")
    u = reports.keep_scalar_fields(batching.union_pages([p1, p2]))
    assert u.columns == ["id", "a"] and u.count() == 2


def test_choice_resolution_text(spark):
    df = spark.createDataFrame([('{"id": 1, "pct": 1, "tag": 5}',), ('{"id": 2, "pct": 2.5, "tag": "x"}',),
                                ('{"id": 3, "tag": null}',)], "j string")
    out = choices.resolve_choice_text(df, "j")
    assert dict(out.dtypes) == {"id": "bigint", "pct": "double", "tag": "string"}
    assert sorted((r.id, r.pct, r.tag) for r in out.collect()) == [(1, 1.0, "5"), (2, 2.5, "x"), (3, None, None)]
    nested = spark.createDataFrame([('{"rows": [{"p": 1}, {"p": 1.5}]}',), ('{"rows": []}',)], "j string")
    out2 = choices.resolve_choice_nested(nested, "j", "rows", ["p"])
    assert sorted(r.p for r in out2.collect()) == [1.0, 1.5]


def test_document_with_empty_array_gives_one_table(spark, workdir):
    doc = {"reportSpecification": {"reportType": "SALES", "dataStartTime": "2024-01-01"},
           "dataByAsin": [{"asin": "A1", "combinationPct": 1}, {"asin": "A2", "combinationPct": 0.5}],
           "dataByDate": []}
    path = os.path.join(workdir, "docs")
    os.makedirs(path)
    with open(os.path.join(path, "report-1.json"), "w") as f:
        json.dump(doc, f)
    written = ingest_report_documents(spark, path, "doc_db", "sp", "2024-02-01T00:00:00",
                                      location_root=os.path.join(workdir, "t"))
    assert sorted(written) == ["sp_dataByAsin"]
    rows = written["sp_dataByAsin"].orderBy("asin").collect()
    assert [(r.asin, r.combinationPct) for r in rows] == [("A1", 1.0), ("A2", 0.5)]
    assert dict(written["sp_dataByAsin"].dtypes)["timestamp"] == "timestamp"


def test_flat_report_gzip_and_mixed_types(spark, workdir):
    import gzip
    path = os.path.join(workdir, "flat")
    os.makedirs(path)
    with gzip.open(os.path.join(path, "report-1.json.gz"), "wt") as f:
        json.dump([{"campaignId": 1, "sales14d": 3, "keyword": "a"}, {"campaignId": 2, "sales14d": 2.5, "keyword": 7}], f)
    with open(os.path.join(path, "ignored.txt"), "w") as f:
        f.write("not a report")
    out = ingest_flat_reports(spark, path, "flat_db", "ads", "2024-02-01T00:00:00",
                              location_root=os.path.join(workdir, "t"))
    types = dict(out.dtypes)
    assert (types["campaignId"], types["sales14d"], types["keyword"]) == ("bigint", "double", "string")
    assert sorted((r.campaignId, r.sales14d, r.keyword) for r in out.collect()) == [(1, 3.0, "a"), (2, 2.5, "7")]


def test_schema_validation(spark):
    from pyspark.sql.types import LongType, StringType, StructField, StructType
    exp = StructType([StructField("a", LongType()), StructField("B", StringType())])
    act = StructType([StructField("b", StringType()), StructField("a", LongType())])
    assert schemas_match(exp, act)
    rows = validate_schema(spark, exp, StructType([StructField("a", StringType())])).collect()
    assert [(r.column, r.ok) for r in rows] == [("a", False), ("b", False)]


def test_transform_registry_and_record_function(spark):
    import pandas as pd
    from lakeshore.plans.registry import TransformRegistry, record_function, with_record_column
    reg = TransformRegistry()
    reg.register("memberships", light=reports.keep_scalar_fields,
                 heavy=lambda df: df.withColumn("n", F.lit(1)))
    df = spark.createDataFrame([("p1", [1])], "person_id string, tags array<int>")
    light = reg.apply(df, "memberships", "light")
    assert light.columns == ["person_id"]
    assert reg.apply(light, "memberships", "heavy").columns == ["person_id", "n"]
    assert reg.apply(df, "unknown", "heavy") is df
    with pytest.raises(KeyError):
        reg.apply(df, "unknown", "heavy", required=True)
    upper = record_function(lambda s: s.str.upper(), "string")
    assert with_record_column(light, "u", upper, "person_id").first().u == "P1"


def test_distributed_json_inference_matches_spark_inference(spark, workdir):
    from lakeshore.sources.files import infer_json_schema, variant_schema_to_ddl
    docs = ['[{"a": 1, "b": 1.5, "c": "x", "d": {"e": 1}, "f": [1, 2], "g": null, "h": true, "detail-type": 1, '
            '"a b": 2, "k": [], "big": 12345678901234567890, "exp": 1e5}]',
            '[{"a": 2, "b": 2, "c": 5, "d": "s", "f": [1.5], "g": null, "h": 1, "n": {"x": [{"y": 1}]}, "k": []}]']
    path = os.path.join(workdir, "j")
    os.makedirs(path)
    for i, d in enumerate(docs):
        with open(os.path.join(path, f"r{i}.json"), "w") as f:
            f.write(d)
    ours = infer_json_schema(spark, path)
    theirs = spark.read.option("multiLine", True).json(path).schema
    assert ours.simpleString() == theirs.simpleString()
    assert variant_schema_to_ddl("OBJECT<`x``y`: ARRAY<VOID>, z: DECIMAL(3,0)>") == "struct<`x``y`:array<string>,`z`:bigint>"
