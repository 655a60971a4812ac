"""Ingest loses and alters nothing: odd names, text, types, broken files, re-runs, NULL keys."""

import json
import os

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lakeshore.functions.paths import parse_file_timestamp
from lakeshore.operators import filters
from lakeshore.operators.choices import resolve_choice_text
from lakeshore.operators.history import object_catalog
from lakeshore.operators.sequence import keyed_running
from lakeshore.plans.ingest import Customer, ingest_flat_reports, ingest_report_documents, ingest_workflow_results
from lakeshore.sinks.tables import create_or_update_table

CUSTOMER = Customer("p", "h", ())


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def _rows(spark, name, *cols):
    return sorted(tuple(r) for r in spark.table(name).select(*cols).collect())


def test_names_with_blanks_and_upper_case_extensions(spark, workdir):
    root, tables = os.path.join(workdir, "l"), os.path.join(workdir, "t")
    _write(f"{root}/workflow=my report/schedule=adhoc/2024-01-05-x y+z.csv", "n,v\n1,a\n")
    _write(f"{root}/workflow=my report/schedule=adhoc/2024-01-06-b.CSV", "n,v\n2,b\n")
    out = ingest_workflow_results(spark, root, "blank_db", CUSTOMER, location_root=tables)
    (name, stats), = out.items()
    assert stats["records"] == 2 and stats["files"] == 2 and stats["rejected"] == 0
    assert _rows(spark, f"blank_db.{name}", "n", "v") == [(1, "a"), (2, "b")]


def test_text_columns_keep_their_text_and_a_rerun_replaces_itself(spark, workdir):
    tables = os.path.join(workdir, "t")
    first, second = os.path.join(workdir, "l1"), os.path.join(workdir, "l2")
    _write(f"{first}/workflow=w/schedule=adhoc/2024-01-01-a.csv", "code,qty\nA7,1\n")
    _write(f"{second}/workflow=w/schedule=adhoc/2024-01-02-b.csv", "code,qty\n007,3.0\n1e5,4\nTRUE,2.5\n")
    ingest_workflow_results(spark, first, "text_db", CUSTOMER, location_root=tables)
    for _ in range(2):
        out = ingest_workflow_results(spark, second, "text_db", CUSTOMER, location_root=tables)["p_w_adhoc"]
        assert (out["records"], out["rejected"]) == (2, 1)
        assert _rows(spark, "text_db.p_w_adhoc", "code", "qty") == [("007", 3), ("1e5", 4), ("A7", 1)]
        bad = spark.read.parquet(f"{tables}/_quarantine/p_w_adhoc").collect()
        assert [(json.loads(r.record)["code"], json.loads(r.record)["qty"], r.reason) for r in bad] == [("TRUE", "2.5", "qty")]


def test_quoted_line_breaks_and_escaped_quotes(spark, workdir):
    root = os.path.join(workdir, "l")
    _write(f"{root}/workflow=w/schedule=adhoc/2024-01-01-a.csv", 'n,v\n1,"two\nlines"\n2,"it\\"s"\n')
    ingest_workflow_results(spark, root, "quote_db", CUSTOMER, location_root=os.path.join(workdir, "t"))
    assert _rows(spark, "quote_db.p_w_adhoc", "n", "v") == [(1, "two\nlines"), (2, "it's")]


def test_hyphen_time_stamp(spark):
    ts = spark.createDataFrame([("2024-01-05T10-20-30-123Z-x-ver2.csv",)], "f string").select(
        parse_file_timestamp("f").alias("t")).first().t
    assert (ts.year, ts.month, ts.hour, ts.millisecond, ts.basename, ts.extension) == ("2024", "01", "10", "123", "x-ver2", "csv")


def test_flat_reports_keep_every_record(spark, workdir):
    a, b, tables = os.path.join(workdir, "a"), os.path.join(workdir, "b"), os.path.join(workdir, "t")
    _write(f"{a}/one.json", '[{"id":1,"v":1}]')
    _write(f"{b}/two.JSON", '[{"id":2,"v":2.5},{"id":3,"v":4.0}]')
    _write(f"{b}/broken.json", '[{"id":4,')
    ingest_flat_reports(spark, a, "flat_db", "r", "2024-01-01 00:00:00", location_root=tables)
    for _ in range(2):
        ingest_flat_reports(spark, b, "flat_db", "r", "2024-01-01 00:00:00", location_root=tables)
        assert _rows(spark, "flat_db.r", "id", "v") == [(1, 1), (3, 4)]
        bad = sorted((r.reason, r.record) for r in spark.read.parquet(f"{tables}/_quarantine/r").collect())
        assert [x[0] for x in bad] == ["no JSON", "v"] and json.loads(bad[1][1])["id"] == 2


def test_report_documents_keep_every_record(spark, workdir):
    tables = os.path.join(workdir, "t")
    for n, v in (("a", "1"), ("b", "1.75")):
        _write(f"{workdir}/{n}/d.json", f'{{"reportSpecification":{{"x":1}},"rows":[{{"id":"{n}","v":{v}}}]}}')
        ingest_report_documents(spark, f"{workdir}/{n}", "docs_db", "d", "2024-01-01 00:00:00", location_root=tables)
    assert _rows(spark, "docs_db.d_rows", "id", "v") == [("a", 1)]
    bad, = spark.read.parquet(f"{tables}/_quarantine/d_rows").collect()
    assert json.loads(bad.record) == {"id": "b", "v": 1.75}


def test_direct_writes_never_cut_values(spark, workdir):
    create_or_update_table(spark, spark.createDataFrame([(1,)], "n bigint"), "cut_t", location=os.path.join(workdir, "t"))
    create_or_update_table(spark, spark.createDataFrame([(2.0,)], "n double"), "cut_t")
    with pytest.raises(Exception, match="do not fit"):
        create_or_update_table(spark, spark.createDataFrame([(2.5,)], "n double"), "cut_t")
    assert _rows(spark, "cut_t", "n") == [(1,), (2,)]


def test_null_keys_are_keys(spark):
    df = spark.createDataFrame([(None, 1, 5), (None, 2, 7), ("a", 1, 1), ("a", None, 2)], "k string, t int, v int")
    got = keyed_running(df, ["k"], ["t"], F.col("t"), sums={"s": F.col("v")}, lags={"p": F.col("v")})
    w = Window.partitionBy("k").orderBy("t")
    want = df.withColumn("s", F.sum("v").over(w)).withColumn("p", F.lag("v").over(w))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    files = spark.createDataFrame([(None, "false"), ("f", "true")], "f string, filtered string")
    assert [r.f for r in filters.drop_all_filtered_files(files, ["f"]).collect()] == [None]
    events = spark.createDataFrame([("x", 1, None), ("y", 1, True)], "k string, t int, d boolean")
    assert [r.k for r in object_catalog(events, "k", ["t"], F.col("d")).collect()] == ["x"]


def test_choice_keys_with_dots(spark):
    df = spark.createDataFrame([('{"a.b": 1, "c": "x"}',), ('{"a.b": 2.5}',)], "j string")
    rows = resolve_choice_text(df, "j").collect()
    assert sorted((r["a.b"], r["c"]) for r in rows) == [(1.0, "x"), (2.5, None)]
