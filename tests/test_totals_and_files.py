"""Totals with late rows, footers of all files, bytes written, reports that name their table."""

import datetime as dt
import json
import os
import random

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakeshore.operators.validate import VALIDATE, file_footers, schema_deviations, validate_table_files
from lakeshore.plans.ingest import Customer, ingest_workflow_results
from lakeshore.sinks.tables import create_or_update_table
from lakeshore.sources.files import list_objects
from lakeshore.streaming.ingest import UNKEYED_SCHEMA, keyed_report_stream
from lakeshore.streaming.state import read_log, stream_totals, stream_totals_of

START = dt.datetime(2024, 1, 1)


def test_late_rows_are_corrections_not_losses(spark, workdir):
    rng = random.Random(1)
    rows = [(START + dt.timedelta(hours=rng.randrange(24 * 20)), rng.choice("ab"), rng.randrange(100)) for _ in range(300)] + [(None, "a", 5)]
    rows.sort(key=lambda r: (r[0] or START) + dt.timedelta(days=rng.random() * 8))          # up to eight days late
    src, log, ck = (os.path.join(workdir, n) for n in ("src", "log", "ck"))
    schema = "ts timestamp, k string, v bigint"

    def run():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(src)
        stream_totals(stream, "ts", {"day": F.to_date("ts"), "k": F.col("k")}, {"total": F.sum("v"), "n": F.count(F.lit(1))}, log, ck, "1 day")
    for n in range(6):
        spark.createDataFrame(rows[n * 51:n * 51 + 51], schema).coalesce(1).write.parquet(os.path.join(src, f"p{n}"))
        if n in (2, 5):
            run()
    got = {(r.day, r.k): (r.total, r.n) for r in stream_totals_of(spark, log, ["day", "k"], ["total", "n"]).collect()}
    want: dict = {}
    for t, k, v in rows:
        total, n = want.get((t and t.date(), k), (0, 0))
        want[t and t.date(), k] = (total + v, n + 1)
    assert got == want
    late = stream_totals_of(spark, log, ["day", "k"], ["n"], late=True).agg(F.sum("n")).first()[0]
    assert 0 < late < len(rows) / 2


def test_footers_of_all_files(spark, workdir):
    loc = os.path.join(workdir, "t")
    df = spark.createDataFrame([(1, "x", START, [1], 1.5)], "Id bigint, v string, ts timestamp, a array<int>, n double")
    create_or_update_table(spark, df, "foot_t", location=loc, properties={VALIDATE: "true"})
    assert validate_table_files(spark, "foot_t").collect() == []
    df.withColumn("extra", F.lit(1)).coalesce(1).write.mode("append").parquet(loc)
    df.union(df).drop("v").withColumn("n", F.col("n").cast("string")).coalesce(1).write.mode("append").parquet(loc)
    with open(os.path.join(loc, "part-broken.parquet"), "w") as f:
        f.write("no parquet at all")
    found = {(r.column, r.expected_type, r.actual_type, r.files, r.rows) for r in validate_table_files(spark, "foot_t").collect()}
    assert found == {("extra", None, "int", 1, 1), ("v", "string", None, 1, 2), ("n", "double", "string", 1, 2), (None, "parquet", "no parquet", 1, None)}
    none = spark.createDataFrame([], "path string")
    assert schema_deviations(file_footers(none), StructType()).collect() == []
    create_or_update_table(spark, df, "foot_off", location=os.path.join(workdir, "u"))
    assert validate_table_files(spark, "foot_off") is None


def test_bytes_written_equal_the_listing(spark, workdir):
    root, tables = os.path.join(workdir, "l"), os.path.join(workdir, "t")
    for n in (1, 2):
        path = f"{root}/workflow=w/schedule=adhoc/2024-0{n}-01-a.csv"
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as f:
            f.write("id,v\n" + "".join(f"{i},x{i}\n" for i in range(500)))
        out = ingest_workflow_results(spark, root, "bytes_db", Customer("p", "h", ()), location_root=tables)["p_w_adhoc"]
    listed = list_objects(spark, f"{tables}/p_w_adhoc", "*.parquet").where(F.contains("path", F.lit("load_batch=")))
    newest = max((r.path.split("load_batch=")[1].split("/")[0], r.modificationTime) for r in listed.collect())
    last = spark.table("bytes_db.load_ledger").orderBy(F.col("version").desc()).first().load_batch
    mine = listed.where(F.contains("path", F.lit(last))).agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("b")).first()
    assert newest and (out["files_written"], out["bytes_written"], out["records"]) == (mine.n, mine.b, 1000) and mine.b > 0


def test_reports_that_name_their_table(spark, workdir):
    root, ck, tables = (os.path.join(workdir, n) for n in ("l", "ck", "t"))

    def land(key, rows):
        path = f"{root}/{key}"
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as f:
            json.dump(rows, f)
    land("team/ds/My Table/a.json", [{"id": 1}])
    land("team/ds/other/a.json", [{"id": 2}])
    land("team/a.json", [{"id": 3}])
    manifest = spark.createDataFrame([(f"file:{root}/team/ds/other/a.json", "2024-03-01 00:00:00")], "path string, timestamp string")
    run = lambda: keyed_report_stream(spark, root, "keyed_db", ck, tables, manifest)
    assert [r["tables"] for r in run()] == [["my_table", "other"]] and run() == []
    land("team/ds/My Table/b.json", [{"id": 4, "more": "x"}])
    run()
    assert sorted((r.id, r.more) for r in spark.table("keyed_db.my_table").collect()) == [(1, None), (4, "x")]
    assert spark.table("keyed_db.other").first().timestamp == dt.datetime(2024, 3, 1)
    assert spark.table("keyed_db.my_table").where("timestamp > '2024-06-01'").count() == 2          # the file's own time
    assert [r.path.rsplit("/", 2)[-2:] for r in read_log(spark, f"{ck}/_unkeyed", UNKEYED_SCHEMA).collect()] == [["team", "a.json"]]
