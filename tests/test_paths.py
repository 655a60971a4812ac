from pyspark.sql import functions as F

from lakeshore.functions import paths as P
from lakeshore.functions.events import normalize_event
from lakeshore.functions.naming import sanitize_column, sanitize_identifier


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v")).alias("r")).first().r


def test_workflow_key_and_file_timestamp(spark):
    key = "workflow=standard_geo_date_summary_V3/schedule=adhoc/2023-05-02T21:42:25.904Z-test-report-ver2.csv"
    wk = one(spark, P.parse_workflow_key, key)
    assert (wk.workflow, wk.schedule) == ("standard_geo_date_summary_V3", "adhoc")
    ft = one(spark, P.parse_file_timestamp, wk.file_name)
    assert ft.file_timestamp == "2023-05-02T21-42-25-904Z"
    assert (ft.basename, ft.extension, ft.year, ft.month) == ("test-report-ver2", "csv", "2023", "05")
    assert one(spark, P.parse_version, ft.basename) == "ver2"
    dated = one(spark, P.parse_file_timestamp, "2020-02-04-standard_geo_V3-ver2.csv")
    assert (dated.file_timestamp, dated.basename, dated.hour) == ("2020-02-04", "standard_geo_V3-ver2", "")
    none = one(spark, P.parse_file_timestamp, "plain.csv")
    assert (none.file_timestamp, none.basename) == ("", "")


def test_interactive_results_and_support(spark):
    assert one(spark, P.is_interactive_result, "analytics-0a1b2c3d-0a1b-0a1b-0a1b-0a1b2c3d4e5f")
    assert not one(spark, P.is_interactive_result, "standard_report")
    df = spark.createDataFrame([("w", "s", "CSV"), ("", "s", "csv"), ("w", "s", "json")], "w string, s string, e string")
    assert [r.ok for r in df.select(P.is_supported_workflow_file("w", "s", "e").alias("ok")).collect()] == \
        [True, False, False]


def test_report_key_gz(spark):
    r = one(spark, P.parse_report_key, "team/dataset/my-table/report-123.json.gz")
    assert (r.team, r.dataset, r.table, r.file_name, r.file_extension) == \
        ("team", "dataset", "my-table", "report-123.json", "gz")
    assert one(spark, P.is_supported_report_file, r.file_extension)


def test_table_name_prefix_and_partitions(spark):
    df = spark.createDataFrame([("wf_a", "adhoc", "", ["wf_a"]), ("Wf-B", "weekly", "ver2", ["x"])],
                               "w string, s string, v string, oob array<string>")
    out = df.select(P.derive_table_name(P.table_prefix(F.col("w"), F.lit("ACME"), F.col("oob")),
                                        F.col("w"), F.col("s"), F.col("v")).alias("t")).collect()
    assert [r.t for r in out] == ["amc_wf_a_adhoc", "acme_wf_b_weekly_ver2"]
    path = "customer_hash=abc/export_year=2023/export_month=05/file_last_modified=x/plain"
    assert one(spark, P.partition_values, path) == {"customer_hash": "abc", "export_year": "2023",
                                                      "export_month": "05", "file_last_modified": "x"}
    assert one(spark, P.customer_hash_of, path) == "abc"


def test_uri_and_stage_paths(spark):
    u = one(spark, P.split_uri, "s3://bucket-name/a/b/c.csv")
    assert (u.bucket, u.key) == ("bucket-name", "a/b/c.csv")
    key = "pre-stage/team/dataset/table_x/file.json"
    assert one(spark, P.post_stage_path, key) == "post-stage/team/dataset/table_x/file"
    assert one(spark, P.staged_table_of, key) == "table_x"
    tp = one(spark, P.table_and_partitions_of_key, "pre-stage/team/ds/tbl/k=1/j=2/file.parquet")
    assert (tp.table_path, tp.table, tp.partitions) == ("pre-stage/team/ds/tbl", "tbl", "k=1/j=2")
    assert one(spark, P.classify_stage, "acct-datalake-stage") == "stage"
    assert one(spark, P.classify_stage, "foreign-bucket") == "raw"
    assert one(spark, P.decode_key, "a+b%20c%2Fd") == "a b c/d"


def test_default_report_table_name(spark):
    df = spark.createDataFrame([(None, "eu", "GET SALES"), ("custom", "eu", "x")], "c string, l string, t string")
    rows = df.select(P.default_report_table_name("c", "l", "t", True).alias("n")).collect()
    assert [r.n for r in rows] == ["eu-GETSALES", "custom"]


def test_sanitize(spark):
    assert sanitize_identifier("Crème Brûlée-Count #1") == "creme_brulee_count_1"
    assert one(spark, sanitize_column, "Crème Brûlée-Count #1") == "creme_brulee_count_1"
    assert one(spark, sanitize_column, "Straße Ünïcode") == "straße_unicode"


def test_normalize_event_shapes(spark):
    api = ('{"detail-type": "AWS API Call via CloudTrail", "time": "2024-01-05T10:00:00.123Z", '
           '"detail": {"eventName": "DeleteObject", "requestParameters": {"bucketName": "b-raw", "key": "t/d/f.csv"}}}')
    note = ('{"detail-type": "Object Created", "time": "2024-01-05T10:00:00Z", '
            '"detail": {"bucket": {"name": "b-stage"}, "object": {"key": "t/d/g.csv"}}}')
    df = spark.createDataFrame([(api,), (note,)], "e string")
    rows = df.select(normalize_event("e", F.lit(1).cast("bigint")).alias("n")).collect()
    assert (rows[0].n.bucket, rows[0].n.key, rows[0].n.is_delete) == ("b-raw", "t/d/f.csv", True)
    assert rows[0].n.last_modified_date == "2024-01-05T10:00:00+00:00"
    assert (rows[1].n.bucket, rows[1].n.operation, rows[1].n.is_delete) == ("b-stage", "Object Created", False)


def test_unknown_event_shape_is_an_error(spark):
    import pytest
    df = spark.createDataFrame([('{"detail-type": "Something Else"}',)], "e string")
    with pytest.raises(Exception):
        df.select(normalize_event("e").alias("n")).collect()
    lenient = df.select(normalize_event("e", strict=False).alias("n")).first().n
    assert lenient.bucket is None


def test_file_timestamp_parts_equal_group_extraction(spark):
    # one match laid out in slots gives exactly what one regexp_extract per group gives
    names = ["2024-01-02T03:04:05.678Z-a$1b\\c.csv", "2020-02-04-geo-ver2.csv\nextra",
             "2020-02-04T01:02:03.004Z-x.tar.gz", "2020-02-04-.csv", "2020-2-4-x.csv", ""]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    ft = P.parse_file_timestamp("n")
    timed = F.col("n").rlike(P.FILE_WITH_TIME)
    dated = ~timed & F.col("n").rlike(P.FILE_WITH_DATE)

    def ref(i_time, i_date):
        d = F.regexp_extract("n", P.FILE_WITH_DATE, i_date) if i_date else F.lit("")
        return F.when(timed, F.regexp_extract("n", P.FILE_WITH_TIME, i_time)).when(dated, d).otherwise("")

    got = df.select("n", ft.year, ft.month, ft.day, ft.hour, ft.millisecond, ft.basename, ft.extension)
    want = df.select("n", ref(1, 1), ref(2, 2), ref(3, 3), ref(4, None), ref(7, None), ref(8, 4), ref(9, 5))
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in want.collect())
