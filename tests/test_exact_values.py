"""Typing and CSV quoting alter nothing: what does not fit is named, never rounded."""

import decimal
import os

import pytest
from pyspark.sql import functions as F

from lakeshore.operators import typecast as T
from lakeshore.plans.ingest import Customer, ingest_workflow_results

D = decimal.Decimal


@pytest.mark.parametrize("have,value,want,result", [
    ("double", 2.5, "int", None), ("double", 2.0, "int", 2), ("double", 1.239, "decimal(10,2)", None),
    ("double", 1.25, "decimal(10,2)", D("1.25")), ("double", 1e300, "bigint", None), ("double", float("nan"), "int", None),
    ("bigint", 9007199254740993, "double", None), ("bigint", 9007199254740992, "double", 9007199254740992.0),
    ("bigint", 300, "tinyint", None), ("decimal(10,3)", D("1.239"), "decimal(10,2)", None), ("decimal(10,3)", D("1.230"), "decimal(10,2)", D("1.23")),
    ("int", 5, "boolean", None), ("int", 1, "boolean", True), ("timestamp_ntz", "2024-01-01 10:00:00", "date", None),
    ("string", "9007199254740993.0", "bigint", 9007199254740993), ("string", "9007199254740993", "bigint", 9007199254740993),
    ("string", "9223372036854775808.0", "bigint", None), ("string", "0.99999999999999999999", "bigint", None), ("string", "1e3", "bigint", 1000),
    ("string", "1.0000000000000000001e0", "bigint", None), ("string", " 3.0 ", "bigint", 3), ("string", "2.5", "int", None),
    ("string", "300", "tinyint", None), ("string", "1.239", "decimal(10,2)", None), ("string", "1.230", "decimal(10,2)", D("1.23")),
    ("string", "12.5e-1", "decimal(10,2)", D("1.25")), ("string", "12.55e-1", "decimal(10,2)", None), ("string", "x", "decimal(10,2)", None),
    ("string", "2024-01-01 10:00:00", "date", None), ("string", "2024-01-01", "date", "2024-01-01"),
])
def test_a_value_fits_whole_or_is_named(spark, have, value, want, result):
    df = spark.createDataFrame([(str(value),)], "v string").select(F.col("v").cast(have).alias("v"))
    row = T.conform_to_schema(df, T.spark_type(f"struct<v:{want}>")).first()
    assert row._bad_columns == ([] if result is not None else ["v"])
    assert row.v == result or str(row.v) == str(result)


def test_inference_is_exact_beyond_doubles(spark):
    df = spark.createDataFrame([("9007199254740993.0", "0.99999999999999999999", "1.0"), ("1", "1", "2e2")], "a string, b string, c string")
    out, types = T.type_text_columns(df)
    assert types == {"a": "bigint", "b": "double", "c": "bigint"}
    assert sorted(tuple(r) for r in out.collect()) == [(1, 1.0, 200), (9007199254740993, 1.0, 1)]


def test_quotes_of_csv_files(spark, workdir):
    root = os.path.join(workdir, "l")
    folder = f"{root}/workflow=w/schedule=adhoc"
    os.makedirs(folder)
    with open(f"{folder}/2024-01-01-a.csv", "w") as f:          # no backslash: Spark's reader
        f.write('n,v\n1,"a ""b"" c"\n2,"x, ""y"""\n3,5" pipe\n4,"two\nlines, ""q"""\n')
    with open(f"{folder}/2024-01-02-b.csv", "w") as f:          # backslash quotes, also before commas and line ends
        f.write('n,v\n5,"say \\"hi\\", ok"\n6,"she said \\"yes\\""\n\n7,"a ""b"" \\"c\\""\n8,\n9\n10,' + "z" * 200_000 + "\n")
    ingest_workflow_results(spark, root, "quotes_db", Customer("p", "h", ()), location_root=os.path.join(workdir, "t"))
    got = {r.n: r.v for r in spark.table("quotes_db.p_w_adhoc").collect()}
    assert got == {1: 'a "b" c', 2: 'x, "y"', 3: '5" pipe', 4: 'two\nlines, "q"', 5: "say 'hi', ok", 6: "she said 'yes'",
                   7: "a \"b\" 'c'", 8: None, 9: None, 10: "z" * 200_000}
