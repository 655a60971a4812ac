"""Profiles of text columns: exact, mergeable, and the types that follow from them."""

import os
import random

from pyspark.sql import functions as F

from lakeshore.operators.profiles import column_profiles, merge_profiles, profile_type, stored_types
from lakeshore.plans.ingest import Customer, ingest_workflow_results
from lakeshore.sinks.ledger import pending_rejects, widen
from lakeshore.streaming.ingest import redrive


def types(profiles):
    return {r.name: r.t for r in profiles.select("name", profile_type().alias("t")).collect()}


def test_types_of_profiles(spark):
    rows = [("1", "9007199254740993", "1.5", "9223372036854775808", "true", "x", None, "12345678901.123456", "1.0"),
            ("2.0", "-5", "2e3", "1", "False", "1", None, "2", "-9223372036854775808")]
    cols = ["whole", "big", "real", "huge", "flag", "mixed", "none", "exact", "least"]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols))
    assert types(column_profiles(df, cols)) == {
        "whole": "bigint", "big": "bigint", "real": "double", "huge": "decimal(38,0)", "flag": "boolean", "mixed": "string", "none": "bigint",
        "exact": "decimal(38,6)", "least": "bigint"}
    p = {r.name: r for r in column_profiles(df, cols).collect()}
    assert (int(p["big"].low), int(p["big"].high), p["exact"].scale, p["none"].present, p["mixed"].rows) == (-5, 9007199254740993, 6, 0, 2)


def test_merged_parts_equal_the_whole(spark):
    rng = random.Random(2)
    texts = ["1", "2.50", "-3", "1e5", "abc", "true", None, "99999999999999999999", "0.001"]
    rows = [(rng.randrange(5), rng.choice(texts), rng.choice(texts[:3])) for _ in range(200)]
    df = spark.createDataFrame(rows, "f int, a string, b string")
    whole = sorted(map(str, column_profiles(df, ["a", "b"]).collect()))
    parts = merge_profiles(column_profiles(df, ["a", "b"], ["f"]))
    assert sorted(map(str, parts.select(*column_profiles(df, ["a"]).columns).collect())) == whole


def test_types_for_widening_come_from_stored_profiles(spark, workdir):
    root, tables = os.path.join(workdir, "l"), os.path.join(workdir, "t")

    def load(name, text):
        path = f"{root}/workflow=w/schedule=adhoc/{name}.csv"
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as f:
            f.write(text)
        return ingest_workflow_results(spark, root, "prof_db", Customer("p", "h", ()), location_root=tables, profiles=True)["p_w_adhoc"]

    load("2024-01-01-a", "id,v,x_id\n1,10,7\n")
    out = load("2024-01-02-b", "id,v,x_id\n2,2.5,8\n3,9007199254740993,9\n")
    assert out["rejected"] == 1
    assert stored_types(spark, "prof_db", "p_w_adhoc") == {"id": "bigint", "v": "decimal(38,1)", "x_id": "string"}
    # no raw file is read for this
    for n in ("2024-01-01-a", "2024-01-02-b"):
        os.rename(f"{root}/workflow=w/schedule=adhoc/{n}.csv", f"{workdir}/{n}.csv")
    fits = stored_types(spark, "prof_db", "p_w_adhoc")
    widen(spark, "prof_db", "p_w_adhoc", {"v": fits["v"]})
    q = f"{tables}/_quarantine/p_w_adhoc"
    assert redrive(spark, q, "prof_db", "p_w_adhoc", q + "_2") == 1
    assert sorted(str(r.v) for r in spark.table("prof_db.p_w_adhoc").collect()) == ["10.0", "2.5", "9007199254740993.0"]
    load("2024-01-02-b", "id,v,x_id\n2,3,8\n")                      # a corrected file has a new profile
    assert stored_types(spark, "prof_db", "p_w_adhoc")["v"] == "bigint"
    assert pending_rejects(spark, "prof_db", "p_w_adhoc", q).count() == 0 and spark.table("prof_db.p_w_adhoc").where(F.col("v") == 3).count() == 1
