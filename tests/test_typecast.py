"""Typing goldens (FIXTURES.md section 8 cases and SURVEY section 8 quirks)."""

import json
import os

from pyspark.sql import functions as F

from lakeshore.operators import typecast as T
from lakeshore.plans.ingest import Customer, ingest_workflow_results


def typed(spark, rows, schema):
    df = spark.createDataFrame(rows, schema)
    return T.type_text_columns(df)


def test_inference_kinds(spark):
    rows = [("1", "1.5", "true", "x", "2.0", None, "TRUE"),
            ("2", "2", "False", "y", "3", None, "-1"),
            (None, "NA", "TRUE", "", "4.0", "n/a", "false")]
    out, types = typed(spark, rows, "a string, b string, c string, d string, e string, f string, g string")
    assert types == {"a": "bigint", "b": "double", "c": "boolean", "d": "string", "e": "bigint",
                     "f": "bigint", "g": "string"}
    r = out.orderBy(F.col("a").asc_nulls_last()).collect()
    assert [x.a for x in r] == [1, 2, None]
    assert [x.b for x in r] == [1.5, 2.0, None]           # NA is a missing token
    assert [x.c for x in r] == [True, False, True]
    assert [x.d for x in r] == ["x", "y", None]           # blank is missing (Q3: NULL, not 'nan')
    assert [x.e for x in r] == [2, 3, 4]                   # whole-valued decimals narrow (C4)
    assert [x.f for x in r] == [None, None, None]          # all-missing column is BIGINT (Q13)


def test_name_overrides_last_match_wins(spark):
    assert T.name_override("total_cost") == "double"
    assert T.name_override("campaign_id") == "string"
    assert T.name_override("ecpm") == "double"
    assert T.name_override("AVG_rate") == "double"
    assert T.name_override("cost_id") == "string"          # both match, the later pattern wins (Q5)
    assert T.name_override("costume") is None
    out, types = typed(spark, [("10", "5", "7")], "total_cost string, campaign_id string, clicks string")
    assert types == {"total_cost": "double", "campaign_id": "string", "clicks": "bigint"}
    r = out.first()
    assert (r.total_cost, r.campaign_id, r.clicks) == (10.0, "5", 7)


def test_boolean_map(spark):
    df = spark.createDataFrame([(v,) for v in ["true", "True", "TRUE", "false", "False", "FALSE", "-1", "yes"]],
                               "v string")
    got = [r.b for r in df.select(T.map_boolean_text(F.col("v")).alias("b")).collect()]
    assert got == [True, True, True, False, False, False, False, None]


def test_inference_ignores_filtered_rows(spark):
    rows = [("abc", "true"), ("1", "false"), ("2", "FALSE")]
    _, types = typed(spark, rows, "n string, filtered string")
    assert types["n"] == "bigint"                        # Q1: types from unfiltered rows


def test_conform_never_truncates(spark):
    table = T.spark_type("struct<cost:bigint,flag:boolean,amount:decimal(10,2)>")
    df = spark.createDataFrame([(2.0, "TRUE", "1.25"), (2.5, "maybe", "x")], "cost double, flag string, amount string")
    out = T.conform_to_schema(df, table).orderBy(F.col("cost").asc_nulls_last()).collect()
    assert (out[0].cost, out[0].flag, float(out[0].amount), out[0]._bad_columns) == (2, True, 1.25, [])
    assert sorted(out[1]._bad_columns) == ["amount", "cost", "flag"]      # 2.5 is never cut to 2 (Q4)


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_csv_job_goldens(spark, workdir):
    root = os.path.join(workdir, "landing")
    # single data row, no final newline (Q6: still loaded)
    # (raw keys with ':' are renamed by the landing step; Hadoop paths cannot hold ':')
    _write(f"{root}/workflow=one_row/schedule=adhoc/2023-05-02-one.csv", "a,b\n1,x")
    # whole-number costs first, fractions in a later file of the same table
    _write(f"{root}/workflow=costs/schedule=adhoc/2023-05-01-costs.csv", "total_cost,clicks\n1,2\n3,4\n")
    # all rows filtered: the file is skipped
    _write(f"{root}/workflow=hidden/schedule=adhoc/2023-05-01-hidden.csv", "a,filtered\n1,true\n2,TRUE\n")
    # missing text
    _write(f"{root}/workflow=gaps/schedule=adhoc/2023-05-01-gaps.csv", 'name,n\n"",1\nNA,2\nz,\n')
    # interactive result: skipped
    _write(f"{root}/workflow=analytics-0a1b2c3d-0a1b-0a1b-0a1b-0a1b2c3d4e5f/schedule=adhoc/2023-05-01-x.csv", "a\n1\n")
    cust = Customer("ACME", "hash1", ())
    res = ingest_workflow_results(spark, root, "golden_db", cust, location_root=os.path.join(workdir, "tables"))
    assert sorted(res) == ["acme_costs_adhoc", "acme_gaps_adhoc", "acme_one_row_adhoc"]
    one = spark.table("golden_db.acme_one_row_adhoc").collect()
    assert [(r.a, r.b, r.customer_hash, r.export_year) for r in one] == [(1, "x", "hash1", "2023")]
    gaps = spark.table("golden_db.acme_gaps_adhoc").orderBy(F.col("n").asc_nulls_last()).collect()
    assert [(r.name, r.n) for r in gaps] == [(None, 1), (None, 2), ("z", None)]
    costs = spark.table("golden_db.acme_costs_adhoc")
    assert dict(costs.dtypes)["total_cost"] == "double"   # override, never narrowed
    # second batch: fractions and an extra column -> conformed and evolved
    root2 = os.path.join(workdir, "landing2")
    _write(f"{root2}/workflow=costs/schedule=adhoc/2023-06-01-costs.csv", "total_cost,clicks,extra\n2.5,5,e\n")
    ingest_workflow_results(spark, root2, "golden_db", cust, location_root=os.path.join(workdir, "tables"))
    rows = spark.table("golden_db.acme_costs_adhoc").orderBy("total_cost").collect()
    assert [(r.total_cost, r.clicks, r.extra) for r in rows] == [(1.0, 2, None), (2.5, 5, "e"), (3.0, 4, None)]
    props = {r.key: r.value for r in spark.sql("SHOW TBLPROPERTIES golden_db.acme_costs_adhoc").collect()}
    assert props.get("customer_hash") == "hash1"


def test_bad_values_go_to_quarantine(spark, workdir):
    root = os.path.join(workdir, "l1")
    _write(f"{root}/workflow=q/schedule=adhoc/2023-05-01-a.csv", "n\n1\n2\n")
    cust = Customer("p", "h", ())
    tables = os.path.join(workdir, "tables")
    ingest_workflow_results(spark, root, "q_db", cust, location_root=tables)
    root2 = os.path.join(workdir, "l2")
    _write(f"{root2}/workflow=q/schedule=adhoc/2023-05-02-a.csv", "n\n3\nnot-a-number\n")
    quarantine = os.path.join(workdir, "quarantine")
    ingest_workflow_results(spark, root2, "q_db", cust, quarantine_path=quarantine, location_root=tables)
    assert sorted(r.n for r in spark.table("q_db.p_q_adhoc").collect()) == [1, 2, 3]
    bad = spark.read.parquet(f"{quarantine}/p_q_adhoc").collect()
    assert [(json.loads(r.record)["n"], r.reason) for r in bad] == [("not-a-number", "n")]


def test_changed_header_within_one_batch(spark, workdir):
    root = os.path.join(workdir, "hdr")
    _write(f"{root}/workflow=w/schedule=adhoc/2023-05-01-a.csv", "n,v\n1,a\n")
    _write(f"{root}/workflow=w/schedule=adhoc/2023-05-02-b.csv", "n,v,extra_cost\n2,b,1.5\n")
    res = ingest_workflow_results(spark, root, "hdr_db", Customer("p", "h", ()),
                                  location_root=os.path.join(workdir, "t"))
    assert res["p_w_adhoc"]["records"] == 2
    rows = spark.table("hdr_db.p_w_adhoc").orderBy("n").collect()
    assert [(r.n, r.v, r.extra_cost) for r in rows] == [(1, "a", None), (2, "b", 1.5)]


def test_changed_header_read_by_folder_scan(spark, workdir):
    # with no room for file lists, each header group is read from the table folders with its
    # own columns and keeps its files by a join (nothing per file reaches the driver)
    root = os.path.join(workdir, "hdr2")
    _write(f"{root}/workflow=w/schedule=adhoc/2023-05-01-a.csv", "n,v\n1,a\n3,c\n")
    _write(f"{root}/workflow=w/schedule=adhoc/2023-05-02-b.csv", "n,v,extra_cost\n2,b,1.5\n")
    res = ingest_workflow_results(spark, root, "hdr2_db", Customer("p", "h", ()),
                                  location_root=os.path.join(workdir, "t"), max_listed_files=0)
    assert res["p_w_adhoc"]["records"] == 3
    rows = spark.table("hdr2_db.p_w_adhoc").orderBy("n").collect()
    assert [(r.n, r.v, r.extra_cost) for r in rows] == [(1, "a", None), (2, "b", 1.5), (3, "c", None)]
