"""Fan-out loads and the routed stream: many customers and tables in one batch, nothing lost."""

import json
import os

from pyspark.sql import functions as F

from lakeshore.plans.fan_out import load_files, write_groups
from lakeshore.session import qualified
from lakeshore.sinks.ledger import pending_rejects, served_tables
from lakeshore.streaming.ingest import redrive
from lakeshore.streaming.routing import CATALOG, routed_stream, unrouted_events
from lakeshore.streaming.state import read_log


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def objects(spark, root, *keys):
    rows = [(f"{qualified(spark, root)}/{prefix}/{key}", None, key, prefix, f"h-{prefix}", ["oob"]) for prefix, key in keys]
    return spark.createDataFrame(rows, "path string, length bigint, key string, customer_prefix string, customer_hash string, "
                                       "oob_reports array<string>").withColumn("modificationTime", F.current_timestamp())


def rows(spark, name, *cols):
    return sorted((tuple(r) for r in spark.table(name).select(*cols).collect()), key=str)


def test_tables_are_grouped_by_their_types():
    assert write_groups({"a": {"v": "bigint", "w": "string"}, "b": {"v": "bigint", "x": "double"}, "c": {"V": "bigint"}, "d": {"v": "string"}}) == [
        ["a", "b"], ["c"], ["d"]]


def test_one_batch_feeds_tables_of_any_shape(spark, workdir):
    root, tables = os.path.join(workdir, "l"), os.path.join(workdir, "t")
    at = lambda w, f: f"workflow={w}/schedule=adhoc/{f}"
    write(f"{root}/p/{at('w', '2024-01-01-a.csv')}", 'id,v,note\n1,10,"a ""q"""\n2,NA,"two\nlines"\n')
    write(f"{root}/q/{at('w', '2024-02-01-b.csv')}", "v,id\ntext,1\n")
    write(f"{root}/p/{at('oob', 'nodate.csv')}", "ID,a,A,filtered\n7,x,y,false\n8,z,z,true\n")
    write(f"{root}/q/{at('gone', '2024-01-01-c.csv')}", "id,filtered\n1,true\n")
    write(f"{root}/q/{at('esc', '2024-01-01-d.csv')}", 'id,v\n1,"say \\"hi\\", ok"\n')
    keys = [("p", at("w", "2024-01-01-a.csv")), ("q", at("w", "2024-02-01-b.csv")), ("p", at("oob", "nodate.csv")),
            ("q", at("gone", "2024-01-01-c.csv")), ("q", at("esc", "2024-01-01-d.csv")), ("q", at("never", "2024-01-01-x.csv"))]
    out = load_files(spark, objects(spark, root, *keys), "fan_db", tables)
    assert served_tables(spark, "fan_db") == ["amc_oob_adhoc", "p_w_adhoc", "q_esc_adhoc", "q_w_adhoc"] == sorted(out)
    assert {t: (r["records"], r["rejected"]) for t, r in out.items()} == {
        "amc_oob_adhoc": (2, 0), "p_w_adhoc": (2, 0), "q_esc_adhoc": (1, 0), "q_w_adhoc": (1, 0)}
    assert rows(spark, "fan_db.p_w_adhoc", "id", "v", "note", "customer_hash", "export_month") == [
        (1, 10, 'a "q"', "h-p", "01"), (2, None, "two\nlines", "h-p", "01")]
    assert rows(spark, "fan_db.q_w_adhoc", "id", "v") == [(1, "text")]
    assert rows(spark, "fan_db.amc_oob_adhoc", "id", "a1", "A2", "filtered", "export_year") == [(7, "x", "y", False, None), (8, "z", "z", True, None)]
    assert rows(spark, "fan_db.q_esc_adhoc", "v") == [("say 'hi', ok",)]

    # later batches: known types hold, columns are added, a corrected file replaces its rows, names in any case
    write(f"{root}/p/{at('w', '2024-01-02-e.csv')}", "ID,v,extra\n3,2.5,x\n4,5,y\n")
    write(f"{root}/q/{at('w', '2024-02-01-b.csv')}", "v,id\nfixed,1\n")
    out = load_files(spark, objects(spark, root, ("p", at("w", "2024-01-02-e.csv")), keys[1]), "fan_db", tables)
    assert (out["p_w_adhoc"]["records"], out["p_w_adhoc"]["rejected"]) == (1, 1)
    assert rows(spark, "fan_db.p_w_adhoc", "id", "v", "extra") == [(1, 10, None), (2, None, None), (4, 5, "y")]
    assert rows(spark, "fan_db.q_w_adhoc", "id", "v") == [(1, "fixed")]
    q = f"{tables}/_quarantine/p_w_adhoc"
    bad, = pending_rejects(spark, "fan_db", "p_w_adhoc", q).collect()
    record = json.loads(bad.record)
    assert (record["id"], record["v"], record["extra"], bad.reason) == ("3", "2.5", "x", "v")
    assert redrive(spark, q, "fan_db", "p_w_adhoc", q + "_2") == 0


def test_routed_stream_over_several_batches(spark, workdir):
    lake, events, ck, tables = (os.path.join(workdir, n) for n in ("lake", "events", "ck", "t"))

    def event(bucket, key, kind="Object Created", time="2024-01-05T10:00:00.0Z"):
        return json.dumps({"detail-type": kind, "time": time, "detail": {"bucket": {"name": bucket}, "object": {"key": key}}})

    def api(bucket, key):
        return json.dumps({"detail-type": "AWS API Call via CloudTrail", "time": "2024-01-06T10:00:00.0Z",
                           "detail": {"eventName": "PutObject", "requestParameters": {"bucketName": bucket, "key": key}}})

    key = lambda w, d: f"workflow={w}/schedule=adhoc/2024-01-0{d}-x.csv"
    for b in "ab":
        for d in (1, 2):
            write(f"{lake}/{b}/{key('w', d)}", f"id,v\n{b}{d},{d}\n")
    customers = spark.createDataFrame([("a", "pa", "ha", ["o"], "t", "d"), ("b", "pb", "hb", ["o"], "t", "d"), ("c", "pc", "hc", ["o"], "t", "none")],
                                      "hash_key string, customer_prefix string, customer_hash string, oob_reports array<string>, team string, dataset string")
    registry = spark.createDataFrame([("t-d", "main")], "name string, pipeline string")
    write(f"{events}/1.txt", "\n".join([event("a", key("w", 1)), event("b", key("w", 1)), event("c", key("w", 1)), "no json",
                                        event("a", key("w", 2)), event("a", key("w", 2), "Object Deleted", "2024-01-05T11:00:00.0Z")]) + "\n")
    run = lambda: routed_stream(spark, events, lake, customers, registry, "routed_db", ck, tables, max_files=1)
    assert len(run()) == 1 and run() == []
    assert served_tables(spark, "routed_db") == ["pa_w_adhoc", "pb_w_adhoc"]
    assert rows(spark, "routed_db.pa_w_adhoc", "id", "customer_hash") == [("a1", "ha")]
    write(f"{lake}/b/{key('w', 1)}", "id,v\nb9,9\n")
    write(f"{events}/2.txt", "\n".join([api("b", key("w", 1)), api("b", key("w", 2)), event("elsewhere", "x/y/z.csv")]) + "\n")
    run()
    assert rows(spark, "routed_db.pb_w_adhoc", "id", "v") == [("b2", 2), ("b9", 9)]
    assert sorted((r.reason, r.id) for r in unrouted_events(spark, ck).collect() if r.id) == [
        ("no pipeline", f"s3://c/{key('w', 1)}"), ("no pipeline", "s3://elsewhere/x/y/z.csv")]
    assert unrouted_events(spark, ck).where("reason = 'no known event' AND event = 'no json'").count() == 1
    catalog = read_log(spark, f"{ck}/_catalog", CATALOG)
    assert catalog.where("_deleted").select("id").collect()[0].id == f"s3://a/{key('w', 2)}"
