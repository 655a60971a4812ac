import json
import os

from pyspark.sql import functions as F

from lakeshore.plans.ingest import Customer
from lakeshore.sinks.tables import add_partitions, create_or_update_table, with_sort_keys, write_rejects
from lakeshore.sources.files import list_objects, parquet_schema
from lakeshore.streaming.ingest import ingest_stream, redrive
from lakeshore.streaming.state import current_from_log, stream_latest_per_key


def test_two_writes_with_added_column(spark, workdir):
    loc = os.path.join(workdir, "t")
    a = spark.createDataFrame([(1, "x", "p1")], "id bigint, v string, part string")
    create_or_update_table(spark, a, "sink_db_t", ["part"], {"customer_hash": "h"}, location=loc)
    b = spark.createDataFrame([(2, "y", 1.5, "p2")], "id bigint, v string, extra double, part string")
    create_or_update_table(spark, b, "sink_db_t", ["part"])
    rows = sorted(tuple(r) for r in spark.table("sink_db_t").select("id", "v", "extra", "part").collect())
    assert rows == [(1, "x", None, "p1"), (2, "y", 1.5, "p2")]
    add_partitions(spark, "sink_db_t", [{"part": "p3"}, {"part": "p1"}])
    parts = {r.partition for r in spark.sql("SHOW PARTITIONS sink_db_t").collect()}
    assert {"part=p1", "part=p2", "part=p3"} <= parts
    assert "extra" in [f.name for f in parquet_schema(spark, loc, merge=True).fields]


def test_listing_prunes_content_and_sort_keys(spark, workdir):
    for name, body in (("a.csv", "x\n1\n"), ("b.csv", "")):
        with open(os.path.join(workdir, name), "w") as f:
            f.write(body)
    listing = list_objects(spark, workdir, "*.csv")
    # zero-length objects never reach the listing (F9 holds by construction)
    assert sorted((os.path.basename(r.path), r.length) for r in listing.collect()) == [("a.csv", 4)]
    df = spark.createDataFrame([("2024-01-01", "late", "p")], "date string, reason string, pipeline string")
    assert with_sort_keys(df, {"date_reason": ["date", "reason"]}).first().date_reason == "2024-01-01#late"


def _land(root, name, text):
    path = os.path.join(root, "workflow=s", "schedule=adhoc", name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_ingest_stream_restart_adds_no_rows(spark, workdir):
    root = os.path.join(workdir, "landing")
    ckpt = os.path.join(workdir, "ckpt")
    tables = os.path.join(workdir, "tables")
    _land(root, "2024-01-01-a.csv", "n,v\n1,a\n2,b\n")
    _land(root, "2024-01-02-b.csv", "n,v\n3,c\n")
    spark.sql("CREATE DATABASE IF NOT EXISTS st_db")
    cust = Customer("p", "h", ())
    ingest_stream(spark, root, "st_db", cust, ckpt, location_root=tables, max_files=1)
    assert spark.table("st_db.p_s_adhoc").count() == 3
    ingest_stream(spark, root, "st_db", cust, ckpt, location_root=tables, max_files=1)     # restart: nothing new
    assert spark.table("st_db.p_s_adhoc").count() == 3
    _land(root, "2024-01-03-c.csv", "n,v\n4,d\n")
    # one new file is waiting but the batch minimum is two: nothing runs (O3)
    assert ingest_stream(spark, root, "st_db", cust, ckpt, location_root=tables, max_files=5, min_files=2) == []
    assert spark.table("st_db.p_s_adhoc").count() == 3
    _land(root, "2024-01-04-d.csv", "n,v\n5,e\n")
    ingest_stream(spark, root, "st_db", cust, ckpt, location_root=tables, max_files=5, min_files=2)
    assert sorted(r.n for r in spark.table("st_db.p_s_adhoc").collect()) == [1, 2, 3, 4, 5]


def test_redrive_loads_rows_that_now_conform(spark, workdir):
    loc = os.path.join(workdir, "t")
    create_or_update_table(spark, spark.createDataFrame([(1, "a")], "n bigint, v string"), "rd_t", location=loc)
    spark.sql("DROP TABLE rd_t")
    create_or_update_table(spark, spark.createDataFrame([(1, "a", "f0")], "n bigint, v string, source_file string"), "rd_t",
                           ["source_file"], location=loc + "2")
    q = os.path.join(workdir, "q")
    write_rejects(spark.createDataFrame([('{"n":"2","v":"b"}', "n", "f1"), ('{"n":"oops","v":"c"}', "n", "f1")],
                                        "record string, reason string, source_file string"), q)
    for _ in range(2):      # a second call replaces what the first one loaded
        assert redrive(spark, q, "default", "rd_t", os.path.join(workdir, "q2")) == 1
        assert sorted(r.n for r in spark.table("rd_t").collect()) == [1, 2]
        assert [json.loads(r.record)["n"] for r in spark.read.parquet(os.path.join(workdir, "q2")).collect()] == ["oops"]


def test_latest_per_key_stream_over_two_batches(spark, workdir):
    src = os.path.join(workdir, "src")
    spark.createDataFrame([("k1", 1, "a", False), ("k2", 1, "b", False)], "k string, t bigint, v string, d boolean") \
        .write.parquet(os.path.join(src, "b1"))
    schema = "k string, t bigint, v string, d boolean"
    log, ckpt = os.path.join(workdir, "log"), os.path.join(workdir, "ck")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(src)
    stream_latest_per_key(stream, ["k"], ["t"], log, ckpt, F.col("d"), snapshot_every=1)
    spark.createDataFrame([("k1", 2, "c", False), ("k2", 2, None, True)], schema).write.parquet(os.path.join(src, "b2"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(src)
    stream_latest_per_key(stream, ["k"], ["t"], log, ckpt, F.col("d"), snapshot_every=1)
    cur = current_from_log(spark, log, ["k"], ["t"]).collect()
    assert [(r.k, r.v) for r in cur] == [("k1", "c")]
    snaps = spark.read.parquet(log + "_snapshots")
    assert sorted(r.batch_id for r in snaps.select("batch_id").distinct().collect()) == [0, 1]
    spark.createDataFrame([("k3", 3, "z", False)], schema).write.parquet(os.path.join(src, "b3"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(src)
    stream_latest_per_key(stream, ["k"], ["t"], log, ckpt, F.col("d"), snapshot_every=5)
    cur = current_from_log(spark, log, ["k"], ["t"]).collect()   # snapshot of batch 1 + delta of batch 2
    assert sorted((r.k, r.v) for r in cur) == [("k1", "c"), ("k3", "z")]


def test_report_stream_flat_and_documents(spark, workdir):
    import gzip
    import json
    from lakeshore.streaming.ingest import report_stream
    flat = os.path.join(workdir, "flat")
    os.makedirs(flat)
    for i in range(3):
        with gzip.open(os.path.join(flat, f"report-{i}.json.gz"), "wt") as f:
            json.dump([{"campaignId": i, "sales14d": i + 0.5 if i else 1}], f)
    spark.sql("CREATE DATABASE IF NOT EXISTS rs_db")
    ck = os.path.join(workdir, "ck1")
    out = report_stream(spark, flat, "rs_db", "ads", ck, location_root=os.path.join(workdir, "t"), max_files=2)
    assert len(out) == 2
    assert sorted(r.campaignId for r in spark.table("rs_db.ads").collect()) == [0, 1, 2]
    assert report_stream(spark, flat, "rs_db", "ads", ck, location_root=os.path.join(workdir, "t")) == []
    docs = os.path.join(workdir, "docs")
    os.makedirs(docs)
    with open(os.path.join(docs, "d.json"), "w") as f:
        json.dump({"reportSpecification": {"reportType": "X"}, "rows": [{"a": 1}], "other": []}, f)
    report_stream(spark, docs, "rs_db", "sp", os.path.join(workdir, "ck2"), documents=True,
                  location_root=os.path.join(workdir, "t2"))
    assert [r.a for r in spark.table("rs_db.sp_rows").collect()] == [1]


def test_stream_alerts_over_many_batches_match_batch(spark, workdir):
    from lakeshore.operators.metrics import metric_alerts
    from lakeshore.streaming.state import stream_metric_alerts
    from conftest import SF_SMALL
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    updates = ev.select(F.col("event_type").alias("code"), F.date_format("ts", "yyyy-MM-dd").alias("date"),
                        F.floor("value").cast("bigint").alias("value"), F.col("event_id").alias("seq"), "ts")
    src = os.path.join(workdir, "src")
    days = [r.d for r in updates.select(F.col("date").alias("d")).distinct().orderBy("d").collect()]
    for i, d in enumerate(days[:6]):            # one file per day, written in time order
        updates.where(F.col("date") == d).coalesce(1).write.parquet(os.path.join(src, f"p{i:02d}"))
    rules = spark.createDataFrame([("purchase", "DAILY", ">=", 40, "ONCE"), ("view", "ROOT", ">", 100, "ALWAYS"),
                                   ("click", "MONTHLY", ">=", 150, "ONCE")],
                                  "metric string, metric_type string, evaluation string, threshold bigint, "
                                  "notify string")
    stream = (spark.readStream.schema(updates.schema).option("recursiveFileLookup", True)
              .option("maxFilesPerTrigger", 1).parquet(src))
    got = stream_metric_alerts(spark, stream, rules, os.path.join(workdir, "state"), os.path.join(workdir, "ck"),
                               ["ts", "seq"], F.date_trunc("hour", "ts"), snapshot_every=2).drop("batch_id")
    want = metric_alerts(updates.where(F.col("date").isin(days[:6])), rules, F.date_trunc("hour", "ts"),
                         order=["ts", "seq"])
    cols = ["root", "metric", "type", "threshold", "value", "seq"]
    assert got.count() > 0
    assert got.select(*cols).exceptAll(want.select(*cols)).count() == 0
    assert want.select(*cols).exceptAll(got.select(*cols)).count() == 0


def test_partition_overwrite_keeps_other_partitions(spark, workdir):
    loc = os.path.join(workdir, "po")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "static")
    try:
        a = spark.createDataFrame([(1, "p1"), (2, "p2")], "id bigint, part string")
        create_or_update_table(spark, a, "po_t", ["part"], location=loc)
        b = spark.createDataFrame([(3, "p2")], "id bigint, part string")
        create_or_update_table(spark, b, "po_t", ["part"], overwrite_partitions=True)
        assert sorted((r.id, r.part) for r in spark.table("po_t").collect()) == [(1, "p1"), (3, "p2")]
        assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == "static"
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
