"""Steps whose time grew faster than their input, or with the number of files or keys."""

import csv
import json
import os

import pytest

from lakeshore.plans.ingest import Customer, create_database, ingest_workflow_results
from lakeshore.session import DEFAULT_CONF, scratch_path
from lakeshore.sinks.tables import create_or_update_table, write_rejects
from lakeshore.sources.files import read_workflow_csv
from lakeshore.streaming import ingest as streaming_ingest

LIMIT, SPLIT = "spark.sql.codegen.hugeMethodLimit", "spark.sql.files.maxPartitionBytes"


def test_ingest_sets_the_method_limit_in_foreign_sessions(spark, workdir):
    own = spark.conf.get(LIMIT)
    try:
        spark.conf.unset(LIMIT)
        if LIMIT not in spark.conf.getAll:           # a session that build_session did not make
            create_database(spark, "limit_db", workdir)
            assert spark.conf.get(LIMIT) == DEFAULT_CONF[LIMIT]
        spark.conf.set(LIMIT, "7000")
        create_database(spark, "limit_db", workdir)
        assert spark.conf.get(LIMIT) == "7000"
    finally:
        spark.conf.set(LIMIT, own)


@pytest.mark.parametrize("last, split", [
    ('9,plain,"a ""b"", c"', True), ('9,"two\nlines",x', False), ('9,x"y,"open\nline"', False), ('9,"",""', True)])
def test_csv_files_without_line_breaks_in_fields_are_split(spark, workdir, last, split):
    lines = ["id,name,note", *[f'{k},"n{k}, ""q""",w{k}' for k in range(20_000)], last]
    with open(f"{workdir}/f.csv", "w", newline="") as f:
        f.write("\n".join(lines) + "\n")
    before = spark.conf.get(SPLIT)
    spark.conf.set(SPLIT, "65536")
    try:
        df = read_workflow_csv(spark, workdir, quote_parity=True, with_attributes=False)
        assert (df.rdd.getNumPartitions() > 1) == split
        got = sorted(tuple(x or "" for x in r) for r in df.collect())
    finally:
        spark.conf.set(SPLIT, before)
    with open(f"{workdir}/f.csv", newline="") as f:
        assert got == sorted(tuple(r) for r in list(csv.reader(f))[1:]) or 'x"y' in last
    assert len(got) == 20_001


def test_landed_documents_of_many_blocks_stay_few_and_even(spark, workdir, monkeypatch):
    from lakeshore.plans import ingest_queries as I
    keys = "CASE WHEN id % 1000 = 0 THEN NULL WHEN id = 7 THEN 1000000000000 ELSE id END"      # one key far out
    spark.range(20_000).selectExpr(f"{keys} AS l_orderkey", "1 AS l_linenumber", "2.5D AS l_extendedprice", "'R' AS l_returnflag",
                                   "current_timestamp() AS l_shipdate").write.parquet(f"{workdir}/lineitem.parquet")
    for most, few in ((300, False), (8, True)):
        monkeypatch.setattr(I, "DOCUMENTS", most)
        I.land_line_reports(spark, workdir, f"{workdir}/landing{most}")
        loaded = spark.read.option("recursiveFileLookup", True).option("multiLine", True).json(f"{workdir}/landing{most}")
        assert loaded.count() == 20_000 - 20                # records of a null key are null text
        sizes = [r["count"] for r in loaded.groupBy("_metadata.file_path").count().collect()]
        assert len(sizes) <= 8 if few else len(sizes) == 42 - 1
        assert max(sizes) < 20_000 / 2


def test_runs_take_and_give_plain_rows(spark):
    """No data frame is built per key: with some millions of keys that took most of the time."""
    from types import SimpleNamespace

    from pyspark.sql import Row

    from lakeshore.streaming.lifecycle import RUN_EVENT, Runs

    class Kept:
        def __init__(self):
            self.held = None
        exists = lambda self: self.held is not None                         # noqa: E731
        get = lambda self: self.held                                        # noqa: E731
        update = put = lambda self, x: setattr(self, "held", x)             # noqa: E731
        appendList = lambda self, x: self.put((self.held or []) + x)        # noqa: E731
        clear = lambda self: self.put(None)                                 # noqa: E731

    timers = []
    handle = SimpleNamespace(getValueState=lambda *a: Kept(), getListState=lambda *a: Kept(), registerTimer=timers.append)
    runs = Runs("start", ("end",))
    runs.init(handle)
    rows = [Row(ts_us=t, seq=s, status=x) for t, s, x in ((9_000, 2, "end"), (1_000, 1, "start"), (9_000, None, "late"), (9_000, 1, "more"))]
    assert list(runs.handleInputRows(("k",), iter(rows), None)) == [] and timers == [10]
    runs.waiting.held = [r for r in runs.waiting.held if r[1] is not None]
    out = list(runs.handleExpiredTimer(("k",), SimpleNamespace(getCurrentWatermarkInMs=lambda: 11), None))
    assert [(r.status, r.run_seq, r.position, r.accepted) for r in out] == [("start", 1, 1, True), ("more", 1, 2, True), ("end", 1, 3, True)]
    assert spark.createDataFrame(out, RUN_EVENT).count() == 3


def test_rows_of_a_large_file_stay_in_the_tasks_that_read_its_parts(spark, workdir):
    at, tables = f"{workdir}/l/workflow=w/schedule=adhoc", f"{workdir}/t"
    os.makedirs(at)

    def load(name, rows):
        with open(f"{at}/{name}", "w") as f:
            f.write("id,v\n" + "".join(f"{i},{v}\n" for i, v in rows))
        return ingest_workflow_results(spark, f"{workdir}/l", "parts_db", Customer("p", "h", ()), location_root=tables)["p_w_adhoc"]

    own = {k: spark.conf.get(k) for k in (SPLIT, "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set(SPLIT, "4k")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")      # what Spark takes to be small does not count
        assert load("2024-01-01-a.csv", [(i, i) for i in range(3000)])["files_written"] > 3
        assert load("2024-01-01-a.csv", [(i, f"{i}.5") for i in range(3000)])["rejected"] == 3000
        rejects = f"{tables}/_quarantine/p_w_adhoc"
        assert len([f for _, _, names in os.walk(rejects) for f in names if f.endswith(".parquet")]) > 3
        assert sorted(int(json.loads(r.record)["id"]) for r in spark.read.parquet(rejects).collect()) == list(range(3000))
    finally:
        for k, v in own.items():
            spark.conf.set(k, v)


def test_redrive_holds_no_rows_in_executor_memory(spark, workdir, monkeypatch):
    create_or_update_table(spark, spark.createDataFrame([(1, "a", "f0")], "n bigint, v string, source_file string"),
                           "held_t", ["source_file"], location=f"{workdir}/t")
    record = lambda n: (json.dumps({"n": n, "v": None if n == "3" else "b"}), "n", "f1")
    write_rejects(spark.createDataFrame([record(n) for n in ("2", "3", "oops")],
                                        "record string, reason string, source_file string"), f"{workdir}/q")
    held, cached = [], spark.sparkContext._jsc.getPersistentRDDs
    before = set(cached())

    def write(df, path):
        held.append(set(cached()) - before)
        write_rejects(df, path)

    monkeypatch.setattr(streaming_ingest, "write_rejects", write)
    scratch = scratch_path(spark, "materialized")
    folders = set(os.listdir(scratch)) if os.path.isdir(scratch) else set()
    assert streaming_ingest.redrive(spark, f"{workdir}/q", "default", "held_t", f"{workdir}/q2") == 2
    assert held == [set()]                                                # was: the parsed rows, cached
    assert set(os.listdir(scratch)) == folders                            # the scratch table is given back
    assert sorted(((r.n, r.v) for r in spark.table("held_t").collect())) == [(1, "a"), (2, "b"), (3, None)]
    assert [json.loads(r.record)["n"] for r in spark.read.parquet(f"{workdir}/q2").collect()] == ["oops"]
