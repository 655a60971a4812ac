"""Tables show what their files last brought: corrected, emptied and filtered files, rejects, redrives, lost jobs."""

import os

import pytest
from pyspark.sql import functions as F

from lakeshore.plans import ingest
from lakeshore.plans.ingest import Customer, ingest_flat_reports, ingest_report_documents, ingest_workflow_results
from lakeshore.sinks.ledger import loads_name, pending_rejects, widen
from lakeshore.streaming.ingest import ingest_stream, redrive

CUSTOMER = Customer("p", "h", ())
STAMP = "2024-01-01 00:00:00"


def write(path, text, age=None):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)
    if age is not None:
        os.utime(path, (age, age))


def rows(spark, name, *cols):
    return sorted(tuple(r) for r in spark.table(name).select(*cols).collect())


def test_csv_files_that_land_again(spark, workdir):
    root, tables = os.path.join(workdir, "l"), os.path.join(workdir, "t")
    at = f"{root}/workflow=w/schedule=adhoc"
    load = lambda: ingest_workflow_results(spark, root, "again_db", CUSTOMER, location_root=tables)
    for n in "abcd":
        write(f"{at}/2024-01-0{ord(n) - 96}-{n}.csv", f"id,v,filtered\n{n}1,1,false\n{n}2,2,false\n", 1_000_000)
    load()
    assert len(rows(spark, "again_db.p_w_adhoc", "id")) == 8
    write(f"{at}/2024-01-01-a.csv", "id,v,filtered\na1,10,false\n", 2_000_000)       # corrected, another time stamp
    write(f"{at}/2024-01-02-b.csv", "id,v,filtered\n")                               # emptied
    write(f"{at}/2024-01-03-c.csv", "id,v,filtered\nc1,1,true\nc2,2,TRUE\n")         # all filtered
    load()
    want = [("a1", 10), ("d1", 1), ("d2", 2)]
    assert rows(spark, "again_db.p_w_adhoc", "id", "v") == want
    # no partition holds one file: year, month and batch only
    parts = [r.partition for r in spark.sql(f"SHOW PARTITIONS again_db.{loads_name('p_w_adhoc')}").collect()]
    assert len(parts) == 2 and all(p.count("/") == 3 and "source_file" not in p for p in parts)


def test_rejects_of_a_corrected_file_are_void_and_never_redriven(spark, workdir):
    root, tables = os.path.join(workdir, "l"), os.path.join(workdir, "t")
    at, q = f"{root}/workflow=w/schedule=adhoc", os.path.join(workdir, "t", "_quarantine", "p_w_adhoc")
    load = lambda: ingest_workflow_results(spark, root, "void_db", CUSTOMER, location_root=tables)
    write(f"{at}/2024-01-01-a.csv", "id,v\n1,1\n")
    load()
    write(f"{at}/2024-01-02-b.csv", "id,v\n2,2.5\n3,3\n")
    write(f"{at}/2024-01-03-c.csv", "id,v\n4,4.5\n")
    load()
    assert pending_rejects(spark, "void_db", "p_w_adhoc", q).count() == 2
    write(f"{at}/2024-01-02-b.csv", "id,v\n2,25\n3,3\n")
    load()
    assert pending_rejects(spark, "void_db", "p_w_adhoc", q).count() == 1
    widen(spark, "void_db", "p_w_adhoc", {"v": "double"})
    assert redrive(spark, q, "void_db", "p_w_adhoc", q + "_2") == 1
    assert redrive(spark, q, "void_db", "p_w_adhoc", q + "_3") == 0             # marked as replayed
    assert rows(spark, "void_db.p_w_adhoc", "id", "v") == [(1, 1.0), (2, 25.0), (3, 3.0), (4, 4.5)]
    write(f"{at}/2024-01-03-c.csv", "id,v\n4,44\n")                            # takes its redriven row along
    load()
    assert rows(spark, "void_db.p_w_adhoc", "id", "v") == [(1, 1.0), (2, 25.0), (3, 3.0), (4, 44.0)]


def test_a_job_that_stops_before_its_commit_shows_nothing(spark, workdir, monkeypatch):
    root, tables = os.path.join(workdir, "l"), os.path.join(workdir, "t")
    at = f"{root}/workflow=w/schedule=adhoc"
    write(f"{at}/2024-01-01-a.csv", "id,v\n1,1\n")
    ingest_workflow_results(spark, root, "half_db", CUSTOMER, location_root=tables)
    write(f"{at}/2024-01-01-a.csv", "id,v\n1,2\n")

    def lost(*_, **__):
        raise RuntimeError("lost")
    monkeypatch.setattr(ingest, "commit", lost)
    with pytest.raises(RuntimeError, match="lost"):
        ingest_workflow_results(spark, root, "half_db", CUSTOMER, location_root=tables)
    assert rows(spark, "half_db.p_w_adhoc", "id", "v") == [(1, 1)]
    monkeypatch.undo()
    ingest_workflow_results(spark, root, "half_db", CUSTOMER, location_root=tables)
    assert rows(spark, "half_db.p_w_adhoc", "id", "v") == [(1, 2)]


def test_reports_that_land_again(spark, workdir):
    root, tables = os.path.join(workdir, "l"), os.path.join(workdir, "t")
    load = lambda: ingest_flat_reports(spark, root, "reland_db", "r", STAMP, location_root=tables)
    write(f"{root}/a.json", '[{"id":1,"timestamp":"own","Source_File":"own"},{"id":2}]')
    write(f"{root}/b.json", '[{"id":3}]')
    load()
    # fields that bear a name of the job's own stay under another one
    assert rows(spark, "reland_db.r", "id", "timestamp_reported", "Source_File_reported")[0] == (1, "own", "own")
    write(f"{root}/a.json", "[]")
    load()
    assert rows(spark, "reland_db.r", "id") == [(3,)]
    write(f"{root}/b.json", '[{"id":3.5}]')
    load()
    assert rows(spark, "reland_db.r", "id") == []
    assert pending_rejects(spark, "reland_db", "r", f"{tables}/_quarantine/r").count() == 1
    write(f"{root}/b.json", '[{"id":4}]')
    load()
    assert rows(spark, "reland_db.r", "id") == [(4,)]
    assert pending_rejects(spark, "reland_db", "r", f"{tables}/_quarantine/r").count() == 0


def test_documents_replace_their_rows_in_all_tables(spark, workdir):
    root, tables = os.path.join(workdir, "l"), os.path.join(workdir, "t")
    load = lambda: ingest_report_documents(spark, root, "redoc_db", "d", STAMP, location_root=tables)
    write(f"{root}/a.json", '{"reportSpecification":{"x":1},"one":[{"id":1}],"two":[{"id":2}]}')
    write(f"{root}/b.json", '{"reportSpecification":{"x":1},"one":[{"id":3}],"two":[]}')
    load()
    write(f"{root}/a.json", '{"reportSpecification":{"x":1},"one":[{"id":10}]}')
    load()
    assert rows(spark, "redoc_db.d_one", "id") == [(3,), (10,)] and rows(spark, "redoc_db.d_two", "id") == []


def test_a_micro_batch_that_runs_twice_adds_nothing(spark, workdir):
    root, ck, tables = (os.path.join(workdir, n) for n in ("l", "ck", "t"))
    at = f"{root}/workflow=w/schedule=adhoc"
    write(f"{at}/2024-01-01-a.csv", "id,v\n1,1\n")
    ingest_stream(spark, root, "twice_db", CUSTOMER, ck, location_root=tables)
    again = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")
    ingest_workflow_results(spark, root, "twice_db", CUSTOMER, files=again, location_root=tables)
    assert rows(spark, "twice_db.p_w_adhoc", "id", "v") == [(1, 1)]
    assert spark.table("twice_db.load_ledger").where(F.col("scope") == "p_w_adhoc").count() == 2
