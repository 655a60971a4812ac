"""Admission control: the source holds its offset until enough files are there, and restarts lose nothing."""

import os
import time

import pytest

from lakeshore.sources.admission import LandedFiles, LandedReader


def land(root, name, age=0.0):
    path = os.path.join(root, "workflow=w", name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write("n\n1\n")
    os.utime(path, (time.time() - age,) * 2)


def reader(root, log, **options):
    return LandedReader({"path": root, "log": log, "glob": "*.csv", **options})


def names(rows):
    return sorted(os.path.basename(r[0]) for r in rows)


def read(source, start, end):
    return names(r for p in source.partitions(start, end) for r in source.read(p))


def test_offsets_wait_for_enough_files_or_long_enough(workdir):
    root, log = os.path.join(workdir, "l"), os.path.join(workdir, "log")
    source = reader(root, log, min_files="2", max_files="3", max_wait="100")
    zero = source.initialOffset()
    assert source.latestOffset() == zero                        # nothing landed yet, not even the folder
    land(root, "a.csv")
    land(root, "x.txt")
    land(root, "_tmp/b.csv")
    assert source.latestOffset() == zero                        # one file waits
    for n in "cdef":
        land(root, f"{n}.csv")
    one = source.latestOffset()
    assert one == {"batch": 1} and read(source, zero, one) == ["a.csv", "c.csv", "d.csv"]
    two = source.latestOffset()
    assert read(source, one, two) == ["e.csv", "f.csv"] and source.latestOffset() == two
    land(root, "old.csv", age=500)                               # has waited long, and is older than all before
    three = source.latestOffset()
    assert read(source, two, three) == ["old.csv"]
    # a restart in the middle: the admitted batch is read again as it was, whatever landed since
    land(root, "g.csv")
    again = reader(root, log, min_files="2", max_files="3", max_wait="100")
    assert read(again, one, two) == ["e.csv", "f.csv"] and again.latestOffset() == three
    land(root, "a.csv", age=200)                                 # written again: new
    assert read(again, three, again.latestOffset()) == ["a.csv", "g.csv"]
    with pytest.raises(ValueError):
        reader(root, log, min_files="5", max_files="2")


def test_stream_over_restarts(spark, workdir):
    root, log, ck = (os.path.join(workdir, n) for n in ("l", "log", "ck"))
    spark.dataSource.register(LandedFiles)
    seen: list[list[str]] = []

    def run(fail=False):
        def handle(batch, batch_id):
            got = names(batch.select("path").collect())
            if fail:
                raise RuntimeError("lost")
            if got:
                seen.append(got)
        files = (spark.readStream.format("landed_files").option("path", root).option("log", log).option("glob", "*.csv")
                 .option("min_files", 2).option("max_files", 2).load())
        q = files.writeStream.foreachBatch(handle).option("checkpointLocation", ck).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    land(root, "a.csv")
    run()
    assert seen == []
    land(root, "b.csv")
    land(root, "c.csv")
    with pytest.raises(Exception, match="lost"):
        run(fail=True)
    run()                                    # the admitted batch again; the third file waits for a second
    assert [x for s in seen for x in s] == ["a.csv", "b.csv"]
    land(root, "d.csv")
    run()
    assert sorted(x for s in seen for x in s) == ["a.csv", "b.csv", "c.csv", "d.csv"] and all(len(s) <= 2 for s in seen)
