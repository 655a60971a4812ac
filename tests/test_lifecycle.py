"""Keyed state that ends and runs in event order, over many micro-batches, late updates and restarts."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from lakeshore.streaming.lifecycle import lifetimes, run_events, runs_of, stream_lifetimes, stream_runs

START = dt.datetime(2024, 1, 1)
SCHEMA = "k string, ts timestamp, seq bigint, status string"


def at(hours):
    return START + dt.timedelta(hours=hours)


def land(spark, src, n, rows):
    spark.createDataFrame([(k, at(h), s, v) for k, h, s, v in rows], SCHEMA).coalesce(1).write.parquet(os.path.join(src, f"p{n:03d}"))


def read(spark, src):
    return spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(src)


def lives(spark, log):
    return sorted(((r.key, r.first_ts, r.last_ts, r.updates, r.payload[-7:-2], r.state) for r in lifetimes(spark, log).collect()), key=str)


def test_lives_end_by_timer_and_late_updates_open_new_ones(spark, workdir):
    src, log, ck = (os.path.join(workdir, n) for n in ("src", "log", "ck"))

    def run():          # a new query on the same checkpoint each time, as after a restart
        stream_lifetimes(read(spark, src), "k", "ts", "seq", "10 hours", log, ck, ["status"], F.col("status") == "stop_", delay="2 hours")

    land(spark, src, 0, [("a", 0, 1, "one_a"), ("b", 0, 2, "one_b"), ("c", 1, 3, "one_c")])
    run()
    land(spark, src, 1, [("a", 5, 5, "two_a"), ("a", 4, 4, "late_"), ("c", 5, 6, "stop_"), ("c", 6, 7, "new_c")])
    run()
    assert [x[0] + x[-1] for x in lives(spark, log)] == ["alive", "blive", "cclosed", "clive"]
    land(spark, src, 2, [("d", 14, 8, "one_d")])                # watermark 12: b is over (0 + 10), a and c are not
    run()
    state = lambda: {r.key.key for r in spark.read.format("statestore").option("path", ck).option("stateVarName", "life").load().collect()}
    assert state() == {"a", "c", "d"}
    land(spark, src, 3, [("b", 15, 9, "two_b"), ("a", 15.5, 10, "three"), ("d", 40, 11, "two_d")])
    run()
    assert lives(spark, log) == sorted([
        ("a", at(0), at(5), 3, "two_a", "expired"), ("a", at(15.5), at(15.5), 1, "three", "expired"), ("b", at(0), at(0), 1, "one_b", "expired"),
        ("b", at(15), at(15), 1, "two_b", "expired"), ("c", at(1), at(5), 2, "stop_", "closed"), ("c", at(6), at(6), 1, "new_c", "expired"),
        ("d", at(14), at(14), 1, "one_d", "expired"), ("d", at(40), at(40), 1, "two_d", "live")], key=str)
    assert state() == {"d"}


def machine(rows):
    """The state machine in plain Python: (key, seq) -> run, position, accepted."""
    out, now = {}, {}
    for k, _, s, v in sorted(rows, key=lambda r: (r[1], r[2])):
        run, place, is_open = now.get(k, (0, 0, False))
        if v == "start":
            run, place, is_open = run + 1, 0, True
        place += is_open
        out[k, s] = (run, place if is_open else None, is_open)
        now[k] = run, place, is_open and v not in ("done", "failed")
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_runs_follow_event_order_whatever_the_batches(spark, workdir, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("abc"), rng.randrange(0, 400) / 4, s, rng.choice(["start", "step", "step", "done", "failed"])) for s in range(120)]
    # updates arrive up to eight hours late, in micro-batches cut anywhere, with restarts
    arrival = sorted(rows, key=lambda r: r[1] + rng.random() * 8)
    src, log, ck = (os.path.join(workdir, n) for n in ("src", "log", "ck"))
    for n in range(6):
        land(spark, src, n, arrival[n * 20:n * 20 + 20])
        if n in (2, 5):
            if n == 5:
                land(spark, src, 6, [("beat", 1000, -1, "step")])
            stream_runs(read(spark, src), "k", "ts", "seq", "status", "start", ("done", "failed"), log, ck, delay="9 hours")
    events = run_events(spark, log).where("key <> 'beat'")
    assert {(r.key, r.seq): (r.run_seq, r.position, r.accepted) for r in events.collect()} == machine(rows)
    runs = runs_of(events, ("done", "failed"), "done").collect()
    want = {}
    for (k, s), (run, place, accepted) in machine(rows).items():
        if accepted:
            want.setdefault((k, run), []).append(place)
    assert {(r.key, r.run_seq): r.n_updates for r in runs} == {key: len(v) for key, v in want.items()}
