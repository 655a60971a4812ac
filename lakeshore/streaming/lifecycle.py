"""Keyed state that ends: lifetimes of keys with timers, and runs as a state machine in event order.

Both are stateful processors on the RocksDB state store, driven by event time, so a restart goes on from the
checkpoint and the answer depends on the events alone, not on how micro-batches cut them.  Their output is a
change log of micro-batches (``write_batch_partition``), from which the current tables are aggregates.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lakeshore.streaming.state import init_log, read_log, run_available_now, write_batch_partition

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LIVE, EXPIRED, CLOSED = "live", "expired", "closed"

#: ``life`` names a life of a key: the time of the update that opened it (a late one can lie before it)
LIFETIME = "key string, life bigint, first_us bigint, last_us bigint, updates bigint, payload string, state string"
RUN_EVENT = "key string, ts_us bigint, seq bigint, status string, run_seq bigint, position bigint, accepted boolean"
LIFE_ROW, RUN_ROW = (Row(*[c.split()[0] for c in schema.split(", ")]) for schema in (LIFETIME, RUN_EVENT))


def micros(ts: Column | str) -> Column:
    return F.unix_micros(ts)


def timestamp_of(us: str) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def in_order(rows: Iterator[Row]) -> list[Row]:
    """A micro-batch's rows of one key by event time, null sequence numbers last; the micro-batch bounds them."""
    return sorted(rows, key=lambda r: (r["ts_us"], r["seq"] is None, r["seq"] or 0))


class Lifetimes(StatefulProcessor):
    """The latest row of a key until no update came for ``ttl_us`` of event time, or a row closed it.

    A timer at the end of the life takes the key out of the state; a later update starts a new life.
    """

    def __init__(self, ttl_us: int):
        self.ttl_us = ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("life", "life bigint, first_us bigint, last_us bigint, updates bigint, payload string, seq bigint, timer bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        life = tuple(self.state.get()) if self.state.exists() else None
        timer, out = life[6] if life else None, []
        for r in in_order(rows):
            ts, seq, payload = r["ts_us"], r["seq"], r["payload"]
            if life and ts - life[2] > self.ttl_us:
                out.append(LIFE_ROW(key[0], *life[:5], EXPIRED))
                life = None
            if life is None:
                life = (ts, ts, ts, 1, payload, seq)
            elif (ts, seq) >= (life[2], life[5]):
                life = (*life[:2], ts, life[3] + 1, payload, seq)
            else:                                # arrived late: counted, but not the latest
                life = (life[0], min(ts, life[1]), life[2], life[3] + 1, *life[4:6])
            if r["closes"]:
                out.append(LIFE_ROW(key[0], *life[:5], CLOSED))
                life = None
        if timer is not None:
            self.handle.deleteTimer(timer)
        if life is None:
            self.state.clear()
        else:
            timer = (life[2] + self.ttl_us) // 1000 + 1
            self.handle.registerTimer(timer)
            self.state.update((*life[:6], timer))
            out.append(LIFE_ROW(key[0], *life[:5], LIVE))
        yield from out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        out = []
        if self.state.exists():
            life = self.state.get()
            if life[6] == expiredTimerInfo.getExpiryTimeInMs():
                out.append(LIFE_ROW(key[0], *life[:5], EXPIRED))
                self.state.clear()
        yield from out

    def close(self) -> None:
        pass

class Runs(StatefulProcessor):
    """W2 + W3: a start opens a run, the first terminal status closes it; other updates belong to the open run or
    are rejected.

    Updates wait in the state until the watermark has passed them, then they are taken in event order.
    """

    def __init__(self, start: str, terminal: Sequence[str]):
        self.start, self.terminal = start, tuple(terminal)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "run_seq bigint, position bigint, is_open boolean")
        self.waiting = handle.getListState("waiting", "ts_us bigint, seq bigint, status string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        waiting = [(r["ts_us"], r["seq"], r["status"]) for r in in_order(rows)]
        self.waiting.appendList(waiting)
        self.handle.registerTimer(waiting[-1][0] // 1000 + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        waiting = sorted(tuple(r) for r in self.waiting.get())
        ready = [r for r in waiting if r[0] // 1000 < passed]
        if len(ready) < len(waiting):             # a later timer is set for these
            self.waiting.put(waiting[len(ready):])
        else:
            self.waiting.clear()
        run_seq, position, is_open = self.run.get() if self.run.exists() else (0, 0, False)
        out = []
        for ts, seq, status in ready:
            if status == self.start:
                run_seq, position, is_open = run_seq + 1, 0, True
            position += is_open
            out.append(RUN_ROW(key[0], ts, seq, status, run_seq, position if is_open else None, bool(is_open)))
            is_open = is_open and status not in self.terminal
        if ready:
            self.run.update((run_seq, position, is_open))
        yield from out

    def close(self) -> None:
        pass

def _run(stream: DataFrame, processor: StatefulProcessor, schema: str, mode: str, log_path: str, checkpoint: str) -> None:
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    init_log(spark, log_path, f"{schema}, batch_id bigint")
    out = stream.groupBy("key").transformWithState(
        statefulProcessor=processor, outputStructType=schema, outputMode=mode, timeMode="eventTime")
    run_available_now(out, lambda batch, batch_id: write_batch_partition(batch, log_path, batch_id), checkpoint, output_mode=mode)


def stream_lifetimes(stream: DataFrame, key: str, ts: str, seq: str, ttl: str, log_path: str, checkpoint: str,
                     payload: Sequence[str] = (), closes: Column | None = None, delay: str = "0 seconds") -> None:
    """T4 + W5: latest rows of keys that live as long as updates come within ``ttl`` (an interval such as ``3 days``).

    ``delay`` is how late an update may come; ``closes`` marks rows that end a life at once (W1 deletes).
    """
    spark = stream.sparkSession
    ttl_us = spark.sql(f"SELECT unix_micros(TIMESTAMP'1970-01-01 00:00:00Z' + INTERVAL {ttl}) AS us").first().us
    closing = F.coalesce(closes, F.lit(False)) if closes is not None else F.lit(False)
    rows = stream.withWatermark(ts, delay).select(
        F.col(key).cast("string").alias("key"), F.col(ts), micros(ts).alias("ts_us"), F.col(seq).cast("bigint").alias("seq"),
        F.to_json(F.struct(*payload) if payload else F.struct(F.lit(None).alias("_"))).alias("payload"), closing.alias("closes"))
    _run(rows, Lifetimes(ttl_us), LIFETIME, "update", log_path, checkpoint)


def lifetimes(spark: SparkSession, log_path: str) -> DataFrame:
    """Each life of each key as the log knows it last: key, first_ts, last_ts, updates, payload, state."""
    log = read_log(spark, log_path, f"{LIFETIME}, batch_id bigint")
    last = log.groupBy("key", "life").agg(F.max_by(
        F.struct("first_us", "last_us", "updates", "payload", "state"), F.struct("batch_id", (F.col("state") != LIVE).alias("ended"))).alias("r"))
    return last.select("key", timestamp_of("r.first_us").alias("first_ts"), timestamp_of("r.last_us").alias("last_ts"),
                       "r.updates", "r.payload", "r.state")


def stream_runs(stream: DataFrame, key: str, ts: str, seq: str, status: str, start: str, terminal: Sequence[str],
                log_path: str, checkpoint: str, delay: str = "0 seconds") -> None:
    """W2 + W3 as a stream: every update with its run and position, or rejected, in event order."""
    rows = stream.withWatermark(ts, delay).select(
        F.col(key).cast("string").alias("key"), F.col(ts), micros(ts).alias("ts_us"), F.col(seq).cast("bigint").alias("seq"),
        F.col(status).alias("status"))
    _run(rows, Runs(start, terminal), RUN_EVENT, "append", log_path, checkpoint)


def run_events(spark: SparkSession, log_path: str) -> DataFrame:
    """The log of ``stream_runs``: key, ts, seq, status, run_seq, position, accepted."""
    log = read_log(spark, log_path, f"{RUN_EVENT}, batch_id bigint")
    return log.select("key", timestamp_of("ts_us").alias("ts"), "seq", "status", "run_seq", "position", "accepted")


def runs_of(events: DataFrame, terminal: Sequence[str], success: str) -> DataFrame:
    """One row per run of the accepted updates, as the batch ``run_history`` has them."""
    ended = F.col("status").isin(*terminal)
    runs = events.where("accepted").groupBy("key", "run_seq").agg(
        F.min("ts").alias("start_ts"), F.max(F.when(ended, F.col("ts"))).alias("end_ts"), F.count(F.lit(1)).alias("n_updates"),
        F.max_by("status", F.struct("ts", "seq")).alias("status"))
    seconds = (F.unix_micros(F.col("end_ts").cast("timestamp")) - F.unix_micros(F.col("start_ts").cast("timestamp"))) / F.lit(1_000_000.0)
    return runs.select("*", F.col("end_ts").isNull().alias("active"), (F.col("status") == success).alias("success"),
                       seconds.alias("duration_in_seconds"))
