"""The bucketed running operator against a plain window, with one key holding every row."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from lakeshore.operators.sequence import keyed_running
from conftest import SF_SMALL


def test_keyed_running_matches_plain_window_on_a_hot_key(spark):
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    # one hot key with every row, plus the real users
    hot = ev.withColumn("user_id", F.lit(-1).cast("bigint"))
    df = ev.unionByName(hot.withColumn("event_id", F.col("event_id") + F.lit(10**9)))
    got = keyed_running(df, ["user_id"], ["ts", "event_id"], F.date_trunc("hour", "ts"),
                        sums={"running": F.floor("value").cast("bigint")},
                        lags={"prev_ts": F.col("ts"), "prev_type": F.col("event_type")})
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    want = df.select("*", F.sum(F.floor("value").cast("bigint")).over(
        w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("running"),
        F.lag("ts").over(w).alias("prev_ts"), F.lag("event_type").over(w).alias("prev_type"))
    cols = ["event_id", "user_id", "running", "prev_ts", "prev_type"]
    assert got.select(*cols).exceptAll(want.select(*cols)).count() == 0
    assert want.select(*cols).exceptAll(got.select(*cols)).count() == 0
    assert got.count() == df.count()


def test_hot_key_is_spread_over_buckets(spark):
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet").withColumn("user_id", F.lit(1).cast("bigint"))
    buckets = ev.select(F.date_trunc("hour", "ts").alias("b")).distinct().count()
    assert buckets > 100     # the single key is processed as hundreds of (key, hour) window partitions
