import datetime as dt
import os

from pyspark.sql import functions as F

from lakeshore.functions.dates import is_valid_date, iso_z, to_text
from lakeshore.operators import batching, filters, history
from lakeshore.sinks.tables import overwrite_table, recover_partitions, write_parquet
from lakeshore.sources.files import list_objects, parquet_schema, with_file_attributes


def test_date_validation_and_text(spark):
    df = spark.createDataFrame([("2024-02-29",), ("2023-02-29",), ("2024-1-5",), ("x",)], "d string")
    assert [r.ok for r in df.select(is_valid_date(F.col("d")).alias("ok")).collect()] == [True, False, True, False]
    ts = spark.createDataFrame([(dt.datetime(2024, 1, 2, 3, 4, 5, 678000),), (dt.datetime(2024, 1, 2),)],
                               "t timestamp_ntz")
    rows = ts.select(to_text(F.col("t"), "timestamp_ntz").alias("x"), iso_z(F.col("t")).alias("z")).collect()
    assert [(r.x, r.z) for r in rows] == [("2024-01-02T03:04:05.678000", "2024-01-02T03:04:05.678Z"),
                                          ("2024-01-02T00:00:00", "2024-01-02T00:00:00.000Z")]


def test_recent_empty_files_and_latest(spark):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 12)), (2, dt.datetime(2023, 12, 30))],
                               "id bigint, created timestamp_ntz")
    assert [r.id for r in filters.recent(df, "created", dt.datetime(2024, 1, 2)).collect()] == [1]
    files = spark.createDataFrame([("a",), ("b",)], "f string")
    rows = spark.createDataFrame([("a", 1)], "f string, v bigint")
    assert [r.f for r in filters.drop_empty_files(rows, ["f"], files).collect()] == ["a"]
    assert history.latest_objects(df, "created").first().id == 1


def test_overwrite_recover_and_footer_schema(spark, workdir):
    path = os.path.join(workdir, "p")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "n bigint, part string")
    write_parquet(df, path, ["part"])
    spark.sql(f"CREATE TABLE misc_parts (n bigint, part string) USING parquet PARTITIONED BY (part) "
              f"LOCATION '{path}'")
    recover_partitions(spark, "misc_parts")
    assert sorted(r.n for r in spark.table("misc_parts").collect()) == [1, 2]
    overwrite_table(spark, df.where("n = 1"), "misc_over")
    overwrite_table(spark, df.where("n = 2"), "misc_over")
    assert [r.n for r in spark.table("misc_over").collect()] == [2]
    write_parquet(spark.createDataFrame([(3, 1.5, "c")], "n bigint, x double, part string"), path, ["part"],
                  mode="append")
    assert "x" in [f.name for f in parquet_schema(spark, path, merge=True).fields]


def test_file_attributes_manifest_and_min_batch_gate(spark, workdir):
    for name in ("a.json", "b.json"):
        with open(os.path.join(workdir, name), "w") as f:
            f.write('{"v": 1}')
    df = with_file_attributes(spark.read.json(workdir))
    assert df.where(F.col("timestamp").isNull()).count() == 0
    listing = list_objects(spark, workdir, "*.json")
    manifest = listing.select("path", F.lit("2024-01-01 00:00:00").alias("timestamp")).limit(1)
    stamped = with_file_attributes(spark.read.json(workdir), manifest)
    stamps = sorted(str(r.timestamp)[:10] for r in stamped.collect())
    assert "2024-01-01" in stamps and len(stamps) == 2
    assert batching.pending_files_ready(listing, None, 2)
    assert not batching.pending_files_ready(listing, listing.limit(1), 2)
    assert batching.micro_batch_options(1, 100) == {"maxFilesPerTrigger": "100"}


def test_csv_quote_parity(spark, workdir):
    from lakeshore.sources.files import read_workflow_csv
    path = os.path.join(workdir, "q.csv")
    with open(path, "w") as f:
        f.write('a,b\n"it\\"s",x\n')
    assert read_workflow_csv(spark, path, with_attributes=False).first().a == 'it"s'
    assert read_workflow_csv(spark, path, with_attributes=False, quote_parity=True).first().a == "it's"
