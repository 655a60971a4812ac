"""Mixed fields of JSON text: one parse, rejects, keys that are data."""

import json

import pytest
from pyspark.sql import functions as F

from lakeshore.operators.choices import frequent_keys, land_variants, resolve_choice_text


def test_bad_records_go_to_quarantine(spark, workdir):
    df = spark.createDataFrame([(1, '{"a": 1}'), (2, "oops"), (3, "[1]"), (4, None), (5, '{"a": 2.5, "b": true}')], "n int, j string")
    out = resolve_choice_text(df, "j", keep=["n"], quarantine=f"{workdir}/q")
    assert sorted((r.n, r.a, r.b) for r in out.collect()) == [(1, 1.0, None), (4, None, None), (5, 2.5, True)]
    assert sorted((r.record, r.reason) for r in spark.read.parquet(f"{workdir}/q").collect()) == [("[1]", "no object"), ("oops", "no JSON")]
    with pytest.raises(ValueError, match="2 values"):
        resolve_choice_text(df, "j")
    assert resolve_choice_text(df.where("n = 4"), "j").columns == []


def test_keys_that_are_data_are_kept_in_a_map(spark):
    df = spark.range(3000).select(F.to_json(F.struct(F.col("id").alias("n"), (F.col("id") % 2 == 0).alias("even"))).alias("j"), "id")
    df = df.select("id", F.concat(F.expr("left(j, length(j) - 1)"), F.lit(',"user-'), "id", F.lit('":{"x":'), "id", F.lit("}}")).alias("j"))
    out = resolve_choice_text(df, "j", keep=["id"], rest="others")
    assert out.columns == ["id", "even", "n", "others"]
    rows = out.collect()
    assert len(rows) == 3000 and all(r.n == r.id and r.even == (r.id % 2 == 0) for r in rows)
    assert all({k: json.loads(v) for k, v in r.others.items()} == {f"user-{r.id}": {"x": r.id}} for r in rows)
    assert len(resolve_choice_text(df.limit(50), "j").columns) == 52              # without a map every key is a column
    given = resolve_choice_text(df, "j", ["n"], rest="others").first()
    assert len(given.others) == 2
    assert frequent_keys(land_variants(df, "j")[0], 0.4) == ["even", "n"]


def test_types_of_all_kinds(spark):
    texts = ['{"i": 1, "d": 1, "s": "x", "b": true, "o": {"p": 1}, "m": 1, "z": null, "big": 12345678901234567890}',
             '{"i": 2, "d": 0.5, "s": "y", "b": false, "o": {"p": 2}, "m": "t", "z": null, "big": 1}']
    out = resolve_choice_text(spark.createDataFrame([(t,) for t in texts], "j string"), "j")
    assert dict(out.dtypes) == {"i": "bigint", "d": "double", "s": "string", "b": "boolean", "o": "string", "m": "string",
                                "z": "string", "big": "double"}
    assert {(r.i, r.d, r.s, r.b, r.o, r.m) for r in out.collect()} == {(1, 1.0, "x", True, '{"p":1}', "1"), (2, 0.5, "y", False, '{"p":2}', "t")}
