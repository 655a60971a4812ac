"""Spark-vs-DuckDB comparison used by the tests (same idea as the driver's check:
row count, column names, order-insensitive values with columns sorted by name)."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return repr(float(v))
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return str(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if v is None:
        return "None"
    return str(v)


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    cols = df.columns
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    rows = [tuple(_norm(r[i]) for i in order) for r in df.collect()]
    return [cols[i] for i in order], sorted(rows)


def duck_rows(con, sql: str) -> tuple[list[str], list[tuple]]:
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    rows = [tuple(_norm(r[i]) for i in order) for r in cur.fetchall()]
    return [cols[i] for i in order], sorted(rows)


_DUCK_TO_SPARK = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string",
                  "BOOLEAN": "boolean", "DATE": "date", "TIMESTAMP": "timestamp_ntz", "FLOAT": "float"}


def type_differences(df, con, sql: str) -> dict:
    spark_types = dict(df.dtypes)
    duck_types = {r[0]: _DUCK_TO_SPARK.get(r[1], r[1]) for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    return {c: (spark_types.get(c), duck_types.get(c)) for c in set(spark_types) | set(duck_types)
            if spark_types.get(c) != duck_types.get(c)}


def compare(df, con, sql: str) -> list[str]:
    """Empty list when equal, else human-readable differences."""
    scols, srows = spark_rows(df)
    dcols, drows = duck_rows(con, sql)
    problems = []
    types = type_differences(df, con, sql)
    if types:
        problems.append(f"column types differ (spark, duckdb): {types}")
    if scols != dcols:
        problems.append(f"columns differ: spark={scols} duckdb={dcols}")
    if len(srows) != len(drows):
        problems.append(f"row count differs: spark={len(srows)} duckdb={len(drows)}")
    if not problems and srows != drows:
        sset, dset = set(srows), set(drows)
        only_s = sorted(sset - dset)[:3]
        only_d = sorted(dset - sset)[:3]
        problems.append(f"values differ: spark-only={only_s} duckdb-only={only_d}")
    return problems
