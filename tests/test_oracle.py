"""Every registered query against its DuckDB oracle at sf0.001 (the driver checks sf0.01)."""

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from oracle import compare, duck

QUERIES = E.queries()
SQL = E.oracle_sql()


def test_every_query_has_an_oracle():
    # queries of the training-data subpackage have SQL only where SQL can express them
    own = {name for name in QUERIES if name != "pipeline" and not name.startswith("op")}
    assert own <= set(SQL) <= set(QUERIES)


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    assert compare(df, con, SQL[name]) == []


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "time_to_conversion" in df.columns
