"""Property test of the CSV typing rules (C1-C4, C10): random text columns typed by the
engine agree with a small Python model of the rules, both in the chosen type and in
every value."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lakeshore.operators.typecast import FALSE_TEXT, NULL_TOKENS, TRUE_TEXT, type_text_columns

INT64 = 2 ** 63

_ints = st.integers(-10 ** 12, 10 ** 12).map(str)
_huge_ints = st.integers(10 ** 19, 10 ** 21).map(str)          # integer text beyond BIGINT
_decimals = st.tuples(st.booleans(), st.integers(0, 10 ** 6), st.sampled_from([0, 0, 5, 250, 999])).map(
    lambda t: f"{'-' if t[0] else ''}{t[1]}.{t[2]:03d}")
_bools = st.sampled_from(TRUE_TEXT + FALSE_TEXT)
_missing = st.sampled_from(["", "NA", "null", "n/a", "None", "NaN"])
_words = st.text(alphabet="bcdxyz-_ ", min_size=1, max_size=6)

# columns that lean towards one kind, with a chance of other kinds mixed in
_column = st.one_of(
    st.lists(st.one_of(_ints, _missing), min_size=1, max_size=12),
    st.lists(st.one_of(_ints, _decimals, _missing), min_size=1, max_size=12),
    st.lists(st.one_of(_bools, _missing), min_size=1, max_size=12),
    st.lists(st.one_of(_ints, _huge_ints), min_size=1, max_size=12),
    st.lists(st.one_of(_ints, _decimals, _bools, _words, _missing), min_size=1, max_size=12),
    st.lists(_missing, min_size=1, max_size=4),
)


def _class(v):
    if v is None or v in NULL_TOKENS:
        return None
    if v in TRUE_TEXT + FALSE_TEXT:
        return "bool"
    if re.fullmatch(r"[+-]?\d+", v) and -INT64 <= int(v) < INT64:
        return "int"
    if re.fullmatch(r"[+-]?\d+(\.\d+)?", v):
        f = float(v)
        return "whole" if f.is_integer() and abs(f) < 9.2e18 else "fraction"
    return "text"


def _model_type(values):
    classes = {_class(v) for v in values} - {None}
    if not classes:
        return "bigint"
    if classes == {"bool"}:
        return "boolean"
    if "text" in classes or "bool" in classes:
        return "string"
    if "fraction" in classes:
        return "double"
    return "bigint"


def _model_value(v, type_name):
    if v is None or v in NULL_TOKENS:
        return None
    if type_name == "boolean":
        return v in TRUE_TEXT
    if type_name == "bigint":
        return int(v) if _class(v) == "int" else int(float(v))
    if type_name == "double":
        return float(v)
    return v


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=_column)
def test_typing_matches_the_rules(spark, values):
    rows = [(str(i), v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "rid string, c string")
    typed, types = type_text_columns(df)
    want = _model_type(values)
    assert types == {"rid": "bigint", "c": want}
    got = {r.rid: r.c for r in typed.collect()}
    assert got == {i: _model_value(v, want) for i, (_, v) in enumerate(rows)}
