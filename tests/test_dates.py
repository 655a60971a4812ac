import datetime as dt

from lakeshore.functions.dates import resolve_macro, resolve_parameters, time_window_bounds
from lakeshore.plans.workflow import bind_custom_parameters

NOW = dt.datetime(2024, 3, 15, 13, 45, 10)


def test_now_and_today():
    assert resolve_macro("NOW()", NOW) == "2024-03-15T13:45:10"
    assert resolve_macro("now()", NOW) == "2024-03-15T13:45:10"
    assert resolve_macro("TODAY()", NOW) == "2024-03-15T00:00:00"
    assert resolve_macro("TODAY(-1)", NOW) == "2024-03-14T00:00:00"
    assert resolve_macro("TODAY(20)", NOW, "%Y-%m-%d") == "2024-04-04"


def test_month_offsets_and_leap_years():
    assert resolve_macro("FIRSTDAYOFOFFSETMONTH(-2)", NOW) == "2024-01-01T00:00:00"
    assert resolve_macro("FIFTEENTHDAYOFOFFSETMONTH(1)", NOW) == "2024-04-15T00:00:00"
    assert resolve_macro("LASTDAYOFOFFSETMONTH(-1)", NOW) == "2024-02-29T00:00:00"      # leap year
    assert resolve_macro("LASTDAYOFOFFSETMONTH(11)", NOW) == "2025-02-28T00:00:00"
    assert resolve_macro("LASTDAYOFOFFSETMONTH(-3)", NOW, "%Y-%m-%d") == "2023-12-31"
    assert resolve_macro("FIRSTDAYOFOFFSETMONTH(-15)", NOW, "%Y-%m-%d") == "2022-12-01"


def test_non_macros_unchanged():
    assert resolve_macro("plain", NOW) == "plain"
    assert resolve_macro(5, NOW) == 5
    assert resolve_macro(None, NOW) is None


def test_nested_parameters():
    params = {"a": "TODAY(-1)", "b": {"c": "LASTDAYOFOFFSETMONTH(0)", "d": ["TODAY()"]}, "e": 3}
    out = resolve_parameters(params, NOW, "%Y-%m-%d")
    assert out == {"a": "2024-03-14", "b": {"c": "2024-03-31", "d": ["TODAY()"]}, "e": 3}
    assert params["a"] == "TODAY(-1)"     # input untouched


def test_time_window_bounds_zone():
    lo, hi = time_window_bounds("EXPLICIT", "FIRSTDAYOFOFFSETMONTH(-1)", "FIRSTDAYOFOFFSETMONTH(0)",
                                "America/New_York", NOW)
    assert lo == dt.datetime(2024, 2, 1, 5, 0)
    assert hi == dt.datetime(2024, 3, 1, 5, 0)
    lo, hi = time_window_bounds("MOST_RECENT_WEEK", now=NOW)
    assert (lo, hi) == (dt.datetime(2024, 3, 8), dt.datetime(2024, 3, 15))


def test_custom_parameter_binding():
    sql = "SELECT CUSTOM_PARAMETER('report_date'), a FROM t WHERE b = CUSTOM_PARAMETER('x') GROUP BY 1"
    out = bind_custom_parameters(sql)
    assert out == "SELECT :report_date AS report_date, a FROM t WHERE b = :x GROUP BY 1"
