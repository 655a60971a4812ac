"""Date macros, time windows and scalar helpers.

Macros such as ``TODAY(-1)`` are resolved once, at plan time, into literals and
then *bound* as query parameters; they are never spliced into SQL text.
"""

from __future__ import annotations

import calendar
import datetime as dt
import operator
import re
from collections.abc import Mapping
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

# Output formats of the macros.
NOW_FORMAT = "%Y-%m-%dT%H:%M:%S"
DEFAULT_MACRO_FORMAT = "%Y-%m-%dT00:00:00"
REPORT_MACRO_FORMAT = "%Y-%m-%d"

#: ``name(offset)``; the offset may be left out where a rule has a default
_CALL = re.compile(r"([A-Za-z]+)\(\s*([^()\s]*)\s*\)")


def _in_month(now: dt.datetime, months: int, day: int | None) -> dt.datetime:
    """``now`` moved to a day (None: the last) of the month that many months away."""
    year, month0 = divmod(now.year * 12 + now.month - 1 + months, 12)
    return now.replace(year=year, month=month0 + 1, day=day or calendar.monthrange(year, month0 + 1)[1])


#: macro name -> (day of an offset, default offset)
_RULES = {
    "TODAY": (lambda now, n: now + dt.timedelta(days=n), 0),
    "FIRSTDAYOFOFFSETMONTH": (lambda now, n: _in_month(now, n, 1), None),
    "FIFTEENTHDAYOFOFFSETMONTH": (lambda now, n: _in_month(now, n, 15), None),
    "LASTDAYOFOFFSETMONTH": (lambda now, n: _in_month(now, n, None), None),
}


def resolve_macro(value, now: dt.datetime | None = None, date_format: str = DEFAULT_MACRO_FORMAT):
    """Resolve one macro value (X1-X5); anything that is not a macro is returned unchanged.

    ``now`` is the clock used for the run; pass it explicitly for reproducible
    runs (tests and scheduled re-runs), otherwise the current time is read at
    call time, never at import time.
    """
    call = _CALL.search(value) if isinstance(value, str) else None
    if call is None:
        return value
    name, offset = call[1].upper(), call[2]
    now = now or dt.datetime.now()
    if name == "NOW" and not offset:
        return now.strftime(NOW_FORMAT)
    rule = _RULES.get(name)
    if rule is None:
        return value
    day, default = rule
    if offset or default is None:
        try:
            default = int(offset)
        except ValueError:
            raise ValueError(f"{value!r} needs a whole number as its offset") from None
    return day(now, default).strftime(date_format)


def resolve_parameters(params: Mapping, now: dt.datetime | None = None,
                       date_format: str = DEFAULT_MACRO_FORMAT) -> dict:
    """A new mapping with every macro resolved, in nested mappings too; lists are data and stay as they are."""
    now = now or dt.datetime.now()
    return {key: resolve_parameters(value, now, date_format) if isinstance(value, Mapping)
            else list(value) if isinstance(value, list) else resolve_macro(value, now, date_format)
            for key, value in params.items()}


# ---- time windows (X9) -------------------------------------------------------------

def time_window_bounds(window_type: str, start: str | None = None, end: str | None = None,
                       zone: str | None = None, now: dt.datetime | None = None
                       ) -> tuple[dt.datetime, dt.datetime]:
    """Half-open [start, end) bounds in UTC for a query time window.

    ``EXPLICIT`` takes macro-resolved start/end text in ``zone``;
    ``MOST_RECENT_WEEK`` is the seven days before ``now``'s date.
    """
    now = now or dt.datetime.now()
    kind = window_type.upper()
    if kind == "EXPLICIT":
        lo = dt.datetime.fromisoformat(resolve_macro(start, now))
        hi = dt.datetime.fromisoformat(resolve_macro(end, now))
    elif kind == "MOST_RECENT_WEEK":
        hi = dt.datetime(now.year, now.month, now.day)
        lo = hi - dt.timedelta(days=7)
    else:
        raise ValueError(f"unsupported time window type {window_type!r}")
    if zone:
        tz = ZoneInfo(zone)
        lo = lo.replace(tzinfo=tz).astimezone(dt.timezone.utc).replace(tzinfo=None)
        hi = hi.replace(tzinfo=tz).astimezone(dt.timezone.utc).replace(tzinfo=None)
    return lo, hi


def in_time_window(ts: Column, bounds: tuple[dt.datetime, dt.datetime]) -> Column:
    """Predicate for a window; literal bounds so Parquet min/max pruning applies."""
    lo, hi = bounds
    return (ts >= F.lit(lo).cast("timestamp_ntz")) & (ts < F.lit(hi).cast("timestamp_ntz"))


# ---- scalars -----------------------------------------------------------------------

def seconds_between(start: Column, end: Column) -> Column:
    """Whole elapsed seconds from ``start`` to ``end``."""
    return F.timestampdiff("SECOND", start, end)


def epoch_millis(ts: Column) -> Column:
    """Epoch milliseconds of a (UTC) timestamp, rounded half-up from microseconds."""
    return F.floor((F.unix_micros(ts.cast("timestamp")) + F.lit(500)) / F.lit(1000)).cast("bigint")


def iso_z(ts: Column) -> Column:
    """ISO-8601 text with milliseconds and a ``Z`` suffix."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def is_valid_date(text: Column) -> Column:
    """X11: text is a real calendar date written ``YYYY-MM-DD``."""
    return (text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$")
            & F.try_to_timestamp(text, F.lit("yyyy-M-d")).isNotNull())


#: The comparisons a rule may name
COMPARISONS = {"=": operator.eq, ">": operator.gt, "<": operator.lt, ">=": operator.ge, "<=": operator.le}


def threshold_met(value: Column, evaluation: Column, threshold: Column) -> Column:
    """The comparison that ``evaluation`` names; a name that is none of COMPARISONS is an error."""
    unknown = F.raise_error(F.concat(F.lit("no comparison has the name "), F.coalesce(evaluation, F.lit("NULL"))))
    results = F.create_map(*[c for name, test in COMPARISONS.items() for c in (F.lit(name), test(value, threshold))])
    return F.when(evaluation.isin(*COMPARISONS), F.element_at(results, evaluation)).otherwise(unknown.cast("boolean"))


def to_text(col: Column, data_type: str) -> Column:
    """Non-native values to text (decimal as digits, dates and timestamps ISO)."""
    kind = data_type.lower()
    if kind.startswith("timestamp"):
        return F.when(F.date_format(col, "SSSSSS") == "000000",
                      F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss")) \
                .otherwise(F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    if kind in ("string", "varchar", "char"):
        return col
    if kind.startswith(("struct", "array", "map")):
        return F.to_json(col)
    return col.cast("string")


def lenient_json(text: Column) -> Column:
    """struct(is_json, value) where value is the parsed VARIANT or NULL.

    Invalid text is not an error; callers keep the original text beside it.
    """
    parsed = F.try_parse_json(text)
    return F.struct(parsed.isNotNull().alias("is_json"), parsed.alias("value"))
