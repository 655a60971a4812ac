"""Parameterised analytic workflows (X6-X9, A1/A2 as shipped SQL).

A workflow definition is SQL text plus declared input parameters; an execution
request adds a time window and parameter values that may be date macros.  The
runner resolves macros at plan time, restricts the source views to the time
window, and hands the text to ``spark.sql`` with the values *bound* as named
parameters, so Catalyst parses, optimises and constant-folds the literals.

Two dialect functions of the workflow language are provided as session SQL
functions (inlined by the analyzer, no Python at run time):
``SECONDS_BETWEEN(a, b)`` and ``CUSTOM_PARAMETER('name')``, the latter as a
named parameter marker.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from lakeshore.functions.dates import (DEFAULT_MACRO_FORMAT, in_time_window, resolve_parameters,
                                       time_window_bounds)

_CUSTOM_PARAMETER = re.compile(r"CUSTOM_PARAMETER\s*\(\s*'([A-Za-z_][A-Za-z0-9_]*)'\s*\)", re.IGNORECASE)
_ENDS_SELECT_ITEM = re.compile(r"\s*(,|FROM\b)", re.IGNORECASE)


def register_dialect_functions(spark: SparkSession) -> None:
    """``SECONDS_BETWEEN``: whole elapsed seconds, for NTZ and zoned timestamps alike."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION seconds_between(a TIMESTAMP_NTZ, b TIMESTAMP_NTZ) "
              "RETURNS BIGINT RETURN timestampdiff(SECOND, a, b)")


def bind_custom_parameters(sql_text: str) -> str:
    """``CUSTOM_PARAMETER('x')`` -> named marker ``:x``; an unaliased select item is named ``x``."""
    out, pos = [], 0
    for m in _CUSTOM_PARAMETER.finditer(sql_text):
        out.append(sql_text[pos:m.start()])
        name = m.group(1)
        tail = sql_text[m.end():]
        out.append(f":{name} AS {name}" if _ENDS_SELECT_ITEM.match(tail) else f":{name}")
        pos = m.end()
    out.append(sql_text[pos:])
    return "".join(out)


def run_workflow(spark: SparkSession, definition: Mapping, request: Mapping,
                 sources: Mapping[str, tuple[DataFrame, str]],
                 now: dt.datetime | None = None) -> DataFrame:
    """Execute a workflow definition for one request.

    ``sources`` maps each view name used by the SQL to (frame, time column);
    the request's time window (``timeWindowType`` EXPLICIT with
    ``timeWindowStart``/``timeWindowEnd``/``timeWindowTimeZone``, or
    MOST_RECENT_WEEK) filters each view before the query runs.  ``now`` pins the
    clock for macros (never the import-time clock).
    """
    now = now or dt.datetime.now()
    resolved = resolve_parameters(dict(request), now, DEFAULT_MACRO_FORMAT)
    window_type = resolved.get("timeWindowType")
    bounds = None
    if window_type:
        bounds = time_window_bounds(window_type, resolved.get("timeWindowStart"), resolved.get("timeWindowEnd"),
                                    resolved.get("timeWindowTimeZone"), now)
    register_dialect_functions(spark)
    for view, (frame, ts_col) in sources.items():
        scoped = frame.where(in_time_window(frame[ts_col], bounds)) if bounds and ts_col else frame
        scoped.createOrReplaceTempView(view)
    params = {p["name"]: p.get("defaultValue") for p in definition.get("inputParameters", [])}
    params.update(resolved.get("parameterValues", {}) or {})
    text = bind_custom_parameters(definition["sqlQuery"])
    used = {m.group(1) for m in re.finditer(r":([A-Za-z_][A-Za-z0-9_]*)", text)}
    return spark.sql(text, args={k: v for k, v in params.items() if k in used})
