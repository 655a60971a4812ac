"""Object-key and path parsing as Spark column expressions.

All of these are regex / ``split`` / ``concat`` projections, so
they stay inside whole-stage codegen and run wherever the rows already are: no
shuffle, no Python.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Key and file-name layouts of the landing zone.
WORKFLOW_KEY = r"^workflow=([^/]*)/schedule=([^/]*)/(.*)"
# (the time of a landed file may have hyphens for its colons and dot, which are no legal file names everywhere)
FILE_WITH_TIME = r"^(\d{4})-(\d{2})-(\d{2})T(\d{2})[:-](\d{2})[:-](\d{2})[.-](\d{3})Z-([^\.]*)\.(.*)"
FILE_WITH_DATE = r"^(\d{4})-(\d{2})-(\d{2})-([^.]*)\.(.*)"
FILE_VERSION = r"^.*-(ver\d)"
REPORT_KEY = r"^([^/]+)/([^/]+)/([^/]+)/([^/]+)\.([^/]+)"
INTERACTIVE_RESULT = r"^analytics-[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}"
STAGES = ("raw", "stage", "analytics")
REPORT_EXTENSIONS = ("gz", "json")
OOB_PREFIX = "amc"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_workflow_key(key) -> Column:
    """``workflow=W/schedule=S/file`` -> struct(workflow, schedule, file_name); '' when absent."""
    g = _groups(_col(key), WORKFLOW_KEY, 3)
    return F.struct(F.get(g, 0).alias("workflow"), F.get(g, 1).alias("schedule"), F.get(g, 2).alias("file_name"))


_SLOT = "\u0001"     # separator of the parts of one match (never part of a key)


def _slots(text: Column, pattern: str, groups: Sequence[int | None]) -> Column:
    """The capture groups of ONE match laid out in fixed slots (None -> empty slot): a single
    ``regexp_replace`` over the matched text instead of one ``regexp_extract`` per group.
    A trailing catch-all drops whatever follows the match, as ``regexp_extract`` would."""
    template = _SLOT.join(f"${g}" if g else "" for g in groups)
    return F.split(F.regexp_replace(text, f"{pattern}(?s:.*)", template), _SLOT)


def _groups(text: Column, pattern: str, n: int) -> Column:
    """Groups 1..n of one match of ``pattern`` (all '' when it does not match, as ``regexp_extract``)."""
    return F.when(text.rlike(pattern), _slots(text, pattern, range(1, n + 1))).otherwise(F.array_repeat(F.lit(""), n))


def parse_file_timestamp(file_name) -> Column:
    """Timestamped or dated file name -> its parts and a path-safe timestamp text.

    Which layout matches is tested once per layout; the parts of the matching layout come
    from one array expression that every field reads, so Catalyst evaluates it once per
    row (common subexpression) rather than once per part.
    """
    name = _col(file_name)
    timed = name.rlike(FILE_WITH_TIME)
    dated = ~timed & name.rlike(FILE_WITH_DATE)
    parts = (F.when(timed, _slots(name, FILE_WITH_TIME, range(1, 10)))
             .when(dated, _slots(name, FILE_WITH_DATE, (1, 2, 3, None, None, None, None, 4, 5)))
             .otherwise(F.array_repeat(F.lit(""), 9)))

    def part(i: int) -> Column:
        return F.get(parts, i)

    year, month, day = part(0), part(1), part(2)
    hour, minute, second, milli = part(3), part(4), part(5), part(6)
    basename, extension = part(7), part(8)
    stamp = (F.when(timed, F.concat(year, F.lit("-"), month, F.lit("-"), day, F.lit("T"), hour, F.lit("-"),
                                    minute, F.lit("-"), second, F.lit("-"), milli, F.lit("Z")))
             .when(dated, F.concat_ws("-", year, month, day)).otherwise(F.lit("")))
    return F.struct(
        year.alias("year"), month.alias("month"), day.alias("day"), hour.alias("hour"),
        minute.alias("minute"), second.alias("second"), milli.alias("millisecond"),
        basename.alias("basename"), extension.alias("extension"), stamp.alias("file_timestamp"),
    )


def parse_version(basename) -> Column:
    """``-verN`` suffix of a base name, '' when absent."""
    return F.regexp_extract(_col(basename), FILE_VERSION, 1)


def parse_report_key(key) -> Column:
    """``team/dataset/table/file.ext`` -> struct of the five parts ('' when not matching)."""
    names = ("team", "dataset", "table", "file_name", "file_extension")
    g = _groups(_col(key), REPORT_KEY, len(names))
    return F.struct(*[F.get(g, i).alias(n) for i, n in enumerate(names)])


def sanitize_table_name(name) -> Column:
    """Catalog-safe table name: runs of characters outside ``[A-Za-z0-9_]`` become ``_``, lower case."""
    return F.lower(F.regexp_replace(_col(name), r"[^A-Za-z0-9_]+", "_"))


def table_prefix(workflow, customer_prefix, oob_reports) -> Column:
    """``amc`` when the workflow is one of the customer's out-of-box reports, else the customer prefix."""
    return F.when(F.coalesce(F.array_contains(_col(oob_reports), _col(workflow)), F.lit(False)),
                  F.lit(OOB_PREFIX)).otherwise(F.lower(_col(customer_prefix)))


def derive_table_name(prefix, workflow, schedule, version) -> Column:
    """P5: ``{prefix}_{workflow}_{schedule}[_{version}]``, sanitized for the catalog."""
    version = _col(version)
    raw = F.concat_ws("_", _col(prefix), _col(workflow), _col(schedule),
                      F.when(version != "", version))
    return sanitize_table_name(raw)


def derive_partition_path(customer_hash, year, month, file_last_modified) -> Column:
    """The four Hive partition segments of a workflow result."""
    return F.concat(
        F.lit("customer_hash="), _col(customer_hash), F.lit("/export_year="), _col(year),
        F.lit("/export_month="), _col(month), F.lit("/file_last_modified="), _col(file_last_modified))


def partition_values(path) -> Column:
    """Every ``k=v`` segment of a path as a map; plain segments are dropped."""
    return F.map_filter(F.str_to_map(_col(path), F.lit("/"), F.lit("=")), lambda k, v: v.isNotNull())


def customer_hash_of(path) -> Column:
    """The ``customer_hash`` partition value (exact key match)."""
    return F.element_at(partition_values(path), F.lit("customer_hash"))


def split_uri(uri) -> Column:
    """``s3://bucket/key`` -> struct(bucket, key)."""
    uri = _col(uri)
    pattern = r"^s3://([^/]*)/(.*)"
    return F.struct(F.regexp_extract(uri, pattern, 1).alias("bucket"),
                    F.regexp_extract(uri, pattern, 2).alias("key"))


def post_stage_path(key) -> Column:
    """P10: output location of a staged report key (``pre-stage`` -> ``post-stage``, no ``.json``)."""
    return F.regexp_replace(F.regexp_replace(_col(key), "pre-stage", "post-stage"), r"\.json$", "")


def staged_table_of(key) -> Column:
    """P10: table name = fourth key segment."""
    return F.element_at(F.split(_col(key), "/"), 4)


def table_and_partitions_of_key(key) -> Column:
    """First four segments (table path) and segments 5..n-1 (partition path)."""
    parts = F.split(_col(key), "/")
    n = F.size(parts)
    table_path = F.array_join(F.slice(parts, 1, 4), "/")
    partitions = F.when(n > 5, F.array_join(F.slice(parts, 5, n - 5), "/")).otherwise(F.lit(""))
    return F.struct(table_path.alias("table_path"),
                    sanitize_table_name(F.element_at(F.slice(parts, 1, 4), -1)).alias("table"),
                    partitions.alias("partitions"))


def classify_stage(bucket) -> Column:
    """stage = last ``-`` part of the bucket when it is a lake stage, else ``raw``."""
    last = F.element_at(F.split(_col(bucket), "-"), -1)
    return F.when(last.isin(*STAGES), last).otherwise(F.lit("raw"))


def decode_key(key) -> Column:
    """URL-decoded object key (``+`` is a blank)."""
    return F.url_decode(_col(key))


def default_report_table_name(custom, left, report_type, strip_blanks: bool = False) -> Column:
    """Custom name, else ``{left}-{report_type}``; blanks removed for document reports."""
    default = F.concat(_col(left), F.lit("-"), _col(report_type))
    if strip_blanks:
        default = F.replace(default, F.lit(" "), F.lit(""))
    return F.coalesce(_col(custom), default)


def is_valid_report_table_name(name) -> Column:
    """A table name becomes a key prefix, so ``/`` is refused."""
    return ~F.contains(_col(name), F.lit("/"))


def is_interactive_result(workflow) -> Column:
    """results of interactive (UI) queries are skipped."""
    return _col(workflow).rlike(INTERACTIVE_RESULT)


def is_supported_workflow_file(workflow, schedule, extension) -> Column:
    """CSV results with a complete key."""
    return (F.lower(_col(extension)) == "csv") & (_col(workflow) != "") & (_col(schedule) != "")


def is_supported_report_file(extension) -> Column:
    """report payloads are JSON, optionally gzip'd."""
    return F.lower(_col(extension)).isin(*REPORT_EXTENSIONS)


def full_workflow_output_path(table, partition_path, file_timestamp, basename, extension) -> Column:
    """Stage-A output key: ``table/partitions/{timestamp}-{basename}.{ext}``."""
    return F.concat(_col(table), F.lit("/"), _col(partition_path), F.lit("/"), _col(file_timestamp),
                    F.lit("-"), _col(basename), F.lit("."), _col(extension))


def not_in_list(col, values: Sequence[str]) -> Column:
    """F2 helper: NULL-safe "not one of"."""
    return ~F.coalesce(_col(col).isin(*values), F.lit(False))
