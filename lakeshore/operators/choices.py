"""Mixed-type ("choice") fields.

A field that holds numbers in some records and text in others is settled per
batch: all-numeric -> DOUBLE, anything else -> STRING.  When the files are read
with Spark's JSON inference this already happens (long+double -> double,
long+string -> string).  Records that arrive as JSON *text* in a column are
parsed once and stored as VARIANT; the decision is one distributed aggregate over
them (its verdict is plan metadata), then a ``variant_get`` projection.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DecimalType, DoubleType, LongType, _parse_datatype_string

from lakeshore.session import materialize
from lakeshore.sinks.tables import write_rejects
from lakeshore.sources.files import variant_schema_to_ddl

_NUMERIC_PREFIXES = ("BIGINT", "INT", "SMALLINT", "TINYINT", "DECIMAL", "DOUBLE", "FLOAT")


def _is_numeric(type_name: str) -> bool:
    return type_name.upper().startswith(_NUMERIC_PREFIXES)


def json_path(name: str) -> str:
    """The path of one key, whatever characters it has (a dot is no step)."""
    quote = '"' if '"' not in name else "'"
    return f"$[{quote}{name}{quote}]"


def field_types(variants: DataFrame, variant_col: str, fields: Sequence[str]) -> dict[str, set[str]]:
    """Set of VARIANT value types seen per top-level field, in one aggregate job."""
    v = F.col(variant_col)
    aggs = [F.collect_set(F.schema_of_variant(F.variant_get(v, json_path(name), "variant"))).alias(name)
            for name in fields]
    row = variants.agg(*aggs).first()
    return {name: {t for t in (row[name] or []) if t and t.upper() != "NULL"} for name in fields}


def choice_resolution(types: set[str]) -> str:
    """C7 rule: all numeric -> double; otherwise string (a single type keeps its own kind)."""
    if not types:
        return "string"
    if all(_is_numeric(t) for t in types):
        return "bigint" if all(t.upper() == "BIGINT" for t in types) else "double"
    if len(types) == 1:
        only = next(iter(types)).upper()
        if only == "BOOLEAN":
            return "boolean"
    return "string"


def land_variants(df: DataFrame, json_col: str, keep: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Records parsed once and stored as VARIANT: (``keep`` columns, ``_v``) of JSON objects, and the rejects
    (``keep`` columns, record, reason) that are none.  Null text is a record without fields."""
    text = F.col(f"`{json_col}`")
    parsed = F.try_parse_json(F.coalesce(text, F.lit("{}")))
    kind = F.schema_of_variant(parsed)
    stored = materialize(df.select(*keep, F.struct(parsed.alias("v"), F.when(parsed.isNull(), "no JSON").when(
        ~kind.startswith("OBJECT<"), "no object").alias("reason"), text.alias("text")).alias("_r")).select(
        *keep, F.when(F.col("_r.reason").isNull(), F.col("_r.v")).alias("_v"), F.col("_r.reason").alias("_reason"),
        F.when(F.col("_r.reason").isNotNull(), F.col("_r.text")).alias("_text")), "variants")
    good = stored.where("_reason IS NULL").select(*keep, "_v")
    return good, stored.where("_reason IS NOT NULL").select(*keep, F.col("_text").alias("record"), F.col("_reason").alias("reason"))


def variant_columns(records: DataFrame) -> dict[str, str]:
    """C7 types of the top-level fields of VARIANT objects, by one aggregate."""
    merged = records.agg(F.schema_of_variant_agg("_v")).first()[0]
    if not merged or not merged.startswith("OBJECT<"):
        return {}
    out = {}
    for f in _parse_datatype_string(variant_schema_to_ddl(merged)).fields:
        numeric = isinstance(f.dataType, (LongType, DoubleType, BooleanType))
        out[f.name] = f.dataType.simpleString() if numeric else "double" if isinstance(f.dataType, DecimalType) else "string"
    return out


def frequent_keys(records: DataFrame, least_share: float) -> list[str]:
    """Keys of at least this share of the records; at most the mean number of a record's keys over the share, however
    many keys there are."""
    keys = records.select(F.explode(F.map_keys(F.variant_get("_v", "$", "map<string,variant>"))).alias("k"))
    counted = keys.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    total = records.count()
    return sorted(r.k for r in counted.where(F.col("n") >= least_share * total).select("k").collect())


def resolve_choice_text(df: DataFrame, json_col: str, fields: Sequence[str] | None = None, keep: Sequence[str] = (),
                        rest: str | None = None, least_share: float = 0.01, quarantine: str | None = None) -> DataFrame:
    """C7 over a JSON-object text column: one typed column per field, from one parse of each record.

    ``fields`` defaults to every key seen in the batch.  With ``rest`` only keys in ``least_share`` of the records become
    columns (or the given ``fields``) and that column is a map of all other keys to their JSON text, so
    keys that are data rather than names need no column.  Texts that are no JSON object go to the ``quarantine``
    folder, or fail the call if none is given.
    """
    records, rejects = land_variants(df, json_col, keep)
    if quarantine:
        write_rejects(rejects.withColumn("source_file", F.lit(json_col)), quarantine)
    elif (bad := rejects.count()):
        raise ValueError(f"{bad} values of {json_col!r} are no JSON objects; name a quarantine folder")
    if fields is None and rest:
        fields = frequent_keys(records, least_share)
    if rest:
        every = F.variant_get("_v", "$", "map<string,variant>")
        others = F.map_filter(every, lambda k, v: ~k.isin(*fields)) if fields else every
        records = records.withColumn(rest, F.transform_values(others, lambda k, v: F.to_json(v)))
        types = {name: choice_resolution(found) for name, found in field_types(records, "_v", fields).items()} if fields else {}
    elif fields is None:
        types = variant_columns(records)
    else:
        types = {name: choice_resolution(found) for name, found in field_types(records, "_v", fields).items()}
    names = sorted(types) if fields is None else fields
    cols = [F.variant_get(F.col("_v"), json_path(name), types[name]).alias(name) for name in names]
    return records.select(*keep, *cols, *([rest] if rest else []))


def resolve_choice_nested(df: DataFrame, json_col: str, array_field: str, fields: Sequence[str],
                          keep: Sequence[str] = ()) -> DataFrame:
    """The same rule for fields of the elements of an array (``report[].field``), from one parse of each record."""
    records, rejects = land_variants(df, json_col, keep)
    if (bad := rejects.count()):
        raise ValueError(f"{bad} values of {json_col!r} are no JSON objects")
    elems = records.select(*keep, F.explode(F.variant_get("_v", json_path(array_field), "array<variant>")).alias("_v"))
    verdict = field_types(elems, "_v", fields)
    cols = [F.variant_get(F.col("_v"), json_path(name), choice_resolution(verdict[name])).alias(name)
            for name in fields]
    return elems.select(*keep, *cols)
