"""Typing of all-text result sets.

CSV results arrive as text.  Types are decided per target table over the whole
batch with ONE aggregate job (C1): for every column the aggregate computes
whether all non-missing values are booleans, integers or numbers, and whether
the numbers are whole.  The verdict is a handful of booleans per column, so it
is collected to the driver (plan-time metadata, bounded by tables x columns),
turned into a projection of casts, and applied in the same scan that writes the
data.  Name-pattern overrides (C2) win over inference; an existing catalog
table wins over both (C5).
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, DataType, FloatType, MapType, StringType, StructField, StructType,
                               _parse_datatype_string)


# Text that the CSV reader treats as missing.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Boolean text.  Inference accepts only the six spellings of
# true/false; the mapping additionally reads "-1" as false.
TRUE_TEXT = ("true", "True", "TRUE")
FALSE_TEXT = ("false", "False", "FALSE")
FALSE_EXTRA_TEXT = ("-1",)

# Column-name overrides, tried in this order, case-blind,
# anchored at the start of the name; the last matching pattern wins.
NAME_OVERRIDES = (
    (r".*_fee[s]*($|_.*)", "double"),
    (r"cost[s]*$|.*_cost[s]*($|_.*)|.*_cost[s]*_.*$", "double"),
    (r".*_rate[s]*($|_.*)", "double"),
    (r".*_score[s]*($|_.*)", "double"),
    (r".*_percent[s]*($|_.*)", "double"),
    (r".*_pct[s]*($|_.*)", "double"),
    (r"avg($|_.*)|.*_avg[s]*($|_.*)", "double"),
    (r"[e]*cpm$|.*_[e]*cpm$|.*_[e]*cpm_.*$", "double"),
    (r".*_id$|.*_asin$", "string"),
)

# Widening order used when a batch and a table disagree.

_INT_TEXT = r"^[+-]?\d+$"
_NUMBER_TEXT = r"^\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|(?i:inf|infinity))\s*$"


def _as_bigint(col: Column) -> Column:
    """BIGINT for integer-looking text, else NULL (the shape test avoids per-value parse failures)."""
    return F.when(col.rlike(_INT_TEXT), col.try_cast("bigint"))


def _as_double(col: Column) -> Column:
    """DOUBLE for numeric-looking text, else NULL; the shape test keeps non-numeric text away from
    the number parser (whose per-value failures are costly)."""
    return F.when(col.rlike(_NUMBER_TEXT), col.try_cast("double"))


_WHOLE_TEXT = r"^\s*[+-]?\d+\.0*\s*$"


def _is_whole(col: Column, number: Column) -> Column:
    """Whether number text (``number`` is its DOUBLE) that is no plain integer stands for a whole BIGINT.

    A DOUBLE holds what up to 16 characters write; longer text must have nothing but zeros behind the point.
    """
    short = (F.length(col) <= 16) & (F.abs(number) < F.lit(2.0 ** 53))
    return (number == F.floor(number)) & (F.abs(number) < F.lit(9.2e18)) & (short | col.rlike(_WHOLE_TEXT))


def _whole(col: Column) -> Column:
    """BIGINT for text of a whole number that is no plain integer (``'3.0'``, ``'1e3'``), else NULL; never rounded."""
    number = _as_double(col)
    digits = F.regexp_replace(col, r"\s|\.0*\s*$", "").try_cast("bigint")
    return F.when(_is_whole(col, number), F.when(F.length(col) <= 16, number.try_cast("bigint")).otherwise(digits))


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


# ---- C10 ----------------------------------------------------------------------------

def null_tokens(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Missing-value words become SQL NULL in the given text columns."""
    columns = list(columns) if columns is not None else [
        f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    wanted = set(columns)
    return df.select(*[
        F.when(~_c(f.name).isin(*NULL_TOKENS), _c(f.name)).alias(f.name) if f.name in wanted else _c(f.name)
        for f in df.schema.fields])


# ---- C1 -----------------------------------------------------------------------------

# Value classes seen by C1, combined per column with bit_or.
_BOOL, _INT, _WHOLE, _FRACTION, _TEXT = 1, 2, 4, 8, 16


@dataclass(frozen=True)
class ColumnVerdict:
    """What the data says about one text column (C1): the set of value classes seen."""
    name: str
    mask: int

    @property
    def non_null(self) -> bool:
        return self.mask != 0

    @property
    def inferred(self) -> str:
        m = self.mask
        if m == 0:
            return "bigint"          # an all-missing column is numeric and narrows to BIGINT
        if m == _BOOL:
            return "boolean"
        if m & _TEXT or m & _BOOL:
            return "string"          # text, or booleans mixed with numbers
        if m & _FRACTION:
            return "double"
        return "bigint"              # integers and whole-valued decimals narrow to BIGINT (C4)


def value_class(col: Column, as_double: Column | None = None, as_bigint: Column | None = None) -> Column:
    """C1 per value: NULL for missing, else one bit naming its class.

    ``as_double`` / ``as_bigint`` may be given as precomputed columns so each
    parse happens once per value.
    """
    as_double = _as_double(col) if as_double is None else as_double
    as_bigint = _as_bigint(col) if as_bigint is None else as_bigint
    return (F.when(col.isNull(), F.lit(None).cast("int"))
            .when(col.isin(*(TRUE_TEXT + FALSE_TEXT)), F.lit(_BOOL))
            .when(as_bigint.isNotNull(), F.lit(_INT))
            .when(as_double.isNull() | F.isnan(as_double), F.lit(_TEXT))
            .when(_is_whole(col, as_double), F.lit(_WHOLE))
            .otherwise(F.lit(_FRACTION)))


def derive_types(df: DataFrame, columns: Sequence[str], group_by: Sequence[str] = (),
                 keep: Column | None = None, row_counts: dict | None = None,
                 kept_counts: dict | None = None) -> dict:
    """One aggregate job over the whole batch, one ``bit_or`` per column.

    ``keep`` restricts inference to some rows (the unfiltered ones, Q1).
    Returns ``{group_key_tuple: {column: ColumnVerdict}}``; without ``group_by``
    the single key is ``()``.  When ``row_counts`` / ``kept_counts`` are given
    they receive the number of rows / kept rows per group from the same job.

    The number parses are projected once per value below the aggregate (they
    are not cheap, so Catalyst keeps the projection instead of repeating them
    inside every branch of the classification).
    """
    keep_col = F.coalesce(keep, F.lit(False)) if keep is not None else F.lit(True)
    parsed = df.select(
        *[F.col(f"`{g}`") for g in group_by], keep_col.alias("_keep"),
        *[F.when(keep_col, _c(n)).alias(f"v{i}") for i, n in enumerate(columns)])
    parsed = parsed.select(
        *[F.col(f"`{g}`") for g in group_by], "_keep",
        *[c for i in range(len(columns)) for c in (
            F.col(f"v{i}"), _as_double(F.col(f"v{i}")).alias(f"d{i}"), _as_bigint(F.col(f"v{i}")).alias(f"b{i}"))])
    exprs = [F.bit_or(value_class(F.col(f"v{i}"), F.col(f"d{i}"), F.col(f"b{i}"))).alias(f"c{i}")
             for i in range(len(columns))]
    exprs.append(F.count(F.lit(1)).alias("_rows"))
    exprs.append(F.count_if(F.col("_keep")).alias("_kept"))
    agg = parsed.groupBy(*group_by).agg(*exprs) if group_by else parsed.agg(*exprs)
    out: dict = {}
    for row in agg.collect():      # one row per target table: plan metadata only
        key = tuple(row[g] for g in group_by)
        if row_counts is not None:
            row_counts[key] = row["_rows"]
        if kept_counts is not None:
            kept_counts[key] = row["_kept"]
        out[key] = {name: ColumnVerdict(name, row[f"c{i}"] or 0) for i, name in enumerate(columns)}
    return out


def derive_types_by_file(df: DataFrame, columns: Sequence[str], file_col: str, keep: Column | None = None
                         ) -> tuple[dict[str, ColumnVerdict] | None, DataFrame, bool]:
    """C1 with per-file filtering (F4), aggregated in Spark: per file, then across kept files.

    Returns (verdicts of the kept files' unfiltered rows, kept file keys as a
    DataFrame, whether any file was dropped).  Only one row reaches the driver.
    Verdicts are None when no file has an unfiltered row.
    """
    keep_col = F.coalesce(keep, F.lit(False)) if keep is not None else F.lit(True)
    parsed = df.select(F.col(f"`{file_col}`").alias("_file"), keep_col.alias("_keep"),
                       *[F.when(keep_col, _c(n)).alias(f"v{i}") for i, n in enumerate(columns)])
    parsed = parsed.select("_file", "_keep", *[c for i in range(len(columns)) for c in (
        F.col(f"v{i}"), _as_double(F.col(f"v{i}")).alias(f"d{i}"), _as_bigint(F.col(f"v{i}")).alias(f"b{i}"))])
    per_file = parsed.groupBy("_file").agg(
        F.count_if(F.col("_keep")).alias("_kept"),
        *[F.bit_or(value_class(F.col(f"v{i}"), F.col(f"d{i}"), F.col(f"b{i}"))).alias(f"c{i}")
          for i in range(len(columns))])
    summary = per_file.agg(
        F.count_if(F.col("_kept") > 0).alias("kept_files"), F.count_if(F.col("_kept") == 0).alias("dropped_files"),
        *[F.bit_or(F.when(F.col("_kept") > 0, F.col(f"c{i}"))).alias(f"c{i}") for i in range(len(columns))]).first()
    kept_files = per_file.where(F.col("_kept") > 0).select(F.col("_file").alias(file_col))
    if not summary.kept_files:
        return None, kept_files, bool(summary.dropped_files)
    verdicts = {name: ColumnVerdict(name, summary[f"c{i}"] or 0) for i, name in enumerate(columns)}
    return verdicts, kept_files, bool(summary.dropped_files)


# ---- C2 -----------------------------------------------------------------------------

def name_override(name: str) -> str | None:
    """Type forced by the column name, or None."""
    forced = None
    for pattern, type_name in NAME_OVERRIDES:
        if re.match(pattern, name, re.IGNORECASE):
            forced = type_name
    return forced


def plan_types(verdicts: dict[str, ColumnVerdict]) -> dict[str, str]:
    """C1 + C2: final type per column."""
    return {name: (name_override(name) or v.inferred) for name, v in verdicts.items()}


# ---- C3 / C4 ------------------------------------------------------------------------

def map_boolean_text(col: Column) -> Column:
    """true/True/TRUE -> true; false/False/FALSE/-1 -> false; anything else NULL."""
    return (F.when(col.isin(*TRUE_TEXT), F.lit(True))
            .when(col.isin(*(FALSE_TEXT + FALSE_EXTRA_TEXT)), F.lit(False)))


def text_to_bigint(col: Column) -> Column:
    """C4: integer text and whole-valued decimals (``'1.0'`` -> 1), digit by digit; NULL for fractions."""
    return F.coalesce(_as_bigint(col), _whole(col))


def _text_to_decimal(col: Column, precision: int, scale: int) -> Column:
    """DECIMAL for number text that it holds without rounding, else NULL."""
    cast = F.when(col.rlike(_NUMBER_TEXT), col.try_cast(f"decimal({precision},{scale})"))
    fits = col.rlike(r"^\s*[+-]?\d*\.?\d{0,%d}0*\s*$" % scale)
    return F.when(fits | (col.rlike("[eE]") & (cast.cast("double") == _as_double(col))), cast)


def _exact_cast(col: Column, have: DataType, want: DataType) -> Column:
    """A cast between typed columns that gives NULL unless the value comes back unchanged.

    FLOAT columns round by nature and are not compared.
    """
    cast = col.try_cast(want.simpleString())
    if isinstance(want, (StringType, FloatType)) or isinstance(have, (StructType, ArrayType, MapType)):
        return cast
    return F.when(cast.try_cast(have.simpleString()) == col, cast)


def cast_text(col: Column, type_name: str) -> Column:
    """Text column to one of the engine's storage types, never failing (bad values become NULL)."""
    t = type_name.lower()
    if t == "boolean":
        return map_boolean_text(col)
    if t in ("bigint", "long", "int", "integer", "smallint", "tinyint"):
        return text_to_bigint(col) if t in ("bigint", "long") else text_to_bigint(col).try_cast(t)
    if t in ("double", "float"):
        return _as_double(col).cast(t)
    if t.startswith("decimal"):
        want = spark_type(t)
        return _text_to_decimal(col, want.precision, want.scale)
    if t == "date":      # a time of day would be cut
        return F.when(col.try_cast("timestamp") == col.try_cast("date").cast("timestamp"), col.try_cast("date"))
    if t == "string":
        return col
    return col.try_cast(t)


def _proven_cast(col: Column, type_name: str, mask: int) -> Column | None:
    """A cast without shape tests when the verdict proves every value parses (None otherwise)."""
    if type_name == "bigint" and mask and mask & ~_INT == 0:
        return col.try_cast("bigint")
    if type_name == "double" and mask and mask & ~(_INT | _WHOLE | _FRACTION) == 0:
        return col.try_cast("double")
    return None


def apply_types(df: DataFrame, types: dict[str, str], verdicts: dict[str, ColumnVerdict] | None = None
                ) -> DataFrame:
    """Projection that casts the text columns named in ``types``; other columns pass through.

    With the batch's ``verdicts`` a column whose values are all proven valid
    for its type is cast directly (no per-value shape test).
    """
    def cast(name: str) -> Column:
        if verdicts and name in verdicts:
            direct = _proven_cast(_c(name), types[name], verdicts[name].mask)
            if direct is not None:
                return direct
        return cast_text(_c(name), types[name])
    return df.select(*[cast(f.name).alias(f.name) if f.name in types else _c(f.name) for f in df.schema.fields])


def type_text_columns(df: DataFrame, columns: Sequence[str] | None = None,
                      filtered_col: str | None = "filtered") -> tuple[DataFrame, dict[str, str]]:
    """C10 + C1 + C2 + C3 + C4 for one target table: returns (typed frame, chosen types)."""
    if columns is None:
        columns = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)
                   and f.name != filtered_col]
    cleaned = null_tokens(df, columns)
    keep = None
    if filtered_col and filtered_col in df.columns:
        keep = unfiltered(filtered_col)
    verdicts = derive_types(cleaned, columns, keep=keep)[()]
    types = plan_types(verdicts)
    # verdicts come from the kept rows only; filtered rows may hold other values, so proven casts
    # are used only when every row took part in the inference
    return apply_types(cleaned, types, verdicts if keep is None else None), types


def unfiltered(filtered_col: str = "filtered") -> Column:
    """a row counts as unfiltered unless its flag reads ``true`` (any case)."""
    return F.coalesce(F.lower(_c(filtered_col)) != "true", F.lit(True))


# ---- C5 / C6 ------------------------------------------------------------------------

def spark_type(type_text: str | DataType) -> DataType:
    """Catalog type text (including parameterised DDL such as ``decimal(10,2)``) to a Spark type."""
    if isinstance(type_text, DataType):
        return type_text
    return _parse_datatype_string(type_text)


def conform_to_schema(df: DataFrame, table_schema: StructType, source_types: dict[str, str] | None = None,
                      strict: bool = False, keep_source: bool = False) -> DataFrame:
    """Cast shared columns to the table's types; unknown columns keep their own type.

    A value that does not survive the cast is never silently truncated: the
    row gets its column name in ``_bad_columns`` (quarantine, K6), or with
    ``strict=True`` the job fails, as the reference does.  ``keep_source``
    adds the untouched input row as ``_source`` so quarantined rows can be
    replayed.  Boolean targets use
    the C3 map rather than "non-empty text is true" (Q15).
    """
    target = {f.name: f.dataType for f in table_schema.fields}
    cols, checks = [], []
    for f in df.schema.fields:
        want = target.get(f.name)
        src = _c(f.name)
        if want is None or want == f.dataType:
            cols.append(src.alias(f.name))
            continue
        if isinstance(f.dataType, StringType):
            cast = cast_text(src, want.simpleString())               # '3.0' is 3, '2.5' does not fit
        elif isinstance(want, StringType):
            cast = src.cast("string")
        else:
            cast = _exact_cast(src, f.dataType, want)                # never 2.5 -> 2 or 1.239 -> 1.24
        cols.append(cast.alias(f.name))
        checks.append(F.when(src.isNotNull() & cast.isNull(), F.lit(f.name)))
    extra = [F.struct(*[_c(f.name) for f in df.schema.fields]).alias("_source")] if keep_source else []
    out = df.select(*cols, F.filter(F.array(*checks), lambda x: x.isNotNull()).alias("_bad_columns")
                    if checks else F.array().cast("array<string>").alias("_bad_columns"), *extra)
    if strict:
        out = out.withColumn("_bad_columns", F.when(
            F.size("_bad_columns") > 0,
            F.raise_error(F.concat(F.lit("values do not fit the table in "),
                                   F.array_join("_bad_columns", ","))).cast("array<string>"),
        ).otherwise(F.col("_bad_columns")))
    return out


def added_columns(df_schema: StructType, table_schema: StructType) -> list[StructField]:
    """Columns of the batch that the table does not have yet (add-only evolution)."""
    have = {f.name.lower() for f in table_schema.fields}
    return [f for f in df_schema.fields if f.name.lower() not in have and not f.name.startswith("_")]
