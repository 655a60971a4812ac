"""Name sanitizing.

Identifiers (column and table names) are plan-time metadata and are sanitized in
plain Python.  For a data column the regex part is a JVM expression; only the
accent stripping needs Unicode decomposition, which Spark SQL has no built-in
for, so it is a small Arrow-batched pandas UDF that gets only the texts with
non-ASCII characters (NULL for the others).
"""

from __future__ import annotations

import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_MARKS = regex.compile(r"\p{Mn}+")
_NOT_WORD = regex.compile(r"\W+")


def strip_accents_text(name: str) -> str:
    """Letters without their combining marks."""
    return name if name.isascii() else _MARKS.sub("", unicodedata.normalize("NFD", name))


def sanitize_identifier(name: str) -> str:
    """P7 for identifiers: accents stripped, non-word runs -> ``_``, lower case."""
    return _NOT_WORD.sub("_", strip_accents_text(name)).lower()


@F.pandas_udf(StringType())
def _strip_accents_udf(values: pd.Series) -> pd.Series:
    return values.map(strip_accents_text, na_action="ignore")


def strip_accents(col: Column) -> Column:
    """Accent stripping on a column.  Python gets NULL instead of a text that is all ASCII."""
    return F.coalesce(_strip_accents_udf(F.when(~col.rlike(r"^[\x00-\x7F]*$"), col)), col)


def sanitize_column(col: Column) -> Column:
    """P7 on a data column (Unicode-aware ``\\W`` like the identifier version)."""
    return F.lower(F.regexp_replace(strip_accents(col), r"(?U)\W+", "_"))
