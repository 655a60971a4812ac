"""File sources of the landing zone.

All readers are Spark file sources: thousands of files are one distributed
scan, split by Spark, with per-file attributes taken from the hidden
``_metadata`` column (path, size, modification time) rather than from a
listing loop on the driver.
"""

from __future__ import annotations

import csv
import io
import itertools
import re
import sys
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from lakeshore.session import materialize

FILE_COLS = ("file_path", "file_size", "file_modification_time")


# any case of the extension, as F3 accepts it
CSV_GLOB = "*.[cC][sS][vV]"
JSON_GLOB = "*.{[jJ][sS][oO][nN],[gG][zZ]}"


def plain_path(file_path: Column) -> Column:
    """The path as listings write it: ``_metadata.file_path`` is URL-encoded (a blank is %20)."""
    return F.url_decode(F.replace(file_path, F.lit("+"), F.lit("%2B")))


def _file_attrs(df: DataFrame) -> DataFrame:
    return df.select("*", plain_path(F.col("_metadata.file_path")).alias("file_path"),
                     *[F.col(f"_metadata.{c}").alias(c) for c in FILE_COLS[1:]])


def read_workflow_csv(spark: SparkSession, paths: str | Sequence[str], schema: StructType | None = None,
                      with_attributes: bool = True, quote_parity: bool = False, check_header: bool = True,
                      multi_line: bool = True) -> DataFrame:
    """CSV results with a header, every column as text.

    Blank lines are skipped by the reader.  Quotes inside a quoted field are doubled; ``\\"`` stands
    for a single quote with ``quote_parity=True`` (as the reference's pre-parse replacement has it), else
    for a double quote.  Missing-value words are *not* handled here
    (the reader knows one ``nullValue`` only); C10 does it.  With a ``schema``
    (all strings, for streaming) no header inference pass is needed; ``check_header=False``
    then skips each file's header line without comparing it with the schema.
    A quoted field may hold line breaks; files known to have none can be split
    over several tasks with ``multi_line=False``.  With ``quote_parity`` the scan of the raw
    lines finds that out: when no file has such a field, all are split.
    """
    doubled = quote_parity
    reader = (spark.read.option("header", True).option("escape", '"' if doubled else "\\").option("multiLine", multi_line)
              .option("recursiveFileLookup", True).option("pathGlobFilter", CSV_GLOB)
              .option("inferSchema", False).option("mode", "PERMISSIVE").option("enforceSchema", not check_header))
    if schema is not None:
        reader = reader.schema(schema)
    paths = list(paths) if not isinstance(paths, str) else paths
    df = reader.csv(paths)
    if doubled:
        df = _with_backslash_quotes(spark, paths, df, check_header,
                                    split=reader.option("multiLine", False).schema(df.schema) if multi_line and df.columns else None)
    else:
        df = _file_attrs(df)
    return df if with_attributes else df.drop(*FILE_COLS)


def read_csv_cells(spark: SparkSession, paths: Sequence[str], width: int) -> DataFrame:
    """Rows of CSV files with any headers, the header lines among them: ``cells`` (as many as ``width``), file attributes,
    and ``seq``, which rises along each file."""
    names = [f"_c{k}" for k in range(width)]
    df = (spark.read.option("header", False).option("escape", '"').option("multiLine", True)
          .schema(", ".join(f"{n} string" for n in names)).csv(list(paths)))
    rows = _with_backslash_quotes(spark, list(paths), df, False, header=False)
    return rows.select(F.array(*names).alias("cells"), *FILE_COLS, F.monotonically_increasing_id().alias("seq"))


def _is_whole_record(line: Column) -> Column:
    """Whether a line (cut at ``\\n``) is blank or a record of its own that readers of lines and of files take alike.

    Quoted parts (without doubled quotes between them, ``\\r`` in their place) must be whole fields, so that no
    quote is open at the end; a ``\\r`` or a line of white space is left to the reader of files.
    """
    fields = F.regexp_replace(line, '"[^"]*"', "\r")
    quoted = ~F.contains(fields, F.lit('"')) & ~fields.rlike("[^,\r]\r|\r[^,\r]")
    plain = ~F.contains(line, F.lit("\r")) & ~line.rlike(r"^[\x00-\x20]+$")
    return plain & (~F.contains(line, F.lit('"')) | quoted)


def _with_backslash_quotes(spark: SparkSession, paths: str | Sequence[str], df: DataFrame, check_header: bool,
                           header: bool = True, split=None) -> DataFrame:
    """Rows of ``df`` with its file attributes; files that hold ``\\"`` anywhere are parsed with ``'`` in its place.

    Spark's reader knows one escape sign, so those files (few, as a rule: a scan of the raw lines finds
    them) go through Python's, each by one task, like any file that may hold quoted line breaks.  If no other
    file holds such a break, the rows come from ``split``, a reader that cuts files into several tasks.
    """
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", CSV_GLOB)
    lines = raw.option("lineSep", "\n").text(paths).select(
        plain_path(F.col("_metadata.file_path")).alias("file_path"), F.contains("value", F.lit('\\"')).alias("escaped"),
        (~_is_whole_record(F.col("value")) if split is not None else F.lit(False)).alias("wrapped"))
    odd = lines.where("escaped OR wrapped").groupBy("file_path").agg(
        F.bool_or("escaped").alias("escaped"), F.bool_or("wrapped").alias("wrapped"))
    counts = odd.agg(F.count_if("escaped").alias("escaped"), F.count_if(F.expr("wrapped AND NOT escaped")).alias("wrapped")).first()
    if split is not None and not counts.wrapped:
        df = split.csv(paths)
    columns, rows = df.columns, _file_attrs(df)
    if not counts.escaped:
        return rows
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", CSV_GLOB)
    escaped = materialize(odd.where("escaped").select("file_path"), "csv_escaped")
    texts = _file_attrs(raw.text(paths, wholetext=True)).join(escaped, "file_path", "left_semi")

    def parse(batches):
        csv.field_size_limit(sys.maxsize)
        for batch in batches:
            for file_path, text, size, time in batch[["file_path", "value", *FILE_COLS[1:]]].itertuples(index=False):
                lines = csv.reader(io.StringIO(text.replace('\\"', "'"), newline=""))
                first = next(lines, []) if header else []
                if header and check_header and first != columns:
                    raise ValueError(f"CSV header of {file_path} is {first}, not {columns}")
                fields = (([x or None for x in line] + [None] * len(columns))[:len(columns)] for line in lines if line)
                while part := list(itertools.islice(fields, 10_000)):
                    yield pd.DataFrame({"fields": part}).assign(file_path=file_path, file_size=size, file_modification_time=time)

    kinds = "fields array<string>, file_path string, file_size bigint, file_modification_time timestamp"
    parsed = texts.mapInPandas(parse, kinds).select(
        *[F.col("fields")[k].alias(c) for k, c in enumerate(columns)], *FILE_COLS)
    return rows.join(escaped, "file_path", "left_anti").select(*parsed.columns).unionByName(parsed)


CORRUPT = "_corrupt_record"


def _report_reader(spark: SparkSession):
    return (spark.read.option("multiLine", True).option("pathGlobFilter", JSON_GLOB)
            .option("recursiveFileLookup", True))


def read_record_array_json(spark: SparkSession, paths: str | Sequence[str], schema: StructType | None = None,
                           with_attributes: bool = True) -> DataFrame:
    """S2 (+S4): each file is one JSON array of records -> one row per record.

    ``.json.gz`` files are decompressed by the codec chosen from the extension.
    Without a ``schema`` the batch's schema is inferred by ``infer_json_schema``
    (distributed; mixed numeric fields DOUBLE, numeric/text mixes STRING: C7/C8),
    then the files are read with it.  A multi-line file is read whole by one
    task, so parallelism comes from the number of files.  A file that is no JSON is
    one row whose text is in ``_corrupt_record``; the jobs send it to quarantine.
    """
    paths = list(paths) if not isinstance(paths, str) else paths
    if schema is None:
        schema = infer_json_schema(spark, paths)
        if schema is not None and CORRUPT not in schema.fieldNames():
            schema = StructType([*schema.fields]).add(CORRUPT, "string")
    reader = _report_reader(spark)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.json(paths)
    return _file_attrs(df) if with_attributes else df


# ---- distributed JSON schema inference -----------------------------------------------

_SCALARS = {"BIGINT": "bigint", "INT": "bigint", "SMALLINT": "bigint", "TINYINT": "bigint",
            "DOUBLE": "double", "FLOAT": "double", "STRING": "string", "BOOLEAN": "boolean",
            "VOID": "string", "VARIANT": "string", "DATE": "date", "TIMESTAMP": "timestamp",
            "TIMESTAMP_NTZ": "timestamp_ntz", "BINARY": "binary"}
_DECIMAL = re.compile(r"DECIMAL\((\d+),\s*(\d+)\)")
_WORD = re.compile(r"[A-Z_]+")
_NAME = re.compile(r"[^:`]+")


def variant_schema_to_ddl(text: str) -> str:
    """Schema text of ``schema_of_variant_agg`` -> Spark DDL type with the JSON-inference rules.

    Integers stay BIGINT (DECIMAL(p,0) beyond the long range stays decimal), any
    fraction makes DOUBLE, incompatible mixes (VARIANT) and all-null fields
    (VOID) become STRING, objects become structs and arrays keep their merged
    element type.
    """
    pos = 0

    def expect(token: str) -> None:
        nonlocal pos
        if not text.startswith(token, pos):
            raise ValueError(f"unexpected variant schema at {pos}: {text[pos:pos + 20]!r}")
        pos += len(token)

    def name() -> str:
        nonlocal pos
        if text[pos] == "`":
            pos += 1
            out = []
            while True:
                ch = text[pos]
                if ch == "`" and text.startswith("``", pos):
                    out.append("`")
                    pos += 2
                elif ch == "`":
                    pos += 1
                    return "".join(out)
                else:
                    out.append(ch)
                    pos += 1
        m = _NAME.match(text, pos)
        pos = m.end()
        return m.group(0)

    def typ() -> str:
        nonlocal pos
        if text.startswith("OBJECT<", pos):
            pos += len("OBJECT<")
            fields = []
            while not text.startswith(">", pos):
                field_name = name()
                expect(": ")
                fields.append("`" + field_name.replace("`", "``") + "`:" + typ())
                if text.startswith(", ", pos):
                    pos += 2
            expect(">")
            return "struct<" + ",".join(fields) + ">"
        if text.startswith("ARRAY<", pos):
            pos += len("ARRAY<")
            element = typ()
            expect(">")
            return f"array<{element}>"
        m = _DECIMAL.match(text, pos)
        if m:
            pos = m.end()
            precision, scale = int(m.group(1)), int(m.group(2))
            if scale == 0:
                return "bigint" if precision <= 18 else f"decimal({min(precision, 38)},0)"
            return "double"
        m = _WORD.match(text, pos)
        if not m or m.group(0) not in _SCALARS:
            raise ValueError(f"unknown variant type at {pos}: {text[pos:pos + 20]!r}")
        pos = m.end()
        return _SCALARS[m.group(0)]

    out = typ()
    if pos != len(text):
        raise ValueError(f"trailing variant schema text: {text[pos:]!r}")
    return out


def infer_json_schema(spark: SparkSession, paths: str | Sequence[str]) -> StructType | None:
    """Record schema of a batch of JSON files, inferred by one distributed aggregate.

    Files are read whole as text (one task per file or group of small files),
    parsed to VARIANT, top-level arrays expanded to their records, and the
    record types merged by ``schema_of_variant_agg``.  Spark's own multi-line
    JSON inference reads the batch through at most two tasks, which does not
    scale with the number of report files.  Returns None when the records are
    not objects, or a file is no VARIANT (broken, or beyond its size limit): the
    caller then falls back to Spark's inference, which leaves no field out.
    """
    text = (spark.read.option("pathGlobFilter", JSON_GLOB).option("recursiveFileLookup", True)
            .text(paths, wholetext=True))
    docs = text.select(F.ltrim("value").startswith("[").alias("_is_array"),
                       F.try_parse_json("value").alias("_v"))
    records = docs.select(F.col("_v").isNull().alias("_failed"), F.explode_outer(
        F.when(F.col("_is_array"), F.variant_get("_v", "$", "array<variant>"))
        .otherwise(F.array(F.col("_v")))).alias("_r"))
    # explode_outer above: an unparsed file is one NULL record, an empty array none that counts
    row = records.agg(F.schema_of_variant_agg("_r").alias("s"), F.count_if("_failed").alias("failed")).first()
    merged = None if row.failed else row.s
    if not merged or not merged.startswith("OBJECT<"):
        return None
    return _parse_datatype_string(variant_schema_to_ddl(merged))


def read_report_document_json(spark: SparkSession, paths: str | Sequence[str],
                              schema: StructType | None = None, with_attributes: bool = True) -> DataFrame:
    """S3 (+S4): each file is one JSON object holding named arrays -> one row per document."""
    return read_record_array_json(spark, paths, schema, with_attributes)


def with_file_attributes(df: DataFrame, manifest: DataFrame | None = None, ts_col: str = "timestamp") -> DataFrame:
    """Size, last-modified and key of each row's file; ingest timestamp from a manifest
    (object metadata, joined on path) else the file's modification time."""
    out = df if "file_path" in df.columns else _file_attrs(df)
    if manifest is not None:
        m = manifest.select(F.col("path").alias("_m_path"), F.col(ts_col).alias("_m_ts"))
        # one manifest row per file: it grows with the landing zone, so no broadcast hint
        out = out.join(m, out["file_path"] == F.col("_m_path"), "left").drop("_m_path")
        stamp = F.coalesce(F.col("_m_ts").cast("timestamp"), F.col("file_modification_time"), F.current_timestamp())
        return out.withColumn(ts_col, stamp).drop("_m_ts")
    return out.withColumn(ts_col, F.coalesce(F.col("file_modification_time"), F.current_timestamp()))


def list_objects(spark: SparkSession, prefix: str, glob: str | None = None) -> DataFrame:
    """Recursive listing (path, length, modificationTime); content is never read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(prefix).select("path", "length", "modificationTime")


def read_catalog_table(spark: SparkSession, name: str) -> DataFrame:
    """Rows (and ``.schema``) of a registered table."""
    return spark.table(name)


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def parquet_schema(spark: SparkSession, paths: str | Sequence[str], merge: bool = False) -> StructType:
    """Schema from Parquet footers only; ``merge`` unions the schemas of all files."""
    reader = spark.read.option("mergeSchema", merge)
    return reader.parquet(*([paths] if isinstance(paths, str) else list(paths))).schema
