"""Readers for exported query logs (S1-S6) and their normalisation into users and queries."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, DataFrameReader, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from searchlog import schemas
from searchlog.functions.normalize import (
    clean_text,
    first_present,
    interactive_flag,
    lenient_double,
    parse_time,
    realtime_flag,
)
from searchlog.operators.ids import with_sequential_ids

# The fields of a 2012 export. Records may lack any of them.
JSON_FIELDS = [
    "$offset", "_time", "error", "range", "search", "search_et", "search_id", "search_lt", "searchlength",
    "searchtype", "total_run_time", "user",
]
JSON_SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in JSON_FIELDS])

# The columns of the CSV layouts, in order.
CSV_LAYOUTS = {
    "format_2013": "searchtype range search_lt search_et search search_id user total_run_time _time".split(),
    "format_2014": (
        "case_id search_type is_realtime search_id user search savedsearch_name search_et search_lt range total_run_time _time"
    ).split(),
}

# Every column that a log is made from, under all its names.
CSV_FIELDS = [*CSV_LAYOUTS["format_2014"], "searchtype", "runtime"]

# An empty cell of these is an empty name or text; one that a layout has no column for is none.
_EMPTY_CELLS = ("user", "case_id", "search")

# Columns that a file may have, if its header isn't declared.
MOST_COLUMNS = 64

# What each kind of record value is called in an export.
RECORD_KEYS = ("search", "error", "searchtype", "searchlength", "range")


class Log(NamedTuple):
    """A normalised log: usable rows, and rows whose time or text is missing or malformed (raw time kept)."""

    rows: DataFrame
    rejects: DataFrame


class BaseTables(NamedTuple):
    users: DataFrame
    queries: DataFrame


def _csv_reader(spark: SparkSession, multi_line: bool) -> DataFrameReader:
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv")
    return reader.option("escape", '"').option("multiLine", multi_line)


def _bound(fields: list[str]):
    """Rows bound by the header of their file, which is the file's first row; files come whole, one after the other."""

    def bind(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, places = None, {}
        for batch in batches:
            files = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            starts = [0, *(np.flatnonzero(files[1:] != files[:-1]) + 1).tolist()]
            for start, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                if start < end and files[start] != file:
                    file, places = files[start], {}
                    for n in range(batch.num_columns - 1):
                        name = batch.column(n)[start].as_py()
                        places.setdefault((name or "").strip("\ufeff ").lower(), n)
                    start += 1
                if start < end:
                    columns = []
                    for field in fields:
                        n = places.get(field.lower())
                        column = pa.nulls(end - start, pa.string()) if n is None else batch.column(n).slice(start, end - start)
                        columns.append(pc.fill_null(column, "") if n is not None and field in _EMPTY_CELLS else column)
                    yield pa.RecordBatch.from_arrays(columns, names=fields)

    return bind


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    multi_line: bool = True,
    layout: str | list[str] | None = None,
    fields: list[str] | None = None,
) -> DataFrame:
    """Raw CSV export(s), every column a string; a directory is read recursively for ``*.csv``, in one scan.

    With a ``layout`` (one of ``CSV_LAYOUTS``, or column names) every file must have that header; Spark checks it when it
    opens the file, and fails otherwise. Files are split if no quoted field goes over lines (``multi_line=False``).

    Without one each file is bound by its own header, so that layouts and column orders may mix; files are read whole, and what
    comes back are the ``fields`` (by default those of a log), null where a file has no such column. With
    ``multi_line=False`` files are split too, but then headers have to be found by a pass over all lines before.
    """
    if layout is not None:
        names = CSV_LAYOUTS[layout] if isinstance(layout, str) else layout
        schema = T.StructType([T.StructField(name, T.StringType()) for name in names])
        rows = _csv_reader(spark, multi_line).option("header", True).option("enforceSchema", False).schema(schema).csv(path)
        return rows.na.fill("", [name for name in _EMPTY_CELLS if name in names])
    fields = fields or CSV_FIELDS
    if not multi_line:
        return _read_split_csv(spark, path, fields)
    cells = T.StructType([T.StructField(f"c{n}", T.StringType()) for n in range(MOST_COLUMNS)])
    rows = _csv_reader(spark, True).option("header", False).schema(cells).csv(path)
    rows = rows.select(*cells.names, F.col("_metadata.file_path").alias("file"))
    return rows.mapInArrow(_bound(fields), ", ".join(f"`{field}` string" for field in fields))


def _read_split_csv(spark: SparkSession, path: str | list[str], fields: list[str]) -> DataFrame:
    """Files in splits, each bound by its header. What the driver holds is a path for each file."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").text(path)
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"))
    quotes = F.regexp_count("value", F.lit('"'))
    if not lines.filter(quotes % 2 == 1).isEmpty():
        raise ValueError("a quoted field goes over lines; read with multi_line=True")
    headers = lines.groupBy("file").agg(F.min_by("value", "line").alias("header"))
    files: dict[str, list[str]] = {}
    for row in headers.sort("file").collect():
        files.setdefault(row["header"], []).append(row["file"])
    parts = []
    for same in files.values():
        part = spark.read.option("header", True).option("escape", '"').csv(same)
        part = part.na.fill("", [c for c in _EMPTY_CELLS if c in part.columns])
        parts.append(part.select(*[F.col(f) if f in part.columns else F.lit(None).cast("string").alias(f) for f in fields]))
    if not parts:
        return spark.createDataFrame([], T.StructType([T.StructField(field, T.StringType()) for field in fields]))
    return reduce(DataFrame.unionByName, parts)


def read_json(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | None = JSON_SCHEMA,
    multi_line: bool = True,
    pattern: str = "*.json",
) -> DataFrame:
    """Raw JSON export(s), combined by column name; a directory is read recursively for files of a ``pattern``.

    ``multi_line`` reads files that are one array of flat objects each, in splits (``read_json_arrays``); without it, one object
    per line. ``schema=None`` infers the fields, for records with unknown keys; arrays are then read as whole files.
    """
    if multi_line and schema is not None:
        return read_json_arrays(spark, path, schema, pattern)
    reader = (
        spark.read.option("multiLine", multi_line)
        .option("primitivesAsString", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
    )
    return (reader.schema(schema) if schema is not None else reader).json(path)


def read_json_arrays(
    spark: SparkSession, path: str | list[str], schema: T.StructType = JSON_SCHEMA, pattern: str = "*.json"
) -> DataFrame:
    """Files that are one array of flat objects each, read in splits, so that one large file keeps many tasks busy.

    Files are cut after every closing brace. A piece that begins with a comma, an opening brace and the name of a field begins a record:
    within a text the quote of such a name would be escaped. If the quotes in it are even in number, it is a whole record.
    Others, with braces in a text, go on in the pieces after them, over the borders of splits too; only those pieces are
    shuffled. Objects without any field of the schema at their beginning, or nested ones, are no records.
    """
    names = "|".join(re.escape(name) for name in schema.names)
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("lineSep", "}")
    pieces = reader.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("n"),
    )
    begins = F.col("value").rlike(rf'^[\s,\[\x{{FEFF}}]*\{{\s*"(?:{names})"\s*:')
    quotes = F.regexp_count(F.regexp_replace("value", r"\\.", ""), F.lit('"'))
    pieces = pieces.withColumns({"begins": begins, "whole": begins & (quotes % 2 == 0)})
    whole = pieces.filter("whole").select(F.concat("value", F.lit("}")).alias("record"))

    parts = pieces.filter("NOT whole").withColumn("begun", F.col("begins").cast("long"))
    in_split = Window.partitionBy("file", "split").orderBy("n")
    parts = parts.withColumn("nth", F.sum("begun").over(in_split))
    # One row per split: the records begun in the splits of the file before it.
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.groupBy("file", "split").agg(F.sum("begun").alias("records"))
    offsets = offsets.select("file", "split", F.coalesce(F.sum("records").over(before), F.lit(0)).alias("offset"))
    parts = parts.join(offsets, ["file", "split"]).withColumn("nth", F.col("nth") + F.col("offset")).filter("nth > 0")
    joined = parts.groupBy("file", "nth").agg(F.sort_array(F.collect_list(F.struct("split", "n", "value"))).alias("parts"))
    joined = joined.select(F.concat(F.array_join("parts.value", "}"), F.lit("}")).alias("record"))

    bare = F.regexp_replace("record", r"^[^{]*", "")
    return whole.unionByName(joined).select(F.from_json(bare, schema).alias("r")).select("r.*")


def normalize_log(raw: DataFrame, version: str, wall_clock: bool = False) -> Log:
    """N1-N8 over raw rows of any layout; columns a layout lacks become null, and without a user column all is one user's.

    ``input_row`` keeps the encounter order. Rows without a readable time or without a text go to ``rejects``; an empty text
    is a text.
    """
    name = first_present(raw, "user")
    search_type = first_present(raw, "searchtype", "search_type")
    realtime = first_present(raw, "is_realtime")
    rows = raw.select(
        name.alias("name"),
        F.when(name.isNotNull(), first_present(raw, "case_id")).alias("case_id"),
        clean_text(first_present(raw, "search")).alias("text"),
        parse_time(first_present(raw, "_time"), wall_clock).alias("ts"),
        interactive_flag(search_type, version).alias("is_interactive"),
        F.lit(False).alias("is_suspicious"),
        lenient_double(first_present(raw, "runtime", "total_run_time")).alias("execution_time"),
        lenient_double(first_present(raw, "search_et")).alias("earliest_event"),
        lenient_double(first_present(raw, "search_lt")).alias("latest_event"),
        lenient_double(first_present(raw, "range")).alias("event_range"),
        realtime_flag(realtime).alias("is_realtime"),
        realtime.alias("is_realtime_raw"),
        search_type.alias("search_type"),
        first_present(raw, "search_id").alias("splunk_search_id"),
        first_present(raw, "savedsearch_name").alias("saved_search_name"),
        first_present(raw, "_time").alias("time_raw"),
        F.monotonically_increasing_id().alias("input_row"),
    )
    usable = F.col("ts").isNotNull() & F.col("text").isNotNull()
    return Log(rows.filter(usable).drop("time_raw"), rows.filter(~usable))


def read_csv_log(
    spark: SparkSession,
    path: str | list[str],
    version: str = "format_2014",
    wall_clock: bool = False,
    multi_line: bool = True,
    layout: str | list[str] | None = None,
) -> Log:
    """A CSV log in the 2013 or 2014 layout, or in both; see ``read_csv`` for a declared ``layout``."""
    return normalize_log(read_csv(spark, path, multi_line, layout), version, wall_clock)


def read_json_log(
    spark: SparkSession,
    path: str | list[str],
    version: str = "format_2012",
    wall_clock: bool = False,
    multi_line: bool = True,
    pattern: str = "*.json",
) -> Log:
    """A JSON log in the 2012 layout; only records with a user, a time and a text count."""
    raw = read_json(spark, path, multi_line=multi_line, pattern=pattern)
    return normalize_log(raw.filter(F.col("user").isNotNull()), version, wall_clock)


def user_identities(rows: DataFrame) -> DataFrame:
    """The distinct users. A user is a name within a case; layouts without cases have the name alone."""
    return rows.select("name", "case_id").distinct()


def base_tables(log: Log) -> BaseTables:
    """Users and queries with ids from 1: users by name and case, queries by user, time, text, input order."""
    users = with_sequential_ids(user_identities(log.rows), ["name", "case_id"], "user_id", start=1)
    users = schemas.conform(users, schemas.USERS)
    # A user's row is unique, and there are few users next to queries; adaptive execution splits a frequent user.
    same_user = log.rows["name"].eqNullSafe(users["name"]) & log.rows["case_id"].eqNullSafe(users["case_id"])
    owned = log.rows.join(users, same_user).select(
        *[log.rows[c] for c in log.rows.columns if c not in ("name", "case_id")], users["user_id"]
    )
    queries = with_sequential_ids(owned, ["user_id", "ts", "text", "input_row"], "query_id", start=1)
    return BaseTables(users, schemas.conform(queries, schemas.QUERIES))


def record_unpivot(records: DataFrame) -> DataFrame:
    """Raw records as ``(key, value)`` pairs; absent keys are not emitted."""
    values = [F.struct(F.lit(c).alias("key"), F.col(f"`{c}`").cast("string").alias("value")) for c in records.columns]
    return records.select(F.inline(F.array(*values))).filter(F.col("value").isNotNull())


def records_by_key(pairs: DataFrame, key: str) -> DataFrame:
    """The values recorded under one key, for example all search texts."""
    if key not in RECORD_KEYS:
        raise ValueError(f"unknown record key {key!r}, expected one of {RECORD_KEYS}")
    return pairs.filter(F.col("key") == key).select("value")
