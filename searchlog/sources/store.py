"""Stored tables: creation, loads, JDBC and JSON sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from searchlog import schemas
from searchlog.operators import stages as stage_operators
from searchlog.operators.select import user_sessions
from searchlog.operators.sessions import SESSION_GAP_S, attach_sessions, number_sessions, sessionize
from searchlog.sources.readers import BaseTables, Log, base_tables


def table_path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}"


def initialize_tables(spark: SparkSession, root: str) -> None:
    """Create or replace the typed tables, empty."""
    for name, schema in schemas.TABLES.items():
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(table_path(root, name))


def write_table(df: DataFrame, root: str, name: str) -> None:
    """Replace one stored table; ``df`` must not read the table it replaces."""
    schemas.conform(df, schemas.TABLES[name]).write.mode("overwrite").parquet(table_path(root, name))


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(schemas.TABLES[name]).parquet(table_path(root, name))


def load_base(log: Log, root: str) -> BaseTables:
    """Users and queries of a log, numbered from 1, sessions unset; one write per table."""
    spark = log.rows.sparkSession
    tables = base_tables(log)
    write_table(tables.users, root, "users")
    write_table(tables.queries, root, "queries")
    return BaseTables(read_table(spark, root, "users"), read_table(spark, root, "queries"))


def load_parsed(spark: SparkSession, root: str) -> DataFrame:
    """The stage table of the stored queries; texts that are not well formed have no rows. Equal texts are parsed once."""
    queries = read_table(spark, root, "queries")
    write_table(stage_operators.once_per_text(queries, stage_operators.stages), root, "stages")
    return read_table(spark, root, "stages")


def load_sessions(
    spark: SparkSession, root: str, to: str, gap_s: float = SESSION_GAP_S, drop_suspicious: bool = True
) -> DataFrame:
    """Sessionise the queries stored below ``root``; write sessions and queries with their ids below ``to``."""
    name, column = ("sessions", "session_id") if drop_suspicious else ("sessions_all", "session_id_all")
    queries = read_table(spark, root, "queries")
    write_table(number_sessions(sessionize(queries, gap_s, drop_suspicious)), to, name)
    sessions = read_table(spark, to, name).withColumnRenamed("session_id", column)
    write_table(attach_sessions(queries, sessions, gap_s, drop_suspicious, (column,)), to, "queries")
    return read_table(spark, to, "queries")


def jdbc_partitions(lower: int, upper: int, rows_per_partition: int = 1_000_000) -> dict[str, str]:
    """Bounds for a parallel JDBC read of an id range."""
    span = max(upper - lower + 1, 1)
    return {
        "lowerBound": str(lower),
        "upperBound": str(upper + 1),
        "numPartitions": str(max(1, -(-span // rows_per_partition))),
    }


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    options: dict[str, str] | None = None,
    id_column: str | None = None,
    rows_per_partition: int = 1_000_000,
) -> DataFrame:
    """A table of a relational store; with ``id_column`` in parallel ranges between its smallest and largest id."""
    reader = spark.read.format("jdbc").options(url=url, **(options or {}))
    if id_column is None:
        return reader.option("dbtable", table).load()
    bounds = (
        reader.option("query", f"SELECT min({id_column}) AS lo, max({id_column}) AS hi FROM {table}").load().first()
    )
    if bounds[0] is None:
        return reader.option("dbtable", table).load()
    ranges = jdbc_partitions(int(bounds[0]), int(bounds[1]), rows_per_partition)
    parallel = spark.read.format("jdbc").options(url=url, **(options or {}))
    return parallel.options(dbtable=table, partitionColumn=id_column, **ranges).load()


def write_jdbc(df: DataFrame, url: str, table: str, options: dict[str, str] | None = None, connections: int = 8) -> None:
    """Write to a relational store over a limited number of connections; the rows are computed in as many tasks as ever."""
    df.repartition(connections).write.format("jdbc").options(url=url, dbtable=table, **(options or {})).mode(
        "append"
    ).save()


def json_sink(df: DataFrame, path: str, max_records_per_file: int = 100_000) -> None:
    """JSON lines, a new file after a number of records."""
    df.write.mode("overwrite").option("maxRecordsPerFile", max_records_per_file).json(path)


def json_array_sink(df: DataFrame, path: str) -> None:
    """S2's format: files that are one JSON array each, a record on each line; a partition becomes a file."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = "["
        for batch in batches:
            texts = batch.column(0).to_pylist()
            marks = [mark] + [","] * (len(texts) - 1)
            yield pa.RecordBatch.from_pydict({"value": [m + t for m, t in zip(marks, texts, strict=True)]})
            mark = "," if texts else mark
        yield pa.RecordBatch.from_pydict({"value": ["[]" if mark == "[" else "]"]})

    df.select(F.to_json(F.struct(*df.columns)).alias("value")).mapInArrow(lines, "value string").write.mode("overwrite").text(path)


def _documents(kind: str, rows: DataFrame, *fields: Column | str) -> DataFrame:
    return rows.select(F.lit(kind).alias("kind"), "user_id", F.to_json(F.struct(*fields)).alias("json"))


def users_json(
    users: DataFrame, queries: DataFrame, gap_s: float = SESSION_GAP_S, drop_suspicious: bool = True
) -> DataFrame:
    """S12 as JSON lines: a document for each user, each of their sessions and each query in those.

    Every document names its parents, so none grows with the log: a session its user, a query its user and session. A query
    has its time in microseconds and ``delta``, the seconds since the query before.
    """
    named = users.select("user_id", "name")
    rows = user_sessions(queries, gap_s, drop_suspicious).join(named, "user_id")
    sessions = rows.groupBy("user_id", "name", "session_seq").agg(
        F.min(F.unix_micros("ts")).alias("start_us"), F.count("*").alias("n_queries")
    )
    session = F.col("session_seq").alias("session")
    return (
        _documents("user", named, "user_id", "name")
        .unionByName(_documents("session", sessions, "user_id", "name", session, "start_us", "n_queries"))
        .unionByName(
            _documents(
                "query", rows, "user_id", session, "query_id", F.unix_micros("ts").alias("time_us"),
                F.col("delta_s").alias("delta"), "text",
            )
        )
    )


def users_json_verbose(users: DataFrame, queries: DataFrame) -> DataFrame:
    """S12, verbose, as JSON lines: a document for each user and one for each of their queries with all its stored fields."""
    owned = queries.join(users.select("user_id"), "user_id")
    fields = [F.unix_micros("ts").alias("time_us"), *[c for c in queries.columns if c != "ts"]]
    return _documents("user", users, "user_id", "name").unionByName(_documents("query", owned, *fields))
