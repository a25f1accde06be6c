"""Loads that add to what is stored (S9, N9, W6, T10-T13): ids given once stay, later loads go on from there.

Every load is a folder ``load=n`` below each table, and nothing stored is rewritten. Users and queries of a load are numbered
after those before it. Sessions are made anew for the users with new queries only, and a user's sessions are
those of the last load that touched the user; a session keeps the smallest id that any of its queries had. First occurrences of
stages go by digest: a load adds the stages that none before it has seen.

A load's ``queries`` are written last of its base tables, and a load without them doesn't count: it is
written again by the next one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from searchlog import schemas
from searchlog.functions import text as text_functions
from searchlog.operators import stages as stage_operators
from searchlog.operators.ids import with_sequential_ids
from searchlog.operators.sessions import SESSION_GAP_S, attach_sessions, sessionize
from searchlog.runtime import scratch_path
from searchlog.sources.readers import Log, user_identities
from searchlog.sources.store import table_path

_LOAD = [T.StructField("load", T.IntegerType())]
_LONG = T.LongType()
_UNIQUE = T.StructType(
    [T.StructField("key", T.BinaryType()), T.StructField("stage_id", T.StringType()), *schemas.STAGES.fields, *_LOAD]
)

TABLES = {
    "users": T.StructType([*schemas.USERS.fields, *_LOAD]),
    "queries": T.StructType([f for f in schemas.QUERIES.fields if not f.name.startswith("session_id")] + _LOAD),
    "sessions": T.StructType([*schemas.SESSIONS.fields, *_LOAD]),
    "query_sessions": T.StructType([T.StructField(n, _LONG) for n in ("query_id", "user_id", "session_id")] + _LOAD),
    "unique_stages": _UNIQUE,
}


def initialize(spark: SparkSession, root: str) -> None:
    """Create or replace the tables, empty. Load 0 holds a row of nulls, as a table without folders couldn't be read."""
    for name, schema in TABLES.items():
        nulls = spark.createDataFrame([[None] * len(schema)], schema).withColumn("load", F.lit(0))
        nulls.write.mode("overwrite").partitionBy("load").parquet(table_path(root, name))


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """All rows that loads have written to a table, with the number of the ``load``."""
    return spark.read.schema(TABLES[name]).parquet(table_path(root, name)).filter(F.col("load") > 0)


def _write(df: DataFrame, root: str, name: str, load: int) -> None:
    columns = [F.col(f.name).cast(f.dataType) for f in TABLES[name].fields if f.name != "load"]
    df.select(*columns).write.mode("overwrite").parquet(f"{table_path(root, name)}/load={load}")


def last_load(spark: SparkSession, root: str) -> int:
    return table(spark, root, "queries").agg(F.max("load")).first()[0] or 0


def _largest(df: DataFrame, column: str, default: int) -> int:
    value = df.agg(F.max(column)).first()[0]
    return default if value is None else value


def _finished(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Rows of finished loads."""
    return table(spark, root, name).filter(F.col("load") <= last_load(spark, root))


def users(spark: SparkSession, root: str) -> DataFrame:
    return _finished(spark, root, "users").drop("load")


def queries(spark: SparkSession, root: str) -> DataFrame:
    return _finished(spark, root, "queries").drop("load")


def _same(left: DataFrame, right: DataFrame, names: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a & b, [left[n].eqNullSafe(right[n]) for n in names])


def _event_key() -> Column:
    """What makes a stored row and a row of a later export the same event."""
    parts = [F.col("user_id").cast("string"), F.unix_micros("ts").cast("string"), F.col("splunk_search_id"), F.col("text")]
    return text_functions.text_digest(F.concat_ws("\n", *[F.coalesce(part, F.lit("\x01")) for part in parts]))


def append_base(spark: SparkSession, log: Log, root: str, skip_known: bool = True) -> int:
    """Add the users and queries of a log; the number of the load, or 0 if it holds nothing new.

    Users that are stored keep their ids. Exports often overlap, so that rows equal to a stored one in user, time, search
    id and text are left out (all copies of them); ``skip_known=False`` keeps them.
    """
    load = last_load(spark, root) + 1
    known = users(spark, root)
    found = user_identities(log.rows)
    new = found.join(known, _same(found, known, ("name", "case_id")), "left_anti")
    new = with_sequential_ids(new, ["name", "case_id"], "user_id", start=_largest(known, "user_id", 0) + 1)
    _write(schemas.conform(new, schemas.USERS), root, "users", load)

    everyone = table(spark, root, "users").filter(F.col("load") <= load).drop("load")
    rows, names = log.rows, ("name", "case_id")
    owned = rows.join(everyone, _same(rows, everyone, names)).select(
        *[rows[c] for c in rows.columns if c not in names], everyone["user_id"]
    )
    stored = queries(spark, root)
    if skip_known:
        keys = stored.select(_event_key().alias("key")).distinct()
        owned = owned.withColumn("key", _event_key()).join(keys, "key", "left_anti").drop("key")
    start = _largest(stored, "query_id", 0) + 1
    numbered = with_sequential_ids(owned, ["user_id", "ts", "text", "input_row"], "query_id", start=start)
    numbered = schemas.conform(numbered, schemas.QUERIES)
    if numbered.isEmpty():
        return 0
    _write(numbered, root, "queries", load)
    return load


def _current(rows: DataFrame) -> DataFrame:
    """Of each user the rows of the last load that touched the user."""
    last = rows.groupBy("user_id").agg(F.max("load").alias("load"))
    return rows.join(last, ["user_id", "load"], "left_semi")


def sessions(spark: SparkSession, root: str) -> DataFrame:
    return schemas.conform(_current(_finished(spark, root, "sessions")), schemas.SESSIONS)


def query_sessions(spark: SparkSession, root: str) -> DataFrame:
    """``query_id``, ``user_id``, ``session_id`` of every query that is in a session."""
    return _current(_finished(spark, root, "query_sessions")).select("query_id", "user_id", "session_id")


def append_sessions(
    spark: SparkSession, root: str, gap_s: float = SESSION_GAP_S, drop_suspicious: bool = True
) -> DataFrame:
    """Bring the sessions up to the last load of queries, with the same gap as ever; the current sessions.

    Only users with queries in loads after the last one that made sessions are read again. Rows that come late may join
    sessions: the new one takes the smallest id, the others are gone.
    """
    load = last_load(spark, root)
    made = table(spark, root, "query_sessions").filter(F.col("load") < load)
    since = _largest(made, "load", 0)
    stored = table(spark, root, "queries").filter(F.col("load") <= load)
    touched = stored.filter(F.col("load") > since).select("user_id").distinct()
    rows = stored.drop("load").join(touched, "user_id", "left_semi")

    placed = attach_sessions(rows, None, gap_s, drop_suspicious).filter(F.col("session_seq").isNotNull())
    old = _current(made).select("query_id", F.col("session_id").alias("old_id"))
    path = scratch_path(spark, "placed-queries")
    placed.select("query_id", "user_id", "session_seq").join(old, "query_id", "left").write.parquet(path)
    placed = spark.read.schema("query_id long, user_id long, session_seq long, old_id long").parquet(path)

    kept = placed.groupBy("user_id", "session_seq").agg(F.min("old_id").alias("session_id"))
    start = _largest(made, "session_id", -1) + 1
    new = with_sequential_ids(
        kept.filter(F.col("session_id").isNull()).select("user_id", "session_seq"), ["user_id", "session_seq"], "session_id", start
    )
    ids = kept.filter(F.col("session_id").isNotNull()).unionByName(new.select(*kept.columns))
    found = sessionize(rows, gap_s, drop_suspicious).join(ids, ["user_id", "session_seq"])
    _write(found, root, "sessions", load)
    _write(placed.join(ids, ["user_id", "session_seq"]), root, "query_sessions", load)
    return sessions(spark, root)


def unique_stages(spark: SparkSession, root: str, commands: list[str] | None = None) -> DataFrame:
    """The stored first occurrences of stages, of some commands only if given.

    ``stage_id`` counts the stages that are new in a query among all commands, whichever are asked for.
    """
    return stage_operators.stages_by_command(table(spark, root, "unique_stages").drop("key", "load"), commands)


def append_unique_stages(spark: SparkSession, root: str) -> DataFrame:
    """Add the stages that first occur in queries loaded since; all first occurrences.

    Queries of later loads have larger ids, so that a stored first occurrence stays the first.
    """
    load, seen = last_load(spark, root), table(spark, root, "unique_stages")
    seen = seen.filter(F.col("load") < load)
    since = _largest(seen, "load", 0)
    fresh = table(spark, root, "queries").filter(F.col("load").between(since + 1, load))
    found = stage_operators.first_stages(fresh).join(seen.select("key"), "key", "left_anti")
    in_query = Window.partitionBy("query_id").orderBy("position")
    numbered = found.withColumn("n", F.row_number().over(in_query) - 1)
    _write(numbered.withColumn("stage_id", F.concat_ws(".", "query_id", "n")), root, "unique_stages", load)
    return unique_stages(spark, root)
