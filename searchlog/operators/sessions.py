"""Sessions: runs of a user's interactive queries without a long idle gap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from searchlog.operators.ids import with_sequential_ids
from searchlog.operators.slices import HOT_ROWS, MICROS, micros, row_gaps, slice_of, sliced_gaps, window_gaps

SESSION_GAP_S = 1800.0


def _in_scope(drop_suspicious: bool) -> Column:
    scope = F.col("is_interactive") & F.col("ts").isNotNull() & F.col("user_id").isNotNull()
    return scope & ~F.coalesce(F.col("is_suspicious"), F.lit(False)) if drop_suspicious else scope


def session_input(queries: DataFrame, drop_suspicious: bool = True) -> DataFrame:
    """The queries that are sessionised: interactive, with a time and a user, and not suspicious unless kept."""
    return queries.filter(_in_scope(drop_suspicious))


def _deltas(gaps: DataFrame) -> DataFrame:
    return gaps.withColumn("delta_s", F.coalesce(F.col("gap_us"), F.lit(0)) / MICROS).drop("gap_us", "ts_us")


def query_deltas(queries: DataFrame, drop_suspicious: bool = True, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``delta_s``, seconds since the user's previous query in the session input; 0 for the first."""
    rows = session_input(queries, drop_suspicious).withColumn("ts_us", F.unix_micros("ts"))
    return _deltas(row_gaps(rows, ["user_id"], hot_rows))


def session_deltas(queries: DataFrame, drop_suspicious: bool = True, sliced: bool = False) -> DataFrame:
    """W1 where it is known whether users have very many rows (``sliced``) or not, as in a clustered table."""
    rows = session_input(queries, drop_suspicious).withColumn("ts_us", F.unix_micros("ts"))
    return _deltas((sliced_gaps if sliced else window_gaps)(rows, ["user_id"]))


def session_slices(
    queries: DataFrame, gap_s: float = SESSION_GAP_S, drop_suspicious: bool = True
) -> DataFrame:
    """Which session every ``(user_id, slice)`` belongs to.

    A slice is as wide as the gap, so queries in one slice can never be split by it. One aggregation with map-side
    combine reduces the log to slices, and the window over a user's slices is bounded by the log's time span.
    """
    gap_us = micros(gap_s)
    slices = (
        session_input(queries, drop_suspicious)
        .select("user_id", F.unix_micros("ts").alias("ts_us"))
        .groupBy("user_id", slice_of(F.col("ts_us"), gap_us + 1).alias("slice"))
        .agg(F.min("ts_us").alias("lo_us"), F.max("ts_us").alias("hi_us"), F.count("*").alias("n"))
    )
    by_time = Window.partitionBy("user_id").orderBy("slice")
    opens = (F.col("lo_us") - F.lag("hi_us").over(by_time)) > gap_us
    return slices.withColumn("opens", F.coalesce(opens, F.lit(False)).cast("long")).select(
        "user_id", "slice", "lo_us", "hi_us", "n", F.sum("opens").over(by_time).alias("session_seq")
    )


def sessionize(queries: DataFrame, gap_s: float = SESSION_GAP_S, drop_suspicious: bool = True) -> DataFrame:
    """One row per session. ``session_seq`` counts from 0 for each user."""
    return (
        session_slices(queries, gap_s, drop_suspicious)
        .groupBy("user_id", "session_seq")
        .agg(F.min("lo_us").alias("lo_us"), F.max("hi_us").alias("hi_us"), F.sum("n").alias("n_queries"))
        .select(
            "user_id",
            "session_seq",
            F.timestamp_micros("lo_us").alias("start_ts"),
            F.timestamp_micros("hi_us").alias("end_ts"),
            ((F.col("hi_us") - F.col("lo_us")) / MICROS).alias("duration_s"),
            "n_queries",
        )
    )


def number_sessions(sessions: DataFrame) -> DataFrame:
    """Global ``session_id`` from 0, users in order and sessions in order."""
    return with_sequential_ids(sessions, ["user_id", "session_seq"], "session_id")


def attach_sessions(
    queries: DataFrame,
    sessions: DataFrame | None = None,
    gap_s: float = SESSION_GAP_S,
    drop_suspicious: bool = True,
    columns: tuple[str, ...] = ("session_seq",),
) -> DataFrame:
    """Every query with columns of the session it belongs to, null for queries outside the session input.

    ``sessions`` is the result of ``sessionize`` with the same parameters, numbered or not; it is only needed for columns
    other than ``session_seq``. All joins have a unique right side; adaptive execution splits the query side where one
    user's slice is hot.
    """
    slices = session_slices(queries, gap_s, drop_suspicious).select("user_id", "slice", "session_seq")
    if sessions is not None:
        wanted = sessions.select("user_id", "session_seq", *[c for c in columns if c != "session_seq"])
        slices = slices.join(wanted, ["user_id", "session_seq"])
    in_scope = F.coalesce(_in_scope(drop_suspicious), F.lit(False))
    slices = slices.select("user_id", "slice", *[F.col(c).alias(f"_{c}") for c in columns])
    return (
        queries.drop(*columns)
        .withColumn("slice", slice_of(F.unix_micros("ts"), micros(gap_s) + 1))
        .join(slices, ["user_id", "slice"], "left")
        .withColumns({c: F.when(in_scope, F.col(f"_{c}")) for c in columns})
        .select(*[c for c in queries.columns if c not in columns], *columns)
    )


def queries_with_session(
    queries: DataFrame,
    gap_s: float = SESSION_GAP_S,
    drop_suspicious: bool = True,
    id_column: str = "session_id",
) -> DataFrame:
    """Write the global session number back to the queries. For the uncleaned variant (W4) pass
    ``drop_suspicious=False`` and ``id_column='session_id_all'``."""
    sessions = number_sessions(sessionize(queries, gap_s, drop_suspicious)).withColumnRenamed("session_id", id_column)
    return attach_sessions(queries, sessions, gap_s, drop_suspicious, (id_column,))
