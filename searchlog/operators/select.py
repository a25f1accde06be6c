"""Projections, filters, marks and nested reads over the stored tables (F1-F16)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from searchlog import schemas
from searchlog.functions import text as text_functions
from searchlog.functions.normalize import split_interactive
from searchlog.operators.sessions import (
    SESSION_GAP_S,
    attach_sessions,
    number_sessions,
    query_deltas,
    session_input,
    sessionize,
)
from searchlog.operators.slices import with_children

USER_COLUMNS = schemas.USERS.fieldNames()
QUERY_COLUMNS = [name for name in schemas.QUERIES.fieldNames() if name != "session_id_all"]
SESSION_QUERY_COLUMNS = ["session_seq", "query_id", "ts", "text", "delta_s"]
QUERY_TYPES = ("all", "interactive", "scheduled")

# Users and text marks that give away machine-issued queries.
SUSPICIOUS_USER_NAMES = ("splunk-system-user",)
SUSPICIOUS_TEXT = "typeahead"

# Query texts known to be issued by the product itself.
SUSPICIOUS_QUERIES = (
    "| metadata type=sourcetypes | search totalCount > 0",
    "|history | head 2000 | search event_count>0 OR result_count>0 | dedup search | table search",
)


def users_table(users: DataFrame) -> DataFrame:
    """F1."""
    return users.select(*USER_COLUMNS)


def queries_table(queries: DataFrame) -> DataFrame:
    """F2."""
    return queries.select(*QUERY_COLUMNS)


def queries_by_type(queries: DataFrame, query_type: str = "all") -> DataFrame:
    """``interactive`` and ``scheduled`` select on the flag; a null flag is in neither."""
    if query_type not in QUERY_TYPES:
        raise ValueError(f"invalid query type {query_type!r}, expected one of {QUERY_TYPES}")
    if query_type == "all":
        return queries
    flag = F.col("is_interactive")
    return queries.filter(flag if query_type == "interactive" else ~flag)


def interactive_queries(queries: DataFrame) -> DataFrame:
    """F3."""
    return queries_by_type(queries, "interactive")


def queries_with_stages(queries: DataFrame, stages: DataFrame | None = None) -> DataFrame:
    """queries with their stages as an array; queries whose text has none drop out.

    Without a stored stage table the array is computed from the text in place and nothing is shuffled. With one, a
    query's stages are collected (bounded by its text) and joined on the query id.
    """
    if stages is None:
        # A filter on the array itself would be pushed below it and compute it twice.
        has_stage = F.size(text_functions.command_words(F.col("text"))) > 0
        return queries.filter(has_stage).withColumn("stages", text_functions.stages(F.col("text")))
    items = F.struct(*[c for c in stages.columns if c != "query_id"])
    per_query = stages.groupBy("query_id").agg(F.array_sort(F.collect_list(items)).alias("stages"))
    return queries.join(per_query, "query_id")


def queries_of_user(queries: DataFrame, user_id: int) -> DataFrame:
    """F5."""
    return queries.filter(F.col("user_id") == user_id)


def queries_in_session(queries: DataFrame, session_id: int, uncleaned: bool = False) -> DataFrame:
    """by the cleaned or the uncleaned session number."""
    return queries.filter(F.col("session_id_all" if uncleaned else "session_id") == session_id)


def queries_with_text(queries: DataFrame, text: str) -> DataFrame:
    """interactive queries with exactly this text."""
    return queries.filter(F.col("is_interactive") & (F.col("text") == text))


def distinct_texts(queries: DataFrame) -> DataFrame:
    """F8."""
    return queries.select("text").distinct()


def sessions_of_user(sessions: DataFrame, user_id: int) -> DataFrame:
    """pass the cleaned or the uncleaned session table."""
    return sessions.filter(F.col("user_id") == user_id)


def users_with_queries(users: DataFrame, queries: DataFrame) -> DataFrame:
    """one row per user and query, whatever their number; users without queries once with nulls.

    ``in_interactive_list`` says which of a user's two lists the query is on; a query without the flag is on the other one.
    """
    columns = [c for c in queries.columns if c != "user_id"]
    interactive = F.coalesce("is_interactive", F.lit(False))
    return with_children(users, queries, "user_id").select(
        *USER_COLUMNS,
        *columns,
        F.when(F.col("query_id").isNotNull(), interactive).alias("in_interactive_list"),
    )


def user_sessions(queries: DataFrame, gap_s: float = SESSION_GAP_S, drop_suspicious: bool = True) -> DataFrame:
    """Every sessionised query with its user's session number and the delta to the query before."""
    rows = query_deltas(queries, drop_suspicious)
    return attach_sessions(rows, None, gap_s, drop_suspicious)


def users_with_sessions(
    users: DataFrame, queries: DataFrame, gap_s: float = SESSION_GAP_S, drop_suspicious: bool = True
) -> DataFrame:
    """one row per user, session and query, whatever their numbers; users without sessions once with nulls."""
    rows = user_sessions(queries, gap_s, drop_suspicious).select(*SESSION_QUERY_COLUMNS, "user_id")
    return with_children(users, rows, "user_id", session_input(queries, drop_suspicious)).select(
        *USER_COLUMNS, *SESSION_QUERY_COLUMNS
    )


def sessions_all(queries: DataFrame, version: str, gap_s: float = SESSION_GAP_S) -> DataFrame:
    """sessions of a freshly read log, singletons included: split by the layout's label, then sessionise."""
    return sessionize(split_interactive(queries, version), gap_s, drop_suspicious=True)


def sessions_multi(
    queries: DataFrame, gap_s: float = SESSION_GAP_S, drop_suspicious: bool = True
) -> DataFrame:
    """the queries of all sessions with more than one query, flat; order by ``session_id, ts, query_id`` to print.

    Without a stored ``session_id`` the sessions are numbered here.
    """
    columns = ["session_id", "user_id", "query_id", "ts", "text", "n_queries"]
    if "session_id" not in queries.columns:
        sessions = number_sessions(sessionize(queries, gap_s, drop_suspicious))
        found = attach_sessions(queries, sessions, gap_s, drop_suspicious, ("session_id", "n_queries"))
        return found.filter(F.col("n_queries") > 1).select(*columns)
    stored = queries.filter(F.col("session_id").isNotNull())
    sizes = stored.groupBy("session_id").agg(F.count("*").alias("n_queries")).filter(F.col("n_queries") > 1)
    # Shuffled on its own, so that adaptive execution can split a very long session on the other side.
    return stored.join(sizes.repartition("session_id"), "session_id").select(*columns)


def mark_suspicious_queries(queries: DataFrame, mark: str = SUSPICIOUS_TEXT) -> DataFrame:
    """set the flag where the text contains the mark; never clears it."""
    flagged = F.coalesce(F.col("is_suspicious"), F.lit(False)) | F.coalesce(F.col("text").contains(mark), F.lit(False))
    return queries.withColumn("is_suspicious", flagged)


def mark_suspicious_users(users: DataFrame, names: tuple[str, ...] = SUSPICIOUS_USER_NAMES) -> DataFrame:
    """F15."""
    return users.withColumn(
        "user_type", F.when(F.col("name").isin(*names), "suspicious").otherwise(F.col("user_type"))
    )


def blocklist(queries: DataFrame, texts: DataFrame | None = None, keep: bool = True) -> DataFrame:
    """F16: keep (or drop) the queries whose text is on a list, by default the known suspicious texts.

    A list given as a DataFrame is semi- or anti-joined, and adaptive execution broadcasts it if it turns out small.
    """
    if texts is None:
        listed = F.coalesce(F.col("text").isin(*SUSPICIOUS_QUERIES), F.lit(False))
        return queries.filter(listed if keep else ~listed)
    return queries.join(texts.select("text").distinct(), "text", "left_semi" if keep else "left_anti")
