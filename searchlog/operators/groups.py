"""Repeat-query groups: interactive queries with equal text and how regularly they arrive.

Metrics depend on the text, or on the text and the user, alone. They are aggregated once per such key and joined back to
the queries; texts are represented by their digest in every shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from searchlog.functions.text import text_digest
from searchlog.operators.slices import (
    HOT_ROWS,
    MICROS,
    instants,
    interval_points,
    join_null_safe,
    row_gaps,
    weighted_intervals,
)

# Fixed values of the metric definitions.
ENTROPY_BINS = 10_000
ENTROPY_BIN_S = 100
ENTROPY_EPSILON = 1e-4
CLOCK_S = 30
CONSISTENCY_LOW = 0.9
CONSISTENCY_HIGH = 1.1

# Thresholds above which a group counts as suspicious.
CONSISTENCY_MAX = 0.9
CLOCKNESS_MAX = 0.9
DISTINCT_USERS_MAX = 3

_KEY = ["text_key", "user_id"]


def _interactive(queries: DataFrame) -> DataFrame:
    return queries.filter(F.col("is_interactive")).select(
        "query_id", "user_id", text_digest(F.col("text")).alias("text_key"), F.unix_micros("ts").alias("ts_us")
    )


def copy_counts(mine: DataFrame) -> DataFrame:
    """G2-G4 per ``(text_key, user_id)`` from ``n_copies_this_user``: also ``n_copies``, ``n_distinct_users``.

    The input has one row per user of a text, so counting rows counts distinct users, a missing user included.
    """
    per_text = mine.groupBy("text_key").agg(
        F.sum("n_copies_this_user").alias("n_copies"), F.count("*").alias("n_distinct_users")
    )
    return mine.join(per_text.repartition("text_key"), "text_key").select(
        *_KEY, "n_copies", "n_copies_this_user", "n_distinct_users"
    )


def query_groups(queries: DataFrame, multiple: bool = True) -> DataFrame:
    """One group per interactive query; with ``multiple`` only those that have a copy."""
    rows = _interactive(queries)
    counts = copy_counts(rows.groupBy(*_KEY).agg(F.count("*").alias("n_copies_this_user")))
    if multiple:
        counts = counts.filter(F.col("n_copies") > 1)
    return _attach(rows, counts, "inner").select(
        "query_id", "user_id", "n_copies", "n_copies_this_user", "n_distinct_users"
    )


def _attach(rows: DataFrame, lookup: DataFrame, how: str) -> DataFrame:
    """Join a table that is unique per ``(text_key, user_id)`` to rows; a null user matches a null user.

    The null-safe join shuffles both sides for itself, which lets adaptive execution split a hot key on the row side.
    """
    return join_null_safe(rows, lookup, _KEY, how)


def interarrivals(queries: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per interval between consecutive copies by the same user, at the later query."""
    return (
        row_gaps(_interactive(queries).filter(F.col("ts_us").isNotNull()), _KEY, hot_rows)
        .filter(F.col("gap_us").isNotNull())
        .select("query_id", "user_id", "text_key", (F.col("gap_us") / MICROS).alias("interval_s"))
    )


def group_metrics(queries: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """G6-G8 per ``(text_key, user_id)`` that has at least one interval.

    Intervals are aggregated per histogram bin first, so a group reaches its final row through at most 10,001 partial
    rows. Times stay integer microseconds until the last division.
    """
    return _metrics(instants(_interactive(queries), _KEY), hot_rows)


def _metrics(points: DataFrame, hot_rows: int) -> DataFrame:
    cold, hot = interval_points(points, _KEY, totals=True, hot_rows=hot_rows)
    return _metrics_of(cold).unionByName(_metrics_of(hot))


def _metrics_of(points: DataFrame) -> DataFrame:
    points = points.filter(F.col("n_total") > 1)
    mean_us = (F.col("last_us") - F.col("first_us")) / (F.col("n_total") - 1)
    x, w = F.col("interval_us"), F.col("weight")

    clock_us = CLOCK_S * MICROS
    phase = F.pmod(x, F.lit(clock_us).cast("long"))
    scaled = F.try_divide(x, F.col("mean_us"))
    width_us = F.lit(ENTROPY_BIN_S * MICROS).cast("long")
    in_range = x <= ENTROPY_BINS * ENTROPY_BIN_S * MICROS
    bin_no = F.when(in_range, F.least(F.call_function("div", x, width_us), F.lit(ENTROPY_BINS - 1)))

    bins = (
        weighted_intervals(points.withColumn("mean_us", mean_us), *_KEY, "mean_us")
        .groupBy(*_KEY, bin_no.alias("bin"))
        .agg(
            F.sum("weight").alias("n"),
            F.sum(F.when((scaled > CONSISTENCY_LOW) & (scaled < CONSISTENCY_HIGH), w).otherwise(0)).alias("n_close"),
            F.sum(F.least(phase, F.lit(clock_us) - phase) * w).alias("off_clock_us"),
        )
    )
    # At most one row per bin in each window group.
    in_range_n = F.sum(F.when(F.col("bin").isNotNull(), F.col("n"))).over(Window.partitionBy(*_KEY))
    density = F.col("n") / (F.col("in_range_n") * ENTROPY_BIN_S)
    term = F.when(F.col("bin").isNotNull(), density * F.ln(density + ENTROPY_EPSILON))
    per_key = (
        bins.withColumn("in_range_n", in_range_n)
        .groupBy(*_KEY)
        .agg(
            F.sum("n").alias("n_intervals"),
            F.sum("n_close").alias("n_close"),
            F.sum("off_clock_us").alias("off_clock_us"),
            (-F.sum(term)).alias("density_entropy"),
        )
    )
    several = F.col("n_intervals") > 1
    return per_key.select(
        *_KEY,
        "n_intervals",
        F.when(several, F.col("density_entropy")).otherwise(0.0).alias("entropy"),
        F.when(several, F.col("n_close") / F.col("n_intervals")).otherwise(1.0).alias("consistency"),
        (1 - F.col("off_clock_us") / (F.col("n_intervals") * clock_us)).alias("clockness"),
    )


def group_report(
    queries: DataFrame, multiple: bool = True, text: str | None = None, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """One row per interactive query with counts and metrics, optionally for one text.

    The intervals themselves are the rows of ``interarrivals`` with the same ``text_key`` and ``user_id``: a group's list has no
    bound, so it is not put in a cell.
    """
    if text is not None:
        queries = queries.filter(F.col("text") == text)
    # Counts and metrics both start from the instants, so the texts are read and digested once for the two.
    points = instants(_interactive(queries), _KEY)
    counts = copy_counts(points.groupBy(*_KEY).agg(F.sum("n").alias("n_copies_this_user")))
    if multiple:
        counts = counts.filter(F.col("n_copies") > 1)
    metrics = _metrics(points, hot_rows)
    rows = queries.filter(F.col("is_interactive")).select(
        "query_id", "user_id", "text", text_digest(F.col("text")).alias("text_key")
    )
    measured = _attach(counts, metrics, "left")
    return _attach(rows, measured, "inner").select(
        "query_id",
        "text_key",
        "text",
        "user_id",
        "n_copies",
        "n_copies_this_user",
        "n_distinct_users",
        F.coalesce("n_intervals", F.lit(0)).alias("n_intervals"),
        F.when(F.col("n_intervals").isNull(), 0.0).otherwise(F.col("entropy")).alias("entropy"),
        F.coalesce("consistency", F.lit(1.0)).alias("consistency"),
        F.coalesce("clockness", F.lit(-1.0)).alias("clockness"),
    )


def group_suspicious(
    report: DataFrame,
    consistency_max: float = CONSISTENCY_MAX,
    clockness_max: float = CLOCKNESS_MAX,
    distinct_users_max: int = DISTINCT_USERS_MAX,
) -> DataFrame:
    """``is_suspicious`` where a group exceeds any threshold. One interval alone already has consistency 1."""
    return report.withColumn(
        "is_suspicious",
        (F.col("consistency") > consistency_max)
        | (F.col("clockness") > clockness_max)
        | (F.col("n_distinct_users") > distinct_users_max),
    )
