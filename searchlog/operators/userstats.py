"""User and interval statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from searchlog.operators.select import SUSPICIOUS_USER_NAMES
from searchlog.operators.slices import (
    MICROS,
    instants,
    micros,
    row_gaps,
    row_points,
    sliced_points,
    split_hot,
    weighted_intervals,
    window_points,
)

HISTOGRAM_MAX_S = 30.0
HISTOGRAM_BINS = 1000
TOO_SHORT_S = 1.0


def suspiciousness(users: DataFrame, queries: DataFrame) -> DataFrame:
    """Share of suspicious queries among a user's interactive ones, -1 without any; ordered by score."""
    per_user = (
        queries.filter(F.col("is_interactive"))
        .groupBy("user_id")
        .agg(F.count("*").alias("n"), F.count_if("is_suspicious").alias("n_suspicious"))
    )
    n = F.coalesce("n", F.lit(0))
    return (
        users.select("user_id")
        .join(per_user, "user_id", "left")
        .select(
            "user_id",
            F.when(n == 0, -1.0).otherwise(F.try_divide("n_suspicious", "n")).alias("score"),
            n.alias("n_interactive"),
        )
        .orderBy("score", "user_id")
    )


def suspiciousness_summary(scores: DataFrame) -> DataFrame:
    """Users with no interactive queries, with only suspicious ones, with no suspicious ones."""
    some = F.col("n_interactive") > 0
    return scores.agg(
        F.count_if(~some).alias("no_interactive"),
        F.count_if(some & (F.col("score") == 1)).alias("only_suspicious"),
        F.count_if(some & (F.col("score") == 0)).alias("no_suspicious"),
    )


def _pool(users: DataFrame, queries: DataFrame, excluded: tuple[str, ...]) -> DataFrame:
    """Timed, interactive, unsuspicious queries of all users but the excluded, of whom there are few."""
    rows = queries.filter(
        F.col("is_interactive")
        & ~F.coalesce(F.col("is_suspicious"), F.lit(False))
        & F.col("ts").isNotNull()
        & F.col("user_id").isNotNull()
    ).select("query_id", "user_id", F.unix_micros("ts").alias("ts_us"))
    return rows.join(users.filter(F.col("name").isin(*excluded)).select("user_id"), "user_id", "left_anti")


def user_interarrivals(
    users: DataFrame, queries: DataFrame, excluded: tuple[str, ...] = SUSPICIOUS_USER_NAMES
) -> DataFrame:
    """One row per interval between a user's consecutive queries, at the later query."""
    return (
        row_gaps(_pool(users, queries, excluded), ["user_id"])
        .filter(F.col("gap_us").isNotNull())
        .select("query_id", "user_id", (F.col("gap_us") / MICROS).alias("interval_s"))
    )


def _pooled_intervals(users: DataFrame, queries: DataFrame, excluded: tuple[str, ...]) -> DataFrame:
    # Few narrow columns are read, so the cold rows are read again rather than shuffled once more.
    cold, hot = split_hot(_pool(users, queries, excluded), ["user_id"])
    parts = [window_points(row_points(cold, ["user_id"]), ["user_id"]), sliced_points(instants(hot, ["user_id"]), ["user_id"])]
    return weighted_intervals(parts[0]).unionByName(weighted_intervals(parts[1]))


def interarrival_counts(
    users: DataFrame, queries: DataFrame, excluded: tuple[str, ...] = SUSPICIOUS_USER_NAMES
) -> DataFrame:
    """Intervals in total, those over 30 s that the histogram leaves out, and those under 1 s."""
    x, w = F.col("interval_us"), F.col("weight")

    def weight_where(condition):
        return F.coalesce(F.sum(F.when(condition, w)), F.lit(0))

    return _pooled_intervals(users, queries, excluded).agg(
        F.coalesce(F.sum(w), F.lit(0)).alias("n_intervals"),
        weight_where(x > micros(HISTOGRAM_MAX_S)).alias("n_discarded"),
        weight_where(x < micros(TOO_SHORT_S)).alias("n_too_short"),
    )


def interarrival_hist(
    users: DataFrame,
    queries: DataFrame,
    excluded: tuple[str, ...] = SUSPICIOUS_USER_NAMES,
    max_s: float = HISTOGRAM_MAX_S,
    bins: int = HISTOGRAM_BINS,
) -> DataFrame:
    """U4: histogram of the intervals up to ``max_s`` in equal bins from the smallest to the largest of them.

    Intervals are aggregated by value first; there are at most ``max_s`` million of those. The last bin is closed on the
    right. When all intervals are equal the range is widened by half a second on both sides, and without any interval
    it is 0 to 1.
    """
    values = (
        _pooled_intervals(users, queries, excluded)
        .filter(F.col("interval_us") <= micros(max_s))
        .groupBy("interval_us")
        .agg(F.sum("weight").alias("n"))
    )
    lo, hi = F.min("interval_us"), F.max("interval_us")
    bounds = values.agg(
        F.struct(
            F.when(lo.isNull(), 0).when(lo == hi, lo - MICROS // 2).otherwise(lo).alias("lo"),
            F.when(lo.isNull(), MICROS).when(lo == hi, hi + MICROS // 2).otherwise(hi).alias("hi"),
        )
    ).scalar()
    # Attached as one column per side, so that the subquery is not repeated in every expression.
    lo, span = F.col("bounds.lo"), F.col("bounds.hi") - F.col("bounds.lo")
    bin_no = F.least(F.call_function("div", (F.col("interval_us") - lo) * bins, span), F.lit(bins - 1).cast("long"))
    counts = values.withColumn("bounds", bounds).groupBy(bin_no.alias("bin")).agg(F.sum("n").alias("n"))
    edges = values.sparkSession.range(bins).withColumn("bounds", bounds).select(
        F.col("id").alias("bin"),
        ((lo + span * F.col("id") / bins) / MICROS).alias("from_s"),
        ((lo + span * (F.col("id") + 1) / bins) / MICROS).alias("to_s"),
    )
    return edges.join(counts, "bin", "left").select("bin", "from_s", "to_s", F.coalesce("n", F.lit(0)).alias("n"))
