"""Consecutive rows of a key, whatever share of the log the key owns.

A window over a key sorts all of that key's rows in one task. That is the cheapest way for all keys but the few *hot* ones
with very many rows, so the two are split:

* cold keys use the plain window, with one shuffle;
* hot keys go through time slices: rows are aggregated (with map-side combine) to distinct instants, the window runs within
  ``(key, time slice)``, and only one row per slice is carried on to a second window over the key. A task then holds one
  slice's instants or one key's slices, both bounded by the clock and not by the number of rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MICROS = 1_000_000
SLICE_US = 60 * MICROS

# A key is hot with more than HOT_ROWS rows and more than 1 / MAX_HOT_KEYS of all rows. The first bounds the window groups of
# small logs, the second the number of hot keys, which is what gets broadcast.
HOT_ROWS = 1_000_000
MAX_HOT_KEYS = 100_000


def micros(seconds: float) -> int:
    return int(round(seconds * MICROS))


def slice_of(ts_us: Column, width_us: int) -> Column:
    """Number of the slice an instant lies in; floors for instants before 1970 too."""
    width = F.lit(width_us).cast("long")
    return F.call_function("div", ts_us - F.pmod(ts_us, width), width)


def _same_keys(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"l.{key}").eqNullSafe(F.col(f"r.{key}")) for key in keys])


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left`` with the other columns of ``right``, joined on keys under which null equals null."""
    extra = [f"r.{c}" for c in right.columns if c not in keys]
    return left.alias("l").join(right.alias("r"), _same_keys(keys), how).select("l.*", *extra)


def split_hot(
    rows: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS, weight: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """The rows of cold keys and the rows of hot keys; ``weight`` names a column with the rows behind each row.

    At most MAX_HOT_KEYS keys can each hold more than that share of all rows, so the hot list is safe to broadcast.
    Without hot keys the second part is found empty while running and costs no scan.
    """
    sizes = rows.groupBy(*keys).agg((F.sum(weight) if weight else F.count("*")).alias("rows"))
    share = sizes.agg(F.sum("rows")).scalar() / MAX_HOT_KEYS
    hot = F.broadcast(sizes.filter((F.col("rows") > hot_rows) & (F.col("rows") > share)).select(*keys)).alias("r")
    parts = [rows.alias("l").join(hot, _same_keys(keys), how) for how in ("left_anti", "left_semi")]
    return parts[0], parts[1]


def instants(rows: DataFrame, keys: list[str], width_us: int = SLICE_US) -> DataFrame:
    """Distinct instants per key: keys, ``slice``, ``ts_us``, ``first_id`` (the lowest query id) and ``n`` (rows).

    ``rows`` has the keys, ``ts_us`` and ``query_id``. This is where any number of simultaneous rows becomes one.
    """
    return rows.groupBy(*keys, slice_of(F.col("ts_us"), width_us).alias("slice"), "ts_us").agg(
        F.min("query_id").alias("first_id"), F.count("*").alias("n")
    )


def row_points(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Every row as a point of its own, in the columns of ``instants`` but the slice."""
    return rows.select(*keys, "ts_us", F.col("query_id").alias("first_id"), F.lit(1).cast("long").alias("n"))


def interval_points(
    points: DataFrame, keys: list[str], totals: bool = False, hot_rows: int = HOT_ROWS
) -> list[DataFrame]:
    """``instants`` with ``gap_us``, the gap to the key's instant before; null at the first. In two parts, cold and hot.

    The ``n - 1`` other rows of an instant follow their predecessor at distance zero. With ``totals`` each point also
    carries the key's ``n_total``, ``first_us`` and ``last_us``. Rows without a time keep a null instant of their own,
    which no gap and no total sees. The cold part comes partitioned by the keys, so that aggregating it by them needs no
    further shuffle; that is why the parts are not one.
    """
    cold, hot = split_hot(points, keys, hot_rows, weight="n")
    return [window_points(cold, keys, totals), sliced_points(hot, keys, totals)]


def _timed_n() -> Column:
    return F.when(F.col("ts_us").isNotNull(), F.col("n"))


def window_points(points: DataFrame, keys: list[str], totals: bool = False) -> DataFrame:
    """Gaps of cold keys, by one window over the key."""
    over_key = Window.partitionBy(*keys)
    gap = F.col("ts_us") - F.lag("ts_us").over(over_key.orderBy("ts_us"))
    extra = [
        F.sum(_timed_n()).over(over_key).alias("n_total"),
        F.min("ts_us").over(over_key).alias("first_us"),
        F.max("ts_us").over(over_key).alias("last_us"),
    ]
    return points.select(*keys, "ts_us", "first_id", "n", gap.alias("gap_us"), *(extra if totals else []))


def sliced_points(points: DataFrame, keys: list[str], totals: bool = False) -> DataFrame:
    """Gaps of hot keys, by windows within and between slices."""
    in_slice = Window.partitionBy(*keys, "slice")
    marked = points.select(
        "*",
        F.lag("ts_us").over(in_slice.orderBy("ts_us")).alias("prev_us"),
        F.max("ts_us").over(in_slice).alias("slice_last_us"),
        F.sum(_timed_n()).over(in_slice).alias("slice_n"),
    )

    over_key = Window.partitionBy(*keys)
    heads = marked.filter(F.col("prev_us").isNull()).withColumn(
        "prev_us", F.lag("slice_last_us").over(over_key.orderBy("slice"))
    )
    tails = marked.filter(F.col("prev_us").isNotNull())
    columns = [*keys, "slice", "ts_us", "first_id", "n", (F.col("ts_us") - F.col("prev_us")).alias("gap_us")]
    if not totals:
        return heads.select(*columns).unionByName(tails.select(*columns)).drop("slice")

    heads = heads.select(
        *columns,
        F.sum("slice_n").over(over_key).alias("n_total"),
        F.min("ts_us").over(over_key).alias("first_us"),
        F.max("slice_last_us").over(over_key).alias("last_us"),
    )
    per_slice = heads.select(*keys, "slice", "n_total", "first_us", "last_us")
    tails = join_null_safe(tails.select(*columns), per_slice, [*keys, "slice"])
    return heads.unionByName(tails).drop("slice")


def weighted_intervals(points: DataFrame, *columns: str) -> DataFrame:
    """The intervals behind ``interval_points`` as ``(columns, interval_us, weight)``, zeros included."""
    others = F.when(F.col("ts_us").isNotNull(), F.col("n") - 1).otherwise(0)
    pairs = F.array(
        F.struct(F.col("gap_us").alias("interval_us"), F.lit(1).cast("long").alias("weight")),
        F.struct(F.lit(0).cast("long").alias("interval_us"), others.alias("weight")),
    )
    kept = F.filter(pairs, lambda p: p["interval_us"].isNotNull() & (p["weight"] > 0))
    return points.select(*columns, F.inline(kept))


def row_gaps(rows: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """``rows`` plus ``gap_us``: distance to the key's previous row by ``(ts_us, query_id)``, null for the first."""
    cold, hot = split_hot(rows, keys, hot_rows)
    return window_gaps(cold, keys).unionByName(sliced_gaps(hot, keys))


def window_gaps(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``row_gaps`` by a window over the key."""
    by_time = Window.partitionBy(*keys).orderBy("ts_us", "query_id")
    return rows.withColumn("gap_us", F.col("ts_us") - F.lag("ts_us").over(by_time))


def sliced_gaps(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``row_gaps`` for keys with very many rows.

    Rows get their gap by a join on ``query_id``, which is unique on both sides and so balanced whatever the keys are.
    """
    points = sliced_points(instants(rows, keys), keys).select(
        F.col("first_id").alias("query_id"), F.col("gap_us").alias("_gap_us"), F.lit(True).alias("_head")
    )
    gap = F.when(F.col("_head"), F.col("_gap_us")).otherwise(F.lit(0).cast("long"))
    gaps = rows.join(points, "query_id", "left").withColumn("gap_us", gap)
    return gaps.select(*rows.columns, "gap_us")


def with_children(parents: DataFrame, children: DataFrame, key: str, child_keys: DataFrame | None = None) -> DataFrame:
    """Parents left-joined to their children, as an inner join plus the parents without any.

    In that form a parent with very many children can be split by adaptive execution, which an outer join that
    preserves the parents does not allow. ``child_keys`` is any cheaper DataFrame with the children's key values.
    """
    keys = (children if child_keys is None else child_keys).select(key).distinct()
    childless = parents.join(keys, key, "left_anti")
    return children.join(parents, key).unionByName(childless, allowMissingColumns=True)
