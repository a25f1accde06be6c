"""One user, one instant and one text that each hold at least a third of the log."""

import random
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

import brute
from searchlog.operators import groups, select, sessions, slices, userstats
from searchlog.plans import testlog
from test_sessions import random_log

HOT_USER, HOT_TEXT, HOT_TIME = 1, "search hot", 50_000.25


def skewed_log(n=6000):
    rng = random.Random(99)
    rows = []
    for q in range(1, n + 1):
        hot = q % 2 == 0
        user = HOT_USER if hot else rng.randrange(2, 300)
        time = HOT_TIME if q % 6 == 0 else rng.uniform(0, 400_000)
        rows.append((q, HOT_TEXT if hot or q % 5 == 0 else rng.choice("abc"), time, True, q % 7 == 0, user))
    return rows


@contextmanager
def settings(spark, **values):
    names = {k.replace("_", "."): str(v) for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture(scope="module")
def rows():
    return skewed_log()


@pytest.fixture(scope="module")
def frame(spark, rows):
    return brute.log_frame(spark, rows).cache()


@pytest.mark.parametrize("hot_rows", [100, 10**6])
def test_sessions_and_deltas(frame, rows, hot_rows):
    expected = brute.session_of_query(rows)
    got = {r.query_id: r.session_seq for r in sessions.attach_sessions(frame).collect()}
    assert {q: s for q, s in got.items() if s is not None} == {q: s for q, (_, s, _) in expected.items()}
    deltas = {r.query_id: round(r.delta_s * 1e6) for r in sessions.query_deltas(frame, hot_rows=hot_rows).collect()}
    assert deltas == {q: d for q, (_, _, d) in expected.items()}


@pytest.mark.parametrize("hot_rows", [50, 10**6])
def test_groups(frame, rows, hot_rows):
    expected = {q: v for q, v in brute.groups(rows).items() if v[0] > 1}
    report = groups.group_report(frame, hot_rows=hot_rows).collect()
    assert len(report) == len(expected)
    for r in report:
        values = (r.n_copies, r.n_copies_this_user, r.n_distinct_users, r.n_intervals, r.entropy, r.consistency, r.clockness)
        assert values == pytest.approx(expected[r.query_id])


def test_hot_and_cold_are_a_partition(frame):
    cold, hot = slices.split_hot(frame, ["user_id"], hot_rows=100)
    assert {r.user_id for r in hot.select("user_id").distinct().collect()} == {HOT_USER}
    assert cold.count() + hot.count() == frame.count()


@pytest.mark.parametrize("hot_rows", [5, 10**6])
def test_random_groups_through_both_paths(spark, hot_rows):
    log = random_log(21)
    report = groups.group_report(brute.log_frame(spark, log), multiple=False, hot_rows=hot_rows).collect()
    expected = brute.groups(log)
    assert len(report) == len(expected)
    for r in report:
        assert (r.n_intervals, r.entropy, r.consistency, r.clockness) == pytest.approx(expected[r.query_id][3:])
    gaps = groups.interarrivals(brute.log_frame(spark, log), hot_rows).count()
    assert gaps == sum(v[3] / v[1] for v in expected.values()).__round__()


def test_counts_of_intervals(spark, frame, rows):
    users = spark.range(400).select(F.col("id").alias("user_id"), F.lit("u").alias("name"))
    gaps = [d for q, (_, _, d) in brute.session_of_query(rows).items()]
    n_users = len({u for u, _, _ in brute.session_of_query(rows).values()})
    counted = userstats.interarrival_counts(users, frame).first()
    assert counted.n_intervals == len(gaps) - n_users
    assert counted.n_discarded == sum(g > 30_000_000 for g in gaps)
    assert counted.n_too_short == sum(g < 1_000_000 for g in gaps) - n_users


def test_hot_instant_is_one_row_before_any_window(frame):
    points = slices.instants(frame.withColumn("ts_us", F.unix_micros("ts")), ["user_id"])
    hot = points.filter(F.col("ts_us") == int(HOT_TIME * 1e6)).filter(F.col("user_id") == HOT_USER)
    assert [r.n for r in hot.collect()] == [1000]


def test_slices_bound_the_windows(frame):
    """A user's rows in the session window are at most one per gap length, however many queries there are."""
    sizes = sessions.session_slices(frame).groupBy("user_id").count().agg(F.max("count")).first()[0]
    assert sizes <= 400_000 / 1800 + 2


def _final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["sessions", "groups", "users"])
def test_adaptive_execution_can_split_the_hot_side(spark, frame, name):
    wide = frame.withColumn("pad", F.repeat(F.sha2(F.col("query_id").cast("string"), 512), 4))
    users = spark.range(400).select(
        F.col("id").alias("user_id"), F.lit("u").alias("name"), F.lit("c").alias("case_id"), F.lit("t").alias("user_type")
    )
    with settings(
        spark,
        spark_sql_autoBroadcastJoinThreshold=-1,
        spark_sql_adaptive_autoBroadcastJoinThreshold=-1,
        spark_sql_adaptive_skewJoin_skewedPartitionThresholdInBytes="20KB",
        spark_sql_adaptive_skewJoin_skewedPartitionFactor="1.5",
        spark_sql_adaptive_advisoryPartitionSizeInBytes="16KB",
        spark_sql_adaptive_coalescePartitions_enabled="false",
        spark_sql_shuffle_partitions="16",
    ):
        spread = wide.repartition(16)
        built = {
            "sessions": lambda: sessions.attach_sessions(spread),
            "groups": lambda: groups.query_groups(spread),
            "users": lambda: select.users_with_queries(users, spread),
        }[name]()
        assert "skew=true" in _final_plan(built)


def test_no_cross_join_no_single_partition_of_rows(spark):
    """No nested loop in the row-level operators, and no exchange that gathers rows in one place."""
    queries = testlog.queries(spark, "/root/testdata/sf0.001")
    for df in (
        sessions.attach_sessions(queries),
        sessions.query_deltas(queries),
        groups.group_report(queries),
        groups.interarrivals(queries),
    ):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        lines = plan.splitlines()
        for line, below in zip(lines, lines[1:]):
            if "SinglePartition" in line:  # only the partial sums of a global count may meet in one place
                assert "HashAggregate(keys=[], functions=[partial_sum" in below


def test_histogram_edge_cases(spark):
    users = spark.range(9).select(F.col("id").alias("user_id"), F.lit("u").alias("name"))

    def hist(*times):
        log = brute.log_frame(spark, [(i, "a", t, True, False, 1) for i, t in enumerate(times)])
        return {r.bin: (r.from_s, r.to_s, r.n) for r in userstats.interarrival_hist(users, log).collect()}

    empty, equal, spread = hist(5.0), hist(0.0, 4.0, 8.0), hist(0.0, 1.0, 3.0, 33.0, 100.0)
    assert len(empty) == 1000 and (empty[0][0], empty[999][1]) == (0.0, 1.0) and not any(n for *_, n in empty.values())
    assert (equal[0][0], equal[999][1], equal[500][2]) == (3.5, 4.5, 2)
    assert (spread[0][2], spread[999][2], sum(n for *_, n in spread.values())) == (1, 1, 3)
