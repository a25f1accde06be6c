import random

import pytest
from pyspark.sql import functions as F

import brute
from searchlog.operators import select, sessions


def _assigned(df):
    return {r.query_id: r.session_seq for r in df.collect() if r.session_seq is not None}


def _run(spark, rows, gap_s=1800.0, drop=True):
    frame = brute.log_frame(spark, rows)
    return _assigned(sessions.attach_sessions(frame, None, gap_s, drop))


def test_gap_is_exclusive(spark):
    rows = [
        (1, "a", 0.0, True, False, 1),
        (2, "a", 1800.0, True, False, 1),
        (3, "a", 3600.000001, True, False, 1),
        (4, "a", 0.0, True, False, 2),
    ]
    assert _run(spark, rows) == {1: 0, 2: 0, 3: 1, 4: 0}


def test_scope(spark):
    rows = [
        (1, "a", 5.0, True, False, 1),
        (2, "a", 5.0, True, True, 1),
        (3, "a", 5.0, False, False, 1),
        (4, "a", None, True, False, 1),
        (5, "a", 5.0, True, False, None),
        (6, "a", 5.0, True, True, 2),
    ]
    assert set(_run(spark, rows)) == {1}
    assert set(_run(spark, rows, drop=False)) == {1, 2, 6}
    stats = sessions.sessionize(brute.log_frame(spark, rows)).collect()
    assert [(s.user_id, s.session_seq, s.duration_s, s.n_queries) for s in stats] == [(1, 0, 0.0, 1)]


def test_times_before_1970(spark):
    rows = [(1, "a", -1801.5, True, False, 1), (2, "a", -1.0, True, False, 1), (3, "a", 1799.0, True, False, 1)]
    assert _run(spark, rows) == brute_seq(rows)


def brute_seq(rows, **kw):
    return {q: seq for q, (_, seq, _) in brute.session_of_query(rows, **kw).items()}


def random_log(seed, n=400):
    rng = random.Random(seed)
    step = rng.choice([0.5, 40, 900, 1800])
    return [
        (
            q,
            rng.choice("abcd"),
            rng.choice([float(rng.randrange(0, 50)) * step, rng.uniform(-1e4, 1e5)]),
            rng.random() < 0.8,
            rng.random() < 0.2,
            rng.choice([1, 1, 1, 2, 3, 4]),
        )
        for q in range(1, n + 1)
    ]


@pytest.mark.parametrize("seed,gap_s,drop", [(1, 1800.0, True), (2, 1800.0, False), (3, 0.0, True), (4, 7.25, True)])
def test_random_logs(spark, seed, gap_s, drop):
    rows = random_log(seed)
    expected = brute.session_of_query(rows, gap_s, drop)
    frame = brute.log_frame(spark, rows)
    assert _run(spark, rows, gap_s, drop) == {q: seq for q, (_, seq, _) in expected.items()}
    deltas = {r.query_id: round(r.delta_s * 1e6) for r in sessions.query_deltas(frame, drop).collect()}
    assert deltas == {q: delta for q, (_, _, delta) in expected.items()}


def test_global_numbers_follow_users_and_sessions(spark):
    rows = random_log(5)
    expected = brute.session_of_query(rows, 900.0)
    order = {key: n for n, key in enumerate(sorted({(u, s) for u, s, _ in expected.values()}))}
    numbered = sessions.queries_with_session(brute.log_frame(spark, rows), 900.0)
    assert numbered.columns[-1] == "session_id"
    got = {r.query_id: r.session_id for r in numbered.collect()}
    assert got == {r[0]: order.get(expected[r[0]][:2]) if r[0] in expected else None for r in rows}


def test_both_session_columns(spark):
    frame = brute.log_frame(spark, random_log(6))
    both = sessions.queries_with_session(sessions.queries_with_session(frame), drop_suspicious=False,
                                         id_column="session_id_all")
    row = both.agg(F.count("session_id").alias("clean"), F.count("session_id_all").alias("all")).first()
    assert 0 < row["clean"] < row["all"]
    one = select.queries_in_session(both, 0, uncleaned=True)
    assert one.count() == both.filter("session_id_all = 0").count() > 0


@pytest.mark.parametrize("partitions", ["1", "4", "200"])
def test_same_result_under_any_partitioning(spark, partitions):
    rows = random_log(7)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert _run(spark, rows) == brute_seq(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_stored_sessions_with_more_than_one_query(spark):
    rows = random_log(8)
    expected = brute.session_of_query(rows)
    sizes = {}
    for user, seq, _ in expected.values():
        sizes[user, seq] = sizes.get((user, seq), 0) + 1
    wanted = {q for q, (u, s, _) in expected.items() if sizes[u, s] > 1}
    frame = brute.log_frame(spark, rows)
    assert {r.query_id for r in select.sessions_multi(frame).collect()} == wanted
    stored = sessions.queries_with_session(frame)
    assert {r.query_id for r in select.sessions_multi(stored).collect()} == wanted
