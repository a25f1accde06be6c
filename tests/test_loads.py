"""Loads that add, and sessions of a stream, against one load and the batch operators."""

import random
from collections import defaultdict
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

import brute
from searchlog import schemas
from searchlog.operators import sessions, stages
from searchlog.operators.integrity import fk_violations
from searchlog.runtime import scratch_path
from searchlog.sources import incremental
from searchlog.sources.readers import Log
from searchlog.streaming.sessions import run_available, stream_deltas, stream_sessions

TEXTS = ["search a | stats count", "search b | head 5", "search a | head 5", "| x [search y]", "broken ["]
_LOG = "name string, case_id string, text string, ts timestamp, is_interactive boolean, is_suspicious boolean, splunk_search_id string"


def _log(spark, rows):
    """Rows of (name, text, seconds, id) as a log."""
    values = [(name, "c", text, brute.at(s), True, False, i) for name, text, s, i in rows]
    frame = spark.createDataFrame(values, _LOG).withColumn("input_row", F.monotonically_increasing_id())
    return Log(frame, frame.limit(0))


def _rows(seed, n, users="abcdef"):
    rng = random.Random(seed)
    return [(rng.choice(users), rng.choice(TEXTS), rng.randrange(60_000), f"s{seed}.{i}") for i in range(n)]


def _load(spark, root, rows):
    load = incremental.append_base(spark, _log(spark, rows), root)
    incremental.append_sessions(spark, root)
    incremental.append_unique_stages(spark, root)
    return load


@pytest.fixture()
def root(spark):
    path = scratch_path(spark, "loads")
    incremental.initialize(spark, path)
    return path


def _ids(spark, root):
    names = {r.user_id: r.name for r in incremental.users(spark, root).collect()}
    rows = incremental.queries(spark, root).collect()
    return {r.query_id: (names[r.user_id], r["text"], brute.us(r.ts.astimezone(brute.EPOCH.tzinfo)), r.splunk_search_id) for r in rows}


def test_ids_stay_and_go_on(spark, root):
    first, second = _rows(1, 60, "abd"), _rows(2, 50, "abcde")
    assert _load(spark, root, first) == 1
    before = _ids(spark, root)
    assert sorted(before) == list(range(1, 61))
    assert _load(spark, root, second + first[:20]) == 2  # an export that overlaps the one before
    after = _ids(spark, root)
    assert sorted(after) == list(range(1, 111)) and {q: after[q] for q in before} == before
    users = [(r.user_id, r.name) for r in incremental.users(spark, root).orderBy("user_id").collect()]
    assert users == [(1, "a"), (2, "b"), (3, "d"), (4, "c"), (5, "e")]
    assert _load(spark, root, second) == 0 and incremental.last_load(spark, root) == 2
    assert _ids(spark, root) == after
    # Without the comparison every row is a query of its own.
    assert incremental.append_base(spark, _log(spark, second), root, skip_known=False) == 3
    assert len(_ids(spark, root)) == 160


def test_sessions_keep_their_ids(spark, root):
    gap = 1800
    _load(spark, root, [("a", "x", 0, "1"), ("a", "x", 10_000, "2"), ("b", "x", 5, "3"), ("c", "x", 7, "4")])

    def current():
        placed = {r.query_id: r.session_id for r in incremental.query_sessions(spark, root).collect()}
        by_id = defaultdict(set)
        for query, value in _ids(spark, root).items():
            by_id[placed[query]].add(value[3])
        found = {r.session_id: (r.session_seq, r.n_queries) for r in incremental.sessions(spark, root).collect()}
        assert {s: len(queries) for s, queries in by_id.items()} == {s: n for s, (_, n) in found.items()}
        return dict(by_id), {s: seq for s, (seq, _) in found.items()}

    assert current() == ({0: {"1"}, 1: {"2"}, 2: {"3"}, 3: {"4"}}, {0: 0, 1: 1, 2: 0, 3: 0})
    # One session goes on, a new one comes between, and a user that was away stays as it was.
    _load(spark, root, [("a", "x", 5000, "5"), ("a", "x", 10_000 + gap, "6"), ("b", "x", 90_000, "7")])
    assert current() == (
        {0: {"1"}, 1: {"2", "6"}, 2: {"3"}, 3: {"4"}, 4: {"5"}, 5: {"7"}}, {0: 0, 4: 1, 1: 2, 2: 0, 3: 0, 5: 1}
    )
    # Late rows join sessions: the smallest id stays.
    _load(spark, root, [("a", "x", s, f"late{s}") for s in range(6000, 10_000, 1000)])
    assert current()[0] == {
        0: {"1"}, 1: {"2", "5", "6", *(f"late{s}" for s in range(6000, 10_000, 1000))}, 2: {"3"}, 3: {"4"}, 5: {"7"}
    }
    only_b = incremental.table(spark, root, "query_sessions").filter("load = 3").select("user_id").distinct().collect()
    assert [r.user_id for r in only_b] == [1]  # nobody else was read again


def test_loads_equal_one(spark, root):
    parts = [_rows(seed, 80) for seed in (5, 6, 7)]
    for part in parts:
        _load(spark, root, part)
    queries = incremental.queries(spark, root)
    whole = sessions.sessionize(schemas.conform(queries, schemas.QUERIES))
    columns = ["user_id", "session_seq", "start_ts", "end_ts", "n_queries"]
    found = incremental.sessions(spark, root)
    assert sorted(map(tuple, found.select(columns).collect())) == sorted(map(tuple, whole.select(columns).collect()))
    assert found.select("session_id").distinct().count() == found.count()
    expected = stages.unique_stages(queries)
    got = incremental.unique_stages(spark, root)
    assert got.select(expected.columns).exceptAll(expected).isEmpty() and expected.exceptAll(got.select(expected.columns)).isEmpty()
    assert {r.command for r in incremental.unique_stages(spark, root, ["head"]).collect()} == {"head"}
    tables = {"users": incremental.users(spark, root), "queries": queries, "sessions": found, "stages": stages.stages(queries)}
    assert fk_violations(tables).isEmpty()


def test_an_empty_load(spark, root):
    assert _load(spark, root, []) == 0
    assert incremental.sessions(spark, root).count() == incremental.unique_stages(spark, root).count() == 0


def test_integrity_reads_each_table_once(spark):
    rows = [(1, "a", 1, 1), (2, None, 9, 1), (3, "b", 9, None), (4, "c", None, 8)]
    queries = spark.createDataFrame(rows, "query_id long, text string, user_id long, session_id long")
    users = spark.createDataFrame([(1,), (2,), (None,)], "user_id long")
    found = spark.createDataFrame([(1, 1), (2, 7)], "session_id long, user_id long")
    result = fk_violations({"queries": queries, "users": users, "sessions": found})
    assert {tuple(r) for r in result.collect()} == {
        ("queries.user_id in users.user_id", "9", 2), ("sessions.user_id in users.user_id", "7", 1),
        ("queries.session_id in sessions.session_id", "8", 1), ("queries.text not null", None, 1),
    }
    plan = result._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") + plan.count("Scan") == 3 and "Join" not in plan
    assert fk_violations({"queries": queries.limit(0), "users": users}).collect() == []


# --- Streams ---


def _stream(spark, tmp_path):
    (tmp_path / "log").mkdir()
    path = str(tmp_path / "log")
    schema = spark.createDataFrame([], brute.LOG_SCHEMA).schema
    return path, spark.readStream.schema(schema).parquet(path)


def _append(spark, path, rows):
    brute.log_frame(spark, rows).coalesce(1).write.mode("append").parquet(path)


def test_streamed_sessions_and_deltas(spark, tmp_path):
    rng = random.Random(2)
    rows = [
        (q, "x", rng.randrange(300, 40_000, 300), rng.random() < 0.9, rng.random() < 0.1, rng.choice([1, 2, None]))
        for q in range(150)
    ]
    rows.sort(key=lambda r: r[2])
    for i in range(0, len(rows), 9):  # out of order by less than the delay
        rows[i : i + 9] = rng.sample(rows[i : i + 9], len(rows[i : i + 9]))
    closing = [(900, "x", 200_000, True, False, 3)]
    path, stream = _stream(spark, tmp_path)
    outs = {"sessions": stream_sessions(stream, delay="2 hours"), "deltas": stream_deltas(stream, delay="2 hours")}
    for part in (rows[:50], rows[50:51], rows[51:], closing, [(901, "late", 10, True, False, 1)]):
        _append(spark, path, part)
        for name, found in outs.items():
            run_available(found, str(tmp_path / name), str(tmp_path / f"{name}-state"))
    expected = brute.session_of_query(rows)
    deltas = spark.read.parquet(str(tmp_path / "deltas")).collect()
    assert {r.query_id: round(r.delta_s * 1e6) for r in deltas} == {q: d for q, (_, _, d) in expected.items()}
    assert len(deltas) == len(expected)
    bounds = defaultdict(list)
    for q, _, s, *_ in rows:
        if q in expected:
            bounds[expected[q][:2]].append(s)
    found = spark.read.parquet(str(tmp_path / "sessions")).collect()
    assert sorted((r.user_id, r.n_queries, r.duration_s) for r in found) == sorted(
        (user, len(times), float(max(times) - min(times))) for (user, _), times in bounds.items()
    )


@pytest.mark.parametrize("at_once", [True, False])
def test_a_streamed_gap_of_exactly_the_limit(spark, tmp_path, at_once):
    rows = [(1, "x", 0, True, False, 1), (2, "x", 1800, True, False, 1), (3, "x", 3600.000001, True, False, 1)]
    rows = [(q, t, s + 60, *flags) for q, t, s, *flags in rows]  # a watermark starts at 1970, which is late then
    path, stream = _stream(spark, tmp_path)
    rows.append((9, "x", 90_000, True, False, 2))
    for part in [rows] if at_once else [[row] for row in rows]:
        _append(spark, path, part)
        run_available(stream_sessions(stream, delay="2 hours"), str(tmp_path / "out"), str(tmp_path / "state"))
    found = spark.read.parquet(str(tmp_path / "out")).orderBy("start_ts").collect()
    assert [(r.n_queries, r.end_ts - r.start_ts) for r in found] == [(2, timedelta(seconds=1800)), (1, timedelta(0))]
