import math

import numpy as np
import pytest

import brute
from searchlog.operators import groups
from test_sessions import random_log


def _report(spark, rows, **kw):
    found = groups.group_report(brute.log_frame(spark, rows), **kw).collect()
    return {
        r.query_id: (
            r.n_copies, r.n_copies_this_user, r.n_distinct_users, r.n_intervals, r.entropy, r.consistency, r.clockness
        )
        for r in found
    }


def _same(got, expected):
    assert set(got) == set(expected)
    for q, values in expected.items():
        for a, b in zip(got[q], values):
            assert (a is None and b is None) or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9), (q, got[q], values)


def _log(*times, text="a", user=1, start=1):
    return [(start + i, text, t, True, False, user) for i, t in enumerate(times)]


def test_one_and_two_copies(spark):
    rows = _log(5.0) + _log(10.0, 40.0, text="b", start=10)
    assert _report(spark, rows, multiple=False)[1] == (1, 1, 1, 0, 0.0, 1.0, -1.0)
    assert set(_report(spark, rows)) == {10, 11}
    assert _report(spark, rows)[10] == (2, 2, 1, 1, 0.0, 1.0, 1.0)


def test_equal_times_have_mean_zero(spark):
    assert _report(spark, _log(7.0, 7.0, 7.0))[1][5:] == (0.0, 1.0)


def test_interval_range_is_closed_at_the_end(spark):
    _same(_report(spark, _log(0.0, 1e6, 1e6 + 50)), brute.groups(_log(0.0, 1e6, 1e6 + 50)))
    over = _log(0.0, 1e6 + 1, 2e6 + 2)
    assert _report(spark, over)[1][4] is None


def test_a_missing_user_is_one_user(spark):
    rows = _log(1.0, 2.0) + _log(3.0, 5.0, user=None, start=10)
    report = _report(spark, rows)
    assert report[1][:3] == report[10][:3] == (4, 2, 2)
    _same(report, brute.groups(rows))


def test_rows_without_a_time_count_as_copies_only(spark):
    rows = _log(1.0, 31.0, None)
    assert _report(spark, rows)[1] == (3, 3, 1, 1, 0.0, 1.0, 1.0)


def test_filter_by_text(spark):
    rows = _log(1.0, 2.0) + _log(3.0, 5.0, text="b", start=10)
    assert set(_report(spark, rows, text="b")) == {10, 11}


@pytest.mark.parametrize("seed", [11, 12, 13])
def test_random_logs(spark, seed):
    rows = random_log(seed)
    expected = {q: v for q, v in brute.groups(rows).items() if v[0] > 1}
    _same(_report(spark, rows), expected)
    counted = groups.query_groups(brute.log_frame(spark, rows)).collect()
    assert {r.query_id: (r.n_copies, r.n_copies_this_user, r.n_distinct_users) for r in counted} == {
        q: v[:3] for q, v in expected.items()
    }


def test_entropy_is_the_density_histogram():
    gaps = [3, 150, 151, 7_000, 250_000, 999_999, 1_000_000, 1_000_001]
    hist, _ = np.histogram(gaps, bins=10_000, range=(0.0, 1e6), density=True)
    assert math.isclose(brute.entropy([g * 10**6 for g in gaps]), -np.sum(hist * np.log(hist + 1e-4)))


def test_thresholds(spark):
    frame = groups.group_report(brute.log_frame(spark, _log(0.0, 45.0, 60.0, 200.0)))
    assert {r.is_suspicious for r in groups.group_suspicious(frame).collect()} == {False}
    loose = groups.group_suspicious(frame, distinct_users_max=0).collect()
    assert {r.is_suspicious for r in loose} == {True}


def test_interarrivals(spark):
    rows = _log(10.0, 4.0, 4.0) + _log(5.0, text="b", start=10)
    got = {r.query_id: r.interval_s for r in groups.interarrivals(brute.log_frame(spark, rows)).collect()}
    assert got == {3: 0.0, 1: 6.0}
