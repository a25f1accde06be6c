"""Every registered query against its SQL, on the smallest data."""

import pytest

from oracle_check import compare, duck
from __spark_entry__ import entry, oracle_sql, queries
from searchlog.plans import catalog

SF = "0.001"


@pytest.fixture(scope="module")
def connection():
    return duck(SF)


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(oracle_sql()) & set(catalog.QUERIES)


@pytest.mark.parametrize("key", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, connection, key):
    problem, _, _ = compare(spark, connection, SF, queries()[key], oracle_sql()[key])
    assert problem is None


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["user_id", "session_seq", "start_us", "end_us", "duration_s", "n_queries"]
    assert df.count() > 0
