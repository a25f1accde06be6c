"""Run registered queries next to their SQL in DuckDB and compare rows.

Usage: python tests/oracle_check.py [sf] [key ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def data_dir(sf: str) -> str:
    return f"/root/testdata/sf{sf}"


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data_dir(sf)}/{table}.parquet'")
    return connection


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return value


_SQL_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def compare(spark: SparkSession, connection, sf: str, function, sql: str) -> tuple[str | None, int, float]:
    """A description of the first difference or None, the number of rows, and the seconds Spark took."""
    start = time.time()
    df = function(spark, data_dir(sf))
    names = sorted(df.columns)
    mine = Counter(tuple(_cell(row[name]) for name in names) for row in df.collect())
    seconds = time.time() - start
    relation = connection.sql(sql)
    if sorted(relation.columns) != names:
        return f"columns {names} != {sorted(relation.columns)}", 0, seconds
    types = dict(zip(relation.columns, map(str, relation.types)))
    for name, dtype in df.dtypes:
        if _SQL_TYPES[dtype] != types[name]:
            return f"type of {name}: {dtype} != {types[name]}", 0, seconds
    order = [relation.columns.index(name) for name in names]
    theirs = Counter(tuple(_cell(row[i]) for i in order) for row in relation.fetchall())
    total = sum(theirs.values())
    if mine == theirs:
        return None, total, seconds
    return (
        f"{sum(mine.values())} rows against {total}; only here {list((mine - theirs).items())[:2]}, "
        f"only there {list((theirs - mine).items())[:2]}",
        total,
        seconds,
    )


def session(cores: str = "8", zone: str = "UTC") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", zone)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def main() -> None:
    from __spark_entry__ import oracle_sql, queries

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    keys = sys.argv[2:] or list(queries())
    spark, connection = session(zone=os.environ.get("CHECK_ZONE", "UTC")), duck(sf)
    spark.sparkContext.setLogLevel("ERROR")
    failed = 0
    for key in keys:
        try:
            problem, rows, seconds = compare(spark, connection, sf, queries()[key], oracle_sql()[key])
        except Exception as error:  # noqa: BLE001 - report and go on with the next query
            problem, rows, seconds = f"{type(error).__name__}: {str(error)[:600]}", 0, 0.0
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {key:25} {rows:7} rows {seconds:6.2f}s {problem or ''}", flush=True)
    print(f"{len(keys) - failed} of {len(keys)} match")


if __name__ == "__main__":
    main()
