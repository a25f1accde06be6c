"""Sessions and groups on a replicated event table, evenly spread and with one user owning a third of all rows.

Usage: python scale_bench.py [copies]. Each copy gets users and times of its own. ``window_*`` is the plain window over the user,
for comparison.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from searchlog.operators import groups, sessions, userstats  # noqa: E402
from searchlog.plans import testlog  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def replicate(spark: SparkSession, copies: int, skewed: bool) -> DataFrame:
    n_users, n_rows, hour_us = 100_000, 10**9, 3_600_000_000
    replica = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long"))).alias("copy")
    rows = testlog.queries(spark, SF_DIR).repartition(int(CPUS) * 2).select("*", replica)
    user = F.col("user_id") + F.col("copy") * n_users
    if skewed:
        user = F.when(F.pmod(F.xxhash64("query_id", "copy"), F.lit(3)) == 0, F.lit(0)).otherwise(user)
    return rows.withColumns(
        {
            "user_id": user.cast("long"),
            "query_id": F.col("query_id") + F.col("copy") * n_rows,
            "ts": F.timestamp_micros(F.unix_micros("ts") + F.col("copy") * hour_us),
        }
    ).drop("copy")


def window_sessions(queries: DataFrame) -> DataFrame:
    by_time = Window.partitionBy("user_id").orderBy("ts", "query_id")
    rows = sessions.session_input(queries).withColumn("ts_us", F.unix_micros("ts"))
    opens = (F.col("ts_us") - F.lag("ts_us").over(by_time)) > 1_800_000_000
    return (
        rows.withColumn("opens", F.coalesce(opens, F.lit(False)).cast("long"))
        .withColumn("seq", F.sum("opens").over(by_time))
        .groupBy("user_id", "seq")
        .agg(F.min("ts_us"), F.max("ts_us"), F.count("*"))
    )


def window_deltas(queries: DataFrame) -> DataFrame:
    by_time = Window.partitionBy("user_id").orderBy("ts", "query_id")
    return sessions.session_input(queries).withColumn("gap", F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(by_time))


def main() -> None:
    copies = int(sys.argv[1]) if len(sys.argv) > 1 else 100
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", str(int(CPUS) * 4))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    root = tempfile.mkdtemp(prefix="searchlog-scale-")
    users = spark.range(1).select(F.col("id").alias("user_id"), F.lit("splunk-system-user").alias("name"))
    for skewed in (False, True):
        path = f"{root}/{'skewed' if skewed else 'even'}"
        replicate(spark, copies, skewed).write.parquet(path)
        queries = spark.read.parquet(path)
        runs = {
            "sessionize": lambda q: sessions.sessionize(q),
            "window_sessions": window_sessions,
            "attach_sessions": lambda q: sessions.attach_sessions(q),
            "query_deltas": lambda q: sessions.query_deltas(q),
            "window_deltas": window_deltas,
            "interarrival_counts": lambda q: userstats.interarrival_counts(users, q),
            "query_groups": lambda q: groups.query_groups(q),
            "group_metrics": lambda q: groups.group_metrics(q),
        }
        seconds = {}
        for name, run in runs.items():
            start = time.perf_counter()
            run(queries).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 2)
        print(json.dumps({"skewed": skewed, "rows": queries.count(), "seconds": seconds}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
