"""Stored tables clustered by user (S8): reads of a user or session prune, windows over a user need no shuffle.

A table is stored in two parts with disjoint users. Most users are dealt into buckets, one file each, sorted by user: a task
has all rows of its users, and a read of one user opens one file. A user with very many rows would make one bucket huge, so
those users' rows go into files by ranges of user and time instead, which are read by as many tasks as they need; the files'
statistics still leave only a few of them to a read. ``per_user`` runs an operator on both parts.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import md5
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from searchlog import schemas
from searchlog.operators import select
from searchlog.operators.sessions import SESSION_GAP_S, session_deltas, sessionize
from searchlog.operators.slices import HOT_ROWS, split_hot
from searchlog.sources.store import table_path

#: Rows that a bucket, or a file of a very frequent user, should hold. Smaller files are written several by a task, so that tasks,
#: each of which reports to the driver, depend on rows and not on files.
ROWS_PER_FILE = 1_000_000

#: Buckets of a table, at most; beyond them files grow.
MOST_BUCKETS = 65_536

#: What the rows of a user are sorted by.
ORDER = {"queries": ("ts", "query_id"), "sessions": ("session_seq",), "sessions_all": ("session_seq",), "users": ()}

_LAYOUT = "buckets int, hot_files int, tasks int"


class Clustered(NamedTuple):
    """A stored table: users in buckets, and users with very many rows in files by user and time.

    ``tasks`` wrote the buckets. Scans by bucket have a task for each; results over them are brought together to this number.
    """

    cold: DataFrame
    hot: DataFrame
    tasks: int

    def rows(self) -> DataFrame:
        return self.cold.unionByName(self.hot)


def _files(rows: int, rows_per_file: int) -> int:
    return max(1, min(MOST_BUCKETS, -(-rows // rows_per_file)))


def _writers(spark: SparkSession, files: int, rows: int) -> int:
    """Tasks that write the files: as many as a shuffle has, more if each would have over ``ROWS_PER_FILE`` rows."""
    return min(files, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_PER_FILE)))


def _bucketed(spark: SparkSession, path: str, schema: T.StructType, buckets: int, order: tuple[str, ...]) -> DataFrame:
    """Stored buckets as a table of the session's catalog, which is what tells Spark how its rows are dealt."""
    name = f"clustered_{md5(path.encode()).hexdigest()}"
    columns = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in schema.fields)
    spark.sql(f"DROP TABLE IF EXISTS {name}")  # the table is external, its files stay
    spark.sql(
        f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (user_id) SORTED BY ({', '.join(order)}) "
        f"INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    return spark.table(name)


def write_clustered(
    df: DataFrame, root: str, name: str, hot_rows: int = HOT_ROWS, rows_per_file: int = ROWS_PER_FILE
) -> Clustered:
    """Replace one clustered table (``schemas.TABLES``); ``df`` must not read the table it replaces and is read four times.

    A user with more than ``hot_rows`` rows (and more than 1/100,000 of the table) is kept out of the buckets. Rows without a
    user are one user's. An empty table has one empty bucket.
    """
    spark, path = df.sparkSession, table_path(root, name)
    rows = schemas.conform(df, schemas.TABLES[name])
    cold, hot = split_hot(rows, ["user_id"], hot_rows)
    order = ("user_id", *ORDER[name])
    in_all, in_hot = rows.count(), hot.count()
    buckets, hot_files = _files(in_all, rows_per_file), _files(in_hot, rows_per_file)
    ranges = hot.repartitionByRange(_writers(spark, hot_files, in_hot), *order).sortWithinPartitions(*order)
    writer = ranges.write.mode("overwrite").option("maxRecordsPerFile", max(rows_per_file, -(-in_hot // hot_files)))
    writer.parquet(f"{path}/hot")
    table = f"clustered_{md5(f'{path}/cold'.encode()).hexdigest()}"
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    # Dealt the way buckets are. Their number is a multiple of the tasks', so that a task has whole buckets and writes one file each.
    tasks = _writers(spark, buckets, in_all)
    buckets = tasks * min(-(-buckets // tasks), MOST_BUCKETS // tasks)
    writer = cold.repartition(tasks, "user_id").write.mode("overwrite").option("path", f"{path}/cold")
    writer.bucketBy(buckets, "user_id").sortBy(*order).saveAsTable(table)
    layout = spark.createDataFrame([(buckets, hot_files, tasks)], _LAYOUT)
    layout.coalesce(1).write.mode("overwrite").json(f"{path}/layout")
    return read_clustered(spark, root, name)


def read_clustered(spark: SparkSession, root: str, name: str) -> Clustered:
    """A clustered table, stored by this session or an earlier one."""
    path, schema = table_path(root, name), schemas.TABLES[name]
    layout = spark.read.schema(_LAYOUT).json(f"{path}/layout").first()
    cold = _bucketed(spark, f"{path}/cold", schema, layout["buckets"], ("user_id", *ORDER[name]))
    return Clustered(cold, spark.read.schema(schema).parquet(f"{path}/hot"), layout["tasks"] or layout["buckets"])


def per_user(table: Clustered, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """An operator that treats every user alone, on both parts. Over the buckets, windows and groups by user aren't shuffled."""
    return operator(table.cold).coalesce(table.tasks).unionByName(operator(table.hot))


def queries_of_user(queries: Clustered, user_id: int) -> DataFrame:
    """opens one bucket, and of the frequent users' files those whose statistics fit."""
    return per_user(queries, lambda rows: select.queries_of_user(rows, user_id))


def sessions_of_user(sessions: Clustered, user_id: int) -> DataFrame:
    """as ``queries_of_user``; pass the cleaned or the uncleaned session table."""
    return per_user(sessions, lambda rows: select.sessions_of_user(rows, user_id))


def queries_in_session(queries: Clustered, sessions: Clustered, session_id: int, uncleaned: bool = False) -> DataFrame:
    """the session's user is looked up first, and only that user's bucket is opened."""
    owner = sessions.rows().filter(F.col("session_id") == session_id).select("user_id").first()
    if owner is None:
        return queries.cold.limit(0)
    return per_user(
        queries, lambda rows: select.queries_in_session(select.queries_of_user(rows, owner["user_id"]), session_id, uncleaned)
    )


def query_deltas(queries: Clustered, drop_suspicious: bool = True) -> DataFrame:
    """W1 without a shuffle of the buckets; frequent users go over time slices."""
    cold = session_deltas(queries.cold, drop_suspicious).coalesce(queries.tasks)
    return cold.unionByName(session_deltas(queries.hot, drop_suspicious, sliced=True))


def sessions_of(queries: Clustered, gap_s: float = SESSION_GAP_S, drop_suspicious: bool = True) -> DataFrame:
    """W2-W5 without a shuffle of the buckets."""
    return per_user(queries, lambda rows: sessionize(rows, gap_s, drop_suspicious))
