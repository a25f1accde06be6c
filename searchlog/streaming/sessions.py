"""Sessions and deltas of a log that is still being written (W1-W3), with Structured Streaming.

Queries may come out of order by as much as ``delay``; those that come later than that are dropped, as Spark's watermark does. The
watermark starts at 1970, so queries from before are dropped too.
A session is given out once, when no query can join it any more, and a delta when no query can come before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from searchlog.operators.sessions import SESSION_GAP_S, session_input
from searchlog.operators.slices import MICROS, micros

DELAY = "1 hour"

_DELTAS = "query_id long, user_id long, ts_us long, delta_s double"
#: Times and ids that wait for earlier ones, and the last time given out.
_STATE = "times array<long>, ids array<long>, last long"


def stream_sessions(
    queries: DataFrame, gap_s: float = SESSION_GAP_S, delay: str = DELAY, drop_suspicious: bool = True
) -> DataFrame:
    """W2, W3 in append mode: ``user_id``, ``start_ts``, ``end_ts``, ``duration_s``, ``n_queries``.

    Spark keeps one row of state per open session, whatever the number of its queries. A session is open until the
    watermark is more than the gap beyond its last query. Sessions have no numbers, as an earlier one may still be open.
    """
    # Spark joins session windows that touch, so that two queries exactly one gap apart are in one session.
    window = F.session_window("ts", f"{micros(gap_s)} microseconds")
    rows = session_input(queries, drop_suspicious).select("user_id", "ts").withWatermark("ts", delay)
    found = rows.groupBy("user_id", window).agg(
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("n_queries")
    )
    duration = (F.unix_micros("end_ts") - F.unix_micros("start_ts")) / MICROS
    return found.select("user_id", "start_ts", "end_ts", duration.alias("duration_s"), "n_queries")


def _deltas(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Deltas of the user's queries up to the watermark; later ones wait."""
    times, ids, last = state.get if state.exists else ([], [], None)
    waiting = list(zip(times, ids, strict=True))
    for rows in batches:
        waiting += zip(rows["ts_us"].tolist(), rows["query_id"].tolist(), strict=True)
    waiting.sort()
    until = state.getCurrentWatermarkMs() * 1000
    ready = [(t, q) for t, q in waiting if t < until]
    found = []
    for t, q in ready:
        found.append((q, key[0], t, 0.0 if last is None else (t - last) / MICROS))
        last = t
    rest = waiting[len(ready) :]
    state.update(([t for t, _ in rest], [q for _, q in rest], last))
    if rest:
        state.setTimeoutTimestamp(max(rest[0][0] // 1000 + 1, until // 1000 + 1))
    if found:
        yield pd.DataFrame(found, columns=["query_id", "user_id", "ts_us", "delta_s"])


def stream_deltas(queries: DataFrame, delay: str = DELAY, drop_suspicious: bool = True) -> DataFrame:
    """W1 in append mode: ``query_id``, ``user_id``, ``ts_us``, ``delta_s``, seconds since the user's query before.

    A user's state is the last time and the queries that are within ``delay`` of the newest one; users that stay away
    keep their last time.
    """
    rows = session_input(queries, drop_suspicious).select("query_id", "user_id", "ts").withWatermark("ts", delay)
    rows = rows.withColumn("ts_us", F.unix_micros("ts"))
    return rows.groupBy("user_id").applyInPandasWithState(
        _deltas, _DELTAS, _STATE, "append", GroupStateTimeout.EventTimeTimeout
    )


def run_available(found: DataFrame, path: str, checkpoint: str) -> None:
    """Work off what a stream's source holds now, and add what can be given out to the Parquet table at ``path``."""
    writer = found.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start(path).awaitTermination()
