"""Embedding near-duplicates by a pivot-permutation index (operator 5).

Some vectors are reference points, the pivots. Every vector is described by its ``DESCRIBED`` nearest pivots in order, and is
listed under the first ``LISTED`` of them. Vectors on one list whose descriptions share at least ``MIN_SHARED`` pivots are
candidates, and candidates are verified by their cosine in double precision. A pair that meets on several lists counts on
the one with the smallest pivot number. No two pivots lie near each other: a tight group, however large its share of the rows,
has one pivot, which its vectors have in common. Among many pivots of its own their order would be noise.

Equal vectors are one entry with a number of copies. A list with many entries is dealt into blocks, and each pair of blocks
is a group of its own, so that no task holds a list whole. Links are summed up where they are found: a group gives a count and a
local smallest neighbour for each vector, not pairs.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from searchlog.llm.common import bounded_batches, map_arrow, row_key, written
from searchlog.llm.components import connected_components

COSINE = 0.95
DESCRIBED = 10
LISTED = 5
MIN_SHARED = 2

#: Pivots are a sample of 2 * sqrt(vectors) by hash, within these bounds. All vectors are indexed.
FEWEST_PIVOTS, MOST_PIVOTS = 64, 4096

#: A sampled pivot with a cosine above this to an earlier one is left out.
APART = 0.8

#: Entries of a list in one block.
BLOCK = 1024


def n_pivots(vectors: int) -> int:
    return min(MOST_PIVOTS, max(FEWEST_PIVOTS, 2 * math.isqrt(vectors)))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of unit length from a column of equally long arrays."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _apart(points: np.ndarray) -> np.ndarray:
    """The points, of unit length, less those too near an earlier one that stays."""
    kept = np.empty_like(points)
    n = 0
    for point in points:
        if not (kept[:n] @ point > APART).any():
            kept[n] = point
            n += 1
    return kept[:n]


def _describe(entries: DataFrame, points: np.ndarray, described: int) -> DataFrame:
    """``entries`` with the numbers of their nearest pivots, in order."""
    k, kind = min(described, len(points)), entries.schema["embedding"].dataType.simpleString()
    points = entries.sparkSession.sparkContext.broadcast(points)

    def describe(batch: pa.RecordBatch):
        likeness = _matrix(batch.column("embedding")) @ points.value.T
        near = np.argpartition(-likeness, k - 1, axis=1)[:, :k]
        order = np.argsort(-np.take_along_axis(likeness, near, 1), axis=1, kind="stable")
        near = np.take_along_axis(near, order, 1).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(near) + 1) * k, pa.int32()), pa.array(near.ravel()))
        yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "pivots"])

    return map_arrow(entries, describe, f"id bigint, copies bigint, embedding {kind}, pivots array<int>")


_FOUND = "id bigint, links bigint, low bigint"


def _links(min_shared: int, listed: int, threshold: float):
    """Links within one group: a block of a list with itself or with another block of it."""

    def find(key: tuple, table: pa.Table) -> pa.Table:
        pivot, left, right = (k.as_py() for k in key)
        ids, copies = table.column("id").to_numpy(), table.column("copies").to_numpy()
        block = table.column("block").to_numpy()
        x = _matrix(table.column("embedding"))
        near = np.array(table.column("pivots").to_pylist(), dtype=np.int64).reshape(len(ids), -1)
        names, of = np.unique(near, return_inverse=True)
        of = of.reshape(near.shape)
        shows = np.zeros((len(ids), len(names)), np.float32)
        shows[np.arange(len(ids))[:, None], of] = 1
        earlier = np.zeros((len(ids), len(names)), np.float32)  # lists before this one, on which a pair counts
        np.maximum.at(earlier, (np.arange(len(ids))[:, None], of[:, :listed]), near[:, :listed] < pivot)
        earlier = earlier[:, names < pivot]
        a, b = np.flatnonzero(block == left), np.flatnonzero(block == right)
        links, low = np.zeros(len(ids), np.int64), ids.copy()
        linked = (earlier[a] @ earlier[b].T == 0) & (shows[a] @ shows[b].T >= min_shared)
        if left == right:
            linked = np.triu(linked, 1)
        if linked.any():
            linked &= x[a] @ x[b].T >= threshold
        i, j = np.nonzero(linked)
        p, q = a[i], b[j]
        np.add.at(links, p, copies[q])
        np.add.at(links, q, copies[p])
        changed = True
        while changed:  # the smallest id that links reach within the group
            before = low.copy()
            np.minimum.at(low, p, before[q])
            np.minimum.at(low, q, before[p])
            changed = bool((low != before).any())
        some = links > 0
        return pa.table({"id": pa.array(ids[some]), "links": pa.array(links[some]), "low": pa.array(low[some])})

    return find


def near_vectors(
    df: DataFrame,
    id_column: str = "vec_id",
    vector: str = "embedding",
    threshold: float = COSINE,
    pivots: int | None = None,
    described: int = DESCRIBED,
    listed: int = LISTED,
    min_shared: int = MIN_SHARED,
    block: int = BLOCK,
) -> DataFrame:
    """One row per input row: id, ``n_links`` and ``component_id``, the smallest id reachable by links.

    Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing, and vectors link only with
    vectors of their length. Equal vectors link with each other. Repeated rows are copies of each other. Other columns, labels
    too, are not read. An empty table gives an empty one.
    """
    bounded_batches(df.sparkSession)
    rows = df.select(F.col(id_column).cast("long").alias("id"), F.col(vector).alias("embedding"))
    fine = F.forall(
        "embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    ) & F.exists("embedding", lambda v: v != 0)
    rows = rows.select("id", F.when(F.coalesce(fine, F.lit(False)), F.col("embedding")).alias("embedding"))
    rows = rows.withColumn("key", F.when(F.col("embedding").isNotNull(), row_key("embedding")))
    valid = rows.filter(F.col("key").isNotNull())
    entries = valid.groupBy("key").agg(
        F.min("id").alias("id"), F.count("*").alias("copies"), F.first("embedding").alias("embedding")
    )
    entries = written(entries.filter(F.col("id").isNotNull()), "vectors")
    lengths = [r[0] for r in entries.select(F.size("embedding").alias("n")).distinct().collect()]

    found = []
    for length in lengths:  # tables hold one length; others are found among themselves
        same = entries.filter(F.size("embedding") == length).select("id", "copies", "embedding")
        wanted = pivots or n_pivots(same.count())
        sample = same.orderBy(F.xxhash64("id"), "id").limit(wanted).select("embedding").collect()
        points = _apart(_matrix(pa.array([r[0] for r in sample])))
        indexed = written(_describe(same, points, described), "pivot-index")
        lists = indexed.select("*", F.explode(F.slice("pivots", 1, listed)).alias("pivot"))
        sizes = indexed.select(F.explode(F.slice("pivots", 1, listed)).alias("pivot")).groupBy("pivot").count()
        # As many rows as pivots, which are bounded.
        sizes = F.broadcast(sizes.select("pivot", F.ceil(F.col("count") / block).cast("int").alias("blocks")))
        dealt = lists.join(sizes, "pivot").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        paired = dealt.select("id", "copies", "embedding", "pivots", "pivot", "block", other.alias("other")).select(
            "*", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right")
        )
        groups = paired.drop("other").groupBy("pivot", "left", "right")
        find = _links(min(min_shared, len(points)), listed, threshold)
        found.append(written(groups.applyInArrow(find, _FOUND), "vector-links"))
    if not found:
        alone = [F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")]
        return rows.select(F.col("id").alias(id_column), *alone)
    links = reduce(DataFrame.unionByName, found)
    counts = links.groupBy("id").agg(F.sum("links").alias("links"))
    components = connected_components(links.select("id", "low"), "id", "low")
    known = (
        entries.select("key", "id", "copies")
        .join(counts, "id", "left")
        .join(components.withColumnRenamed("node", "id"), "id", "left")
        .select(
            "key",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "id").alias("component_id"),
        )
    )
    return rows.join(known, "key", "left").select(
        F.col("id").alias(id_column),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
    )


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return near_vectors(vectors).withColumn("kept", F.col("vec_id") == F.col("component_id"))
