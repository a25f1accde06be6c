"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from searchlog.llm.common import written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node`` and ``component``, the smallest node it reaches, for every node that has a link to another one.

    Alternating stars: every node first links its larger neighbours to the smallest node near it, then its smaller ones,
    until each component is a star around its smallest node. That takes about log n rounds. Nothing of a component is
    collected; a hub's links are rows, joined with a unique right side, which adaptive execution can split. Each round is
    written to the shared scratch folder, so a lost executor costs at most one round. Links to oneself and links with a null
    end are ignored, repeated links count once, and no links give no rows.
    """
    x, y = F.col(a), F.col(b)
    edges = links.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).filter(
        x.isNotNull() & y.isNotNull() & (x != y)
    )
    edges = written(edges.distinct(), "links")
    before, now = None, _state(edges)
    while now[0] and now != before:
        around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = around.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))
        large = (
            around.join(nearest, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))
        ).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(lowest, "a").filter(F.col("b") != F.col("low"))
        small = small.select(F.col("b").alias("a"), F.col("low").alias("b"))
        edges = written(small.unionByName(lowest.select("a", F.col("low").alias("b"))).distinct(), "links")
        before, now = now, _state(edges)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
