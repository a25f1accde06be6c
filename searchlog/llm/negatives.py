"""Hard negatives by inner product from cover trees (operator 11).

Every vector gets one more component, so that all have the length of the longest. They then lie on a sphere, where an inner
product with an anchor is a cosine, and a node of a tree is a cap: all of its vectors lie within an angle of its centre.
With the anchor's own angle to the centre this bounds their inner products from both sides.

The top level is a bounded sample of centres. Each vector goes to the nearest one, and a centre's vectors are dealt into
blocks of bounded size, whatever the centre's share of the rows. A block becomes one cover tree: below each node its vectors
are covered greedily by caps of half the angle, the node's own centre first, down to single vectors. An anchor is sent to the
top caps that can hold what it looks for, and descends the trees of their blocks best cap first. Caps above or below all of
its windows are skipped, and the vectors that are left are scored exactly in whole numbers.

First each anchor finds its positives: its own cap gives a score to beat, then the caps that can beat it are searched. Each
positive's score gives a window, and one descent serves all windows of an anchor.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from searchlog.llm.common import bounded_batches, map_arrow, written

POSITIVES = 5
NEGATIVES = 5

#: A negative's score lies between these hundredths of the positive's.
LOW, HIGH = 80, 100

#: Components are multiplied by this and rounded down, so that scores are whole numbers.
SCALE = 256

#: Vectors in one tree, and anchors that meet a tree in one task.
BLOCK = 2048

#: Centres of the top level, at most, and the numbers in them, at most (8 MB); they are broadcast.
MOST_CAPS, MOST_NUMBERS = 4096, 2**20

#: Tasks of one search, at most.
MOST_TASKS = 4096

#: A node of so many vectors is not divided again.
LEAF = 16

#: Squared lengths below this are added up exactly in double precision, up to the second one in whole numbers of 64 bits.
DOUBLES, LONGS = 2.0**53, 2.0**56

#: Beyond any score.
EDGE = 2**62


class Cover:
    """A cover tree in arrays: the children of a node are consecutive nodes; a node without children is one vector."""

    def __init__(self, unit: np.ndarray) -> None:
        """``unit`` has a row of unit length for each vector."""
        likeness = unit @ unit.T
        self.centre, self.first, self.last, self.angle = [0], [0], [0], [0.0]
        waiting = [(0, np.arange(len(unit)))]
        for node, members in waiting:
            width = _angle(likeness[self.centre[node], members].min()) if len(members) > 1 else 0.0
            self.angle[node], self.first[node] = width, len(self.centre)
            if len(members) <= LEAF or width < 1e-5:
                parts = [members[i : i + 1] for i in range(len(members))]
            else:
                parts = _covered(likeness, members, self.centre[node], math.cos(width / 2))
            for part in parts:
                if len(part) > 1:
                    waiting.append((len(self.centre), part))
                self.centre.append(int(part[0]))
                self.first.append(0)
                self.last.append(0)
                self.angle.append(0.0)
            self.last[node] = len(self.centre)


def _angle(cosine: float) -> float:
    """An angle that is not too small, whatever the rounding of the cosine."""
    return math.acos(max(-1.0, min(1.0, cosine - 1e-12)))


def _covered(likeness: np.ndarray, members: np.ndarray, centre: int, cosine: float) -> list[np.ndarray]:
    """The members in groups, each within the angle of its first member; the centre's group comes first."""
    parts, rest = [], members
    while len(rest):
        near = likeness[centre, rest] >= cosine
        near[rest == centre] = True
        group = rest[near]
        parts.append(np.concatenate([[centre], group[group != centre]]))
        rest = rest[~near]
        centre = int(rest[0]) if len(rest) else 0
    return parts


class Search:
    """What one anchor has found: for each window its best vectors so far, and the score that another one must reach."""

    def __init__(self, point: np.ndarray, low: np.ndarray, high: np.ndarray, wanted: int) -> None:
        self.point, self.high, self.wanted = point, high, wanted
        self.length = math.sqrt(float(np.dot(point.astype(np.float64), point.astype(np.float64))))
        self.bar = low.copy()
        self.scores = [np.empty(0, np.int64) for _ in low]
        self.ids = [np.empty(0, np.int64) for _ in low]

    def bounds(self, scores: np.ndarray, angles: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner products within caps whose centres have these scores; a little wider than exact."""
        size = self.length * radius
        at = np.arccos(np.clip(scores / size, -1.0, 1.0)) if size else np.zeros(len(scores))
        slack = 1e-7 * size + 1e-6
        return size * np.cos(np.minimum(math.pi, at + angles)) - slack, size * np.cos(np.maximum(0.0, at - angles)) + slack

    def promise(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The best score that caps with these bounds can add to any window; minus infinity if they can add none."""
        needed = (high[:, None] >= self.bar) & (low[:, None] <= self.high)
        return np.where(needed, np.minimum(high[:, None], self.high), -np.inf).max(axis=1, initial=-np.inf)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        for j in range(len(self.bar)):
            fits = (scores >= self.bar[j]) & (scores <= self.high[j])
            if fits.any():
                s = np.concatenate([self.scores[j], scores[fits].astype(np.int64)])
                i = np.concatenate([self.ids[j], ids[fits]])
                best = np.lexsort((i, -s))[: self.wanted]
                self.scores[j], self.ids[j] = s[best], i[best]
                if len(best) == self.wanted:
                    self.bar[j] = self.scores[j][-1]


def _unit(points: np.ndarray, squares: float) -> np.ndarray:
    """Points with one more component that gives all of them the same length, scaled to one."""
    points = points.astype(np.float64)
    more = np.sqrt(np.maximum(squares - np.einsum("ij,ij->i", points, points), 0.0))
    return np.column_stack([points, more]) / (math.sqrt(squares) or 1.0)


def _points(column: pa.ChunkedArray | pa.Array, size: int, exact: type = np.float64) -> np.ndarray:
    """Rows of a column of arrays; shorter ones go on with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    rows = np.zeros((len(column), size), exact)
    rows[np.arange(size) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return rows


class Miner:
    """The index of a table of points: top caps on the driver, trees of blocks in a stored table."""

    def __init__(self, points: DataFrame, block: int) -> None:
        self.spark, self.block = points.sparkSession, block
        self.points = written(points, "points")
        count, squares, size = self.points.agg(F.count("*"), F.max("square"), F.max(F.size("point"))).first()
        self.count, self.squares, self.size = count, squares or 0.0, size or 0
        self.exact = np.float64 if self.squares < DOUBLES else np.int64
        caps = min(MOST_CAPS, max(1, MOST_NUMBERS // max(1, self.size)), -(-count // block))
        sample = self.points.orderBy(F.xxhash64("id"), "id").limit(caps).select("point").collect()
        centres = np.zeros((len(sample), self.size))
        for n, (point,) in enumerate(sample):
            centres[n, : len(point)] = point
        self.centres = np.unique(centres, axis=0)
        self._assign()

    def _assign(self) -> None:
        """Every point with its cap, the caps' angles and blocks, and a tree for each block."""
        squares, size, exact = self.squares, self.size, self.exact
        unit = self.spark.sparkContext.broadcast(_unit(self.centres, squares))

        def nearest(batch: pa.RecordBatch):
            likeness = _unit(_points(batch.column("point"), size), squares) @ unit.value.T
            cap = likeness.argmax(axis=1).astype(np.int32)
            columns = [*batch.columns, pa.array(cap), pa.array(likeness.max(axis=1))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "cap", "cosine"])

        schema = "id bigint, label bigint, point array<bigint>, square double, asks boolean, cap int, cosine double"
        self.assigned = written(map_arrow(self.points, nearest, schema), "points-by-cap")
        blocks = F.ceil(F.count("*") / self.block).cast("int").alias("blocks")
        # One row per cap, and caps are bounded.
        self.caps = self.assigned.groupBy("cap").agg(blocks, F.min("cosine").alias("cosine")).orderBy("cap").collect()
        names = "cap int, blocks int, cosine double"
        self.blocks = F.broadcast(self.spark.createDataFrame(self.caps, names).select("cap", "blocks"))

        def grown(key: tuple, table: pa.Table) -> pa.Table:
            points = _points(table.column("point"), size, exact)
            tree = Cover(_unit(points, squares))
            row = {
                "cap": key[0].as_py(),
                "block": key[1].as_py(),
                "ids": table.column("id").to_numpy().tobytes(),
                "labels": table.column("label").to_numpy().tobytes(),
                "points": points.astype(np.int64).tobytes(),
                "centre": np.array(tree.centre, np.int32).tobytes(),
                "first": np.array(tree.first, np.int32).tobytes(),
                "last": np.array(tree.last, np.int32).tobytes(),
                "angle": np.array(tree.angle).tobytes(),
            }
            return pa.Table.from_pylist([row], pa.schema([(n, pa.int32() if n in ("cap", "block") else pa.binary()) for n in row]))

        dealt = self.assigned.join(self.blocks, "cap")
        dealt = dealt.select("cap", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"), "id", "label", "point")
        arrays = ", ".join(f"{n} binary" for n in ("ids", "labels", "points", "centre", "first", "last", "angle"))
        trees = dealt.groupBy("cap", "block").applyInArrow(grown, f"cap int, block int, {arrays}")
        self.trees = written(trees, "cover-trees")

    def routed(self, asked: DataFrame) -> DataFrame:
        """``asked`` (``_ASKED``) once for each cap that can hold a score within one of the row's windows."""
        squares, size, exact = self.squares, self.size, self.exact
        top = self.spark.sparkContext.broadcast(
            (self.centres[[r["cap"] for r in self.caps]], np.array([r["cap"] for r in self.caps], np.int32),
             np.array([_angle(r["cosine"]) for r in self.caps]))
        )

        def reach(batch: pa.RecordBatch):
            centres, caps, angles = top.value
            points = _points(batch.column("point"), size, exact)
            skipped = batch.column("skipped").to_pylist()
            lows, highs = batch.column("low").to_pylist(), batch.column("high").to_pylist()
            rows, found = [], []
            for n, point in enumerate(points):
                search = Search(point, np.array(lows[n], np.int64), np.array(highs[n], np.int64), 1)
                bounds = search.bounds(centres @ point.astype(np.float64), angles, math.sqrt(squares))
                hit = caps[search.promise(*bounds) > -np.inf]
                hit = hit[hit != skipped[n]] if skipped[n] is not None else hit
                rows.append(np.full(len(hit), n))
                found.append(hit)
            taken = batch.drop_columns(["cap"]).take(pa.array(np.concatenate(rows)))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(np.concatenate(found))], [*taken.schema.names, "cap"])

        return map_arrow(asked, reach, _ASKED + ", cap int")

    def search(self, asked: DataFrame, same: bool, wanted: int, chunks: int) -> DataFrame:
        """``anchor_id``, ``name``, ``id``, ``score``: for each row and window the best vectors of each block, ``wanted`` at most.

        Vectors have the row's label or, unless ``same``, another one. ``asked`` names a cap in each row.
        """
        size, exact, radius = self.size, self.exact, math.sqrt(self.squares)
        parts = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
        asked = written(asked, "asked").join(self.blocks, "cap").select("*", parts)
        asked = asked.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int"))
        key = ["cap", "block", "chunk"]
        trees = self.trees.join(asked.select(*key).distinct(), ["cap", "block"])
        trees = trees.toDF(*trees.columns)  # columns of its own, as the other side of the cogroup has the same ones
        # Groups are small and slow, so they are dealt out by number and not put together by size.
        tasks = min(MOST_TASKS, chunks * sum(row["blocks"] for row in self.caps))
        asked, trees = asked.repartition(tasks, *key), trees.repartition(tasks, *key)

        def descend(left: pa.Table, right: pa.Table) -> pa.Table:
            tree = right.to_pylist()[0]
            ids, labels = (np.frombuffer(tree[n], np.int64) for n in ("ids", "labels"))
            points = np.frombuffer(tree["points"], np.int64).reshape(len(ids), size).astype(exact)
            centre, first, last = (np.frombuffer(tree[n], np.int32) for n in ("centre", "first", "last"))
            angle, leaf = np.frombuffer(tree["angle"]), first == last
            centres, ids, labels = points[centre], ids[centre], labels[centre]
            found = {n: [] for n in ("anchor_id", "name", "id", "score")}
            queries = _points(left.column("point"), size, exact)
            for row, point in zip(left.drop_columns(["point"]).to_pylist(), queries, strict=True):
                search = Search(point, np.array(row["low"], np.int64), np.array(row["high"], np.int64), wanted)
                heap = [(-math.inf, 0)]
                while heap:
                    promise, node = heapq.heappop(heap)
                    if -promise < search.bar.min():
                        break
                    a, b = first[node], last[node]
                    scores = centres[a:b] @ point
                    single = leaf[a:b]
                    fits = single & ((labels[a:b] == row["label"]) == same) & (ids[a:b] != row["id"])
                    if fits.any():
                        search.add(scores[fits], ids[a:b][fits])
                    inner = np.flatnonzero(~single)
                    if len(inner):
                        bounds = search.bounds(scores[inner].astype(np.float64), angle[a:b][inner], radius)
                        for best, child in zip(search.promise(*bounds), inner + a, strict=True):
                            if best > -math.inf:
                                heapq.heappush(heap, (-best, int(child)))
                for name, some, points_ in zip(row["names"], search.ids, search.scores, strict=True):
                    found["anchor_id"] += [row["id"]] * len(some)
                    found["name"] += [name] * len(some)
                    found["id"] += some.tolist()
                    found["score"] += points_.tolist()
            return pa.table({n: pa.array(v, pa.int64()) for n, v in found.items()})

        def both(left: pa.Table, right: pa.Table) -> pa.Table:
            return descend(left, right) if left.num_rows and right.num_rows else _NONE

        grouped = asked.groupBy(*key).cogroup(trees.groupBy(*key))
        return grouped.applyInArrow(both, "anchor_id bigint, name bigint, id bigint, score bigint")


_ASKED = "id bigint, label bigint, point array<bigint>, low array<bigint>, high array<bigint>, names array<bigint>, skipped int"
_NONE = pa.table({n: pa.array([], pa.int64()) for n in ("anchor_id", "name", "id", "score")})


def _hundredths(score: Column) -> Column:
    """A whole number divided by 100 and rounded down."""
    return F.call_function("div", score - F.pmod(score, F.lit(100)), F.lit(100))


def _best(found: DataFrame, wanted: int) -> DataFrame:
    """The first rows of each anchor and name with their ``place`` from 1."""
    order = Window.partitionBy("anchor_id", "name").orderBy(F.col("score").desc(), "id")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= wanted)


def hard_negatives(
    df: DataFrame,
    asks: Column,
    id_column: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    scale: int = SCALE,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    block: int = BLOCK,
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    Anchors are the rows where ``asks`` holds. A score is the inner product with the anchor of components times ``scale``,
    rounded down; ties go to the smaller id. An anchor's positives are its first other rows of the same label, a positive's
    negatives the first rows of other labels that score from ``low`` to ``high`` hundredths of the positive's score, so that
    a negative score has none. Anchors without positives and positives without negatives give no rows.

    Rows with a null id, label or vector, or with any null or non-finite component, take no part, nor do vectors whose
    scaled length is 2^28 or more, as their scores do not fit. Shorter vectors go on with zeros, an empty one is all zeros.
    An id is one row: of rows with one id the one with the smallest label and vector counts, repeated rows once. Other
    columns are not read. Without rows or anchors the result is empty.
    """
    bounded_batches(df.sparkSession)
    rows = df.select(
        F.col(id_column).cast("long").alias("id"),
        F.struct(F.col(label).cast("long").alias("label"), F.col(vector).alias("vector")).alias("row"),
        F.coalesce(asks, F.lit(False)).alias("asks"),
    )
    fine = F.forall("row.vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < 2.0**28))
    rows = rows.filter(F.col("id").isNotNull() & F.col("row.label").isNotNull() & F.coalesce(fine, F.lit(False)))
    rows = rows.groupBy("id").agg(F.min("row").alias("row"), F.max("asks").alias("asks"))
    point = F.transform("row.vector", lambda v: F.floor(v.cast("double") * scale))
    square = F.aggregate("point", F.lit(0.0), lambda total, v: total + v.cast("double") * v)
    points = rows.select("id", "row.label", point.alias("point"), "asks").withColumn("square", square)
    points = points.filter(F.col("square") < LONGS).select("id", "label", "point", "square", "asks")

    miner = Miner(points, block)
    anchors = miner.assigned.filter("asks").select("id", "label", "point", "cap")
    n_anchors = anchors.count()
    if not n_anchors:
        empty = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
        return df.sparkSession.createDataFrame([], empty)
    chunks = -(-n_anchors // block)

    everything, none = [F.array(F.lit(n).cast("long")) for n in (-EDGE, EDGE, 0)], F.lit(None).cast("int")
    low_, high_, name = everything[0].alias("low"), everything[1].alias("high"), everything[2].alias("names")
    home = anchors.select("id", "label", "point", low_, high_, name, none.alias("skipped"), "cap")
    near = written(_best(miner.search(home, True, positives, chunks), positives).drop("place"), "near-positives")
    bars = near.groupBy("anchor_id").agg(F.when(F.count("*") == positives, F.min("score")).alias("bar"))
    bar = F.array(F.coalesce("bar", F.lit(-EDGE))).alias("low")
    rest = anchors.join(bars.withColumnRenamed("anchor_id", "id"), "id", "left")
    rest = rest.select("id", "label", "point", bar, high_, name, F.col("cap").alias("skipped"), "cap")
    far = miner.search(miner.routed(rest), True, positives, chunks)
    chosen = written(_best(near.unionByName(far), positives), "positives")

    least, most = -_hundredths(F.col("score") * -low), _hundredths(F.col("score") * high)
    windows = chosen.filter(least <= most).groupBy("anchor_id").agg(
        F.collect_list(F.struct(F.col("id").alias("name"), least.alias("low"), most.alias("high"))).alias("w")
    )
    asked = anchors.join(windows.withColumnRenamed("anchor_id", "id"), "id").select(
        "id", "label", "point", "w.low", "w.high", F.col("w.name").alias("names"), none.alias("skipped"), "cap"
    )
    found = _best(miner.search(miner.routed(asked), False, negatives, chunks), negatives)
    scores = chosen.select("anchor_id", F.col("id").alias("name"), F.col("score").alias("positive_score"))
    return found.join(scores, ["anchor_id", "name"]).select(
        "anchor_id",
        F.col("name").alias("positive_id"),
        F.col("place").alias("rank"),
        F.col("id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)
