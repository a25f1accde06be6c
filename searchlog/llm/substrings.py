"""Substring dedup by super-k-mers (operator 2).

A window is a run of consecutive words. Its minimiser is the smallest hash among its m-mers, the shorter runs within it.
Equal windows have equal minimisers, and neighbouring windows mostly share theirs: such a run of windows, a super-k-mer,
travels as one packed string to the bucket of its minimiser, where its windows are cut out, sorted and counted as they are,
byte by byte.

1. Each document gives its super-k-mers as (minimiser, place); minimisers are counted. One that occurs once has no
   repeated window and goes no further, which is most of the text.
2. The others are packed from the texts, sent to their buckets and counted there.
3. A minimiser with more than ``HOT_MINIMISER`` super-k-mers would fill a bucket. Its equal strings are first reduced to one,
   and the windows of the different ones travel singly, as 128-bit digests; both are counted by aggregations that add up
   before they shuffle.
4. The words that repeated windows cover are taken out of the texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from searchlog.llm.common import bounded_batches, documents, map_arrow, row_key, words, written

WINDOW = 35
MER = 8

#: Super-k-mers under one minimiser before its windows travel singly.
HOT_MINIMISER = 1000

#: Windows of a super-k-mer at most, so that a packed string has a bounded size.
LONGEST_RUN = 128

_ONE = np.uint64(0x9E3779B97F4A7C15)
_TWO = np.uint64(0xBF58476D1CE4E5B9)


def super_kmers(tokens: list[bytes], window: int, mer: int, longest: int = LONGEST_RUN) -> tuple[np.ndarray, ...]:
    """Of each run of windows that share their minimiser: that, its first window, their number, and whether it may hold a
    window twice, which takes the minimiser at two places.
    """
    n = len(tokens) - window + 1
    if n < 1:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, len(tokens))
    mers = len(tokens) - mer + 1
    value = np.zeros(mers, np.uint64)
    for i in range(mer):
        value = value * _ONE + hashes[i : i + mers]
    value = (value ^ (value >> np.uint64(31))) * _TWO
    value ^= value >> np.uint64(29)
    each = value
    # Minimum over each window's m-mers, by doubling.
    span, wide = 1, window - mer + 1
    while span * 2 <= wide:
        value = np.minimum(value[:-span], value[span:])
        span *= 2
    if span < wide:
        value = np.minimum(value[: len(value) - (wide - span)], value[wide - span :])
    new = np.flatnonzero(value[1:] != value[:-1]) + 1
    starts = np.concatenate(([0], new))
    sizes = np.diff(np.concatenate((starts, [n])))
    if sizes.max() > longest:
        pieces = -(-sizes // longest)
        within = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        ends = np.repeat(starts + sizes, pieces)
        starts = np.repeat(starts, pieces) + within * longest
        sizes = np.minimum(ends - starts, longest)
    places = np.arange(wide)
    first, last = (np.argmin(each[at[:, None] + places], axis=1) + at for at in (starts, starts + sizes - 1))
    return value[starts].view(np.int64), starts, sizes, first != last


def _repeated(strings: list[bytes], window: int) -> list[list[int]]:
    """For the packed strings of one bucket, which of their windows occur more than once."""
    found: list[tuple[bytes, int, int]] = []
    for which, string in enumerate(strings):
        spaces = np.flatnonzero(np.frombuffer(string, np.uint8) == 0x20).tolist()
        starts, ends = [0, *(s + 1 for s in spaces)], [*spaces, len(string)]
        found += [(string[a:b], which, i) for i, (a, b) in enumerate(zip(starts, ends[window - 1 :]))]
    found.sort()
    out: list[list[int]] = [[] for _ in strings]
    for i, (text, which, place) in enumerate(found):
        if (i and found[i - 1][0] == text) or (i + 1 < len(found) and found[i + 1][0] == text):
            out[which].append(place)
    return out


def _spans(places: Iterable[int], offset: int, window: int) -> list[tuple[int, int]]:
    """Merged word spans of windows."""
    out: list[list[int]] = []
    for place in sorted(places):
        if out and place + offset <= out[-1][1]:
            out[-1][1] = place + offset + window
        else:
            out.append([place + offset, place + offset + window])
    return [tuple(span) for span in out]


_PACKED = "mini bigint, packed binary, row binary, start int"
_SPANS = "row binary, first int, end int"


def _count_buckets(window: int):
    """Counts the windows of whole buckets; rows come sorted by minimiser."""

    def spans_of(buckets: pa.Table) -> pa.RecordBatch:
        minis = buckets.column("mini").to_numpy()
        strings, starts = buckets.column("packed").to_pylist(), buckets.column("start").to_pylist()
        rows = buckets.column("row").to_pylist()
        out_rows, firsts, ends = [], [], []
        edges = [0, *(np.flatnonzero(minis[1:] != minis[:-1]) + 1).tolist(), len(minis)]
        for a, b in zip(edges, edges[1:]):
            for which, places in enumerate(_repeated(strings[a:b], window), a):
                for first, end in _spans(places, starts[which], window):
                    out_rows.append(rows[which])
                    firsts.append(first)
                    ends.append(end)
        return pa.RecordBatch.from_arrays(
            [pa.array(out_rows, pa.binary()), pa.array(firsts, pa.int32()), pa.array(ends, pa.int32())],
            ["row", "first", "end"],
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []  # all of the last bucket begun
        for batch in batches:
            if not batch.num_rows:
                continue
            minis = batch.column("mini").to_numpy()
            last = int(np.searchsorted(minis, minis[-1]))
            if last or (waiting and waiting[-1].column("mini")[-1].as_py() != minis[0]):
                # Every bucket but the last one of this batch is complete.
                ready = pa.Table.from_batches([*waiting, batch.slice(0, last)])
                waiting = []
                yield spans_of(ready)
            waiting.append(batch.slice(last))
        if waiting:
            yield spans_of(pa.Table.from_batches(waiting))

    return count


def repeated_spans(docs: DataFrame, window: int, mer: int, hot_minimiser: int) -> DataFrame:
    """``row``, ``first``, ``end``: spans of words under repeated windows; ``docs`` has ``id``, ``row`` and ``text``."""

    def find_runs(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        minis, starts, sizes, twice, of = [], [], [], [], []
        for i, text in enumerate(batch.column("text")):
            value, start, size, again = super_kmers(words(text.as_py()), window, mer)
            if len(value):
                minis.append(value)
                starts.append(start)
                sizes.append(size)
                twice.append(again)
                of.append(np.full(len(value), i))
        if minis:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(minis)),
                    batch.column("row").take(pa.array(np.concatenate(of))),
                    pa.array(np.concatenate(starts).astype(np.int32)),
                    pa.array(np.concatenate(sizes).astype(np.int32)),
                    pa.array(np.concatenate(twice)),
                ],
                ["mini", "row", "start", "size", "twice"],
            )

    runs = map_arrow(docs.select("row", "text"), find_runs, "mini bigint, row binary, start int, size int, twice boolean")
    runs = written(runs, "super-kmers")
    counts = runs.groupBy("mini").agg(F.count("*").alias("n"), F.max("twice").alias("twice"))
    counts = counts.filter((F.col("n") > 1) | F.col("twice")).select("mini", "n")
    shared = written(runs.drop("twice").join(counts, "mini"), "shared-super-kmers")

    def by_row(chosen: DataFrame) -> DataFrame:
        # Repeated rows have one key and the same runs: a set, or each of them would pack the runs of all.
        places = chosen.groupBy("row").agg(F.collect_set(F.struct("mini", "start", "size")).alias("runs"))
        return docs.select("id", "row", "text").join(places, "row")

    def pack(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        minis, packed, of, starts = [], [], [], []
        for i, (text, runs) in enumerate(zip(batch.column("text"), batch.column("runs"))):
            tokens = words(text.as_py())
            for run in runs.as_py():
                minis.append(run["mini"])
                packed.append(b" ".join(tokens[run["start"] : run["start"] + run["size"] + window - 1]))
                of.append(i)
                starts.append(run["start"])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(minis, pa.int64()),
                pa.array(packed, pa.binary()),
                batch.column("row").take(pa.array(of, pa.int64())),
                pa.array(starts, pa.int32()),
            ],
            ["mini", "packed", "row", "start"],
        )

    cold = map_arrow(by_row(shared.filter(F.col("n") <= hot_minimiser)), pack, _PACKED)
    buckets = cold.repartition("mini").sortWithinPartitions("mini")
    spans = buckets.mapInArrow(_count_buckets(window), _SPANS)

    hot = shared.filter(F.col("n") > hot_minimiser)
    if not hot.isEmpty():
        spans = spans.unionByName(_hot_spans(map_arrow(by_row(hot), pack, _PACKED), window))
    return spans


def _hot_spans(packed: DataFrame, window: int) -> DataFrame:
    """Spans under hot minimisers: equal strings are one string with a count, and its windows are counted by their digests.

    Copies of a document or passage so cost a row for each string, and only the strings that differ are cut into windows.
    """
    strings = written(packed.withColumn("string", F.unhex(F.md5("packed"))), "hot-strings")
    distinct = strings.groupBy("string").agg(F.first("packed").alias("packed"), F.count("*").alias("n"))

    def cut(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        digests, of, places = [], [], []
        for i, string in enumerate(batch.column("packed").to_pylist()):
            tokens = string.split(b" ")
            for place in range(len(tokens) - window + 1):
                digests.append(xxhash.xxh128_digest(b" ".join(tokens[place : place + window])))
                of.append(i)
                places.append(place)
        of = pa.array(of, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(digests, pa.binary()),
                batch.column("string").take(of),
                batch.column("n").take(of),
                pa.array(places, pa.int32()),
            ],
            ["digest", "string", "n", "place"],
        )

    windows = written(map_arrow(distinct, cut, "digest binary, string binary, n bigint, place int"), "hot-windows")
    many = windows.groupBy("digest").agg(F.sum("n").alias("n")).filter(F.col("n") > 1).select("digest")
    covered = windows.join(many, "digest").groupBy("string").agg(F.collect_list("place").alias("places"))
    found = strings.select("string", "row", "start").join(covered, "string")

    @F.arrow_udf(T.ArrayType(T.StructType([T.StructField(name, T.IntegerType()) for name in ("first", "end")])))
    def merged(places: pa.Array, starts: pa.Array) -> pa.Array:
        spans = [_spans(p, start, window) for p, start in zip(places.to_pylist(), starts.to_pylist())]
        kind = pa.struct([("first", pa.int32()), ("end", pa.int32())])
        return pa.array([[{"first": a, "end": b} for a, b in each] for each in spans], pa.list_(kind))

    return found.select("row", F.inline(merged("places", "start")))


def without_repeats(
    df: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    window: int = WINDOW,
    mer: int = MER,
    hot_minimiser: int = HOT_MINIMISER,
) -> DataFrame:
    """One row per input row: id, ``n_words``, ``n_removed`` and ``kept``, the words that stay, joined by one space.

    A word goes if a window over it occurs anywhere else, in the same document or another; all occurrences go. Repeated rows
    are documents of their own, so their long passages all go. Null texts have no words; texts shorter than a window keep
    all. Other columns are not read, and an empty table gives an empty one.
    """
    bounded_batches(df.sparkSession)
    docs = df.select(F.col(id_column).alias("id"), row_key(id_column, text).alias("row"), F.col(text).alias("text"))
    spans = repeated_spans(docs, window, mer, hot_minimiser)
    # A table, so that the files of the exchanges before it are gone when the texts are shuffled again.
    of_row = written(spans.groupBy("row").agg(F.collect_set(F.struct("first", "end")).alias("spans")), "repeated-spans")

    @F.arrow_udf("struct<n_words:bigint,n_removed:bigint,kept:string>")
    def keep(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, all_spans in batches:
            totals, removed, kept = [], [], []
            for value, spans in zip(texts, all_spans):
                tokens = words(value.as_py())
                totals.append(len(tokens))
                if spans.is_valid:
                    edge = np.zeros(len(tokens) + 1, np.int64)
                    np.add.at(edge, spans.values.field("first").to_numpy(), 1)
                    np.add.at(edge, spans.values.field("end").to_numpy(), -1)
                    stays = np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()
                    tokens = [tokens[i] for i in stays]
                removed.append(totals[-1] - len(tokens))
                kept.append(b" ".join(tokens).decode())
            yield pa.StructArray.from_arrays(
                [pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                ["n_words", "n_removed", "kept"],
            )

    joined = docs.join(of_row, "row", "left").select("id", keep("text", "spans").alias("r"))
    return joined.select(F.col("id").alias(id_column), "r.n_words", "r.n_removed", "r.kept")


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(documents(spark, sf_dir, "doc_id", "text")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )
