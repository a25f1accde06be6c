"""SimHash near-duplicates by deletion-variant signatures (operator 3).

Two 64-bit fingerprints that differ in at most two bits differ in at most one bit of at least one half. So each distinct
fingerprint is indexed under 64 keys: for each half and each of its 32 bits, the half with that bit wiped out. Fingerprints
that share a key are candidates, and those within two bits are linked.

A key with very many fingerprints would pair them all. Its fingerprints go another way that is exact as well: each
is listed under itself and under its 64 neighbours at one bit. Two fingerprints within two bits of each other share such a
neighbour, and no neighbour has more than 65 fingerprints around it, which are all within two bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from searchlog.llm.common import bounded_batches, documents, lower_words, row_key, written
from searchlog.llm.components import connected_components

SEED = 42
BITS = 64
HALF = 32
MAX_DISTANCE = 2

#: Fingerprints under one key before they go the other way.
HOT_KEY = 200

_SHINGLES_AT_ONCE = 1 << 16


def fingerprint(tokens: list[bytes], shingle: int = 3) -> int:
    """Bits that are set in over half of the shingles' hashes, as a signed 64-bit number; 0 without words."""
    if not tokens:
        return 0
    if len(tokens) < shingle:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(tokens), SEED)], dtype="<u8")
    else:
        shingles = map(b" ".join, zip(*(tokens[i:] for i in range(shingle))))
        hashes = np.fromiter(
            map(partial(xxhash.xxh64_intdigest, seed=SEED), shingles), dtype="<u8", count=len(tokens) - shingle + 1
        )
    counts = np.zeros(BITS, dtype=np.int64)
    for start in range(0, len(hashes), _SHINGLES_AT_ONCE):
        part = hashes[start : start + _SHINGLES_AT_ONCE].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint_column(text: str | Column, shingle: int = 3) -> Column:
    """The fingerprint of a text column as a signed long; null and empty texts have fingerprint zero."""

    @F.arrow_udf("bigint")
    def of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array([fingerprint(lower_words(text.as_py()), shingle) for text in batch], pa.int64())

    return of(text)


def _half(place: Column) -> Column:
    """Mask of the half that a bit place lies in."""
    return F.when(place < HALF, F.lit((1 << HALF) - 1)).otherwise(F.lit(-(1 << HALF)))


def linked_fingerprints(distinct: DataFrame, hot_key: int = HOT_KEY) -> DataFrame:
    """Links ``x``, ``y`` between distinct values of ``fingerprint`` that make the same groups as all pairs within two bits."""
    fp, ones = F.col("fingerprint"), (1 << HALF) - 1

    def variant(place: int) -> Column:
        half = fp.bitwiseAND(F.lit(ones)) if place < HALF else F.shiftrightunsigned(fp, HALF)
        return half.bitwiseAND(F.lit(ones ^ (1 << place % HALF))).bitwiseOR(F.lit(place << HALF))

    keyed = distinct.select("fingerprint", F.explode(F.array(*map(variant, range(BITS)))).alias("key"))
    hot = keyed.groupBy("key").count().filter(F.col("count") > hot_key).select("key")
    hot = written(hot, "hot-keys")
    cold = keyed.join(hot, "key", "left_anti")
    left, right = cold.withColumnRenamed("fingerprint", "x"), cold.withColumnRenamed("fingerprint", "y")
    place = F.shiftrightunsigned("key", HALF)
    differing = F.col("x").bitwiseXOR(F.col("y"))
    # Equal halves agree under all their keys; the first of them is enough.
    once = (differing.bitwiseAND(_half(place)) != 0) | (F.pmod(place, F.lit(HALF)) == 0)
    # Spark takes the keys for as few as the fingerprints they come from, and would broadcast them.
    pairs = left.hint("merge").join(right, "key").filter(
        (F.col("x") < F.col("y")) & (F.bit_count(differing) <= MAX_DISTANCE) & once
    )

    crowded = keyed.join(hot, "key", "left_semi").select("fingerprint").distinct()
    flips = [F.lit(1 << i if i < BITS - 1 else -(1 << (BITS - 1))).cast("long") for i in range(BITS)]
    around = crowded.select(
        "fingerprint",
        F.explode(F.transform(F.array(F.lit(0).cast("long"), *flips), lambda bit: fp.bitwiseXOR(bit))).alias("centre"),
    )
    nearest = around.groupBy("centre").agg(F.min("fingerprint").alias("x"), F.collect_list("fingerprint").alias("ys"))
    stars = nearest.select("x", F.explode("ys").alias("y")).filter(F.col("x") != F.col("y"))
    return pairs.select("x", "y").unionByName(stars)


def simhash_groups(
    df: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = 3, hot_key: int = HOT_KEY
) -> DataFrame:
    """One row per input row: the id, ``row_key``, ``fingerprint`` (a long) and ``component_id``, the smallest id of the group.

    Equal fingerprints are reduced to one before anything is compared. Texts without words, null ones included, all have
    fingerprint zero and make one group. Repeated rows and repeated ids stay as they are; null ids are the smallest of no
    group. Other input columns are not read. An empty table gives an empty one.
    """
    bounded_batches(df.sparkSession)
    marked = written(
        df.select(
            F.col(id_column).alias("id"),
            row_key(id_column, text).alias("row_key"),
            fingerprint_column(F.col(text), shingle).alias("fingerprint"),
        ),
        "fingerprints",
    )
    distinct = marked.groupBy("fingerprint").agg(F.min("id").alias("first_id"))
    found = connected_components(linked_fingerprints(distinct, hot_key), "x", "y")
    grouped = written(
        distinct.join(found, distinct["fingerprint"] == found["node"], "left").select(
            "fingerprint", "first_id", F.coalesce("component", "fingerprint").alias("component")
        ),
        "components",
    )
    smallest = grouped.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = grouped.join(smallest, "component").select("fingerprint", "component_id")
    return marked.join(named, "fingerprint").select(
        F.col("id").alias(id_column), "row_key", "fingerprint", "component_id"
    )


def one_of_each(df: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """The rows of ``df`` that are the first of their group, by id and then by row; a repeated row stays once."""
    groups = simhash_groups(df, id_column, text, shingle)
    place = F.struct(F.col(id_column), F.col("row_key"))
    first = groups.groupBy("component_id").agg(F.min(place).alias("_first"))
    rows = df.withColumn("_row", row_key(id_column, text))
    kept = rows.join(first.select(F.col("_first.row_key").alias("_row")).distinct(), "_row", "left_semi")
    return kept.dropDuplicates(["_row"]).select(*df.columns)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(documents(spark, sf_dir, "doc_id", "text")).select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )
