"""Words, keys and row helpers that the operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from searchlog.runtime import scratch_path

#: A-Z to a-z, every other byte as it is.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

#: As LOWER, and every ASCII byte but letters and digits becomes a space. Bytes of other characters stay.
ALNUM = bytes(
    b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in bytes(range(256)).translate(LOWER)
)


def words(text: str | None) -> list[bytes]:
    """Runs of bytes other than space, tab, line feed, vertical tab, form feed and carriage return; null has none."""
    return text.encode().split() if text else []


def lower_words(text: str | None) -> list[bytes]:
    """``words`` of the text with A-Z in lower case."""
    return text.encode().translate(LOWER).split() if text else []


def alnum_words(text: str | None) -> list[bytes]:
    """Runs of a-z, 0-9 and characters beyond ASCII in the text with A-Z in lower case."""
    return text.encode().translate(ALNUM).split() if text else []


def bounded_batches(spark: SparkSession, megabytes: int = 4) -> None:
    """Hand Python at most so many megabytes at once (one row at least); sessions allow 64 by default.

    What a worker makes of a batch takes several times its size, and two or more workers share an executor.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{megabytes}m")


def map_arrow(df: DataFrame, function: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with a function of one batch."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            if batch.num_rows:
                yield from function(batch)

    bounded_batches(df.sparkSession)
    return df.mapInArrow(batches, schema)


def row_key(*columns: str) -> Column:
    """A 16-byte key of a row's values. Rows with equal values, repeated rows that is, have equal keys."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.unhex(F.md5(F.concat_ws("|", *parts)))


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return rows.select(*columns) if columns else rows


#: Whether Spark removes a query's shuffle files when it ends; else they stay until the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the scratch folder that all executors share: computed once, whatever reads it how often.

    The shuffle files that went into the table are removed with its last row.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
