"""Sequential surrogate ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from searchlog.runtime import scratch_path

# monotonically_increasing_id() keeps the partition number above this bit and the row number below it.
_ROW_BITS = 33


def with_sequential_ids(df: DataFrame, order_by: list[str], id_column: str, start: int = 0) -> DataFrame:
    """Number rows ``start, start + 1, …`` in the order of ``order_by``, which should be unique per row.

    Rows are range-partitioned and sorted, and written with their place inside the partition; a row's id is that place
    plus the sizes of the partitions before. No task sees more than one range. Writing the ranges once keeps the ids
    stable however often the result is recomputed; the written table stays until the scratch folder is cleaned.
    """
    spark = df.sparkSession
    path = scratch_path(spark, id_column)
    (
        df.repartitionByRange(*order_by)
        .sortWithinPartitions(*order_by)
        .withColumn("_place", F.monotonically_increasing_id())
        .write.parquet(path)
    )
    schema = T.StructType([*df.schema.fields, T.StructField("_place", T.LongType())])
    placed = spark.read.schema(schema).parquet(path)

    partition = F.shiftright("_place", _ROW_BITS)
    sizes = placed.groupBy(partition.alias("_partition")).agg(F.count("*").alias("_size"))
    # One row per range partition: their number is the shuffle setting, not the data size.
    offsets = sizes.select(
        "_partition", (F.sum("_size").over(Window.orderBy("_partition")) - F.col("_size")).alias("_offset")
    )
    row = F.col("_place").bitwiseAND((1 << _ROW_BITS) - 1)
    return (
        placed.withColumn("_partition", partition)
        .join(F.broadcast(offsets), "_partition")
        .withColumn(id_column, F.col("_offset") + row + F.lit(start))
        .select(id_column, *df.columns)
    )
