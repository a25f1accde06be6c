"""A stored dictionary of query texts with their stages.

Logs repeat texts: dashboards and schedulers send the same one thousands of times. ``texts`` holds every distinct text once under
its digest, ``text_stages`` its stages, in folders by command, so that a report on some commands reads those alone. A
load takes apart only the texts that no earlier load has seen. Queries meet the stages by digest.

Each load is a folder of its own, and its texts are written last. A load that failed before is not seen, and is
written again by the next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from searchlog import schemas
from searchlog.functions.taxonomy import is_known_command
from searchlog.operators import stages as stage_operators
from searchlog.sources.store import table_path

_KEY = [T.StructField("text_key", T.BinaryType())]
_LOAD = [T.StructField("load", T.IntegerType())]
TEXTS = T.StructType([*_KEY, T.StructField("text", T.StringType()), *_LOAD])
TEXT_STAGES = T.StructType(
    [*_KEY, *[f for f in schemas.STAGES.fields if f.name != "query_id"], *_LOAD, T.StructField("command_group", T.StringType())]
)


def _folder(root: str, name: str, load: int) -> str:
    return f"{table_path(root, name)}/load={load}"


def initialize_dictionary(spark: SparkSession, root: str) -> None:
    """Create or replace the dictionary, empty. Load 0 holds a row of nulls, as a table without folders couldn't be read."""
    for name, schema, folders in (("texts", TEXTS, ["load"]), ("text_stages", TEXT_STAGES, ["load", "command_group"])):
        nulls = spark.createDataFrame([[None] * len(schema)], schema)
        nulls = nulls.withColumns({"load": F.lit(0)} | ({"command_group": F.lit("none")} if len(folders) > 1 else {}))
        nulls.write.mode("overwrite").partitionBy(*folders).parquet(table_path(root, name))


def texts(spark: SparkSession, root: str) -> DataFrame:
    """``text_key``, ``text``, ``load`` of every text of a finished load."""
    return _read(spark, root, "texts", TEXTS).filter(F.col("load") > 0)


def _read(spark: SparkSession, root: str, name: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(table_path(root, name))


def command_group(command: Column, token_class: Column) -> Column:
    """The folder of a stage: built-in commands have one each, macros and all external commands one together."""
    return F.when(is_known_command(command), command).otherwise(token_class)


def load_texts(queries: DataFrame, root: str) -> int:
    """Add the texts of ``queries`` that aren't stored yet, with their stages; the number of the load."""
    spark = queries.sparkSession
    known = texts(spark, root)
    load = (known.agg(F.max("load")).first()[0] or 0) + 1
    new = stage_operators.texts_of(queries).join(known.select("text_key"), "text_key", "left_anti")
    parsed = stage_operators.stages(new.withColumnRenamed("text_key", "query_id")).withColumnRenamed("query_id", "text_key")
    grouped = parsed.withColumn("command_group", command_group(F.col("command"), F.col("token_class")))
    # Frequent commands fill several files, rare ones share a task.
    spread = grouped.hint("rebalance", "command_group")
    spread.write.mode("overwrite").partitionBy("command_group").parquet(_folder(root, "text_stages", load))
    new.write.mode("overwrite").parquet(_folder(root, "texts", load))
    return load


def text_stages(spark: SparkSession, root: str, commands: list[str] | None = None) -> DataFrame:
    """The stages of the stored texts, by ``text_key``; of some commands only, other folders aren't read then."""
    last = texts(spark, root).agg(F.max("load")).first()[0] or 0  # a later one has not finished
    stages = _read(spark, root, "text_stages", TEXT_STAGES).filter(F.col("load").between(1, last))
    if commands is not None:
        names = [command.lower() for command in commands]
        groups = [*names, "MACRO", "EXTERNAL_COMMAND"]
        stages = stages.filter(F.col("command_group").isin(groups) & F.col("command").isin(names))
    return stages.drop("load", "command_group")


def stages_of_queries(queries: DataFrame, root: str, commands: list[str] | None = None) -> DataFrame:
    """The stage table of queries whose texts are stored, of some commands only if given."""
    parsed = text_stages(queries.sparkSession, root, commands)
    return schemas.conform(stage_operators.join_texts(queries, parsed), schemas.STAGES)
