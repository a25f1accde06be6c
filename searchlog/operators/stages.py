"""Tables over the stages of query texts: frequencies, extraction, uniqueness."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from searchlog.functions import text as text_functions

# The hand-made command lists of the unique-stage reports.
FILTER_COMMANDS = [
    "dedup", "head", "regex", "search", "tail", "where", "uniq",
]
AGGREGATE_COMMANDS = [
    "addtotals", "addcoltotals", "chart", "eventcount", "geostats", "mvcombine", "rare", "stats", "timechart", "top",
    "transaction", "tstats",
]
AUGMENT_COMMANDS = [
    "addinfo", "addtotals", "appendcols", "bin", "bucket", "eval", "eventstats", "extract", "gauge", "iplocation",
    "kv", "outputtext", "rangemap", "relevancy", "rex", "spath", "strcat", "tags", "xmlkv",
]

_STAGE_COLUMNS = ["position", "depth", "command", "token_class", "args", "stage_text", "stage_key"]


def stages(queries: DataFrame) -> DataFrame:
    """One row per stage of every well-formed query. Computed in place, nothing is shuffled."""
    return queries.select("query_id", F.inline(text_functions.stages(F.col("text")))).select(
        "query_id", *_STAGE_COLUMNS
    )


def texts_of(queries: DataFrame) -> DataFrame:
    """The distinct texts of queries with their digests: ``text_key``, ``text``. Equal texts are one before they are shuffled."""
    keyed = queries.filter(F.col("text").isNotNull()).select(text_functions.text_digest(F.col("text")).alias("text_key"), "text")
    return keyed.groupBy("text_key").agg(F.first("text").alias("text"))


def join_texts(queries: DataFrame, parsed: DataFrame) -> DataFrame:
    """``parsed`` (with ``text_key``) for every query (``query_id``, ``text``): digests travel, texts don't.

    A text that very many queries have is a skewed key whose rows in ``parsed`` are few, so adaptive execution can split it.
    """
    keyed = queries.select("query_id", text_functions.text_digest(F.col("text")).alias("text_key"))
    return keyed.join(parsed, "text_key").drop("text_key")


def once_per_text(queries: DataFrame, parse: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """T1-T4, T14 for logs that repeat texts: ``parse`` (one of the operators here) takes every distinct text apart once."""
    texts = texts_of(queries).withColumnRenamed("text_key", "query_id")
    return join_texts(queries, parse(texts).withColumnRenamed("query_id", "text_key"))


def query_tokens(queries: DataFrame) -> DataFrame:
    """T1, one row per token; texts that are not well formed yield none."""
    parsed = queries.select("query_id", F.posexplode(text_functions.tokens(F.col("text"))).alias("position", "t"))
    return parsed.select("query_id", "position", "t.token_class", "t.value")


def query_splits(queries: DataFrame) -> DataFrame:
    """T2, one row per top-level stage."""
    return queries.select(
        "query_id", F.posexplode(text_functions.split_stages(F.col("text"))).alias("position", "stage")
    )


def query_commands(queries: DataFrame) -> DataFrame:
    """T3, one row per command."""
    return queries.select(
        "query_id", F.posexplode(text_functions.commands(F.col("text"))).alias("position", "command")
    )


def query_categories(queries: DataFrame) -> DataFrame:
    """T4, one row per stage with its category."""
    return queries.select(
        "query_id", F.posexplode(text_functions.categories(F.col("text"))).alias("position", "category")
    )


def command_counts(queries: DataFrame) -> DataFrame:
    """Occurrences of each built-in command, most frequent first, and its rank from 0.

    Equal texts are counted together before any is taken apart. The ranking window holds one row per known command.
    """
    per_text = queries.groupBy("text").agg(F.count("*").alias("copies"))
    counts = (
        per_text.select("copies", F.explode(text_functions.command_words(F.col("text"))).alias("w"))
        .filter(F.col("w.token_class") == "COMMAND")
        .groupBy(F.col("w.value").alias("command"))
        .agg(F.sum("copies").alias("n"))
    )
    by_frequency = Window.orderBy(F.desc("n"), "command")
    return counts.select("command", "n", (F.row_number().over(by_frequency) - 1).cast("long").alias("rank"))


def eval_stages(queries: DataFrame, drop_last: bool = False) -> DataFrame:
    """The ``eval`` stages of the distinct texts. ``drop_last`` leaves out those that no pipe follows."""
    texts = queries.filter(F.col("text").contains("eval")).select("text").distinct()
    parsed = texts.select("text", F.inline(text_functions.stages(F.col("text")))).filter(F.col("command") == "eval")
    if drop_last:
        parsed = parsed.filter(F.col("piped_on"))
    return parsed.select("text", "position", "stage_text")


def stages_by_command(stage_table: DataFrame, commands: list[str] | None = None) -> DataFrame:
    """Stages whose command is listed (no list: all), with their position among all stages of the query."""
    return stage_table.filter(F.col("command").isin(*commands)) if commands else stage_table


def stages_with_commands(queries: DataFrame, commands: list[str]) -> DataFrame:
    """T9 from texts: the stages of the listed commands, with their position among all stages of the query.

    A text that holds none of the words can't hold the commands, so only the others are taken apart.
    """
    lowered = F.lower("text")
    named = reduce(lambda a, b: a | b, [lowered.contains(command) for command in commands])
    return stages_by_command(stages(queries.filter(named)), commands)


def first_stages(queries: DataFrame, commands: list[str] | None = None) -> DataFrame:
    """The first occurrence of every distinct stage, by query and position, with its digest as ``key``.

    Only the first query of every distinct text can contribute, so texts are reduced to that before they are taken apart; the
    first occurrence of a stage is an aggregation with map-side combine.
    """
    first_of_text = queries.groupBy("text").agg(F.min("query_id").alias("query_id"))
    parsed = first_of_text.select("query_id", F.inline(text_functions.stages(F.col("text")))).select(
        "query_id", *_STAGE_COLUMNS
    )
    candidates = stages_by_command(parsed, commands).withColumn("key", text_functions.text_digest(F.col("stage_key")))
    row = F.struct("query_id", *_STAGE_COLUMNS)
    first = candidates.groupBy("key").agg(F.min_by(row, F.struct("query_id", "position")).alias("first"))
    return first.select("key", "first.*")


def unique_stages(queries: DataFrame, commands: list[str] | None = None) -> DataFrame:
    """The first occurrence of every distinct stage, in query order.

    ``stage_id`` is ``<query_id>.<n>``, n counting the stages that are new in that query. The numbering window holds the
    stages of one query. ``sources.incremental`` keeps the result over many loads.
    """
    first = first_stages(queries, commands)
    in_query = Window.partitionBy("query_id").orderBy("position")
    return first.withColumn("n", F.row_number().over(in_query) - 1).select(
        F.concat_ws(".", "query_id", "n").alias("stage_id"), "query_id", *_STAGE_COLUMNS
    )


def unique_filters(queries: DataFrame) -> DataFrame:
    """T11."""
    return unique_stages(queries, FILTER_COMMANDS)


def unique_aggregates(queries: DataFrame) -> DataFrame:
    """T12."""
    return unique_stages(queries, AGGREGATE_COMMANDS)


def unique_augments(queries: DataFrame) -> DataFrame:
    """T13."""
    return unique_stages(queries, AUGMENT_COMMANDS)
