"""The command taxonomy (data for T4) and category lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Category -> commands.
CATEGORY_COMMANDS = {
    "Aggregate": [
        "addcoltotals", "addtotals col", "chart", "contingency", "counttable", "eventcount", "geostats", "mvcombine",
        "rare", "stats", "timechart", "timewrap", "top", "transaction", "tstats",
    ],
    "Augment": [
        "addinfo", "addtotals", "addtotals row", "appendcols", "bin", "bucket", "eval", "eventstats", "extract",
        "gauge", "iplocation", "kv", "outputtext", "rangemap", "relevancy", "rex", "spath", "strcat", "tags",
        "xmlkv",
    ],
    "Cache": [
        "collect", "sichart", "sirare", "sistats", "sitimechart", "sitop", "summaryindex", "summarize", "tscollect",
    ],
    "Filter": ["dedup", "head", "regex", "search", "tail", "uniq", "where"],
    "Input": ["datamodel", "dbquery", "inputcsv", "inputlookup", "loadjob", "metadata", "rest", "savedsearch"],
    "Join": ["geoip", "join", "lookup"],
    "Macro": ["macro"],
    "Meta": ["delete", "localop", "metasearch"],
    "Miscellaneous": ["abstract", "format", "map", "noop", "overlap", "return"],
    "Output": ["export", "outputcsv", "outputlookup", "sendemail"],
    "Project": ["fields", "table"],
    "Read Metadata": ["audit", "dbinspect", "history", "typeahead"],
    "Rename": ["rename"],
    "Reorder": ["reverse", "sort"],
    "Set": ["append", "appendpipe", "set"],
    "Transform": [
        "convert", "fieldformat", "filldown", "fillnull", "makemv", "multikv", "mvexpand", "nomv", "outlier",
        "replace",
    ],
    "Transpose": ["transpose"],
    "Window": ["anomalies", "delta", "streamstats"],
}

COMMAND_CATEGORY = {
    command: category for category, commands in CATEGORY_COMMANDS.items() for command in commands
}

MISCELLANEOUS = "Miscellaneous"


def taxonomy(spark: SparkSession) -> DataFrame:
    """The taxonomy as a table ``(command, category)``."""
    return spark.createDataFrame(sorted(COMMAND_CATEGORY.items()), "command string, category string")


def is_known_command(command: Column) -> Column:
    return command.isin(sorted(COMMAND_CATEGORY))


def category_of(command: Column) -> Column:
    """The category of a command name, null when unknown: constant sets, so neither a join nor a shuffle."""
    found = F.when(F.lit(False), F.lit(None).cast("string"))
    for category, commands in CATEGORY_COMMANDS.items():
        found = found.when(command.isin(commands), category)
    return found
