"""From raw audit events to a query log, one function per documented extraction recipe.

Events have ``_time, event_id, index, source, action, id, search_id, is_realtime, user, total_run_time,
savedsearch_name, _raw``. ``first`` and ``last`` of an id's events mean by ``(_time, event_id)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What stands around the fields of the recipes in a raw line: earliest and latest time, search text.
_MARKS = (("search_et=", ", search_lt"), ("search_lt=", ", is_realtime"), ("search='", "', autojoin"))
_EXCLUDED_TYPES = ("subsearch", "summary_director", "dm_acceleration")
_EXCLUDED_TEXTS = ("_internal", "_audit")


def _field(start: str, end: str, any_line: bool) -> str:
    """Looks ahead for the first field from one mark to the next end mark, which may be absent."""
    inside = r"[\s\S]*?" if any_line else ".*?"
    return rf"(?=(?:[\s\S]*?({start}{inside})(?={end}))?)"


# The fields with their first mark, so that an empty field differs from an absent one, put one after the other.
_FIELDS = "^" + "".join(_field(*marks, any_line=n == 2) for n, marks in enumerate(_MARKS)) + r"[\s\S]*$"
_BETWEEN = "\x01"


def _with_fields(events: DataFrame) -> DataFrame:
    """``events`` with ``et``, ``lt`` and ``text``, the first of each in the raw line or null. A line is matched once."""
    joined = F.regexp_replace("_raw", _FIELDS, _BETWEEN.join(f"${n}" for n in (1, 2, 3)))

    def fields(parts: Column) -> Column:
        named = []
        for n, ((start, _), name) in enumerate(zip(_MARKS, ("et", "lt", "text"), strict=True)):
            part = F.get(parts, F.lit(n))
            named.append(F.when(part != "", F.substr(part, F.lit(len(start) + 1))).alias(name))
        return F.struct(*named)

    parts = F.array(F.split(joined, _BETWEEN, len(_MARKS)))
    return events.select("*", F.inline(F.transform(parts, fields)))


def _unquote(value: Column) -> Column:
    return F.replace(value, F.lit("'"), F.lit(""))


def _order() -> Column:
    return F.struct("_time", "event_id")


def _first(name: str) -> Column:
    """First non-null value of a group."""
    return F.min_by(name, F.when(F.col(name).isNotNull(), _order()))


def _last(name: str) -> Column:
    return F.max_by(name, F.when(F.col(name).isNotNull(), _order()))


def _known_user() -> Column:
    return F.when(F.col("user") != "n/a", F.col("user"))


def _not_about_the_product(text: Column) -> Column:
    lowered = F.lower(text)
    return ~(lowered.contains(_EXCLUDED_TEXTS[0]) | lowered.contains(_EXCLUDED_TEXTS[1]))


def audit_to_log_2014(events: DataFrame, sysinfo: DataFrame, limit: int | None = None) -> DataFrame:
    """The version-6 recipe. ``sysinfo(index, splunk_version)`` tells which indexes to take.

    ``limit`` is the recipe's final row limit; the documented value is 100,000, and the default here is the whole log.
    """
    version_6 = sysinfo.filter(F.col("splunk_version").startswith("6")).select("index").distinct()
    audit = events.filter((F.col("action") == "search") & F.col("source").endswith("audit.log"))
    audit = _with_fields(audit.join(version_6, "index", "left_semi"))

    rt_id = F.col("search_id").startswith("rt")
    raw_flag = F.col("is_realtime")
    search_id = _unquote(F.col("search_id"))
    saved = F.coalesce(F.col("savedsearch_name"), F.lit(""))
    search_type = (
        F.when(F.coalesce(F.col("id"), F.lit("")).like("DM_%") | saved.like("_ACCELERATE_DM%"), "dm_acceleration")
        .when(search_id.startswith("scheduler"), "scheduled")
        .when(search_id.startswith("subsearch"), "subsearch")
        .when(
            search_id.startswith("SummaryDirector") | search_id.startswith("summarize_SummaryDirector"),
            "summary_director",
        )
        .otherwise("adhoc")
    )
    fields = audit.select(
        "_time",
        "event_id",
        search_id.alias("search_id"),
        _known_user().alias("user"),
        F.col("total_run_time").try_cast("double").alias("total_run_time"),
        _unquote(F.col("text")).alias("search"),
        "savedsearch_name",
        F.col("index").alias("case_id"),
        search_type.alias("search_type"),
        F.when((raw_flag == "1") | ((raw_flag == "N/A") & rt_id), "true").otherwise("false").alias("is_realtime"),
        F.col("et").alias("search_et"),
        F.col("lt").alias("search_lt"),
    )
    firsts = ["user", "search", "case_id", "search_type", "is_realtime", "search_et"]
    grouped = (
        fields.filter(F.col("search_id").isNotNull())
        .groupBy("search_id")
        .agg(
            F.min("_time").alias("_time"),
            F.max("total_run_time").alias("total_run_time"),
            F.array_sort(F.collect_set("savedsearch_name")).alias("savedsearch_name"),
            _last("search_lt").alias("search_lt"),
            *[_first(c).alias(c) for c in firsts],
        )
    )
    log = grouped.filter(
        ~F.col("search_type").isin(*_EXCLUDED_TYPES) & _not_about_the_product(F.col("search"))
    ).select(
        "case_id",
        "search_type",
        "is_realtime",
        "search_id",
        "user",
        "search",
        F.array_join("savedsearch_name", "\n").alias("savedsearch_name"),
        "search_et",
        "search_lt",
        (F.col("search_lt").try_cast("double") - F.col("search_et").try_cast("double")).alias("range"),
        "total_run_time",
        "_time",
    )
    return log if limit is None else log.limit(limit)


def audit_to_log_2012(events: DataFrame) -> DataFrame:
    """The recipe for older versions. ``search_et`` and ``search_lt`` are the sets of values seen for an id; the
    range is taken where each set has one value."""
    audit = _with_fields(events.filter((F.col("action") == "search") & F.col("source").endswith("audit.log")))
    fields = audit.select(
        "_time",
        "event_id",
        _unquote(F.coalesce("search_id", "id")).alias("search_id"),
        _known_user().alias("user"),
        F.col("total_run_time").try_cast("double").alias("total_run_time"),
        F.col("text").alias("search"),
        F.col("et").alias("search_et"),
        F.col("lt").alias("search_lt"),
    )
    grouped = (
        fields.filter(F.col("search_id").isNotNull())
        .groupBy("search_id")
        .agg(
            F.array_sort(F.collect_set("search_et")).alias("search_et"),
            F.array_sort(F.collect_set("search_lt")).alias("search_lt"),
            F.min("_time").alias("_time"),
            F.max("total_run_time").alias("total_run_time"),
            _first("user").alias("user"),
            _first("search").alias("search"),
        )
    )
    search_id = F.col("search_id")
    search_type = (
        F.when(search_id.like("13%.%"), "historical")
        .when(search_id.like("rt_%"), "realtime")
        .when(search_id.like("scheduler__%"), "scheduled")
        .when(search_id.like("subsearch_%"), "subsearch")
        .when(search_id.like("remote_%"), "remote")
        .when(search_id.like("%search%"), "other")
    )

    def single(name: str) -> Column:
        return F.when(F.size(name) == 1, F.get(F.col(name), F.lit(0))).try_cast("double")

    text = F.lower("search")
    return (
        grouped.filter((text.startswith("search") | text.startswith("rtsearch")) & _not_about_the_product(F.col("search")))
        .withColumn("searchtype", search_type)
        .filter(F.col("searchtype") != "subsearch")
        .select(
            "searchtype",
            (single("search_lt") - single("search_et")).alias("range"),
            F.array_join("search_lt", "\n").alias("search_lt"),
            F.array_join("search_et", "\n").alias("search_et"),
            "search",
            "search_id",
            "user",
            "total_run_time",
            "_time",
        )
    )
