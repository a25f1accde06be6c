"""A query log derived from the ``events`` table, and the raw forms of it that the readers take.

Every event becomes one query. Its text is one of ten templates, so that copies, quoting, macros, subsearches and external
commands all occur. The SQL constants build the same relations for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from searchlog import schemas
from searchlog.operators.select import mark_suspicious_queries, mark_suspicious_users
from searchlog.runtime import scratch_path

TEMPLATES = (
    "search index=web status=500 | stats count by host",
    "search index=web | eval mb=bytes/1024 | table host, mb",
    "| inputlookup assets | join host [search index=inv | dedup host | fields host, owner] | sort owner",
    'typeahead prefix="src" count="50"',
    'search `prod_idx` "a|b" | rex "code=(?<code>[0-9]+)" | top code',
    "search index=app | timechart count by region | addtotals col=true",
    "search index=app | ADDTOTALS row=true | head 10",
    "search index=fw action=deny | mycustomcmd level=3 | eval z=level*2",
    "search index=web status=500 | stats count by host",
    "search index=web | append [search index=app | append [search index=db | stats count] | stats count] "
    "| eventstats sum(count) as total",
)

_TEXT_SQL = "CASE event_id % 10 " + " ".join(f"WHEN {n} THEN '{t}'" for n, t in enumerate(TEMPLATES)) + " END"

QUERIES_SQL = f"""
q AS (
  SELECT event_id + 1 AS query_id, {_TEXT_SQL} AS text, epoch_us(ts) AS ts_us,
         event_type <> 'error' AS is_interactive,
         event_id % 10 = 3 AS is_suspicious,
         value AS execution_time,
         CASE WHEN event_type = 'error' THEN 'scheduled' ELSE 'adhoc' END AS search_type,
         user_id
  FROM events)"""

# Prose, turns of conversations and the templates as query texts; most are not well formed, many are long.
TEXT_QUERIES_SQL = f"""
q AS (
  SELECT doc_id * 4 AS query_id, text, doc_id % 50 AS user_id FROM documents
  UNION ALL SELECT (conv_id * 1000 + turn) * 4 + 1, text, conv_id % 50 FROM conversations
  UNION ALL SELECT event_id * 4 + 2, {_TEXT_SQL}, user_id FROM events)"""

USERS_SQL = """
u AS (
  SELECT user_id, CASE WHEN user_id = 0 THEN 'splunk-system-user' ELSE 'u' || user_id END AS name,
         'case_' || (user_id % 3) AS case_id,
         CASE WHEN user_id = 0 THEN 'suspicious' END AS user_type
  FROM (SELECT user_id FROM events UNION SELECT c_custkey FROM customer))"""


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table with its zoneless time read as UTC, whatever the session zone."""
    ts = F.col("ts")
    days = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    seconds = (days * 24 + F.hour(ts)) * 3600 + F.minute(ts) * 60
    second_us = (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")
    return read(spark, sf_dir, "events").withColumn("ts", F.timestamp_micros(seconds * 1_000_000 + second_us))


EPOCH_US = 1_704_067_200_000_000


def dense_tables(spark: SparkSession, sf_dir: str, faster: int) -> str:
    """A folder with the users' table and the events, whose times since the start of 2024 are divided by ``faster``."""
    path = scratch_path(spark, "dense")
    since = F.call_function("div", F.unix_micros("ts") - EPOCH_US, F.lit(faster))
    seconds = (since / F.lit(1_000_000).cast("decimal(10,0)")).cast("decimal(18,6)")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    moved = start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)
    events(spark, sf_dir).withColumn("ts", moved).write.parquet(f"{path}/events.parquet")
    read(spark, sf_dir, "customer").write.parquet(f"{path}/customer.parquet")
    return path


def template_text() -> Column:
    return F.get(F.array(*[F.lit(t) for t in TEMPLATES]), (F.col("event_id") % 10).cast("int"))


def _name(user_id: Column) -> Column:
    return F.when(user_id == 0, "splunk-system-user").otherwise(F.concat(F.lit("u"), user_id.cast("string")))


def _case(user_id: Column) -> Column:
    return F.concat(F.lit("case_"), (user_id % 3).cast("string"))


def raw_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored form of the log, nothing marked and nothing sessionised."""
    search_type = F.when(F.col("event_type") == "error", "scheduled").otherwise("adhoc")
    log = events(spark, sf_dir).select(
        (F.col("event_id") + 1).alias("query_id"),
        template_text().alias("text"),
        "ts",
        (search_type == "adhoc").alias("is_interactive"),
        F.lit(False).alias("is_suspicious"),
        F.col("value").alias("execution_time"),
        search_type.alias("search_type"),
        "user_id",
    )
    return schemas.conform(log, schemas.QUERIES).drop("session_id", "session_id_all")


def text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of every kind as queries, see TEXT_QUERIES_SQL."""
    docs = read(spark, sf_dir, "documents").select(
        (F.col("doc_id") * 4).alias("query_id"), "text", (F.col("doc_id") % 50).alias("user_id")
    )
    turn = (F.col("conv_id") * 1000 + F.col("turn")) * 4 + 1
    turns = read(spark, sf_dir, "conversations").select(
        turn.alias("query_id"), "text", (F.col("conv_id") % 50).alias("user_id")
    )
    templates = read(spark, sf_dir, "events").select(
        (F.col("event_id") * 4 + 2).alias("query_id"), template_text().alias("text"), "user_id"
    )
    return docs.union(turns).union(templates)


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_suspicious_queries(raw_queries(spark, sf_dir))


def raw_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everyone with an event, and every customer; most customers issue no query."""
    ids = (
        read(spark, sf_dir, "events")
        .select("user_id")
        .union(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id")))
        .distinct()
    )
    named = ids.select("user_id", _name(F.col("user_id")).alias("name"), _case(F.col("user_id")).alias("case_id"))
    return schemas.conform(named, schemas.USERS)


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_suspicious_users(raw_users(spark, sf_dir))


def export_2014(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as an export in the 2014 CSV layout."""
    seconds = F.unix_micros("ts") / 1_000_000
    no_range = F.col("event_id") % 3 == 0
    return events(spark, sf_dir).select(
        _case(F.col("user_id")).alias("case_id"),
        F.when(F.col("event_type") == "error", "scheduled").otherwise("adhoc").alias("search_type"),
        F.when(F.col("event_id") % 2 == 0, "true").otherwise("false").alias("is_realtime"),
        F.concat(F.lit("sid_"), F.col("event_id").cast("string")).alias("search_id"),
        _name(F.col("user_id")).alias("user"),
        F.concat(F.lit("  "), template_text(), F.lit("\t")).alias("search"),
        F.lit(None).cast("string").alias("savedsearch_name"),
        F.when(no_range, "N/A").otherwise(F.floor(seconds).cast("string")).alias("search_et"),
        F.when(no_range, "N/A").otherwise((F.floor(seconds) + 60).cast("string")).alias("search_lt"),
        F.when(~no_range, "60").alias("range"),
        F.col("value").cast("string").alias("total_run_time"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxx").alias("_time"),
    )


def export_2012(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as records in the 2012 JSON layout; ``range`` is absent where it is not known."""
    _number = F.substring_index("search_id", "_", -1).cast("long")
    return export_2014(spark, sf_dir).select(
        F.when(F.col("search_type") == "adhoc", "historical").otherwise("other").alias("searchtype"),
        "range",
        "search",
        "search_id",
        "search_et",
        "search_lt",
        "total_run_time",
        "user",
        F.when(_number % 7 == 0, F.concat(F.lit("failed "), _number.cast("string"))).alias("error"),
        (F.char_length(F.btrim("search", F.lit(" \t"))) + 3).cast("string").alias("searchlength"),
        F.date_format(F.to_timestamp("_time"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx").alias("_time"),
    )


EXPORT_SQL = f"""
x AS (
  SELECT event_id, 'case_' || (user_id % 3) AS case_id,
         CASE WHEN user_id = 0 THEN 'splunk-system-user' ELSE 'u' || user_id END AS name,
         {_TEXT_SQL} AS text, epoch_us(ts) AS ts_us, event_type <> 'error' AS is_interactive,
         CASE WHEN event_type = 'error' THEN 'scheduled' ELSE 'adhoc' END AS search_type,
         value AS execution_time,
         CASE WHEN event_id % 3 <> 0 THEN floor(epoch_us(ts) / 1000000) END AS earliest_event,
         CASE WHEN event_id % 3 <> 0 THEN floor(epoch_us(ts) / 1000000) + 60 END AS latest_event,
         CASE WHEN event_id % 3 <> 0 THEN 60.0::DOUBLE END AS event_range,
         event_id % 2 = 0 AS is_realtime, 'sid_' || event_id AS splunk_search_id
  FROM events)"""

# Prefixes of the search ids in the synthetic audit log, by id number.
_ID_PREFIXES = ("scheduler__a_", "subsearch_", "SummaryDirector_", "rt_", "remote_", "13", "ad_search_")
_AUDIT_TEXT_INTERNAL = "search index=_internal | head 5"


def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw audit events, three to a search id, with every case the recipes distinguish."""
    e = F.col("event_id")
    number = F.call_function("div", e, F.lit(3))
    prefix = F.get(F.array(*[F.lit(p) for p in _ID_PREFIXES]), (number % len(_ID_PREFIXES)).cast("int"))
    text = F.when(number % 19 == 0, _AUDIT_TEXT_INTERNAL).otherwise(template_text())
    seconds = F.call_function("div", F.unix_micros("ts"), F.lit(1_000_000))
    raw = F.concat(
        F.lit("Audit:["),
        F.when(e % 6 == 0, "").otherwise(F.concat(F.lit("search_et="), seconds.cast("string"), F.lit(", "))),
        F.lit("search_lt="),
        (seconds + 60).cast("string"),
        F.lit(", is_realtime=0, search='"),
        text,
        F.lit("', autojoin='1']"),
    )
    return events(spark, sf_dir).select(
        F.col("ts").alias("_time"),
        "event_id",
        F.concat(F.lit("main_"), (F.col("user_id") % 3).cast("string")).alias("index"),
        F.lit("/var/log/audit.log").alias("source"),
        F.when(e % 11 == 0, "quota").otherwise("search").alias("action"),
        F.when(number % 13 == 0, "DM_x").when(number % 23 == 0, "from_id").alias("id"),
        F.when(number % 23 != 0, F.concat(F.lit("'"), prefix, number.cast("string"), F.lit(".5'"))).alias("search_id"),
        F.when(e % 4 == 0, "0").when(e % 4 == 1, "1").when(e % 4 == 2, "N/A").alias("is_realtime"),
        F.when(F.col("user_id") % 5 == 0, "n/a").otherwise(_name(F.col("user_id"))).alias("user"),
        F.col("value").cast("string").alias("total_run_time"),
        F.when(number % 17 == 0, "_ACCELERATE_DM_y")
        .when(e % 3 == 1, F.concat(F.lit("saved_"), (F.col("user_id") % 4).cast("string")))
        .alias("savedsearch_name"),
        raw.alias("_raw"),
    )


def sysinfo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which version each index's system runs."""
    part = read(spark, sf_dir, "events").select((F.col("user_id") % 3).alias("i")).distinct()
    return part.select(
        F.concat(F.lit("main_"), F.col("i").cast("string")).alias("index"),
        F.when(F.col("i") == 1, "5.0.1").otherwise("6.0").alias("splunk_version"),
    )


AUDIT_SQL = f"""
a AS (
  SELECT ts, epoch_us(ts) AS ts_us, event_id, event_id // 3 AS g, user_id, value,
         'main_' || (user_id % 3) AS case_id,
         CASE WHEN (event_id // 3) % 13 = 0 THEN 'DM_x' WHEN (event_id // 3) % 23 = 0 THEN 'from_id' END AS id,
         CASE WHEN (event_id // 3) % 23 <> 0 THEN
           CASE (event_id // 3) % 7 {" ".join(f"WHEN {n} THEN '{p}'" for n, p in enumerate(_ID_PREFIXES))} END
           || (event_id // 3) || '.5' END AS search_id,
         CASE event_id % 4 WHEN 1 THEN 'true' ELSE 'false' END AS is_realtime,
         CASE WHEN user_id % 5 <> 0 THEN 'u' || user_id END AS user_name,
         CASE WHEN (event_id // 3) % 17 = 0 THEN '_ACCELERATE_DM_y'
              WHEN event_id % 3 = 1 THEN 'saved_' || (user_id % 4) END AS saved,
         CASE WHEN (event_id // 3) % 19 = 0 THEN '{_AUDIT_TEXT_INTERNAL}' ELSE {_TEXT_SQL} END AS search,
         CASE WHEN event_id % 6 <> 0 THEN epoch_us(ts) // 1000000 END AS et,
         epoch_us(ts) // 1000000 + 60 AS lt
  FROM events WHERE event_id % 11 <> 0)"""
