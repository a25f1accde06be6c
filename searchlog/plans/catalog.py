"""Every registered query with the SQL that must give the same rows.

A query takes ``(spark, sf_dir)``. Times are compared as integer microseconds, metrics rounded to six digits.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from searchlog import schemas
from searchlog.functions import normalize, text as text_functions
from searchlog.functions.taxonomy import COMMAND_CATEGORY
from searchlog.operators import groups, select, sessions, stages, userstats
from searchlog.operators.ids import with_sequential_ids
from searchlog.operators.integrity import fk_violations
from searchlog.plans import testlog
from searchlog.plans.testlog import AUDIT_SQL, EXPORT_SQL, QUERIES_SQL, USERS_SQL
from searchlog.runtime import scratch_path
from searchlog.sources import audit, clustered, dictionary, incremental, readers, store
from searchlog.streaming.sessions import run_available, stream_deltas, stream_sessions

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        ORACLES[name] = sql.strip()
        return function

    return register


def _us(name: str) -> Column:
    return F.unix_micros(name)


# --- Sessions ---------------------------------------------------------------------------------------------------------


def _sessions_sql(gap_us: int, where: str) -> str:
    """Sessions by the textbook route: lag, running count of long gaps, group."""
    return f"""
d AS (SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY user_id ORDER BY ts_us, query_id) AS gap_us
      FROM q WHERE {where}),
s AS (SELECT *, CAST(count(*) FILTER (gap_us > {gap_us}) OVER (PARTITION BY user_id ORDER BY ts_us, query_id
             ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_seq FROM d),
ss AS (SELECT user_id, session_seq, min(ts_us) AS start_us, max(ts_us) AS end_us,
              (max(ts_us) - min(ts_us)) / 1e6 AS duration_s, count(*) AS n_queries
       FROM s GROUP BY user_id, session_seq),
sn AS (SELECT *, row_number() OVER (ORDER BY user_id, session_seq) - 1 AS session_id FROM ss)"""


_CLEAN = "is_interactive AND NOT is_suspicious"
_HOUR8 = 8 * 3600
_STATS = "user_id, session_seq, start_us, end_us, duration_s, n_queries"
_WITH_SESSIONS_30M = f"WITH {QUERIES_SQL}, {_sessions_sql(1800 * 10**6, _CLEAN)}"
_WITH_SESSIONS_8H = f"WITH {QUERIES_SQL}, {_sessions_sql(_HOUR8 * 10**6, _CLEAN)}"
_WITH_SESSIONS_ALL = f"WITH {QUERIES_SQL}, {_sessions_sql(_HOUR8 * 10**6, 'is_interactive')}"


def _session_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "user_id", "session_seq", _us("start_ts").alias("start_us"), _us("end_ts").alias("end_us"), "duration_s",
        "n_queries",
    )


@query("session_stats", f"{_WITH_SESSIONS_30M} SELECT {_STATS} FROM ss")
def _(spark, sf_dir):
    return _session_columns(sessions.sessionize(testlog.queries(spark, sf_dir)))


@query("sessionize_30m", f"{_WITH_SESSIONS_30M} SELECT query_id, user_id, session_seq FROM s")
def _(spark, sf_dir):
    rows = testlog.queries(spark, sf_dir)
    return (
        sessions.attach_sessions(rows)
        .filter(F.col("session_seq").isNotNull())
        .select("query_id", "user_id", "session_seq")
    )


@query("sessionize_8h", f"{_WITH_SESSIONS_8H} SELECT {_STATS} FROM ss")
def _(spark, sf_dir):
    return _session_columns(sessions.sessionize(testlog.queries(spark, sf_dir), gap_s=_HOUR8))


@query("sessionize_uncleaned", f"{_WITH_SESSIONS_ALL} SELECT {_STATS} FROM ss")
def _(spark, sf_dir):
    return _session_columns(sessions.sessionize(testlog.queries(spark, sf_dir), _HOUR8, drop_suspicious=False))


@query(
    "query_deltas",
    f"{_WITH_SESSIONS_30M} SELECT query_id, user_id, ts_us, coalesce(gap_us, 0) / 1e6 AS delta_s FROM s",
)
def _(spark, sf_dir):
    deltas = sessions.query_deltas(testlog.queries(spark, sf_dir))
    return deltas.select("query_id", "user_id", _us("ts").alias("ts_us"), "delta_s")


@query(
    "queries_with_session",
    f"""{_WITH_SESSIONS_8H} SELECT q.query_id, q.text, q.ts_us, q.is_interactive, q.is_suspicious, q.execution_time,
           q.search_type, q.user_id, sn.session_id
    FROM q LEFT JOIN s USING (query_id) LEFT JOIN sn ON sn.user_id = s.user_id AND sn.session_seq = s.session_seq""",
)
def _(spark, sf_dir):
    numbered = sessions.queries_with_session(testlog.queries(spark, sf_dir), gap_s=_HOUR8)
    return numbered.withColumn("ts_us", _us("ts")).select(*_Q_COLUMNS.split(", "), "session_id")


@query(
    "surrogate_ids",
    f"""WITH {QUERIES_SQL}, {USERS_SQL}
    SELECT CAST(row_number() OVER (ORDER BY name, ts_us, text, query_id) AS BIGINT) AS new_id, query_id
    FROM q JOIN u USING (user_id)""",
)
def _(spark, sf_dir):
    owned = testlog.queries(spark, sf_dir).join(testlog.users(spark, sf_dir), "user_id")
    ordered = owned.select("name", "ts", "text", "query_id")
    return with_sequential_ids(ordered, ["name", "ts", "text", "query_id"], "new_id", start=1).select(
        "new_id", "query_id"
    )


# --- Projections, filters, nested reads -------------------------------------------------------------------------------

_Q_COLUMNS = "query_id, text, ts_us, is_interactive, is_suspicious, execution_time, search_type, user_id"


def _plain(df: DataFrame) -> DataFrame:
    return df.withColumn("ts_us", _us("ts")).select(*_Q_COLUMNS.split(", "))


@query("users", f"WITH {USERS_SQL} SELECT user_id, name, case_id, user_type FROM u")
def _(spark, sf_dir):
    return select.users_table(testlog.users(spark, sf_dir))


@query(
    "mark_users",
    f"WITH {USERS_SQL} SELECT user_id, name, user_type FROM u WHERE user_type = 'suspicious' OR user_type IS NULL",
)
def _(spark, sf_dir):
    return select.mark_suspicious_users(testlog.raw_users(spark, sf_dir)).select("user_id", "name", "user_type")


@query(
    "queries_all",
    f"""WITH {QUERIES_SQL} SELECT {_Q_COLUMNS}, NULL::DOUBLE AS earliest_event, NULL::DOUBLE AS latest_event,
    NULL::DOUBLE AS event_range, NULL::BOOLEAN AS is_realtime, NULL::VARCHAR AS splunk_search_id,
    NULL::VARCHAR AS saved_search_name, NULL::BIGINT AS session_id FROM q""",
)
def _(spark, sf_dir):
    stored = schemas.conform(testlog.queries(spark, sf_dir), schemas.QUERIES)
    return select.queries_table(stored).withColumn("ts_us", _us("ts")).drop("ts")


@query(
    "queries_by_type",
    f"""WITH {QUERIES_SQL} SELECT 'interactive' AS kind, query_id, text FROM q WHERE is_interactive
    UNION ALL SELECT 'scheduled', query_id, text FROM q WHERE NOT is_interactive""",
)
def _(spark, sf_dir):
    rows = testlog.queries(spark, sf_dir)
    kinds = [
        select.queries_by_type(rows, kind).select(F.lit(kind).alias("kind"), "query_id", "text")
        for kind in ("interactive", "scheduled")
    ]
    return kinds[0].unionByName(kinds[1])


@query("queries_of_user", f"WITH {QUERIES_SQL} SELECT {_Q_COLUMNS} FROM q WHERE user_id = 7")
def _(spark, sf_dir):
    return _plain(select.queries_of_user(testlog.queries(spark, sf_dir), 7))


@query(
    "queries_with_text",
    f"WITH {QUERIES_SQL} SELECT {_Q_COLUMNS} FROM q WHERE is_interactive AND text = '{testlog.TEMPLATES[0]}'",
)
def _(spark, sf_dir):
    return _plain(select.queries_with_text(testlog.queries(spark, sf_dir), testlog.TEMPLATES[0]))


@query("distinct_texts", f"WITH {QUERIES_SQL} SELECT DISTINCT text FROM q")
def _(spark, sf_dir):
    return select.distinct_texts(testlog.queries(spark, sf_dir))


@query("mark_typeahead", f"WITH {QUERIES_SQL} SELECT query_id, is_suspicious FROM q")
def _(spark, sf_dir):
    return select.mark_suspicious_queries(testlog.raw_queries(spark, sf_dir)).select("query_id", "is_suspicious")


@query(
    "blocklist_match",
    f"""WITH {QUERIES_SQL}, hot AS (SELECT text FROM q GROUP BY text HAVING count(DISTINCT user_id) = (
        SELECT max(n) FROM (SELECT count(DISTINCT user_id) AS n FROM q GROUP BY text)))
    SELECT query_id, text IN (SELECT text FROM hot) AS listed FROM q""",
)
def _(spark, sf_dir):
    rows = testlog.queries(spark, sf_dir)
    per_text = rows.groupBy("text", "user_id").count().groupBy("text").agg(F.count("*").alias("n"))
    widest = per_text.filter(F.col("n") == per_text.agg(F.max("n")).scalar())
    listed = [
        select.blocklist(rows, widest, keep).select("query_id", F.lit(keep).alias("listed")) for keep in (True, False)
    ]
    return listed[0].unionByName(listed[1])


@query(
    "queries_in_session",
    f"""{_WITH_SESSIONS_8H} SELECT s.query_id, s.text, sn.session_id FROM s JOIN sn USING (user_id, session_seq)
    WHERE sn.session_id = 5""",
)
def _(spark, sf_dir):
    numbered = sessions.queries_with_session(testlog.queries(spark, sf_dir), gap_s=_HOUR8)
    return select.queries_in_session(numbered, 5).select("query_id", "text", "session_id")


@query(
    "queries_in_session_uncleaned",
    f"""{_WITH_SESSIONS_ALL} SELECT s.query_id, s.text, sn.session_id AS session_id_all
    FROM s JOIN sn USING (user_id, session_seq) WHERE sn.session_id = 5""",
)
def _(spark, sf_dir):
    rows = testlog.queries(spark, sf_dir)
    numbered = sessions.number_sessions(sessions.sessionize(rows, _HOUR8, drop_suspicious=False))
    numbered = numbered.withColumnRenamed("session_id", "session_id_all")
    owned = sessions.attach_sessions(rows, numbered, _HOUR8, False, ("session_id_all",))
    return select.queries_in_session(owned, 5, uncleaned=True).select("query_id", "text", "session_id_all")


@query("sessions_of_user_uncleaned", f"{_WITH_SESSIONS_ALL} SELECT {_STATS} FROM ss WHERE user_id = 7")
def _(spark, sf_dir):
    stored = sessions.sessionize(testlog.queries(spark, sf_dir), _HOUR8, drop_suspicious=False)
    return _session_columns(select.sessions_of_user(stored, 7))


@query("sessions_of_user", f"{_WITH_SESSIONS_8H} SELECT {_STATS} FROM ss WHERE user_id = 7")
def _(spark, sf_dir):
    stored = sessions.sessionize(testlog.queries(spark, sf_dir), gap_s=_HOUR8)
    return _session_columns(select.sessions_of_user(stored, 7))


@query(
    "sessions_all",
    f"""WITH {EXPORT_SQL}, q AS (SELECT event_id AS query_id, hash(name, case_id) AS user_id, name, * EXCLUDE (name)
        FROM x), {_sessions_sql(1800 * 10**6, 'is_interactive')}
    SELECT name, session_seq, start_us, end_us, n_queries FROM ss JOIN (SELECT DISTINCT user_id, name FROM q)
    USING (user_id)""",
)
def _(spark, sf_dir):
    path = scratch_path(spark, "sessions_all")
    _write_csv(testlog.export_2014(spark, sf_dir), path)
    base = readers.base_tables(readers.read_csv_log(spark, path))
    found = select.sessions_all(base.queries, "format_2014")
    return found.join(base.users, "user_id").select(
        "name", "session_seq", _us("start_ts").alias("start_us"), _us("end_ts").alias("end_us"), "n_queries"
    )


@query(
    "sessions_multi",
    f"""{_WITH_SESSIONS_8H} SELECT sn.session_id, s.user_id, s.query_id, s.ts_us, s.text, sn.n_queries
    FROM s JOIN sn USING (user_id, session_seq) WHERE sn.n_queries > 1""",
)
def _(spark, sf_dir):
    found = select.sessions_multi(testlog.queries(spark, sf_dir), gap_s=_HOUR8)
    return found.withColumn("ts_us", _us("ts")).drop("ts")


@query(
    "users_with_queries",
    f"""WITH {QUERIES_SQL}, {USERS_SQL} SELECT u.user_id, name, case_id, user_type, query_id, ts_us, text, is_interactive,
    is_suspicious, execution_time, search_type, is_interactive AS in_interactive_list FROM u LEFT JOIN q USING (user_id)""",
)
def _(spark, sf_dir):
    rows = testlog.queries(spark, sf_dir).select(
        "query_id", "text", "ts", "is_interactive", "is_suspicious", "execution_time", "search_type", "user_id"
    )
    return select.users_with_queries(testlog.users(spark, sf_dir), rows).withColumn("ts_us", _us("ts")).drop("ts")


@query(
    "users_with_sessions",
    f"""{_WITH_SESSIONS_8H}, {USERS_SQL}
    SELECT u.user_id, name, case_id, user_type, session_seq, query_id, ts_us, text,
           coalesce(gap_us, CASE WHEN query_id IS NOT NULL THEN 0 END) / 1e6 AS delta_s FROM u LEFT JOIN s USING (user_id)""",
)
def _(spark, sf_dir):
    found = select.users_with_sessions(testlog.users(spark, sf_dir), testlog.queries(spark, sf_dir), gap_s=_HOUR8)
    return found.withColumn("ts_us", _us("ts")).drop("ts")


# --- Repeat-query groups ----------------------------------------------------------------------------------------------

_GROUPS_SQL = f"""WITH {QUERIES_SQL},
i AS (SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY text, user_id ORDER BY ts_us, query_id) AS x
      FROM q WHERE is_interactive),
t AS (SELECT text, count(*) AS n_copies, count(DISTINCT user_id) AS n_distinct_users FROM i GROUP BY text),
p AS (SELECT text, user_id, count(*) AS n_copies_this_user, count(x) AS n_intervals, avg(x) AS mean_us
      FROM i GROUP BY text, user_id),
b AS (SELECT text, user_id, least(x // 100000000, 9999) AS bin, count(*) AS n
      FROM i WHERE x <= 1000000000000 GROUP BY ALL),
bt AS (SELECT *, n / (sum(n) OVER (PARTITION BY text, user_id) * 100.0) AS d FROM b),
e AS (SELECT text, user_id, -sum(d * ln(d + 1e-4)) AS entropy FROM bt GROUP BY text, user_id),
c AS (SELECT text, user_id, avg(CASE WHEN x / mean_us > 0.9 AND x / mean_us < 1.1 THEN 1.0 ELSE 0.0 END) AS close,
             1 - avg(least(x % 30000000, 30000000 - x % 30000000)) / 30000000 AS clock
      FROM i JOIN p USING (text, user_id) WHERE x IS NOT NULL GROUP BY text, user_id),
m AS (SELECT p.*, n_copies, n_distinct_users,
             round(CASE WHEN n_intervals <= 1 THEN 0.0 ELSE entropy END, 6) AS entropy,
             round(CASE WHEN n_intervals <= 1 THEN 1.0 ELSE close END, 6) AS consistency,
             round(CASE WHEN n_intervals = 0 THEN -1.0 ELSE clock END, 6) AS clockness
      FROM p JOIN t USING (text) LEFT JOIN e USING (text, user_id) LEFT JOIN c USING (text, user_id))"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("entropy", "consistency", "clockness") if c in df.columns})


@query(
    "query_groups",
    f"""{_GROUPS_SQL} SELECT i.query_id, i.user_id, n_copies, n_copies_this_user, n_distinct_users
    FROM i JOIN m USING (text, user_id) WHERE n_copies > 1""",
)
def _(spark, sf_dir):
    return groups.query_groups(testlog.queries(spark, sf_dir))


@query(
    "interarrivals",
    f"{_GROUPS_SQL} SELECT query_id, user_id, x / 1e6 AS interval_s FROM i WHERE x IS NOT NULL",
)
def _(spark, sf_dir):
    return groups.interarrivals(testlog.queries(spark, sf_dir)).drop("text_key")


def _metric(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = testlog.queries(spark, sf_dir)
        texts = rows.select("text").distinct().withColumn("text_key", text_functions.text_digest(F.col("text")))
        found = groups.group_metrics(rows).join(texts, "text_key")
        return _rounded(found.select("text", "user_id", "n_intervals", name))

    return run


for _name in ("entropy", "consistency", "clockness"):
    query(
        f"group_{_name}",
        f"{_GROUPS_SQL} SELECT text, user_id, n_intervals, {_name} FROM m WHERE n_intervals > 0",
    )(_metric(_name))

_REPORT = "query_id, text, user_id, n_copies, n_copies_this_user, n_distinct_users, n_intervals, entropy, consistency, clockness"


@query("group_report", f"{_GROUPS_SQL} SELECT {_REPORT} FROM i JOIN m USING (text, user_id) WHERE n_copies > 1")
def _(spark, sf_dir):
    return _rounded(groups.group_report(testlog.queries(spark, sf_dir)).drop("text_key"))


@query(
    "group_intervals",
    f"""{_GROUPS_SQL} SELECT i.text, i.user_id, i.query_id, x / 1e6 AS interval_s FROM i JOIN m USING (text, user_id)
    WHERE n_copies > 1 AND x IS NOT NULL""",
)
def _(spark, sf_dir):
    """The intervals behind the rows of the report."""
    rows = testlog.queries(spark, sf_dir)
    reported = groups.group_report(rows).select("text_key", "text", "query_id")
    return groups.interarrivals(rows).join(reported, ["text_key", "query_id"]).drop("text_key")


@query(
    "group_suspicious",
    f"""{_GROUPS_SQL} SELECT query_id, consistency > 0.9 OR clockness > 0.9 OR n_distinct_users > 3 AS is_suspicious
    FROM i JOIN m USING (text, user_id) WHERE n_copies > 1""",
)
def _(spark, sf_dir):
    report = groups.group_report(testlog.queries(spark, sf_dir))
    return groups.group_suspicious(report).select("query_id", "is_suspicious")


# --- Users and intervals ----------------------------------------------------------------------------------------------

_SCORES_SQL = f"""WITH {QUERIES_SQL}, {USERS_SQL},
sc AS (SELECT user_id, count(query_id) AS n_interactive,
              CASE WHEN count(query_id) = 0 THEN -1.0 ELSE count(*) FILTER (is_suspicious) / count(query_id) END AS score
       FROM u LEFT JOIN (SELECT * FROM q WHERE is_interactive) USING (user_id) GROUP BY user_id)"""


@query("suspiciousness", f"{_SCORES_SQL} SELECT user_id, score, n_interactive FROM sc ORDER BY score, user_id")
def _(spark, sf_dir):
    return userstats.suspiciousness(testlog.users(spark, sf_dir), testlog.queries(spark, sf_dir))


@query(
    "suspiciousness_summary",
    f"""{_SCORES_SQL} SELECT count(*) FILTER (n_interactive = 0) AS no_interactive,
    count(*) FILTER (n_interactive > 0 AND score = 1) AS only_suspicious,
    count(*) FILTER (n_interactive > 0 AND score = 0) AS no_suspicious FROM sc""",
)
def _(spark, sf_dir):
    scores = userstats.suspiciousness(testlog.users(spark, sf_dir), testlog.queries(spark, sf_dir))
    return userstats.suspiciousness_summary(scores)


_POOL_SQL = f"""WITH {QUERIES_SQL}, {USERS_SQL},
w AS (SELECT query_id, user_id, ts_us - lag(ts_us) OVER (PARTITION BY user_id ORDER BY ts_us, query_id) AS x
      FROM q JOIN u USING (user_id) WHERE name <> 'splunk-system-user' AND {_CLEAN})"""


@query("user_interarrivals", f"{_POOL_SQL} SELECT query_id, user_id, x / 1e6 AS interval_s FROM w WHERE x IS NOT NULL")
def _(spark, sf_dir):
    return userstats.user_interarrivals(testlog.users(spark, sf_dir), testlog.queries(spark, sf_dir))


@query(
    "interarrival_counts",
    f"""{_POOL_SQL} SELECT count(x) AS n_intervals, count(*) FILTER (x > 30000000) AS n_discarded,
    count(*) FILTER (x < 1000000) AS n_too_short FROM w""",
)
def _(spark, sf_dir):
    return userstats.interarrival_counts(testlog.users(spark, sf_dir), testlog.queries(spark, sf_dir))


@query(
    "interarrival_hist",
    f"""{_POOL_SQL}, v AS (SELECT x FROM w WHERE x <= 30000000),
    r AS (SELECT CASE WHEN min(x) IS NULL THEN 0 WHEN min(x) = max(x) THEN min(x) - 500000 ELSE min(x) END AS lo,
                 CASE WHEN min(x) IS NULL THEN 1000000 WHEN min(x) = max(x) THEN max(x) + 500000 ELSE max(x) END AS hi
          FROM v),
    h AS (SELECT least(((x - lo) * 1000) // (hi - lo), 999) AS bin, count(*) AS n FROM v, r GROUP BY 1)
    SELECT bin, round((lo + (hi - lo) * bin / 1000.0) / 1e6, 6) AS from_s,
           round((lo + (hi - lo) * (bin + 1) / 1000.0) / 1e6, 6) AS to_s, coalesce(n, 0) AS n
    FROM (SELECT range AS bin FROM range(1000)) LEFT JOIN h USING (bin), r""",
)
def _(spark, sf_dir):
    hist = userstats.interarrival_hist(testlog.users(spark, sf_dir), testlog.queries(spark, sf_dir))
    return hist.select("bin", F.round("from_s", 6).alias("from_s"), F.round("to_s", 6).alias("to_s"), "n")


# --- Query texts ------------------------------------------------------------------------------------------------------

_TAXONOMY_SQL = (
    "tax(command, category) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in sorted(COMMAND_CATEGORY.items())) + ")"
)
_BLANKS = "chr(32) || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"
_ATOM_SQL = r"""(?s)\s*(?:"(?:[^"\\]|\\.)*"|`[^`]*`|[\[\]|]|[^"`\[\]|\s][^"`\[\]|]*|["`])"""


def _texts_sql(source: str) -> str:
    """Atoms, stages and words of the distinct texts of ``source``, by unnesting and windows."""
    return f"""{_TAXONOMY_SQL},
tx AS (SELECT DISTINCT text FROM ({source}) WHERE text IS NOT NULL),
ax AS (SELECT text, unnest(range(len(a))) AS i, unnest(a) AS raw
       FROM (SELECT text, regexp_extract_all(text, '{_ATOM_SQL}') AS a FROM tx)),
av AS (SELECT *, trim(raw, {_BLANKS}) AS v FROM ax),
ad AS (SELECT *, lag(v) OVER w AS prev, count(*) OVER (PARTITION BY text) AS n_atoms,
              sum(CASE v WHEN '[' THEN 1 WHEN ']' THEN -1 ELSE 0 END) OVER w AS after
       FROM av WINDOW w AS (PARTITION BY text ORDER BY i)),
ok AS (SELECT text FROM ad GROUP BY text
       HAVING min(after) >= 0 AND arg_max(after, i) = 0 AND NOT bool_or(v IN ('"', '`'))),
ap AS (SELECT ad.*, after - CASE v WHEN '[' THEN 1 WHEN ']' THEN -1 ELSE 0 END AS depth,
              v NOT IN ('|', '[', ']') AND coalesce(prev IN ('|', '['), TRUE) AS starts
       FROM ad JOIN ok USING (text)),
wd AS (SELECT *, CASE WHEN v LIKE '`%' OR v LIKE '"%' THEN v ELSE regexp_extract(v, '^\\S+') END AS word
       FROM ap WHERE starts),
wc AS (SELECT wd.*, lower(word) AS command,
              CASE WHEN word LIKE '`%' THEN 'MACRO' WHEN tax.command IS NOT NULL THEN 'COMMAND'
                   ELSE 'EXTERNAL_COMMAND' END AS token_class
       FROM wd LEFT JOIN tax ON tax.command = lower(word)),
se AS (SELECT b.text, b.i, coalesce(min(e.i), any_value(b.n_atoms)) AS stop
       FROM wc b LEFT JOIN ap e ON e.text = b.text AND e.i > b.i AND e.depth = b.depth AND e.v IN ('|', ']')
       GROUP BY b.text, b.i),
st AS (SELECT wc.text, (row_number() OVER (PARTITION BY wc.text ORDER BY wc.i) - 1)::INTEGER AS position,
              wc.depth::INTEGER AS depth, wc.command,
              wc.token_class, wc.word, se.stop, trim(z.stage_text, {_BLANKS}) AS stage_text,
              trim(substr(trim(z.stage_text, {_BLANKS}), length(wc.word) + 1), {_BLANKS}) AS args,
              lower(wc.word) || substr(trim(z.stage_key, {_BLANKS}), length(wc.word) + 1) AS stage_key
       FROM wc JOIN se USING (text, i) JOIN (
         SELECT se.text, se.i, string_agg(p.raw, '' ORDER BY p.i) AS stage_text,
                string_agg(CASE WHEN p.v LIKE '`%' OR p.v LIKE '"%' THEN regexp_replace(p.raw, '^\\s+', ' ')
                           ELSE regexp_replace(p.raw, '\\s+', ' ', 'g') END, '' ORDER BY p.i) AS stage_key
         FROM se JOIN ap p ON p.text = se.text AND p.i >= se.i AND p.i < se.stop GROUP BY se.text, se.i
       ) z USING (text, i))"""


_TEXTS = f"WITH {QUERIES_SQL}, {_texts_sql('SELECT text FROM q')}"
_STAGE = "position, depth, command, token_class, args, stage_text, stage_key"


@query(
    "tokens",
    f"""{_TEXTS}, tk AS (
      SELECT text, i, 0 AS k, CASE v WHEN '|' THEN 'PIPE' WHEN '[' THEN 'LBRACKET' WHEN ']' THEN 'RBRACKET'
             ELSE 'ARGS' END AS token_class, v AS value FROM ap WHERE NOT starts
      UNION ALL SELECT text, i, 0, token_class, word FROM wc
      UNION ALL SELECT text, i, 1, 'ARGS', trim(substr(v, length(word) + 1), {_BLANKS}) FROM wc
                WHERE trim(substr(v, length(word) + 1), {_BLANKS}) <> ''),
    tp AS (SELECT *, (row_number() OVER (PARTITION BY text ORDER BY i, k) - 1)::INTEGER AS position FROM tk)
    SELECT query_id, position, token_class, value FROM q JOIN tp USING (text)""",
)
def _(spark, sf_dir):
    return stages.query_tokens(testlog.queries(spark, sf_dir))


@query(
    "stage_split",
    f"""{_TEXTS},
    c AS (SELECT *, CASE WHEN (v = '|' AND depth = 0) OR coalesce(lag(v = ']' AND depth = 1) OVER w, FALSE)
                    THEN 1 ELSE 0 END AS cuts FROM ap WINDOW w AS (PARTITION BY text ORDER BY i)),
    g AS (SELECT *, sum(cuts) OVER (PARTITION BY text ORDER BY i) AS part FROM c),
    sp AS (SELECT text, part, string_agg(v, ' ' ORDER BY i) AS stage FROM g GROUP BY text, part),
    sn AS (SELECT text, (row_number() OVER (PARTITION BY text ORDER BY part) - 1)::INTEGER AS position, stage FROM sp)
    SELECT query_id, position, stage FROM q JOIN sn USING (text)""",
)
def _(spark, sf_dir):
    return stages.query_splits(testlog.queries(spark, sf_dir))


@query("commands", f"{_TEXTS} SELECT query_id, position, command FROM q JOIN st USING (text)")
def _(spark, sf_dir):
    return stages.query_commands(testlog.queries(spark, sf_dir))


# The option rule for addtotals on texts whose options are plain words.
_ADDTOTALS_SQL = """CASE WHEN regexp_matches(args, '^[^"]*?\\bcol\\s*=\\s*(?i:true|t|0*[1-9][0-9]*)\\b')
    AND NOT regexp_matches(args, '\\brow\\s*=\\s*(?i:true|t|0*[1-9][0-9]*)\\b.*\\bcol\\s*=')
    THEN 'addtotals col' ELSE 'addtotals row' END"""


@query(
    "categories",
    f"""{_TEXTS} SELECT query_id, position, CASE WHEN token_class = 'MACRO' THEN 'Macro'
      ELSE coalesce(tax.category, 'Miscellaneous') END AS category
    FROM q JOIN st USING (text)
    LEFT JOIN tax ON tax.command = CASE st.command WHEN 'addtotals' THEN {_ADDTOTALS_SQL} ELSE st.command END""",
)
def _(spark, sf_dir):
    return stages.query_categories(testlog.queries(spark, sf_dir))


@query(
    "addtotals_kind",
    f"""{_TEXTS} SELECT query_id, position, {_ADDTOTALS_SQL} AS kind FROM q JOIN st USING (text)
    WHERE command = 'addtotals'""",
)
def _(spark, sf_dir):
    found = stages.stages_with_commands(testlog.queries(spark, sf_dir), ["addtotals"])
    return found.select("query_id", "position", text_functions.addtotals_kind(F.col("args")).alias("kind"))


@query(
    "truth_value",
    """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN TRUE WHEN event_id % 5 = 1 THEN TRUE
    WHEN event_id % 5 = 2 THEN value <> 0 WHEN event_id % 5 = 3 THEN user_id <> 0 ELSE FALSE END AS truth FROM events""",
)
def _(spark, sf_dir):
    kind = F.col("event_id") % 5
    raw = (
        F.when(kind == 0, "True")
        .when(kind == 1, "t")
        .when(kind == 2, F.col("value").cast("string"))
        .when(kind == 3, F.col("user_id").cast("string"))
        .otherwise(F.col("event_type"))
    )
    return testlog.events(spark, sf_dir).select("event_id", normalize.truth_value(raw).alias("truth"))


@query("stages", f"{_TEXTS} SELECT query_id, {_STAGE} FROM q JOIN st USING (text)")
def _(spark, sf_dir):
    return stages.stages(testlog.queries(spark, sf_dir))


@query(
    "queries_with_stages",
    f"""{_TEXTS} SELECT query_id, user_id, count(*) AS n_stages, max(depth) AS max_depth,
    string_agg(stage_key, ' > ' ORDER BY position) AS path FROM q JOIN st USING (text) GROUP BY query_id, user_id""",
)
def _(spark, sf_dir):
    parsed = select.queries_with_stages(testlog.queries(spark, sf_dir))
    return parsed.select(
        "query_id",
        "user_id",
        F.size("stages").cast("long").alias("n_stages"),
        F.array_max("stages.depth").alias("max_depth"),
        F.array_join("stages.stage_key", " > ").alias("path"),
    )


@query(
    "command_counts",
    f"""{_TEXTS}, cc AS (SELECT command, count(*) AS n FROM q JOIN st USING (text) WHERE token_class = 'COMMAND'
      GROUP BY command)
    SELECT command, n, row_number() OVER (ORDER BY n DESC, command) - 1 AS rank FROM cc""",
)
def _(spark, sf_dir):
    return stages.command_counts(testlog.queries(spark, sf_dir))


@query(
    "eval_stages_piped_on",
    f"{_TEXTS} SELECT text, position, stage_text FROM st WHERE command = 'eval' "
    "AND EXISTS (SELECT 1 FROM ap WHERE ap.text = st.text AND ap.i = st.stop AND ap.v = '|')",
)
def _(spark, sf_dir):
    return stages.eval_stages(testlog.queries(spark, sf_dir), drop_last=True)


@query("eval_stages", f"{_TEXTS} SELECT text, position, stage_text FROM st WHERE command = 'eval'")
def _(spark, sf_dir):
    return stages.eval_stages(testlog.queries(spark, sf_dir))


@query(
    "stages_by_command",
    f"""{_TEXTS} SELECT query_id, position, command, stage_key FROM q JOIN st USING (text)
    WHERE command IN ('stats', 'search')""",
)
def _(spark, sf_dir):
    found = stages.stages_with_commands(testlog.queries(spark, sf_dir), ["stats", "search"])
    return found.select("query_id", "position", "command", "stage_key")


def _unique_sql(commands: list[str] | None) -> str:
    where = "" if commands is None else "WHERE command IN (" + ", ".join(f"'{c}'" for c in commands) + ")"
    return f"""{_TEXTS},
    a AS (SELECT query_id, {_STAGE}, row_number() OVER (PARTITION BY stage_key ORDER BY query_id, position) AS k
          FROM q JOIN st USING (text) {where})
    SELECT query_id || '.' || (row_number() OVER (PARTITION BY query_id ORDER BY position) - 1) AS stage_id,
           query_id, {_STAGE} FROM a WHERE k = 1"""


@query("unique_stages", _unique_sql(None))
def _(spark, sf_dir):
    return stages.unique_stages(testlog.queries(spark, sf_dir))


@query("unique_filters", _unique_sql(stages.FILTER_COMMANDS))
def _(spark, sf_dir):
    return stages.unique_filters(testlog.queries(spark, sf_dir))


@query("unique_aggregates", _unique_sql(stages.AGGREGATE_COMMANDS))
def _(spark, sf_dir):
    return stages.unique_aggregates(testlog.queries(spark, sf_dir))


@query("unique_augments", _unique_sql(stages.AUGMENT_COMMANDS))
def _(spark, sf_dir):
    return stages.unique_augments(testlog.queries(spark, sf_dir))


# --- Sources and normalisation ----------------------------------------------------------------------------------------


def _write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("escape", '"').option("quoteAll", True).option("emptyValue", "").option(
        "ignoreLeadingWhiteSpace", False
    ).option("ignoreTrailingWhiteSpace", False).csv(path)


_LOG = "name, case_id, text, ts_us, is_interactive, execution_time, earliest_event, latest_event, event_range, is_realtime, search_type, splunk_search_id"


def _log_columns(log: readers.Log) -> DataFrame:
    return log.rows.withColumn("ts_us", _us("ts")).select(*_LOG.split(", "))


@query("read_csv_log", f"WITH {EXPORT_SQL} SELECT {_LOG} FROM x")
def _(spark, sf_dir):
    path = scratch_path(spark, "csv_log")
    _write_csv(testlog.export_2014(spark, sf_dir), path)
    return _log_columns(readers.read_csv_log(spark, path))


_BROKEN_SQL = "replace(text, ' | ', ' |' || chr(10) || ' ')"


@query(
    "read_log_dir",
    f"""WITH {EXPORT_SQL} SELECT {_LOG.replace("case_id, text", f"CASE WHEN is_interactive THEN case_id END AS case_id, {_BROKEN_SQL} AS text")
        .replace("is_realtime", "CASE WHEN is_interactive THEN is_realtime END AS is_realtime")}
    FROM x""",
)
def _(spark, sf_dir):
    """Files of two layouts, one of them also with its columns in another order; texts with line breaks."""
    path = scratch_path(spark, "log_dir")
    broken = F.regexp_replace("search", "(?<=\\S) \\| ", " |\n ")
    export = testlog.export_2014(spark, sf_dir).withColumn("search", broken)
    adhoc, other = export.filter(F.col("search_type") == "adhoc"), export.filter(F.col("search_type") != "adhoc")
    even = F.xxhash64("search_id") % 2 == 0
    _write_csv(adhoc.filter(even), f"{path}/a")
    _write_csv(adhoc.filter(~even).select(*reversed(export.columns)), f"{path}/a/reordered")
    old = other.withColumnRenamed("search_type", "searchtype").drop("case_id", "is_realtime", "savedsearch_name")
    _write_csv(old, f"{path}/b/nested")
    return _log_columns(readers.read_csv_log(spark, path))


_JSON_LOG = (
    "name, text, ts_us, is_interactive, execution_time, earliest_event, latest_event, event_range, splunk_search_id"
)


def _json_columns(log: readers.Log) -> DataFrame:
    return log.rows.withColumn("ts_us", _us("ts")).select(*_JSON_LOG.split(", "))


@query("read_json_log", f"WITH {EXPORT_SQL} SELECT {_JSON_LOG} FROM x")
def _(spark, sf_dir):
    path = scratch_path(spark, "json_log")
    testlog.export_2012(spark, sf_dir).write.json(path)
    return _json_columns(readers.read_json_log(spark, path, multi_line=False))


_BRACED_SQL = "replace(text, ' | ', ' | \"},{\" ')"

_RECORDS_SQL = f"""WITH {EXPORT_SQL},
rec AS (SELECT CASE WHEN is_interactive THEN 'historical' ELSE 'other' END AS searchtype,
               CASE WHEN event_range IS NOT NULL THEN '60' END AS "range", '  ' || text || chr(9) AS search,
               splunk_search_id AS search_id, name AS "user", coalesce(earliest_event::BIGINT::VARCHAR, 'N/A') AS search_et,
               coalesce(latest_event::BIGINT::VARCHAR, 'N/A') AS search_lt, execution_time::VARCHAR AS total_run_time,
               strftime(make_timestamp(ts_us), '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS _time,
               CASE WHEN event_id % 7 = 0 THEN 'failed ' || event_id END AS error,
               (length(text) + 3)::VARCHAR AS searchlength FROM x)"""
_RECORD = 'searchtype, "range", search, search_id, "user", search_et, search_lt, total_run_time, _time, error, searchlength'


@query("combine_results", f"{_RECORDS_SQL} SELECT {_RECORD} FROM rec")
def _(spark, sf_dir):
    path = scratch_path(spark, "results")
    export = testlog.export_2012(spark, sf_dir)
    by_hand = F.col("searchtype") == "historical"
    export.filter(by_hand).write.json(f"{path}/1")
    export.filter(~by_hand).write.json(f"{path}/2")
    both = readers.read_json(spark, [f"{path}/1", f"{path}/2"], multi_line=False)
    return both.drop("$offset")


@query(
    "record_unpivot",
    f"{_RECORDS_SQL} SELECT key, value FROM (UNPIVOT rec ON {_RECORD} INTO NAME key VALUE value)",
)
def _(spark, sf_dir):
    return readers.record_unpivot(testlog.export_2012(spark, sf_dir))


@query(
    "records_by_key",
    f"""{_RECORDS_SQL} SELECT 'search' AS key, search AS value FROM rec UNION ALL SELECT 'searchtype', searchtype FROM rec
    UNION ALL SELECT 'range', "range" FROM rec WHERE "range" IS NOT NULL
    UNION ALL SELECT 'error', error FROM rec WHERE error IS NOT NULL UNION ALL SELECT 'searchlength', searchlength FROM rec""",
)
def _(spark, sf_dir):
    pairs = readers.record_unpivot(testlog.export_2012(spark, sf_dir))
    parts = [readers.records_by_key(pairs, key).select(F.lit(key).alias("key"), "value") for key in readers.RECORD_KEYS]
    return reduce(DataFrame.unionByName, parts)


@query("user_identity", f"WITH {EXPORT_SQL} SELECT DISTINCT name, case_id FROM x")
def _(spark, sf_dir):
    log = readers.normalize_log(testlog.export_2014(spark, sf_dir), "format_2014")
    return readers.user_identities(log.rows)


@query(
    "norm_text",
    "SELECT doc_id, trim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(32) || chr(160)) AS text "
    "FROM documents",
)
def _(spark, sf_dir):
    padded = F.concat(F.lit("\t  "), F.col("text"), F.lit("\r\n  "))
    return testlog.read(spark, sf_dir, "documents").select("doc_id", normalize.clean_text(padded).alias("text"))


@query("norm_time", "SELECT event_id, CASE WHEN event_type <> 'view' THEN epoch_us(ts) END AS ts_us FROM events")
def _(spark, sf_dir):
    pattern = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    raw = (
        F.when(F.col("event_type") == "view", F.col("event_type"))
        .when(F.col("event_type") == "click", F.date_format("ts", pattern + "xx"))
        .otherwise(F.date_format("ts", pattern + "xxx"))
    )
    rows = testlog.events(spark, sf_dir).select("event_id", raw.alias("raw"))
    return rows.select("event_id", F.unix_micros(normalize.parse_time(F.col("raw"))).alias("ts_us"))


@query(
    "norm_doubles",
    """SELECT event_id, CASE event_id % 6 WHEN 0 THEN value WHEN 1 THEN user_id::DOUBLE WHEN 2 THEN -value
    WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE NULL END AS number FROM events""",
)
def _(spark, sf_dir):
    kind, value = F.col("event_id") % 6, F.col("value").cast("string")
    raw = (
        F.when(kind == 0, value)
        .when(kind == 1, F.concat(F.lit(" "), F.col("user_id").cast("string"), F.lit(" ")))
        .when(kind == 2, F.concat(F.lit("-"), value))
        .when(kind == 3, F.concat(value, F.lit("f")))
        .when(kind == 4, "N/A")
        .otherwise("")
    )
    return testlog.events(spark, sf_dir).select("event_id", normalize.lenient_double(raw).alias("number"))


@query(
    "norm_realtime",
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS is_realtime,
    CASE event_id % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE event_type END AS is_realtime_raw FROM events""",
)
def _(spark, sf_dir):
    kind = F.col("event_id") % 3
    raw = F.when(kind == 0, "true").when(kind == 1, "false").otherwise(F.col("event_type"))
    return testlog.events(spark, sf_dir).select(
        "event_id", normalize.realtime_flag(raw).alias("is_realtime"), raw.alias("is_realtime_raw")
    )


@query(
    "norm_aliases",
    """SELECT event_id, value AS execution_time, event_type AS search_type FROM events
    UNION ALL SELECT event_id, value, event_type FROM events""",
)
def _(spark, sf_dir):
    rows = testlog.events(spark, sf_dir)
    new = rows.select("event_id", F.col("value").alias("runtime"), F.col("event_type").alias("searchtype"))
    old = rows.select("event_id", F.col("value").alias("total_run_time"), F.col("event_type").alias("search_type"))
    parts = [
        raw.select(
            "event_id",
            normalize.first_present(raw, "runtime", "total_run_time").alias("execution_time"),
            normalize.first_present(raw, "searchtype", "search_type").alias("search_type"),
        )
        for raw in (new, old)
    ]
    return parts[0].unionByName(parts[1])


@query("flag_interactive", f"WITH {QUERIES_SQL} SELECT query_id, is_interactive FROM q")
def _(spark, sf_dir):
    rows = testlog.raw_queries(spark, sf_dir)
    return rows.select("query_id", normalize.interactive_flag(F.col("search_type")).alias("is_interactive"))


@query("split_interactive", f"WITH {EXPORT_SQL} SELECT splunk_search_id, is_interactive FROM x")
def _(spark, sf_dir):
    records = testlog.export_2012(spark, sf_dir).select(
        F.col("search_id").alias("splunk_search_id"), F.col("searchtype").alias("search_type")
    )
    return normalize.split_interactive(records, "format_2012").drop("search_type")


@query(
    "load_base",
    f"""WITH {EXPORT_SQL}, un AS (SELECT name, case_id, CAST(row_number() OVER (ORDER BY name, case_id) AS BIGINT)
      AS user_id FROM (SELECT DISTINCT name, case_id FROM x))
    SELECT CAST(row_number() OVER (ORDER BY user_id, ts_us, text, event_id) AS BIGINT) AS query_id, user_id, name,
           case_id, text, ts_us, is_interactive, execution_time, earliest_event, latest_event, event_range, is_realtime,
           search_type, splunk_search_id, NULL::BIGINT AS session_id
    FROM x JOIN un USING (name, case_id)""",
)
def _(spark, sf_dir):
    log = readers.normalize_log(testlog.export_2014(spark, sf_dir), "format_2014")
    stored = store.load_base(log, scratch_path(spark, "load_base"))
    return stored.queries.join(stored.users, "user_id").select(
        "query_id", "user_id", "name", "case_id", "text", _us("ts").alias("ts_us"), "is_interactive", "execution_time",
        "earliest_event", "latest_event", "event_range", "is_realtime", "search_type", "splunk_search_id", "session_id",
    )


# The columns of the stored tables.
_STORED_TYPES = {
    "users": "user_id bigint, name string, case_id string, user_type string",
    "queries": "query_id bigint, text string, ts timestamp, is_interactive boolean, is_suspicious boolean, "
    "execution_time double, earliest_event double, latest_event double, event_range double, is_realtime boolean, "
    "search_type string, splunk_search_id string, saved_search_name string, user_id bigint, session_id bigint, "
    "session_id_all bigint",
    "sessions": "session_id bigint, user_id bigint, session_seq bigint, start_ts timestamp, end_ts timestamp, "
    "duration_s double, n_queries bigint",
    "stages": "query_id bigint, position int, depth int, command string, token_class string, args string, "
    "stage_text string, stage_key string",
}
_STORED_TYPES_SQL = ", ".join(
    f"('{table}', '{column.split()[0]}', '{column.split()[1]}')"
    for table, columns in _STORED_TYPES.items()
    for column in columns.split(", ")
)


@query(
    "table_schemas",
    f"""{_TEXTS}, {_sessions_sql(_HOUR8 * 10**6, _CLEAN)}, {USERS_SQL},
    n AS (SELECT 'users' AS table_name, count(*) AS n_rows FROM u UNION ALL SELECT 'queries', count(*) FROM q
          UNION ALL SELECT 'sessions', count(*) FROM sn UNION ALL SELECT 'stages', count(*) FROM q JOIN st USING (text)),
    c(table_name, column_name, column_type) AS (VALUES {_STORED_TYPES_SQL})
    SELECT table_name, column_name, column_type, n_rows FROM n JOIN c USING (table_name)""",
)
def _(spark, sf_dir):
    """What is stored after all loads: the columns as files hold them, and how many rows."""
    root, final = scratch_path(spark, "tables"), scratch_path(spark, "tables")
    store.initialize_tables(spark, root)
    store.write_table(testlog.users(spark, sf_dir), root, "users")
    store.write_table(testlog.queries(spark, sf_dir), root, "queries")
    store.load_parsed(spark, root)
    store.load_sessions(spark, root, final, gap_s=_HOUR8)
    places = {"users": root, "queries": final, "sessions": final, "stages": root}
    parts = []
    for name, where in places.items():
        stored = spark.read.parquet(store.table_path(where, name))
        columns = [F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("column_type")) for c, t in stored.dtypes]
        counted = stored.agg(F.lit(name).alias("table_name"), F.count("*").alias("n_rows"))
        parts.append(counted.select("table_name", "n_rows", F.inline(F.array(*columns))))
    return reduce(DataFrame.unionByName, parts)


@query(
    "fk_violations_all",
    f"""WITH {QUERIES_SQL}
    SELECT 'queries.user_id in users.user_id' AS rule, user_id::VARCHAR AS value, count(*) AS n_rows
    FROM q WHERE user_id % 3 = 0 GROUP BY user_id
    UNION ALL SELECT 'sessions.user_id in users.user_id', user_id::VARCHAR, count(*) FROM q WHERE user_id % 3 = 0 GROUP BY user_id
    UNION ALL SELECT 'sessions_all.user_id in users.user_id', user_id::VARCHAR, count(*)
    FROM q WHERE user_id % 3 = 0 GROUP BY user_id
    UNION ALL SELECT 'queries.session_id in sessions.session_id', query_id::VARCHAR, 1 FROM q WHERE query_id % 5 = 0
    UNION ALL SELECT 'queries.session_id_all in sessions_all.session_id', query_id::VARCHAR, 1 FROM q WHERE query_id % 7 = 0
    UNION ALL SELECT 'stages.query_id in queries.query_id', query_id::VARCHAR, 1 FROM q WHERE query_id % 2 = 0
    UNION ALL SELECT 'queries.text not null', NULL, count(*) FROM q WHERE query_id % 11 = 0 AND query_id % 2 = 1""",
)
def _(spark, sf_dir):
    """Stored tables with parents and texts missing, so that every rule has something to report."""
    rows = testlog.queries(spark, sf_dir)
    number = F.col("query_id")
    owned = rows.select("user_id", number.alias("session_id"))
    queries_ = rows.select(
        "query_id", "user_id", number.alias("session_id"), number.alias("session_id_all"),
        F.when(number % 11 != 0, F.col("text")).alias("text"),
    )
    odd = queries_.filter(number % 2 == 1)
    keys = rows.select("user_id", "query_id")
    tables = {
        "users": testlog.users(spark, sf_dir).filter(F.col("user_id") % 3 != 0),
        "queries": queries_,
        "sessions": owned.filter(F.col("session_id") % 5 != 0),
        "sessions_all": owned.filter(F.col("session_id") % 7 != 0),
        "stages": keys,
    }
    # Sessions lose rows above and still have to show all their users.
    parents = fk_violations({"users": tables["users"], "sessions": owned, "sessions_all": owned, "queries": rows})
    by_session = fk_violations({name: tables[name] for name in ("queries", "sessions", "sessions_all")})
    by_query = fk_violations({"queries": odd, "stages": tables["stages"]})
    return parents.filter(F.col("rule").contains("users.")).unionByName(
        by_session.filter(F.col("rule").contains("in sessions"))
    ).unionByName(by_query)


@query("interarrivals_hot", ORACLES["interarrivals"])
def _(spark, sf_dir):
    """Keys of more than five rows go the way of hot keys."""
    return groups.interarrivals(testlog.queries(spark, sf_dir), hot_rows=5).drop("text_key")


@query("group_report_hot", ORACLES["group_report"])
def _(spark, sf_dir):
    return _rounded(groups.group_report(testlog.queries(spark, sf_dir), hot_rows=5).drop("text_key"))


@query("query_deltas_hot", ORACLES["query_deltas"])
def _(spark, sf_dir):
    deltas = sessions.query_deltas(testlog.queries(spark, sf_dir), hot_rows=5)
    return deltas.select("query_id", "user_id", _us("ts").alias("ts_us"), "delta_s")


@query(
    "fk_violations",
    f"""{_WITH_SESSIONS_8H} SELECT 'queries.user_id in users.user_id' AS rule, user_id::VARCHAR AS value, count(*) AS n_rows
    FROM q WHERE user_id NOT IN (SELECT s_suppkey FROM supplier) GROUP BY user_id
    UNION ALL SELECT 'sessions.user_id in users.user_id', user_id::VARCHAR, count(*)
    FROM sn WHERE user_id NOT IN (SELECT s_suppkey FROM supplier) GROUP BY user_id""",
)
def _(spark, sf_dir):
    rows = testlog.queries(spark, sf_dir)
    suppliers = testlog.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("user_id"))
    tables = {"users": suppliers, "queries": rows, "sessions": sessions.sessionize(rows, gap_s=_HOUR8)}
    return fk_violations(tables)


@query(
    "json_sink",
    f"WITH {QUERIES_SQL} SELECT query_id, text, search_type, user_id FROM q",
)
def _(spark, sf_dir):
    path = scratch_path(spark, "json_sink")
    rows = testlog.queries(spark, sf_dir).select("query_id", "text", "search_type", "user_id")
    store.json_sink(rows, path, max_records_per_file=1000)
    return spark.read.schema(rows.schema).json(path)


_DOCUMENT = (
    "user_id bigint, name string, session bigint, start_us bigint, n_queries bigint, query_id bigint, time_us bigint, "
    "delta double, text string"
)


@query(
    "users_json",
    f"""{_WITH_SESSIONS_8H}, {USERS_SQL}
    SELECT 'user' AS kind, user_id, name, NULL::BIGINT AS session, NULL::BIGINT AS start_us, NULL::BIGINT AS n_queries,
           NULL::BIGINT AS query_id, NULL::BIGINT AS time_us, NULL::DOUBLE AS delta, NULL::VARCHAR AS text FROM u
    UNION ALL SELECT 'session', user_id, name, session_seq, start_us, n_queries, NULL, NULL, NULL, NULL
    FROM ss JOIN u USING (user_id)
    UNION ALL SELECT 'query', user_id, NULL, session_seq, NULL, NULL, query_id, ts_us, coalesce(gap_us, 0) / 1e6, text
    FROM s JOIN u USING (user_id)""",
)
def _(spark, sf_dir):
    documents = store.users_json(testlog.users(spark, sf_dir), testlog.queries(spark, sf_dir), gap_s=_HOUR8)
    return documents.select("kind", F.from_json("json", _DOCUMENT).alias("d")).select("kind", "d.*")


_STORED = "text string, is_interactive boolean, is_suspicious boolean, execution_time double, search_type string"


@query(
    "users_json_verbose",
    f"""WITH {QUERIES_SQL}, {USERS_SQL}
    SELECT 'user' AS kind, user_id, name, NULL::BIGINT AS query_id, NULL::BIGINT AS time_us, NULL::VARCHAR AS text,
           NULL::BOOLEAN AS is_interactive, NULL::BOOLEAN AS is_suspicious, NULL::DOUBLE AS execution_time,
           NULL::VARCHAR AS search_type FROM u
    UNION ALL SELECT 'query', user_id, NULL, query_id, ts_us, text, is_interactive, is_suspicious, execution_time, search_type
    FROM q JOIN u USING (user_id)""",
)
def _(spark, sf_dir):
    documents = store.users_json_verbose(testlog.users(spark, sf_dir), testlog.queries(spark, sf_dir))
    layout = f"user_id bigint, name string, query_id bigint, time_us bigint, {_STORED}"
    return documents.select("kind", F.from_json("json", layout).alias("d")).select("kind", "d.*")


@query(
    "audit_to_log_2014",
    f"""WITH {AUDIT_SQL},
    f AS (SELECT *, CASE WHEN coalesce(id, '') LIKE 'DM_%' OR coalesce(saved, '') LIKE '_ACCELERATE_DM%'
             THEN 'dm_acceleration' WHEN search_id LIKE 'scheduler%' THEN 'scheduled'
             WHEN search_id LIKE 'subsearch%' THEN 'subsearch' WHEN search_id LIKE 'SummaryDirector%'
             THEN 'summary_director' ELSE 'adhoc' END AS search_type
          FROM a WHERE case_id <> 'main_1' AND search_id IS NOT NULL),
    g2 AS (SELECT search_id, min(ts_us) AS ts_us, max(value) AS total_run_time,
             first(user_name ORDER BY ts, event_id) FILTER (user_name IS NOT NULL) AS "user",
             first(search ORDER BY ts, event_id) AS search, first(case_id ORDER BY ts, event_id) AS case_id,
             first(search_type ORDER BY ts, event_id) AS search_type,
             first(is_realtime ORDER BY ts, event_id) AS is_realtime,
             first(et ORDER BY ts, event_id) FILTER (et IS NOT NULL) AS et, last(lt ORDER BY ts, event_id) AS lt,
             coalesce(string_agg(DISTINCT saved, chr(10) ORDER BY saved), '') AS savedsearch_name
           FROM f GROUP BY search_id)
    SELECT case_id, search_type, is_realtime, search_id, "user", search, savedsearch_name, et::VARCHAR AS search_et,
           lt::VARCHAR AS search_lt, (lt - et)::DOUBLE AS "range", total_run_time, ts_us
    FROM g2 WHERE search_type NOT IN ('subsearch', 'summary_director', 'dm_acceleration')
      AND search NOT LIKE '%\\_internal%' ESCAPE '\\' AND search NOT LIKE '%\\_audit%' ESCAPE '\\'""",
)
def _(spark, sf_dir):
    log = audit.audit_to_log_2014(testlog.audit_events(spark, sf_dir), testlog.sysinfo(spark, sf_dir))
    return log.withColumn("ts_us", _us("_time")).drop("_time")


@query(
    "audit_to_log_2012",
    f"""WITH {AUDIT_SQL},
    g2 AS (SELECT coalesce(search_id, id) AS search_id, min(ts_us) AS ts_us, max(value) AS total_run_time,
             first(user_name ORDER BY ts, event_id) FILTER (user_name IS NOT NULL) AS "user",
             first(search ORDER BY ts, event_id) AS search,
             coalesce(string_agg(DISTINCT et::VARCHAR, chr(10) ORDER BY et::VARCHAR), '') AS search_et,
             string_agg(DISTINCT lt::VARCHAR, chr(10) ORDER BY lt::VARCHAR) AS search_lt,
             CASE WHEN count(DISTINCT et) = 1 AND count(DISTINCT lt) = 1 THEN (max(lt) - max(et))::DOUBLE END AS "range"
           FROM a WHERE coalesce(search_id, id) IS NOT NULL GROUP BY 1),
    ty AS (SELECT *, CASE WHEN search_id LIKE '13%.%' THEN 'historical' WHEN search_id LIKE 'rt_%' THEN 'realtime'
             WHEN search_id LIKE 'scheduler__%' THEN 'scheduled' WHEN search_id LIKE 'subsearch_%' THEN 'subsearch'
             WHEN search_id LIKE 'remote_%' THEN 'remote' WHEN search_id LIKE '%search%' THEN 'other' END AS searchtype
           FROM g2)
    SELECT searchtype, "range", search_lt, search_et, search, search_id, "user", total_run_time, ts_us
    FROM ty WHERE searchtype <> 'subsearch' AND (search LIKE 'search%' OR search LIKE 'rtsearch%')
      AND search NOT LIKE '%\\_internal%' ESCAPE '\\' AND search NOT LIKE '%\\_audit%' ESCAPE '\\'""",
)
def _(spark, sf_dir):
    return audit.audit_to_log_2012(testlog.audit_events(spark, sf_dir)).withColumn("ts_us", _us("_time")).drop("_time")


# --- Stored layouts ---------------------------------------------------------------------------------------------------


def _clustered(spark: SparkSession, rows: DataFrame, name: str, root: str) -> clustered.Clustered:
    """A clustered table in several buckets, with the users of more than 70 rows out of them."""
    return clustered.write_clustered(rows, root, name, hot_rows=70, rows_per_file=1000)


@query(
    "clustered_reads",
    f"""{_WITH_SESSIONS_8H}
    SELECT 'query' AS kind, user_id, query_id AS id, ts_us, text FROM q WHERE user_id IN (7, 8)
    UNION ALL SELECT 'session', user_id, session_id, start_us, NULL FROM sn WHERE user_id IN (7, 8)
    UNION ALL SELECT 'in session', s.user_id, query_id, ts_us, text FROM s JOIN sn USING (user_id, session_seq)
    WHERE session_id IN (5, 600)""",
)
def _(spark, sf_dir):
    """Reads of single users and sessions from clustered tables."""
    root, rows = scratch_path(spark, "clustered"), testlog.queries(spark, sf_dir)
    found = sessions.sessionize(rows, gap_s=_HOUR8)
    stored_sessions = _clustered(spark, sessions.number_sessions(found), "sessions", root)
    stored = _clustered(spark, sessions.queries_with_session(rows, gap_s=_HOUR8), "queries", root)

    def shown(kind: str, df: DataFrame, id_column: str, ts: str, text: Column) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), "user_id", F.col(id_column).alias("id"), _us(ts).alias("ts_us"), text.alias("text"))

    none, parts = F.lit(None).cast("string"), []
    for user in (7, 8):
        parts.append(shown("query", clustered.queries_of_user(stored, user), "query_id", "ts", F.col("text")))
        parts.append(shown("session", clustered.sessions_of_user(stored_sessions, user), "session_id", "start_ts", none))
    for session in (5, 600):
        in_session = clustered.queries_in_session(stored, stored_sessions, session)
        parts.append(shown("in session", in_session, "query_id", "ts", F.col("text")))
    return reduce(DataFrame.unionByName, parts)


@query("clustered_sessions", ORACLES["sessionize_8h"])
def _(spark, sf_dir):
    stored = _clustered(spark, testlog.queries(spark, sf_dir), "queries", scratch_path(spark, "clustered"))
    return _session_columns(clustered.sessions_of(stored, gap_s=_HOUR8))


@query("clustered_deltas", ORACLES["query_deltas"])
def _(spark, sf_dir):
    stored = _clustered(spark, testlog.queries(spark, sf_dir), "queries", scratch_path(spark, "clustered"))
    return clustered.query_deltas(stored).select("query_id", "user_id", _us("ts").alias("ts_us"), "delta_s")


@query("stages_once_per_text", ORACLES["stages"])
def _(spark, sf_dir):
    return stages.once_per_text(testlog.queries(spark, sf_dir), stages.stages)


@query(
    "text_dictionary",
    f"""{_TEXTS.replace(QUERIES_SQL, testlog.TEXT_QUERIES_SQL)} SELECT query_id, {_STAGE} FROM q JOIN st USING (text)
    WHERE command IN ('stats', 'eval', 'the')""",
)
def _(spark, sf_dir):
    """The stages of some commands, from a dictionary that was filled by two loads with texts in common."""
    rows, root = testlog.text_queries(spark, sf_dir), scratch_path(spark, "dictionary")
    dictionary.initialize_dictionary(spark, root)
    dictionary.load_texts(rows.filter(F.col("user_id") < 25), root)
    dictionary.load_texts(rows, root)
    return dictionary.stages_of_queries(rows, root, ["stats", "eval", "the"])


@query("read_csv_layout", ORACLES["read_csv_log"])
def _(spark, sf_dir):
    """Files of a declared layout, in splits."""
    path = scratch_path(spark, "csv_log")
    _write_csv(testlog.export_2014(spark, sf_dir), path)
    return _log_columns(readers.read_csv_log(spark, path, multi_line=False, layout="format_2014"))


@query("read_json_arrays", f"WITH {EXPORT_SQL} SELECT {_JSON_LOG.replace('text', f'{_BRACED_SQL} AS text')} FROM x")
def _(spark, sf_dir):
    """Files that are one array each, with braces and quotes in texts, read in splits."""
    path = scratch_path(spark, "json_arrays")
    braced = F.regexp_replace("search", "(?<=\\S) \\| ", ' | "},{" ')
    store.json_array_sink(testlog.export_2012(spark, sf_dir).withColumn("search", braced), path)
    return _json_columns(readers.read_json_log(spark, path, pattern="part-*"))


# --- Loads that add, and streams --------------------------------------------------------------------------------------

# The first load takes two thirds of the log, the second one the rest and some of the first again.
_FIRST, _SECOND = "event_id % 3 <> 0", "event_id % 3 <> 1"


def _loads(spark: SparkSession, sf_dir: str, first: str, second: str, append: Callable) -> str:
    """Tables filled by two loads of parts of the log, with one more step after each."""
    root, export = scratch_path(spark, "loads"), testlog.export_2014(spark, sf_dir)
    number = F.substring_index("search_id", "_", -1).cast("long")
    export = export.withColumn("event_id", number)
    incremental.initialize(spark, root)
    for part in (first, second):
        log = readers.normalize_log(export.filter(part).drop("event_id"), "format_2014")
        incremental.append_base(spark, log, root)
        append(spark, root)
    return root


def _loads_sql(first: str) -> str:
    return f"""WITH {EXPORT_SQL},
lx AS (SELECT *, CASE WHEN {first} THEN 1 ELSE 2 END AS load FROM x),
lu AS (SELECT name, case_id, min(load) AS load FROM lx GROUP BY name, case_id),
un AS (SELECT name, case_id, CAST(row_number() OVER (ORDER BY load, name, case_id) AS BIGINT) AS user_id FROM lu),
q AS (SELECT CAST(row_number() OVER (ORDER BY load, user_id, ts_us, text, event_id) AS BIGINT) AS query_id, user_id, text,
             ts_us, is_interactive, load FROM lx JOIN un USING (name, case_id)),
f AS (SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY user_id ORDER BY ts_us, query_id) AS gap_us
      FROM q WHERE is_interactive AND load = 1),
fs AS (SELECT *, count(*) FILTER (gap_us > 1800000000) OVER (PARTITION BY user_id ORDER BY ts_us, query_id
              ROWS UNBOUNDED PRECEDING) AS seq FROM f),
fi AS (SELECT user_id, seq, row_number() OVER (ORDER BY user_id, seq) - 1 AS id FROM (SELECT DISTINCT user_id, seq FROM fs)),
old AS (SELECT query_id, id FROM fs JOIN fi USING (user_id, seq)),
{_sessions_sql(1800 * 10**6, "is_interactive").lstrip()},
k AS (SELECT user_id, session_seq, min(id) AS id FROM s LEFT JOIN old USING (query_id) GROUP BY user_id, session_seq),
ids AS (SELECT user_id, session_seq, CASE WHEN id IS NULL THEN
          (SELECT count(*) FROM fi) + row_number() OVER (PARTITION BY id IS NULL ORDER BY user_id, session_seq) - 1
        ELSE id END AS session_id FROM k)"""


@query(
    "two_loads",
    f"""{_loads_sql(_FIRST)}
    SELECT query_id, user_id, text, ts_us, session_id FROM q LEFT JOIN s USING (query_id, user_id, text, ts_us)
    LEFT JOIN ids USING (user_id, session_seq)""",
)
def _(spark, sf_dir):
    """Queries with their ids and sessions after two loads that overlap in time, users and rows."""
    root = _loads(spark, sf_dir, _FIRST, _SECOND, incremental.append_sessions)
    placed = incremental.query_sessions(spark, root).drop("user_id")
    found = incremental.queries(spark, root).join(placed, "query_id", "left")
    return found.select("query_id", "user_id", "text", _us("ts").alias("ts_us"), "session_id")


@query(
    "two_loads_sessions",
    f"""{_loads_sql(_FIRST)} SELECT session_id, user_id, session_seq, start_us, end_us, duration_s, n_queries
    FROM ss JOIN ids USING (user_id, session_seq)""",
)
def _(spark, sf_dir):
    found = incremental.sessions(spark, _loads(spark, sf_dir, _FIRST, _SECOND, incremental.append_sessions))
    return _session_columns(found.drop("session_id")).join(found.select("user_id", "session_seq", "session_id"), ["user_id", "session_seq"])


@query(
    "two_loads_unique_stages",
    f"""{_loads_sql("event_id % 10 < 4")}, {_texts_sql("SELECT text FROM q")},
    a AS (SELECT query_id, {_STAGE}, row_number() OVER (PARTITION BY stage_key ORDER BY query_id, position) AS n
          FROM q JOIN st USING (text)),
    b AS (SELECT * EXCLUDE (n), query_id || '.' || (row_number() OVER (PARTITION BY query_id ORDER BY position) - 1) AS stage_id
          FROM a WHERE n = 1)
    SELECT stage_id, query_id, {_STAGE} FROM b""",
)
def _(spark, sf_dir):
    root = _loads(spark, sf_dir, "event_id % 10 < 4", "event_id >= 0", incremental.append_unique_stages)
    return incremental.unique_stages(spark, root)


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as a stream of files."""
    path = scratch_path(spark, "stream")
    rows = testlog.queries(spark, sf_dir)
    rows.write.parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


def _streamed(spark: SparkSession, found: DataFrame) -> DataFrame:
    out = scratch_path(spark, "stream-out")
    run_available(found, out, scratch_path(spark, "stream-state"))
    return spark.read.schema(found.schema).parquet(out)


# What is given out is what the watermark, an hour before the last query in whole milliseconds, leaves behind.
_WATERMARK = f"(SELECT max(ts_us) // 1000 * 1000 - CAST(3600000000 AS BIGINT) FROM q WHERE {_CLEAN})"


@query(
    "stream_sessions",
    f"""{_WITH_SESSIONS_30M} SELECT user_id, start_us, end_us, duration_s, n_queries FROM ss
    WHERE end_us + 1800000000 <= {_WATERMARK}""",
)
def _(spark, sf_dir):
    found = _streamed(spark, stream_sessions(_stream(spark, sf_dir)))
    return found.select("user_id", _us("start_ts").alias("start_us"), _us("end_ts").alias("end_us"), "duration_s", "n_queries")


@query(
    "stream_deltas",
    f"""{_WITH_SESSIONS_30M} SELECT query_id, user_id, ts_us, coalesce(gap_us, 0) / 1e6 AS delta_s FROM s
    WHERE ts_us < {_WATERMARK}""",
)
def _(spark, sf_dir):
    return _streamed(spark, stream_deltas(_stream(spark, sf_dir)))


# --- Dense times ------------------------------------------------------------------------------------------------------
# The events of a user lie hours apart. With a clock that runs 600 times faster, sessions hold many queries and intervals
# fill the histogram.

_SLOW, _FAST = "epoch_us(ts) AS ts_us", f"{testlog.EPOCH_US} + (epoch_us(ts) - {testlog.EPOCH_US}) // 600 AS ts_us"
_DENSE = [
    "session_stats", "sessionize_30m", "sessionize_uncleaned", "query_deltas", "queries_with_session", "sessions_multi",
    "users_with_sessions", "interarrivals", "group_entropy", "group_consistency", "group_clockness", "group_report",
    "user_interarrivals", "interarrival_counts", "interarrival_hist",
]


def _dense(function: Query) -> Query:
    return lambda spark, sf_dir: function(spark, testlog.dense_tables(spark, sf_dir, 600))


for _name in _DENSE:
    assert _SLOW in ORACLES[_name]
    query(f"{_name}_dense", ORACLES[_name].replace(_SLOW, _FAST))(_dense(QUERIES[_name]))


# --- Texts of every kind ----------------------------------------------------------------------------------------------

_OF_TEXTS = {
    "tokens": stages.query_tokens,
    "stage_split": stages.query_splits,
    "commands": stages.query_commands,
    "categories": stages.query_categories,
    "stages": stages.stages,
    "command_counts": stages.command_counts,
    "eval_stages": stages.eval_stages,
    "unique_stages": stages.unique_stages,
}


def _of_texts(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(testlog.text_queries(spark, sf_dir))


for _name, _operator in _OF_TEXTS.items():
    query(f"{_name}_of_texts", ORACLES[_name].replace(QUERIES_SQL, testlog.TEXT_QUERIES_SQL))(_of_texts(_operator))
