import json

import pytest
from pyspark.sql import functions as F

from searchlog import schemas
from searchlog.functions import normalize
from searchlog.operators import select, sessions
from searchlog.operators.ids import with_sequential_ids
from searchlog.operators.integrity import fk_violations
from searchlog.plans import testlog
from searchlog.runtime import scratch_root
from searchlog.sources import audit, readers, store

CSV_2014 = """case_id,search_type,is_realtime,search_id,user,search,savedsearch_name,search_et,search_lt,range,total_run_time,_time
c1,adhoc,false,1.1,ann,"  search a, b | stats count ",,N/A,N/A,,0.75,2014-02-03T09:10:11.120-0800
c1,scheduled,true,1.2,ann,"search ""quoted"" | head",saved,100,160,60,1.5f,2014-02-03T09:12:11.120-0800
c2,adhoc,maybe,1.3,ann,search c,,1e2,160.5,60.5,2,2014-02-03T10:00:00.000-0800
c2,adhoc,false,1.4,,search d,,,,,,2014-02-03T11:00:00.000-0800
"""

CSV_2013 = """searchtype,range,search_lt,search_et,search,search_id,user,total_run_time,_time
searchtype,range,search_lt,search_et,search,search_id,ann,total_run_time,_time
historical,60.000000000,160.000000000,100.000000000,search a,1.1,ann,3.25,2013-06-05T08:01:00.250-0700
scheduled,,N/A,100.000000000,search b,1.2,bob,4.50,2013-06-05T08:03:00.500-0700
"""

JSON_2012 = [
    {"$offset": "1", "search": " search a ", "searchtype": "historical", "_time": "2012-11-20T07:30:01.125-08:00",
     "user": "ann", "range": "60.0", "search_et": "N/A", "total_run_time": "1.5", "search_id": "x1"},
    {"$offset": "2", "search": "search b", "searchtype": "other", "_time": "2012-11-20T07:31:02.125-08:00", "user": "ann"},
    {"$offset": "3", "search": "search c", "searchtype": "other", "_time": "2012-11-20T07:31:02.125-08:00"},
    {"$offset": "4", "error": "failed", "user": "ann", "_time": "2012-11-20T07:31:02.125-08:00"},
]


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "csv/sub").mkdir(parents=True)
    (tmp_path / "csv/a.csv").write_text(CSV_2014)
    (tmp_path / "csv/sub/b.csv").write_text(CSV_2014.replace("ann", "cat"))
    (tmp_path / "csv/notes.txt").write_text("not a log")
    (tmp_path / "2013.csv").write_text(CSV_2013)
    (tmp_path / "2012.json").write_text(json.dumps(JSON_2012, indent=4))
    return tmp_path


def test_csv_2014(spark, folder):
    log = readers.read_csv_log(spark, str(folder / "csv/a.csv"))
    assert log.rejects.count() == 0
    a, b, c, d = log.rows.orderBy("splunk_search_id").collect()
    assert (a["text"], a.name, a.case_id, a.is_interactive) == ("search a, b | stats count", "ann", "c1", True)
    assert (a.execution_time, a.earliest_event, a.event_range, a.is_realtime) == (0.75, None, None, False)
    assert (b["text"], b.is_interactive, b.is_realtime, b.saved_search_name) == ('search "quoted" | head', False, True, "saved")
    assert (b.execution_time, b.earliest_event, b.latest_event, b.event_range) == (None, 100.0, 160.0, 60.0)
    assert (c.is_realtime, c.is_realtime_raw, c.earliest_event, c.latest_event) == (None, "maybe", 100.0, 160.5)
    assert d.name == ""
    first = log.rows.filter("splunk_search_id = '1.1'").select(F.unix_micros("ts")).first()[0]
    assert first == 1391447411_120000


def test_csv_2013_rejects_the_stray_header(spark, folder):
    log = readers.read_csv_log(spark, str(folder / "2013.csv"), "format_2013")
    assert [r.time_raw for r in log.rejects.collect()] == ["_time"]
    rows = log.rows.orderBy("splunk_search_id").collect()
    assert [(r.name, r.case_id, r.is_interactive, r.execution_time) for r in rows] == [
        ("ann", None, True, 3.25), ("bob", None, False, 4.5)
    ]


def test_json_2012_array(spark, folder):
    log = readers.read_json_log(spark, str(folder / "2012.json"))
    rows = log.rows.orderBy("ts").collect()
    assert [(r["text"], r.is_interactive, r.event_range) for r in rows] == [
        ("search a", True, 60.0), ("search b", False, None)
    ]
    assert log.rejects.count() == 1


def test_directory_merges_users_over_files(spark, folder):
    log = readers.read_csv_log(spark, str(folder / "csv"))
    assert log.rows.count() == 8
    names = sorted((r.name, r.case_id) for r in readers.user_identities(log.rows).collect())
    assert names == [("", "c2"), ("ann", "c1"), ("ann", "c2"), ("cat", "c1"), ("cat", "c2")]


def test_wall_clock_drops_the_offset(spark, folder):
    log = readers.read_csv_log(spark, str(folder / "csv/a.csv"), wall_clock=True)
    assert log.rows.agg(F.min(F.unix_micros("ts"))).first()[0] == (1391447411 - 8 * 3600) * 10**6 + 120000


def test_records(spark, folder):
    raw = readers.read_json(spark, str(folder / "2012.json"))
    pairs = readers.record_unpivot(raw)
    assert pairs.count() == sum(len(record) for record in JSON_2012)
    assert [r.value for r in readers.records_by_key(pairs, "error").collect()] == ["failed"]
    assert readers.records_by_key(pairs, "search").count() == 3
    with pytest.raises(ValueError):
        readers.records_by_key(pairs, "colour")
    inferred = readers.read_json(spark, str(folder / "2012.json"), schema=None)
    assert sorted(inferred.columns) == sorted({k for record in JSON_2012 for k in record})


def test_unknown_version(spark):
    with pytest.raises(ValueError):
        normalize.interactive_flag(F.lit("adhoc"), "format_1999")


@pytest.mark.parametrize(
    "raw,number",
    [("1", 1.0), (" 2.5 ", 2.5), ("1e3", 1000.0), ("-.5", -0.5), ("5.", 5.0), ("1.5f", None), ("2d", None), ("N/A", None),
     ("", None), ("0x10", None), ("inf", float("inf")), ("-Infinity", float("-inf"))],
)
def test_lenient_double(spark, raw, number):
    row = spark.createDataFrame([(raw,)], "raw string").select(normalize.lenient_double(F.col("raw")).alias("x")).first()
    assert row.x == number


@pytest.mark.parametrize("raw", ["\t a \n", " a ", "\x1ca\x1f", "a"])
def test_clean_text(spark, raw):
    row = spark.createDataFrame([(raw,)], "raw string").select(normalize.clean_text(F.col("raw")).alias("x")).first()
    assert row.x == raw.strip() == "a"


@pytest.mark.parametrize("raw,truth", [("TRUE", True), ("t", True), ("1", True), ("-0.5", True), ("0", False), ("f", False), (None, False)])
def test_truth_value(spark, raw, truth):
    row = spark.createDataFrame([(raw,)], "raw string").select(normalize.truth_value(F.col("raw")).alias("x")).first()
    assert row.x == truth


def test_sequential_ids_are_dense_and_ordered(spark):
    rows = spark.range(5000).select(((F.col("id") * 7919) % 5000).alias("k"), F.lit("x").alias("v"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = with_sequential_ids(rows, ["k"], "n", start=1)
        assert got.filter("n != k + 1").count() == 0
        assert got.select("n").distinct().count() == 5000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_load_base_sessions_and_stages(spark, folder, tmp_path):
    root, final = str(tmp_path / "tables"), str(tmp_path / "final")
    store.initialize_tables(spark, root)
    for name, schema in schemas.TABLES.items():
        assert store.read_table(spark, root, name).schema == schema
        assert store.read_table(spark, root, name).count() == 0
    base = store.load_base(readers.read_csv_log(spark, str(folder / "csv")), root)
    assert [r.user_id for r in base.users.orderBy("name", "case_id").collect()] == [1, 2, 3, 4, 5]
    assert sorted(r.query_id for r in base.queries.collect()) == list(range(1, 9))
    assert base.queries.filter("session_id is not null").count() == 0
    assert store.load_parsed(spark, root).count() == 12
    queries = store.load_sessions(spark, root, final)
    assert queries.filter("session_id is not null").count() == queries.filter("is_interactive").count() == 6
    tables = {n: store.read_table(spark, root, n) for n in ("users", "stages")}
    tables |= {"queries": queries, "sessions": store.read_table(spark, final, "sessions")}
    assert fk_violations(tables).count() == 0
    tables["users"] = tables["users"].filter("user_id > 1")
    found = {(r.rule, r.value, r.n_rows) for r in fk_violations(tables).collect()}
    assert ("queries.user_id in users.user_id", "1", 2) in found
    broken = {"queries": queries.withColumn("text", F.when(F.col("query_id") > 2, F.col("text")))}
    assert [(r.rule, r.n_rows) for r in fk_violations(broken).collect()] == [("queries.text not null", 2)]


def test_json_sink_rolls_files(spark, tmp_path):
    store.json_sink(spark.range(25).coalesce(1), str(tmp_path / "out"), max_records_per_file=10)
    files = sorted((tmp_path / "out").glob("*.json"))
    assert [len(f.read_text().splitlines()) for f in files] == [10, 10, 5]


def test_user_documents(spark):
    users = testlog.users(spark, "/root/testdata/sf0.001")
    queries = testlog.queries(spark, "/root/testdata/sf0.001")
    rows = [(r.kind, json.loads(r.json)) for r in store.users_json(users, queries).collect()]
    of = {kind: [d for k, d in rows if k == kind] for kind in ("user", "session", "query")}
    assert len(of["user"]) == users.count()
    assert len(of["query"]) == sessions.session_input(queries).count() == sum(d["n_queries"] for d in of["session"])
    assert {(d["user_id"], d["session"]) for d in of["query"]} == {(d["user_id"], d["session"]) for d in of["session"]}
    assert set(of["query"][0]) == {"user_id", "session", "query_id", "time_us", "delta", "text"}
    verbose = store.users_json_verbose(users, queries)
    assert verbose.filter("kind = 'query'").count() == queries.count()


@pytest.mark.parametrize("n", [10, 10_000])
def test_users_have_one_shape_at_every_size(spark, n):
    users = spark.createDataFrame([(3, "ann", "c", None), (4, "bob", "c", None)], schemas.USERS)
    rows = spark.range(n).select(
        F.col("id").alias("query_id"), F.lit("search a").alias("text"), F.timestamp_seconds(F.col("id") * 60).alias("ts"),
        F.lit(True).alias("is_interactive"), F.lit(3).cast("long").alias("user_id"),
    )
    queries = schemas.conform(rows, schemas.QUERIES)
    flat = select.users_with_queries(users, queries)
    assert flat.count() == n + 1 and flat.filter("user_id = 3").select("query_id").distinct().count() == n
    nested = select.users_with_sessions(users, queries)
    assert nested.columns == [*select.USER_COLUMNS, *select.SESSION_QUERY_COLUMNS]
    assert nested.groupBy("user_id", "session_seq").count().filter("user_id = 3").collect()[0]["count"] == n
    assert store.users_json(users, queries).groupBy("kind").count().collect()


def test_csv_files_keep_their_own_headers_and_line_breaks(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log/a.csv").write_text(
        'case_id,search_type,user,search,_time\nc1,adhoc,ann,"search a\n| head 5",2014-02-03T09:10:11.120-0800\n'
    )
    (tmp_path / "log/b.csv").write_text(
        "user,search,search_type,case_id,_time\nbob,,adhoc,c2,2014-02-03T09:10:12.120-0800\n"
        "bob,   ,adhoc,c2,2014-02-03T09:10:13.120-0800\n"
    )
    (tmp_path / "log/c.csv").write_text("search,case_id,_time\nsearch c,c3,2014-02-03T09:10:14.120-0800\n")
    log = readers.read_csv_log(spark, str(tmp_path / "log"))
    assert log.rejects.count() == 0
    found = [(r.name, r.case_id, r["text"]) for r in log.rows.orderBy("ts").collect()]
    # A layout without users has one user, whatever its cases; an empty text is a text.
    assert found == [("ann", "c1", "search a\n| head 5"), ("bob", "c2", ""), ("bob", "c2", ""), (None, None, "search c")]
    with pytest.raises(ValueError):
        readers.read_csv_log(spark, str(tmp_path / "log"), multi_line=False)
    split = readers.read_csv_log(spark, [str(tmp_path / "log/b.csv")], multi_line=False)
    assert split.rows.count() == 2


def test_marks_and_lists(spark):
    users = spark.createDataFrame([(1, "splunk-system-user", None, None), (2, "ann", None, "vip")], schemas.USERS)
    assert [r.user_type for r in select.mark_suspicious_users(users).orderBy("user_id").collect()] == ["suspicious", "vip"]
    rows = [(1, "x typeahead y", False), (2, "Typeahead", False), (3, "a", True), (4, None, None),
            (5, select.SUSPICIOUS_QUERIES[0], False)]
    queries = spark.createDataFrame(rows, "query_id long, text string, is_suspicious boolean")
    marked = select.mark_suspicious_queries(queries).orderBy("query_id").collect()
    assert [r.is_suspicious for r in marked] == [True, False, True, False, False]
    assert [r.query_id for r in select.blocklist(queries).collect()] == [5]
    assert select.blocklist(queries, keep=False).count() == 4
    listed = spark.createDataFrame([("a",), ("a",)], "text string")
    assert [r.query_id for r in select.blocklist(queries, listed).collect()] == [3]
    assert select.blocklist(queries, listed, keep=False).count() == 4


def test_query_types(spark):
    queries = spark.createDataFrame([(1, True), (2, False), (3, None)], "query_id long, is_interactive boolean")
    kinds = {k: sorted(r.query_id for r in select.queries_by_type(queries, k).collect()) for k in select.QUERY_TYPES}
    assert kinds == {"all": [1, 2, 3], "interactive": [1], "scheduled": [2]}
    with pytest.raises(ValueError):
        select.queries_by_type(queries, "weekly")


def test_flat_users_keep_those_without_queries(spark):
    users = spark.createDataFrame([(1, "a", None, None), (2, "b", None, None)], schemas.USERS)
    queries = spark.createDataFrame([(7, 1, True), (8, 1, None)], "query_id long, user_id long, is_interactive boolean")
    rows = select.users_with_queries(users, queries).collect()
    assert sorted((r.user_id, r.query_id or 0, r.in_interactive_list) for r in rows) == [
        (1, 7, True), (1, 8, False), (2, 0, None)
    ]


def test_jdbc_ranges():
    assert store.jdbc_partitions(1, 10, 4) == {"lowerBound": "1", "upperBound": "11", "numPartitions": "3"}
    assert store.jdbc_partitions(5, 5)["numPartitions"] == "1"


def test_scratch_root_follows_the_session(spark):
    assert scratch_root(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


AUDIT = (
    "_time timestamp, event_id long, index string, source string, action string, id string, search_id string, "
    "is_realtime string, user string, total_run_time string, savedsearch_name string, _raw string"
)


def _event(n, search_id, raw, **kw):
    from brute import at

    row = {"_time": at(n), "event_id": n, "index": "i6", "source": "/x/audit.log", "action": "search", "id": None,
           "search_id": search_id, "is_realtime": "0", "user": "ann", "total_run_time": "1.5", "savedsearch_name": None,
           "_raw": raw}
    return tuple({**row, **kw}.values())


def _raw(search, et="10", lt="70"):
    return f"search_et={et}, search_lt={lt}, is_realtime=0, search='{search}', autojoin='1'"


def test_audit_2014(spark):
    events = spark.createDataFrame(
        [
            _event(1, "'a1'", _raw("search x", et="20"), user="n/a"),
            _event(2, "'a1'", _raw("search later", lt="90"), total_run_time="9.5", savedsearch_name="s2"),
            _event(3, "'a1'", "no captures", savedsearch_name="s1"),
            _event(4, "rt_1", _raw("search y"), is_realtime="N/A"),
            _event(5, "'scheduler__a'", _raw("search z"), is_realtime="1"),
            _event(6, "'subsearch_1'", _raw("search z")),
            _event(7, "'a2'", _raw("search index=_INTERNAL")),
            _event(8, "'a3'", _raw("search z"), id="DM_1"),
            _event(9, "'a4'", _raw("search z"), index="i5"),
            _event(10, "'a5'", _raw("search z"), action="other"),
            _event(11, "'a6'", "never a text"),
        ],
        AUDIT,
    )
    sysinfo = spark.createDataFrame([("i6", "6.1"), ("i6", "6.0"), ("i5", "5.0")], "index string, splunk_version string")
    rows = {r.search_id: r for r in audit.audit_to_log_2014(events, sysinfo).collect()}
    assert set(rows) == {"a1", "rt_1", "scheduler__a"}
    a1 = rows["a1"]
    assert (a1.user, a1.search, a1.search_et, a1.search_lt, a1.range) == ("ann", "search x", "20", "90", 70.0)
    assert (a1.total_run_time, a1.savedsearch_name, a1.case_id, a1.search_type) == (9.5, "s1\ns2", "i6", "adhoc")
    assert (rows["rt_1"].is_realtime, rows["scheduler__a"].is_realtime, a1.is_realtime) == ("true", "true", "false")
    assert rows["scheduler__a"].search_type == "scheduled"
    assert audit.audit_to_log_2014(events, sysinfo, limit=2).count() == 2


def test_audit_2012(spark):
    events = spark.createDataFrame(
        [
            _event(1, None, _raw("search a"), id="'1330.5'"),
            _event(2, "rt_9", _raw("rtsearch b")),
            _event(3, "remote_x_search", _raw("search c", et="1")),
            _event(4, "remote_x_search", _raw("search c", et="2")),
            _event(5, "my_search_1", _raw("search d")),
            _event(6, "plain", _raw("search e")),
            _event(7, "subsearch_1", _raw("search f")),
            _event(8, "scheduler__q", _raw("| metadata")),
            _event(9, "1399.1", _raw("search _audit")),
        ],
        AUDIT,
    )
    rows = {r.search_id: r for r in audit.audit_to_log_2012(events).collect()}
    assert {k: r.searchtype for k, r in rows.items()} == {
        "1330.5": "historical", "rt_9": "realtime", "remote_x_search": "remote", "my_search_1": "other"
    }
    assert rows["remote_x_search"].search_et == "1\n2" and rows["remote_x_search"].range is None
    assert rows["rt_9"].range == 60.0
