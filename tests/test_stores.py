"""Clustered tables, the text dictionary, declared CSV layouts and split JSON arrays."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import brute
from searchlog import schemas
from searchlog.operators import sessions, stages
from searchlog.runtime import scratch_path
from searchlog.sources import clustered, dictionary, readers, store


@pytest.fixture()
def buckets_shown(spark):
    """A scan tells of its buckets in the plan only if it is planned by bucket; it skips the others in any case."""
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", False)
    yield
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    df.collect()
    return plan_of(df).split("Initial Plan")[0]


def _log(spark, seed=1, users=30, rows=600):
    rng = random.Random(seed)
    log = []
    for q in range(rows):
        user = 3 if rng.random() < 0.4 else rng.choice([None, *range(users)])
        log.append((q, rng.choice("abc"), rng.randrange(100_000), rng.random() < 0.9, rng.random() < 0.1, user))
    return log, schemas.conform(brute.log_frame(spark, log), schemas.QUERIES)


@pytest.fixture(scope="module")
def stored(spark):
    """A log with one very frequent user, sessions included, in both tables."""
    log, rows = _log(spark)
    root = scratch_path(spark, "clustered")
    numbered = sessions.queries_with_session(rows)
    queries = clustered.write_clustered(numbered, root, "queries", hot_rows=100, rows_per_file=60)
    found = sessions.number_sessions(sessions.sessionize(rows))
    return log, root, queries, clustered.write_clustered(found, root, "sessions", hot_rows=40, rows_per_file=50)


def test_clustered_parts(spark, stored):
    log, root, queries, _ = stored
    assert queries.cold.count() + queries.hot.count() == len(log)
    assert [r.user_id for r in queries.hot.select("user_id").distinct().collect()] == [3]
    again = clustered.read_clustered(spark, root, "queries")
    assert Counter(map(tuple, again.rows().collect())) == Counter(map(tuple, queries.rows().collect()))


def test_clustered_reads_open_one_bucket(spark, stored, buckets_shown):
    log, _, queries, found = stored
    for user in (3, 5, 999):
        read = clustered.queries_of_user(queries, user)
        assert sorted(r.query_id for r in read.collect()) == [r[0] for r in log if r[5] == user]
        assert "SelectedBucketsCount: 1 out of" in plan_of(read)
        assert "SelectedBucketsCount: 1 out of" in plan_of(clustered.sessions_of_user(found, user))
    by_session = {}
    for row in queries.rows().filter("session_id IS NOT NULL").collect():
        by_session.setdefault(row.session_id, []).append(row.query_id)
    for session in (0, max(by_session)):
        read = clustered.queries_in_session(queries, found, session)
        assert sorted(r.query_id for r in read.collect()) == sorted(by_session[session])
        assert "SelectedBucketsCount: 1 out of" in plan_of(read)
    assert clustered.queries_in_session(queries, found, -5).collect() == []


def test_clustered_windows_need_no_shuffle(spark, stored):
    log, _, queries, _ = stored
    assert "Exchange" not in final_plan(sessions.sessionize(queries.cold))
    assert "Exchange" not in final_plan(sessions.session_deltas(queries.cold))
    expected = brute.session_of_query(log)
    deltas = {r.query_id: round(r.delta_s * 1e6) for r in clustered.query_deltas(queries).collect()}
    assert deltas == {q: delta for q, (_, _, delta) in expected.items()}
    sizes = Counter((user, seq) for user, seq, _ in expected.values())
    found = clustered.sessions_of(queries).collect()
    assert {(r.user_id, r.session_seq): r.n_queries for r in found} == sizes and len(found) == len(sizes)


def test_clustered_files_are_written_several_by_a_task(spark):
    """Every task reports to the driver; small files must not make many of them."""
    rows = 6000
    log = spark.range(rows).select(
        (F.col("id") + 1).alias("query_id"),
        F.lit("a").alias("text"),
        F.timestamp_seconds(F.col("id")).alias("ts"),
        F.lit(True).alias("is_interactive"),
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 1999).cast("long").alias("user_id"),
    )
    table = clustered.write_clustered(log, scratch_path(spark, "clustered"), "queries", hot_rows=1000, rows_per_file=20)
    for part, files in ((table.cold, rows // 20), (table.hot, rows // 3 // 20)):
        by_file = part.groupBy(F.input_file_name().alias("file")).agg(
            F.count("*").alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.count_distinct("user_id").alias("users")
        )
        found = by_file.orderBy("lo").collect()
        # The name of a file begins with the number of its task.
        tasks = {r.file.rsplit("/", 1)[1].split("-")[1] for r in found}
        assert len(tasks) <= 8 < len(found) and files * 0.7 <= len(found) <= files * 1.2
    assert max(r.n for r in found) <= 20 and all(a.hi < b.lo for a, b in zip(found, found[1:]))
    buckets = table.cold.select("user_id", F.input_file_name().alias("file")).distinct().groupBy("user_id").count()
    assert buckets.filter("count > 1").isEmpty()
    assert Counter(r.query_id for r in table.rows().collect()) == Counter(range(1, rows + 1))
    alone = clustered.Clustered(table.cold, table.hot.limit(0), table.tasks)
    for read in (clustered.query_deltas(alone), clustered.sessions_of(alone)):
        assert len({r.task for r in read.select(F.spark_partition_id().alias("task")).distinct().collect()}) <= 8


def test_empty_clustered_table(spark):
    empty = spark.createDataFrame([], schemas.QUERIES)
    table = clustered.write_clustered(empty, scratch_path(spark, "clustered"), "queries")
    assert table.rows().count() == clustered.queries_of_user(table, 1).count() == clustered.sessions_of(table).count() == 0


# --- Dictionary ---

TEXTS = ["search a | stats count", "search b | head 5", "| inputlookup x [search y | stats c]", "broken [ text", "`m` | mycmd", None]


def _repeated(spark, texts, copies):
    rows = [(n * 10_000 + i, t) for n, t in enumerate(texts) for i in range(copies)]
    return spark.createDataFrame(rows, "query_id long, text string")


def test_every_text_is_parsed_once(spark):
    queries = _repeated(spark, TEXTS, 1000)
    for operator in (stages.stages, stages.query_tokens, stages.query_commands, stages.query_splits, stages.query_categories):
        once, each = stages.once_per_text(queries, operator), operator(queries)
        assert once.columns == each.columns and once.exceptAll(each).isEmpty() and each.exceptAll(once).isEmpty()
    # What takes texts apart stands above their aggregation, whose rows are the distinct texts.
    plan = plan_of(stages.once_per_text(queries, stages.stages))
    assert plan.index("Generate") < plan.index("Aggregate(") and plan.count("Generate") == 1
    assert stages.texts_of(queries).count() == 5


def test_dictionary_loads(spark):
    root = scratch_path(spark, "dictionary")
    dictionary.initialize_dictionary(spark, root)
    assert dictionary.texts(spark, root).count() == dictionary.text_stages(spark, root).count() == 0
    first, second = _repeated(spark, TEXTS[:3], 4), _repeated(spark, TEXTS, 3)
    assert dictionary.load_texts(first, root) == 1
    dictionary.load_texts(second, root)
    loads = {r.load: r["count"] for r in dictionary.texts(spark, root).groupBy("load").count().collect()}
    assert loads == {1: 3, 2: 2}  # the second load takes only new texts apart
    both = first.union(second)
    found, expected = dictionary.stages_of_queries(both, root), stages.stages(both)
    assert found.exceptAll(expected).isEmpty() and expected.exceptAll(found).isEmpty()


def test_dictionary_reads_only_the_folders_of_the_commands(spark):
    root = scratch_path(spark, "dictionary")
    dictionary.initialize_dictionary(spark, root)
    queries = _repeated(spark, TEXTS, 2)
    dictionary.load_texts(queries, root)
    for commands in (["stats"], ["STATS", "mycmd"], ["`m`"], ["nothing"], []):
        found = dictionary.stages_of_queries(queries, root, commands)
        expected = stages.stages_by_command(stages.stages(queries), [c.lower() for c in commands] or ["-"])
        assert found.exceptAll(expected).isEmpty() and expected.exceptAll(found).isEmpty()
    plan = plan_of(dictionary.text_stages(spark, root, ["stats"]))
    assert "command_group" in plan.split("PartitionFilters: [")[1].split("]")[0]
    folders = {r.command_group for r in dictionary._read(spark, root, "text_stages", dictionary.TEXT_STAGES).collect()}
    assert {"stats", "search", "MACRO", "EXTERNAL_COMMAND"} <= folders and "mycmd" not in folders


def test_a_load_that_failed_is_written_again(spark):
    root = scratch_path(spark, "dictionary")
    dictionary.initialize_dictionary(spark, root)
    queries = _repeated(spark, TEXTS, 2)
    stray = dictionary.text_stages(spark, root)
    stray = spark.createDataFrame([(bytearray(b"x"), 0, 0, "stats", "COMMAND", "", "stats", "stats")], stray.schema)
    path = dictionary._folder(root, "text_stages", 1)
    stray.withColumn("command_group", F.lit("stats")).write.partitionBy("command_group").parquet(path)
    assert dictionary.text_stages(spark, root).count() == 0  # stages without the texts that are written last
    dictionary.load_texts(queries, root)
    assert dictionary.text_stages(spark, root).filter(F.col("text_key") == b"x").count() == 0


# --- CSV by layout ---

HEADER = ",".join(readers.CSV_LAYOUTS["format_2014"])


def _csv(path, header, rows):
    path.parent.mkdir(exist_ok=True, parents=True)
    path.write_text("\n".join([header, *rows]) + "\n")


def test_declared_layout_is_one_scan_that_checks_headers(spark, tmp_path):
    row = "c1,adhoc,false,{},ann,search a,,1,2,1,0.5,2014-02-03T09:10:11.120-0800"
    for name in ("a", "b"):
        _csv(tmp_path / f"log/{name}.csv", HEADER, [row.format(i) for i in range(500)])
    log = readers.read_csv_log(spark, str(tmp_path / "log"), multi_line=False, layout="format_2014")
    assert log.rows.count() == 1000 and log.rejects.count() == 0
    assert plan_of(log.rows).count("FileScan csv") == 1
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        split = readers.read_csv(spark, str(tmp_path / "log"), multi_line=False, layout="format_2014")
        assert split.rdd.getNumPartitions() > 8 and split.select("search_id").distinct().count() == 500
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    _csv(tmp_path / "log/c.csv", ",".join(readers.CSV_LAYOUTS["format_2013"]), ["historical,60,160,100,search a,1.1,ann,3.25,x"])
    with pytest.raises(Exception, match="(?i)header"):
        readers.read_csv_log(spark, str(tmp_path / "log"), layout="format_2014").rows.collect()


def test_headers_of_mixed_layouts_in_one_scan(spark, tmp_path):
    _csv(tmp_path / "log/a.csv", HEADER, ["c1,adhoc,false,1,ann,search a,,1,2,1,0.5,2014-02-03T09:10:11.120-0800"] * 3)
    _csv(tmp_path / "log/x/b.csv", "﻿User,_time,extra,search", ['bob,2014-02-03T09:10:12.120-0800,?,"x\ny ""z"""'])
    _csv(tmp_path / "log/c.csv", ",".join(f"n{i}" for i in range(100)), [",".join("v" * 100)])
    _csv(tmp_path / "log/only_header.csv", HEADER, [])
    (tmp_path / "log/empty.csv").write_text("")
    raw = readers.read_csv(spark, str(tmp_path / "log"))
    assert raw.columns == readers.CSV_FIELDS and plan_of(raw).count("FileScan csv") == 1
    rows = Counter((r.user, r.search, r.case_id) for r in raw.collect())
    assert rows == {("ann", "search a", "c1"): 3, ("bob", 'x\ny "z"', None): 1, (None, None, None): 1}
    named = readers.read_csv(spark, str(tmp_path / "log"), fields=["extra", "n63"])
    assert Counter((r.extra, r.n63) for r in named.collect()) == {(None, None): 3, ("?", None): 1, (None, "v"): 1}


# --- JSON arrays ---


def test_json_arrays_in_splits(spark, tmp_path):
    """Texts with braces, quotes, escapes and what looks like the border of two records."""
    rng = random.Random(5)
    bits = ["a", "}", "{", '"', "\\", ",", '},{"search":', "[", "]", " ", "\n", "é", '"}', "x=1"]
    records = []
    for n in range(3):
        some = [
            {k: "".join(rng.choices(bits, k=rng.randrange(12))) for k in rng.sample(readers.JSON_FIELDS, rng.randrange(1, 8))}
            for _ in range(800)
        ]
        (tmp_path / f"{n}.json").write_text(json.dumps(some, indent=(None, 4, 0)[n], ensure_ascii=n == 1))
        records += some
    (tmp_path / "none.json").write_text("[\n]\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10k")
    try:
        rows = readers.read_json(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 10
        found = Counter(map(tuple, rows.collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found == Counter(tuple(r.get(k) for k in readers.JSON_FIELDS) for r in records)


def test_json_array_sink(spark, tmp_path):
    rows = spark.range(25).select(F.col("id").cast("string").alias("search_id"), F.lit('a } "b"').alias("search"))
    store.json_array_sink(rows.repartition(3), str(tmp_path / "out"))
    files = [json.loads(f.read_text()) for f in (tmp_path / "out").glob("part-*")]
    assert sorted(int(r["search_id"]) for f in files for r in f) == list(range(25))
    again = readers.read_json(spark, str(tmp_path / "out"), pattern="part-*")
    assert {(r.search_id, r.search) for r in again.collect()} == {(str(n), 'a } "b"') for n in range(25)}
