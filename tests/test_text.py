import random
import time

import pytest
from pyspark.sql import functions as F

import brute
from searchlog.functions import text as tx
from searchlog.functions.taxonomy import COMMAND_CATEGORY, taxonomy
from searchlog.operators import select, stages

SAMPLES = [
    "search index=web status=500 | stats count by host",
    "| inputlookup assets | join host [search index=inv | dedup host] | sort owner",
    'typeahead prefix="src" count="50"',
    'search `prod_idx` "a|b" | rex "code=(?<code>[0-9]+)" | top code',
    "`get(1)` | [search a] foo | x",
    'append [search x] tail "q ]" text | y',
    "a || b |",
    "|",
    "  ",
    "",
    '"quoted start" b | [[c] d | e] f | g',
    'x "esc \\" | [" | y',
    "it's | don't",
    "a ] b",
    "a [ b",
    'open "quote | x',
    "open `macro | x",
    "tabs\tand\nlines   | STATS  Count\t by  x",
]


def _random_texts(seed, n=300):
    rng = random.Random(seed)
    parts = ["search", " ", "  ", "|", "|", "[", "]", '"', '"a|b"', "`m(x)`", "`", "x=1", "\\", "\n", "STATS", "'", "é"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 14))) for _ in range(n)]


def _frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")


@pytest.fixture(scope="module")
def parsed(spark):
    texts = SAMPLES + _random_texts(1) + _random_texts(2)
    text = F.col("text")
    rows = _frame(spark, texts).select(
        "text",
        tx.well_formed(text).alias("ok"),
        tx.split_stages(text).alias("split"),
        tx.commands(text).alias("commands"),
        tx.stages(text).alias("stages"),
        tx.tokens(text).alias("tokens"),
    )
    return rows.collect()


def test_against_a_hand_written_lexer(parsed):
    well_formed = 0
    for row in parsed:
        expected = brute.lex(row.text)
        assert row.ok == (expected is not None), row.text
        assert row.split == brute.split_stages(row.text), row.text
        assert row.commands == brute.commands(row.text), row.text
        if expected is None:
            assert row.stages is None and row.tokens is None
            continue
        well_formed += 1
        got = [(s.depth, s.stage_text.strip()) for s in row.stages]
        assert got == [(d, t.strip()) for d, t in brute.stage_texts(row.text)], row.text
        assert [s.command for s in row.stages] == row.commands
        assert [s.position for s in row.stages] == list(range(len(got)))
    assert well_formed > 100


def test_tokens_cover_the_text(parsed):
    for row in parsed:
        if row.tokens is not None:
            kept = "".join("".join(t.value.split()) for t in row.tokens)
            assert kept == "".join(row.text.split()), row.text


def test_whole_documents(spark):
    """Real prose of up to 20,000 words, every text compared from end to end."""
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")
    rows = documents.select("text", tx.split_stages(F.col("text")).alias("split")).collect()
    assert len(rows) >= 200
    for row in rows:
        assert row.split == brute.split_stages(row.text)


def test_very_long_quotes_and_many_stages(spark):
    quoted = 'search "' + 'x\\"' * 200_000 + '" | head'
    piped = " | ".join(["eval a=1"] * 3000)
    nested = "[search " * 60 + "]" * 60
    rows = _frame(spark, [quoted, piped, nested]).select(F.size(tx.stages(F.col("text"))).alias("n")).collect()
    assert [r.n for r in rows] == [2, 3000, 60]


def _spans_by_stack(marks):
    """(begin, depth, end) of every stage, by walking the segments with a stack of open stages."""
    spans, open_ = [], [None]
    waiting = [True]
    for i, mark in enumerate(marks):
        if mark in "|]" and open_[-1] is not None:
            spans.append((open_[-1], len(open_) - 1, i))
            open_[-1] = None
        if mark == "|":
            waiting[-1] = True
        elif mark == "[":
            waiting[-1] = False
            open_.append(None)
            waiting.append(True)
        elif mark == "]":
            open_.pop()
            waiting.pop()
        elif waiting[-1]:
            open_[-1], waiting[-1] = i, False
    if open_[-1] is not None:
        spans.append((open_[-1], 0, len(marks)))
    return sorted(spans)


def test_spans_against_a_stack(spark):
    rng = random.Random(11)
    lists = []
    for _ in range(300):
        marks, depth = [], 0
        for _ in range(rng.randrange(30)):
            mark = rng.choice("||[[]]xxx")
            if (mark == "]" and not depth) or (mark == "x" and marks and marks[-1] == "x"):
                continue
            depth += (mark == "[") - (mark == "]")
            marks.append(mark)
        lists.append(marks + ["]"] * depth)
    deep = ["["] * 50_000 + ["x"] + ["]"] * 50_000
    wide = [m for _ in range(33_000) for m in ("|", "x", "[", "x", "]", "x")]
    lists += [deep, wide]
    frame = spark.createDataFrame([(n, marks) for n, marks in enumerate(lists)], "n long, marks array<string>")
    rows = frame.select("n", tx._nested_spans(F.col("marks")).alias("spans")).collect()
    for row in rows:
        assert [tuple(s) for s in row.spans] == _spans_by_stack(lists[row.n])


def test_a_hundred_thousand_brackets(spark):
    """Work grows with the text: ten times the brackets must not take a hundred times as long."""
    text = "search a" + " [search b | head 1] | eval c=1" * 50_000
    split = [f"{'| eval c=1 ' if n else 'search a '}[ search b | head 1 ]" for n in range(50_000)]
    start = time.time()
    row = _frame(spark, [text]).select(
        F.size(tx.stages(F.col("text"))).alias("stages"), tx.split_stages(F.col("text")).alias("split")
    ).first()
    assert time.time() - start < 60
    assert row.stages == 150_001
    assert row.split == [*split, "| eval c=1"]


def _one(spark, text, column):
    return _frame(spark, [text]).select(column(F.col("text")).alias("x")).first()["x"]


def test_canonical_key(spark):
    key = _one(spark, 'STATS   count\t by  "a  b"  `m  x`', lambda t: F.get(tx.stages(t), F.lit(0))["stage_key"])
    assert key == 'stats count by "a  b" `m  x`'


def test_categories(spark):
    text = "`m` | search x | mycmd | addtotals col=t | ADDTOTALS | fields a"
    assert _one(spark, text, tx.categories) == [
        "Macro", "Filter", "Miscellaneous", "Aggregate", "Augment", "Project"
    ]


@pytest.mark.parametrize(
    "args,kind",
    [
        ("", "row"), ("col=t", "col"), ("col=true row=true", "col"), ("row=true col=true", "row"), ("row=f col=T", "col"),
        ("col=1", "col"), ("col=0", "row"), ("col = TRUE", "col"), ('labelfield="col=true"', "row"), ('col="true"', "col"),
        ("mycol=true", "row"), ('"col=t"', "row"),
    ],
)
def test_addtotals(spark, args, kind):
    assert _one(spark, args, tx.addtotals_kind) == f"addtotals {kind}"


def test_taxonomy(spark):
    assert len(COMMAND_CATEGORY) == taxonomy(spark).count() == 102
    assert len(set(COMMAND_CATEGORY.values())) == 18
    assert COMMAND_CATEGORY["addtotals col"] == "Aggregate" and COMMAND_CATEGORY["addtotals"] == "Augment"


def test_command_counts(spark):
    texts = ["search a | STATS b", "search a | STATS b", "search [search x | mycmd] | `m`", 'broken " search']
    rows = stages.command_counts(_frame(spark, texts)).collect()
    assert [(r.command, r.n, r["rank"]) for r in sorted(rows, key=lambda r: r["rank"])] == [
        ("search", 4, 0), ("stats", 2, 1)
    ]


def test_eval_stages(spark):
    texts = ["search a | eval x=1 | eval y=2", "search a | eval x=1 | eval y=2", "a [eval z=1]", "a [b | eval q=1] | c"]
    frame = _frame(spark, texts)
    assert sorted(r.stage_text for r in stages.eval_stages(frame).collect()) == [
        "eval q=1", "eval x=1", "eval y=2", "eval z=1"
    ]
    assert sorted(r.stage_text for r in stages.eval_stages(frame, drop_last=True).collect()) == ["eval q=1", "eval x=1"]


def test_unique_stages(spark):
    texts = ["search a | head", "search  a | search b | search b", "head | HEAD | tail | search a", "search a | head"]
    rows = stages.unique_stages(_frame(spark, texts)).collect()
    assert sorted((r.stage_id, r.position, r.stage_key) for r in rows) == [
        ("0.0", 0, "search a"), ("0.1", 1, "head"), ("1.0", 1, "search b"), ("2.0", 2, "tail")
    ]
    only = stages.unique_stages(_frame(spark, texts), ["tail"]).collect()
    assert [(r.stage_id, r.position) for r in only] == [("2.0", 2)]


def test_stages_of_queries_computed_or_stored(spark):
    frame = _frame(spark, SAMPLES)
    computed = {r.query_id: [s.stage_key for s in r.stages] for r in select.queries_with_stages(frame).collect()}
    stored = select.queries_with_stages(frame, stages.stages(frame)).collect()
    assert computed == {r.query_id: [s.stage_key for s in r.stages] for r in stored}
    assert 7 not in computed and 13 not in computed
