"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from searchlog.llm import bpe, decontaminate, embeddings, lines, lm, quality, secrets, simhash, substrings, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word and more words of a very long text. " * 8000
#: Names that operators give to their own columns.
EXTRA = "id row row_key key value words spans score fingerprint node component line place n_words _doc _text _row block".split()


def table(spark, empty=False):
    rows = [
        (1, None, "en", "a", None),
        (2, "", "en", None, 0),
        (3, LONG, None, "a", len(LONG)),
        (4, LONG, "en", "a", len(LONG)),
        (5, "One, two\nthree four five six", "en", "a", 27),
        (5, "One, two\nthree four five six", "en", "a", 27),
        (None, "a row without an id", "en", "a", 19),
        (7, " \n\t ", "en", "a", 4),
        (8, "ünïcödé ΑΒΓ 中文 😀", "el", "b", 15),
    ]
    frame = spark.createDataFrame([] if empty else rows, SCHEMA)
    return frame.withColumns({name: F.lit("x") for name in EXTRA})


def weights():
    return toxicity.prior()


OPERATORS = {
    "bpe": lambda spark, d: bpe.with_tokens(d, bpe.production_codec(spark)),
    "substrings": lambda spark, d: substrings.without_repeats(d),
    "simhash": lambda spark, d: simhash.simhash_groups(d),
    "one_of_each": lambda spark, d: simhash.one_of_each(d),
    "findings": lambda spark, d: secrets.findings(d),
    "lm": lambda spark, d: lm.lm_scores(d),
    "quality": lambda spark, d: quality.with_quality(d, quality.Network.start()),
    "lines": lambda spark, d: lines.without_repeated_lines(d),
    "toxicity": lambda spark, d: toxicity.with_toxicity(d, weights()),
    "without_toxic": lambda spark, d: toxicity.without_toxic(d, weights()),
    "contamination": lambda spark, d: decontaminate.contamination(d, benchmark(spark)),
    "without_contaminated": lambda spark, d: decontaminate.without_contaminated(d, benchmark(spark)),
}


def benchmark(spark, rows=((1, "three four five six"), (2, None), (3, ""), (None, "ünïcödé"))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, name):
    assert OPERATORS[name](spark, table(spark, empty=True)).collect() == []


@pytest.mark.parametrize("name", sorted(set(OPERATORS) - {"one_of_each", "findings", "without_contaminated"}))
def test_row_counts(spark, name):
    found = OPERATORS[name](spark, table(spark)).collect()
    assert sorted(r["doc_id"] or 0 for r in found) == [0, 1, 2, 3, 4, 5, 5, 7, 8]


def test_values(spark):
    docs = table(spark)
    tokens = {r["doc_id"]: r for r in OPERATORS["bpe"](spark, docs).collect()}
    assert tokens[1]["token_ids"] == tokens[2]["token_ids"] == [] and bytes(tokens[1]["decoded"]) == b""
    assert all(bytes(r["decoded"]).decode() == (r["text"] or "") for r in tokens.values())

    removed = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in OPERATORS["substrings"](spark, docs).collect()}
    assert removed[1] == removed[2] == removed[7] == (0, 0)
    assert removed[3] == removed[4] == (72_000, 72_000)  # copies lose all, as each occurs elsewhere
    assert removed[5] == (6, 0)  # shorter than a window

    groups = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in OPERATORS["simhash"](spark, docs).collect()}
    assert groups[1] == groups[2] == groups[7] == (0, 1)
    assert groups[3][1] == groups[4][1] == 3

    kept = sorted(r["doc_id"] or 0 for r in OPERATORS["one_of_each"](spark, docs).collect())
    assert kept == [0, 1, 3, 5, 8]

    scores = {r["doc_id"]: r for r in OPERATORS["lm"](spark, docs).collect()}
    assert scores[1]["n_tokens"] == scores[2]["n_tokens"] == 1 and scores[3]["n_tokens"] == 72_001

    lined = {r["doc_id"]: r for r in OPERATORS["lines"](spark, docs).collect()}
    assert (lined[1]["text"], lined[1]["n_lines"]) == (None, 0)
    assert (lined[2]["text"], lined[2]["n_lines"]) == ("", 1)
    assert lined[3]["n_removed"] == 0 and (lined[4]["n_removed"], lined[4]["text"]) == (1, "")
    assert lined[5]["n_removed"] == 0  # a repeated row is the same document

    hit = {r["doc_id"]: r for r in OPERATORS["contamination"](spark, docs).collect()}
    assert hit[5]["item_ids"] == [1] and hit[8]["item_ids"] == [] and len(hit[8]["spans"]) == 1
    assert hit[1]["n_words"] == 0 and hit[3]["spans"] == []
    clean = sorted(r["doc_id"] or 0 for r in OPERATORS["without_contaminated"](spark, docs).collect())
    assert clean == [0, 1, 2, 3, 4, 7]


def test_filters_keep_columns(spark):
    docs = table(spark)
    for name in ("one_of_each", "without_toxic", "without_contaminated"):
        assert OPERATORS[name](spark, docs).columns == docs.columns


def test_empty_companions(spark):
    docs = table(spark)
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert all(not r["spans"] for r in decontaminate.contamination(docs, nothing).collect())
    labels = spark.createDataFrame([(1, None, None), (None, 1, 1), (99, 1, 0)], "doc_id long, quality int, toxic int")
    assert (toxicity.train(docs, labels) == toxicity.prior()).all()
    assert quality.train(docs, labels).score("text") > 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embeddings.near_vectors(vectors).collect() == []
    odd = spark.createDataFrame([(1, None), (2, [0.0]), (None, [1.0]), (4, [1.0]), (4, [1.0])], "vec_id long, embedding array<float>")
    found = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"]) for r in embeddings.near_vectors(odd).collect())
    assert found == [(0, 2, 4), (1, 0, 1), (2, 0, 2), (4, 2, 4), (4, 2, 4)]


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_pipeline_stages_on_odd_rows(spark, stage, tmp_path):
    """Each stage runs on odd and on empty tables, and all but the last keep the columns."""
    benchmark(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    function = dict(corpus_pipeline.STAGES)[stage]
    for empty in (False, True):
        docs = table(spark, empty).select("doc_id", "text", "lang", "source", "n_chars")
        out = function(spark, docs, str(tmp_path))
        assert out.count() <= docs.count() and (out.count() > 0) != empty
        if stage != corpus_pipeline.STAGES[-1][0]:
            assert out.dtypes == docs.dtypes


def test_exact_copies_with_short_lines(spark):
    """Copies go whole, not as fragments of their short lines, through line dedup and near duplicates."""
    text = "Title\nA long enough line of the text to be compared.\nYes.\nAnother line that is long enough to be compared."
    texts = [text, text, text, "Yes.\nA text of its own that shares only its short line.", text]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], SCHEMA)
    kept = corpus_pipeline.repeated_lines(spark, docs, "")
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(0, text), (3, texts[3])]
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, kept, "").collect()) == [0, 3]


def test_secrets_on_odd_and_empty_tables(spark, tmp_path):
    """Nulls, no rows and clashing columns, through the fit, the scan and the registered query."""
    empty = table(spark, empty=True)
    assert secrets.train(secrets.labelled_findings(empty)) is None
    assert secrets.scan(empty, None).collect() == []
    model = secrets.train(secrets.labelled_findings(table(spark)))
    secret = "api_key = 'q8Zr3TmN0bVx7LkW2pHs9DfGc4JyQe1A'"
    rows = [(1, None), (2, ""), (None, secret), (4, secret), (4, secret), (5, "word " * 50_000 + secret)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({name: F.lit("x") for name in EXTRA})
    found = secrets.scan(docs, model).collect()
    assert sorted(r["doc_id"] or 0 for r in found) == [0, 4, 4, 5]
    assert all(r["candidate"].strip("'") == secret.split("'")[1] and r["is_secret"] is not None for r in found)
    assert [r["is_secret"] for r in secrets.scan(docs.filter("doc_id = 5"), None).collect()] == [True]
    empty.select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    assert secrets.op4_secrets(spark, str(tmp_path)).collect() == []
