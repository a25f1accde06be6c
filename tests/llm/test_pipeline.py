"""The pipeline and the queries without SQL, on the smallest data, against brute force."""

import hashlib

import duckdb
import numpy as np
import public_tokenizers as public
import pytest
import tiktoken

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from oracle_check import compare, data_dir, duck
from searchlog.llm import bpe, lines, simhash, toxicity
from searchlog.llm.queries import ORACLES, QUERIES
from test_operators import brute_contamination, brute_lines, groups_of

SF = "0.001"


def documents():
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{data_dir(SF)}/documents.parquet' ORDER BY doc_id").fetchall()
    return dict(rows)


documents_ = documents()


def test_registered():
    assert set(QUERIES) <= set(queries()) and set(ORACLES) <= set(oracle_sql())
    assert {k.split("_")[0] for k in QUERIES} == {*(f"op{n}" for n in range(1, 14)), "pipeline"}


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_queries_match_sql(spark, key):
    problem, _, _ = compare(spark, duck(SF), SF, QUERIES[key], ORACLES[key])
    assert problem is None


def encoding():
    path = public.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as file:
        ranks = bpe.load(file.read(), public.PATTERN, path).ranks
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_op1(spark):
    reference = encoding()
    for row in QUERIES["op1_bpe"](spark, data_dir(SF)).collect():
        text = documents_[row["doc_id"]]
        ids = reference.encode_ordinary(text)
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()



def near(a, b):
    return bin((a ^ b) & (2**64 - 1)).count("1") <= 2


def test_op3(spark):
    prints = {i: simhash.fingerprint(simhash.lower_words(t)) for i, t in documents_.items()}
    ids = sorted(prints)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if near(prints[a], prints[b])]
    component = groups_of(ids, links)
    found = QUERIES["op3_simhash"](spark, data_dir(SF)).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in found} == {
        i: (f"{prints[i] & (2**64 - 1):016x}", component[i]) for i in ids
    }


def test_op8(spark):
    found = {r["doc_id"]: r for r in QUERIES["op8_lines"](spark, data_dir(SF)).collect()}
    ids = sorted(documents_)
    expected = brute_lines([documents_[i] for i in ids], lines.MAX_EDITS, lines.MIN_CHARS)
    for n, i in enumerate(ids):
        text, n_lines, n_removed = expected[n]
        assert (found[i]["n_lines"], found[i]["n_removed"]) == (n_lines, n_removed)
        assert found[i]["kept_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_classifiers(spark):
    """Held-out accuracy; the labels hold some noise, so it is below one for the best of models."""
    folder = data_dir("0.01")
    for key, label, least in (("op7_quality", "quality", 0.93), ("op9_toxicity", "toxic", 0.9)):
        truth = dict(duckdb.sql(f"SELECT doc_id, {label} FROM '{folder}/labels.parquet'").fetchall())
        rows = [r for r in QUERIES[key](spark, folder).collect() if r["held_out"] and r["doc_id"] in truth]
        assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in rows]) >= least
        assert all(0 <= r["score"] <= 1 for r in rows)


def test_op6(spark):
    rows = QUERIES["op6_lm"](spark, data_dir(SF)).collect()
    held_out = [r for r in rows if r["held_out"]]
    assert held_out and sum(r["score"] for r in held_out) > sum(r["base_score"] for r in held_out)


def test_op4(spark):
    rows = QUERIES["op4_secrets"](spark, data_dir("0.01")).collect()
    assert rows and {r["length"] for r in rows if r["is_secret"]} == {40}


def test_pipeline(spark):
    """Stage by stage in plain Python, with the same toxicity weights."""
    folder = data_dir(SF)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    weights, stems = toxicity.production_grammar(spark, docs, folder)
    score = {i: 1 / (1 + np.exp(-(np.array(toxicity.features(t, stems)) @ weights[:-1] + weights[-1]))) for i, t in documents_.items()}
    texts = {i: t for i, t in documents_.items() if score[i] < toxicity.THRESHOLD}
    ids = sorted(texts)
    cleaned = brute_lines([texts[i] for i in ids], lines.MAX_EDITS, lines.MIN_CHARS)
    # A document that lost lines goes if nothing is left, or if it is an exact copy of an earlier one.
    first = {}
    for i in ids:
        first.setdefault(texts[i], i)
    kept = [n for n, i in enumerate(ids) if cleaned[n][2] == 0 or (cleaned[n][0].strip() and first[texts[i]] == i)]
    texts = {ids[n]: cleaned[n][0] for n in kept}
    prints = {i: simhash.fingerprint(simhash.lower_words(t)) for i, t in texts.items()}
    ids = sorted(prints)
    component = groups_of(ids, [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if near(prints[a], prints[b])])
    texts = {i: texts[i] for i in ids if component[i] == i}
    items = duckdb.sql(f"SELECT item_id, text FROM '{folder}/benchmark.parquet'").fetchall()
    ids = sorted(texts)
    hit = brute_contamination([texts[i] for i in ids], items, 13)
    clean = [i for n, i in enumerate(ids) if not (hit[n][1] and 20 * len(hit[n][1]) >= hit[n][0])]
    reference = encoding()
    expected = {i: reference.encode_ordinary(texts[i]) for i in clean}

    rows = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"]: r["token_ids"] for r in rows} == expected
    assert all(r["round_trip"] and r["n_tokens"] == len(r["token_ids"]) for r in rows)
    assert len(rows) == len(expected) < len(documents_)
