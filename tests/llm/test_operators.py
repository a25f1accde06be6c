"""Operators against brute-force versions on small random tables."""

import random
import re
import unicodedata
from collections import Counter, defaultdict
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from searchlog.llm import bpe, common, decontaminate, embeddings, lines, lm, quality, secrets, simhash, substrings, toxicity
from searchlog.llm.components import connected_components
from searchlog.runtime import scratch_root

SCHEMA = "doc_id long, text string"


def groups_of(nodes, links):
    """The smallest member of each node's group."""
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def random_texts(seed, n, words, vocabulary="abcdefgh"):
    rng = random.Random(seed)
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.4:  # a near copy
            tokens = rng.choice(texts).split()
            if tokens:
                tokens[rng.randrange(len(tokens))] = rng.choice(vocabulary)
        else:
            tokens = [rng.choice(vocabulary) for _ in range(rng.randrange(words))]
        texts.append(rng.choice([" ", "\n", " \t "]).join(tokens))
    return texts


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)]
    expected = groups_of({n for pair in links for n in pair}, links)
    linked = {n for a, b in links if a != b for n in (a, b)}
    frame = spark.createDataFrame([*links, (1, None), (None, 2)], "a long, b long")
    found = {r["node"]: r["component"] for r in connected_components(frame, "a", "b").collect()}
    assert found == {n: c for n, c in expected.items() if n in linked}


# --- 1 ---


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken
    import public_tokenizers as public

    path = public.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as file:
        own = bpe.load(file.read(), public.PATTERN, path)
    reference = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    return own, reference


def test_bpe_equals_merging(tiktoken_encoding):
    own, reference = tiktoken_encoding
    rng, tokens = random.Random(1), list(own.ranks)
    for _ in range(4000):
        kind = rng.random()
        if kind < 0.4:
            text = b"".join(rng.choice(tokens) for _ in range(rng.randint(1, 6))).decode("utf8", "replace")
        elif kind < 0.7:
            text = "".join(rng.choice("abcdeinrst AE'\n  0189éß中　😀") for _ in range(rng.randint(0, 40)))
        else:
            text = "".join(rng.choice("aaab  \n==--") for _ in range(rng.randint(0, 60)))
        ids = own.encode(text)
        assert ids == reference.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_bpe_long_pieces_and_special_strings(tiktoken_encoding):
    own, reference = tiktoken_encoding
    for text in ("a" * 20_000, " " * 20_000, "<|endoftext|>", "xyzzy" * 3000):
        assert own.encode(text) == reference.encode_ordinary(text)


# --- 2 ---


def brute_substrings(texts, window):
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    counts = Counter(tuple(w[i : i + window]) for w in tokens for i in range(len(w) - window + 1))
    out = []
    for w in tokens:
        gone = {p for i in range(len(w) - window + 1) if counts[tuple(w[i : i + window])] > 1 for p in range(i, i + window)}
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


@pytest.mark.parametrize("hot, longest", [(1000, 128), (2, 128), (1000, 3)])
def test_substrings(spark, monkeypatch, hot, longest):
    monkeypatch.setattr(substrings, "LONGEST_RUN", longest)
    texts = random_texts(5, 60, 60, "abcdefghijklmnopqrstuvwxyz") + ["a " * 50, "b c " * 9, "q " * 11, None, "", "é ü " * 8]
    frame = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    found = substrings.without_repeats(frame, window=6, mer=2, hot_minimiser=hot)
    rows = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in found.collect()}
    assert rows == dict(enumerate(brute_substrings(texts, 6)))
    assert any(r[1] for r in rows.values())


@pytest.mark.parametrize("hot", [2000, 2])
def test_repeated_rows_pack_their_own_strings_only(spark, monkeypatch, hot):
    """Twice the repeated rows make twice the packed strings, not four times as many."""
    packed = []
    real = substrings.map_arrow

    def counted(df, function, schema):
        found = real(df, function, schema)
        if "packed" in schema:
            packed.append(found)
        return found

    monkeypatch.setattr(substrings, "map_arrow", counted)
    text, sizes = " ".join(f"w{i}" for i in range(300)), []
    for copies in (40, 80):
        packed.clear()
        frame = spark.createDataFrame([(7, text)] * copies + [(8, "some other words")], SCHEMA)
        found = substrings.without_repeats(frame, window=20, mer=3, hot_minimiser=hot).collect()
        assert sorted((r["n_words"], r["n_removed"]) for r in found) == [(3, 0)] + [(300, 300)] * copies
        sizes.append(sum(p.count() for p in packed))
    assert sizes[1] == 2 * sizes[0]


# --- 3 ---


@pytest.mark.parametrize("hot", [200, 1])
def test_linked_fingerprints(spark, hot):
    rng = random.Random(2)
    values = {rng.getrandbits(64) for _ in range(30)}
    for value in list(values):
        for _ in range(6):
            flipped = value
            for _ in range(rng.randint(1, 4)):
                flipped ^= 1 << rng.randrange(64)
            values.add(flipped)
    signed = [v - (1 << 64) if v >> 63 else v for v in values] + [0, 1, 3, -1, -2]
    frame = spark.createDataFrame([(v,) for v in set(signed)], "fingerprint long")
    links = [(r["x"], r["y"]) for r in simhash.linked_fingerprints(frame, hot).collect()]
    assert all(bin((x ^ y) & (2**64 - 1)).count("1") <= 2 for x, y in links)
    near = [(x, y) for x, y in combinations(set(signed), 2) if bin((x ^ y) & (2**64 - 1)).count("1") <= 2]
    assert groups_of(set(signed), links) == groups_of(set(signed), near)


def test_simhash_fingerprints():
    def brute(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))
        shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] * bool(w)
        hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
        return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))

    for text in ["", "One", "One two", "Über É a b", *random_texts(4, 20, 30)]:
        assert simhash.fingerprint(simhash.lower_words(text)) & (2**64 - 1) == brute(text)


# --- 4 ---


def test_secrets(spark):
    train = spark.range(600).selectExpr("id AS doc_id")
    model = secrets.train(secrets.labelled_findings(train))
    texts = [
        'the token = "9c8b45435718dcc700c184a7e303cdc64c6a8f7f" in',
        "ofthedouaonanerthtionmenting and thereconvertationproing",
        "fixed in commit 9c8b45435718dcc700c184a7e303cdc64c6a8f7f today",
        None, "", "short words only",
        'api_key : "Zk3vQ9x8LmW2rT5yUb7nCe4Ha1sDf6gJ" , then',
    ]
    found = secrets.scan(spark.createDataFrame(list(enumerate(texts)), SCHEMA), model).collect()
    assert {r["doc_id"] for r in found if r["is_secret"]} == {0, 6}
    assert {r["doc_id"] for r in found} == {0, 1, 2, 6}
    assert [r["candidate"] for r in found if r["doc_id"] == 0] == ["9c8b45435718dcc700c184a7e303cdc64c6a8f7f"]


# --- 5 ---


def brute_vectors(rows):
    fine = {
        i: np.array(v, float) / np.linalg.norm(np.array(v, float))
        for i, v in rows
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    }
    links = [(a, b) for a, b in combinations(fine, 2) if len(fine[a]) == len(fine[b]) and fine[a] @ fine[b] >= 0.95]
    counts = Counter(n for pair in links for n in pair)
    component = groups_of([i for i, _ in rows], links)
    return {i: (counts[i], component[i]) for i, _ in rows}


@pytest.mark.parametrize("block", [1024, 16])
def test_near_vectors(spark, block):
    rng = np.random.default_rng(1)
    rows = [rng.normal(size=24).tolist() for _ in range(150)]
    for i in range(12):
        rows += [(np.array(rows[i]) + rng.normal(0, 0.1, 24)).tolist() for _ in range(9)]
    rows += [rows[0], rows[0], (2 * np.array(rows[1])).tolist(), [0.0] * 24, None, [], [float("nan")] * 24]
    rows += [[1.0, float("inf")], [1.0, None], [1.0, 0.0], [1.0, 0.01]]
    rows = [(i, v) for i, v in enumerate(rows)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    # As many pivots as describe a vector: every pair is a candidate, so the result must be complete.
    found = embeddings.near_vectors(frame, pivots=10, listed=10, block=block)
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in found.collect()} == brute_vectors(rows)


def test_recall(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(400, 64))
    noise = rng.normal(size=(400, 5, 64)) * rng.uniform(0.05, 0.33, size=(400, 5, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, (base[:, None] + noise).reshape(-1, 64)]))]
    expected = brute_vectors(rows)
    found = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {r["vec_id"]: r["n_links"] for r in found.collect()}
    assert all(got[i] <= n for i, (n, _) in expected.items())
    assert sum(got.values()) >= 0.9 * sum(n for n, _ in expected.values())


def crowd(n, others):
    """Distinct unit vectors around one centre, pairwise cosine about 0.97, and others in all directions; links of each."""
    rng = np.random.default_rng(3)
    centre = rng.normal(size=64)
    x = np.concatenate([centre + rng.normal(size=(n, 64)) * 0.17 * np.linalg.norm(centre) / 8, rng.normal(size=(others, 64))])
    x = (x / np.linalg.norm(x, axis=1, keepdims=True))[rng.permutation(n + others)]
    links = np.concatenate([(x[i : i + 2000] @ x.T >= embeddings.COSINE).sum(axis=1) - 1 for i in range(0, len(x), 2000)])
    return x, links


@pytest.mark.parametrize("n, others", [(6_667, 13_333), (700, 0)])
def test_recall_in_a_large_group(spark, n, others):
    x, links = crowd(n, others)
    assert links.max() > 0.9 * n
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    found = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {r["vec_id"]: r["n_links"] for r in found.collect()}
    assert all(got[i] <= n for i, n in enumerate(links))
    assert sum(got.values()) >= 0.98 * links.sum()


# --- 6 ---


def test_lm_scores(spark):
    rng = random.Random(8)
    texts = ["The " + " ".join(rng.choice("abcdefghij") * rng.randint(1, 2) for _ in range(rng.randrange(40))) for _ in range(120)]
    texts += ["", None, "unseenword " * 3]
    frame = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    found = {r["doc_id"]: r for r in lm.lm_scores(frame, block_bytes=700).collect()}
    again = {r["doc_id"]: r for r in lm.lm_scores(frame).collect()}
    tokens = {i: [*(t or "").lower().split(), "</s>"] for i, t in enumerate(texts)}
    counts = Counter(w for i in tokens if not lm.is_held_out(i) for w in tokens[i])
    total, types = sum(counts.values()), len(counts)
    for i, row in found.items():
        assert row["held_out"] == lm.is_held_out(i)
        assert (row["n_tokens"], row["train_tokens"]) == (len(tokens[i]), total)
        assert row["n_known"] == sum(counts[w] > 0 for w in tokens[i])
        base = sum(np.log10((counts[w] + 1) / (total + types + 1)) for w in tokens[i])
        assert row["base_score"] == pytest.approx(base, abs=1e-9)
        assert row["score"] == pytest.approx(again[i]["score"], abs=1e-9)  # however the text is dealt to blocks
        assert row["score"] < 0
    assert len(found) == len(texts)


def test_lm_weights():
    """Where pairs predict perfectly they get the weight; where they never do, words get it."""
    cells = np.array([[3, 0, -8 * lm.GRID, 100], [5, 1, -2 * lm.GRID, 100]])
    weights = lm.learn_weights(cells, 1e-6)
    assert weights[3, 0] > 0.9 and weights[5, 1] > 0.9
    assert np.allclose(weights.sum(axis=1), 1)
    assert np.allclose(weights[4], weights[3])


# --- 7 ---


def test_quality_network():
    rng = random.Random(1)
    good = ["".join(rng.choice("abcdefgh  .") for _ in range(rng.randint(30, 900))) for _ in range(60)]
    bad = [re.sub(" ", "%%% ", g) for g in good]
    samples = [quality.training_chunks(t) for t in good[:40] + bad[:40]]
    net = quality.fit(samples, [1] * 40 + [0] * 40, epochs=25)
    scores = [net.score(t) for t in good[40:] + bad[40:]]
    assert sum((s >= 0.5) == (i < 20) for i, s in enumerate(scores)) >= 38
    assert 0 <= net.score(None) == net.score("") <= 1


def test_quality_is_fitted_on_whole_texts(spark, monkeypatch):
    """All chunks go into the fit, in parts as in one piece; the bound on bytes leaves out rows, not ends of texts."""
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdefgh  .") for _ in range(rng.randint(3000, 30_000))) for _ in range(8)]
    samples = [quality.training_chunks(t) for t in texts]
    step = quality.STEP * quality.CHUNK_STEPS
    assert all(b"".join(c[:step] for c in chunks) == t.encode() for chunks, t in zip(samples, texts))
    whole = quality.fit(samples, [0, 1] * 4, epochs=2)
    monkeypatch.setattr(quality, "FIT_CHUNKS", 3)
    parts = quality.fit(samples, [0, 1] * 4, epochs=2)
    assert np.allclose(whole.filters, parts.filters, atol=1e-4) and np.allclose(whole.layer, parts.layer, atol=1e-4)

    seen = []
    monkeypatch.setattr(quality, "fit", lambda samples, labels: seen.append((samples, labels)))
    docs = spark.createDataFrame([*enumerate(texts), (90, None)], SCHEMA)
    labels = spark.createDataFrame([(i, i % 2) for i in [*range(8), 90, 91]], "doc_id long, quality int")
    quality.train(docs, labels)
    assert len(seen[0][0]) == 9 and sorted(map(len, seen[0][0])) == sorted([0, *map(len, samples)])
    quality.train(docs, labels, max_bytes=sum(map(len, texts)) // 2)
    assert 1 <= len(seen[1][0]) < 9 and all(chunks in [[], *samples] for chunks in seen[1][0])


def test_quality_gradients():
    """Against differences of the loss."""
    rng = np.random.default_rng(3)
    net = quality.Network.start()
    chunks = quality._padded(quality.training_chunks("".join(map(chr, rng.integers(32, 127, 1500)))))
    parameters = {"filters": net.filters.astype(np.float64), "offsets": net.offsets + 0.05, "layer": net.layer.astype(np.float64), "bias": np.zeros(1)}
    net = quality.Network(parameters["filters"], parameters["offsets"], parameters["layer"], 0.0)
    gradients = {name: np.zeros_like(p) for name, p in parameters.items()}
    quality._add_gradients(net, parameters, gradients, chunks, 1.0)

    def loss():
        cells = quality._BYTES[chunks].reshape(*chunks.shape[:2], -1).astype(np.float64)
        half = quality.WIDTH // 2
        out = np.maximum(cells[:, :-1] @ net.filters[:half] + cells[:, 1:] @ net.filters[half:] + net.offsets, 0)
        best = out.max(axis=1)
        z = np.concatenate([best.max(axis=0), best.mean(axis=0)]) @ net.layer + parameters["bias"][0]
        return np.log1p(np.exp(-z))

    for name, parameter in parameters.items():
        flat = parameter.reshape(-1)
        for place in rng.integers(0, flat.size, 6):
            before = flat[place]
            flat[place] = before + 1e-5
            above = loss()
            flat[place] = before - 1e-5
            below = loss()
            flat[place] = before
            assert abs((above - below) / 2e-5 - gradients[name].reshape(-1)[place]) < 1e-3


def test_quality_covers_long_texts(monkeypatch):
    """A document in parts is described as in one piece."""
    net = quality.Network.start()
    data = bytes(random.Random(2).randrange(256) for _ in range(40_000))
    whole = net.describe(data)
    monkeypatch.setattr(quality, "PART_BYTES", 4096)
    assert np.allclose(net.describe(data), whole, atol=1e-4)


# --- 8 ---


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("k", [1, 2, 3])
def test_within_edits(spark, k):
    rng, pairs = random.Random(k), []
    for _ in range(400):
        a = [rng.choice("abé") for _ in range(rng.randint(k + 1, 14))]
        b = list(a)
        for _ in range(rng.randint(0, k + 2)):
            kind, at = rng.random(), rng.randrange(len(b) + 1)
            if kind < 0.4 and len(b) > k + 1:
                del b[min(at, len(b) - 1)]
            elif kind < 0.7:
                b.insert(at, rng.choice("abé"))
            else:
                b[min(at, len(b) - 1)] = rng.choice("abé")
        a, b = sorted([a, b], key=len)
        if len(b) - len(a) <= k:
            pairs.append(("".join(a), "".join(b)))
    frame = spark.createDataFrame(pairs, "a string, b string")
    judged = frame.select("a", "b", lines.within_edits(F.split("a", ""), F.split("b", ""), k).alias("near")).collect()
    assert all(r["near"] == (edit_distance(r["a"], r["b"]) <= k) for r in judged)
    assert {r["near"] for r in judged} == {True, False}


def brute_lines(texts, k, min_chars):
    where = defaultdict(list)
    for i, text in enumerate(texts):
        for place, line in enumerate((text or "").split("\n")):
            if len(line.strip(" \t\r\f\v")) >= min_chars:
                where[line.strip(" \t\r\f\v")].append((i, place))
    near = [(a, b) for a, b in combinations(where, 2) if abs(len(a) - len(b)) <= k and edit_distance(a, b) <= k]
    group, first = groups_of(where, near), {}
    for line, places in where.items():
        first[group[line]] = min(first.get(group[line], places[0]), min(places))
    out = {}
    for i, text in enumerate(texts):
        if text is None:
            out[i] = (None, 0, 0)
            continue
        kept = [
            line for place, line in enumerate(text.split("\n"))
            if len(line.strip(" \t\r\f\v")) < min_chars or first[group[line.strip(" \t\r\f\v")]] == (i, place)
        ]
        n = text.count("\n") + 1
        out[i] = ("\n".join(kept), n, n - len(kept))
    return out


@pytest.mark.parametrize("k, crowded", [(1, 100), (1, 1), (2, 100), (2, 2)])
def test_lines(spark, k, crowded):
    rng, seen, texts = random.Random(10 * k + crowded), [], []
    for _ in range(60):
        rows = []
        for _ in range(rng.randint(0, 4)):
            line = rng.choice(seen) if seen and rng.random() < 0.6 else "".join(rng.choice("abcdeé ") for _ in range(rng.randint(6, 24)))
            if rng.random() < 0.5 and line:
                at = rng.randrange(len(line))
                line = line[:at] + rng.choice(["", "x", "xy"]) + line[at + rng.randint(0, 1) :]
            seen.append(line)
            rows.append(line + rng.choice(["", " ", "\r"]))
        texts.append("\n".join(rows))
    texts += [None, "", "\n\n", "numbered line of text 1\nnumbered line of text 2"]
    found = lines.without_repeated_lines(
        spark.createDataFrame(list(enumerate(texts)), SCHEMA), max_edits=k, min_chars=8, crowded=crowded
    )
    rows = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in found.collect()}
    assert rows == brute_lines(texts, k, 8)


def test_edits_grow_with_the_line(spark):
    """Pairs around each border: near if within the edits of the shorter line."""
    rng, texts = random.Random(5), []
    for size in (30, 49, 50, 60, 74, 75, 76, 120, 300):
        for edits in range(1, 5):
            line = "".join(rng.choice("abcdefghij") for _ in range(size))
            places = rng.sample(range(size), edits)
            texts.append((line, "".join("X" if n in places else c for n, c in enumerate(line))))
            texts.append((line[::-1], line[::-1] + "X" * edits))
    rows = [(2 * n + i, line) for n, pair in enumerate(texts) for i, line in enumerate(pair)]
    found = lines.without_repeated_lines(spark.createDataFrame(rows, SCHEMA)).collect()
    removed = {r["doc_id"]: r["n_removed"] for r in found}
    for n, (a, b) in enumerate(texts):
        k = 1 if len(a) < 50 else 2 if len(a) < 75 else 3
        assert (removed[2 * n], removed[2 * n + 1]) == (0, int(edit_distance(a, b) <= k))


@pytest.mark.parametrize("base", [True, False])
def test_a_family_of_lines_costs_rows_in_proportion(spark, base):
    """Lines that are all within the edits of each other, or of one line that is frequent, make one group by few pairs."""
    text, letters = "the quick brown fox jumps over the lazy dog and runs on through the dark forest at night, twice", "abcdefghijklmnopqrstuvwxyz0123456789"
    found = []
    for n in (100, 200):
        if base:  # each has an edit of its own, so that two of them are two edits apart
            lines_ = [text[: 1 + i % 90] + letters[i // 90] + letters[i % 36] + text[3 + i % 90 :] for i in range(n)] + [text] * 5
        else:  # one place differs
            lines_ = [text[:40] + letters[i % 36] + letters[i // 36] + text[42:] for i in range(n)]
        frame = spark.createDataFrame([(bytes(line, "ascii"), line) for line in lines_], "line_id binary, line string")
        pairs = [tuple(map(bytes, r)) for r in lines.near_lines(frame, ((0, 2),), 16).collect()]
        groups = groups_of({bytes(line, "ascii") for line in lines_}, pairs)
        assert len(set(groups.values())) == 1
        found.append(len(pairs))
    assert found[1] <= 3 * found[0] and found[1] < 200 * 40


def test_repeats_leave_only_their_spans_to_the_last_query(spark):
    """Strings are packed and counted before the texts are shuffled for the result, so that their exchanges are gone then."""
    text = " ".join(str(i) for i in range(60))
    kept = substrings.without_repeats(spark.createDataFrame([(1, text), (2, "a " + text), (3, "b")], "doc_id long, text string"))
    assert "MapInArrow" not in kept._jdf.queryExecution().toString()
    assert sorted(map(tuple, kept.collect())) == [(1, 60, 60, ""), (2, 61, 60, "a"), (3, 1, 0, "b")]


def test_length_classes_share_one_plan(spark, monkeypatch):
    """Lines of one, two and three edits are joined by the same tables, and links across classes are found."""
    names, write = [], lines.written
    monkeypatch.setattr(lines, "written", lambda df, name: names.append(name) or write(df, name))
    base = "the quick brown fox jumps over the lazy dog and runs away from all the cats of this old town today"
    texts = [base[:30], base[:29] + "#", base[:49], base[:20] + "##" + base[20:49], base[:74], base[:73] + "##"]
    texts += [base, "#" + base[1:50] + "#" + base[51:] + "#"]
    frame = spark.createDataFrame([(bytes(t, "ascii"), t) for t in texts], "line_id binary, line string")
    pairs = {frozenset(texts.index(v.decode()) for v in map(bytes, r)) for r in lines.near_lines(frame).collect()}
    assert pairs == {frozenset(p) for p in [(0, 1), (4, 5), (6, 7)]}
    assert names.count("line-candidates") == names.count("crowded-keys") == 1


def test_written_removes_shuffle_files(spark, tmp_path):
    import time

    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles

    def shuffled():
        return {str(files().apply(i)) for i in range(files().size()) if "shuffle_" in str(files().apply(i))}

    before = shuffled()
    table = common.written(spark.range(10000).groupBy((F.col("id") % 100).alias("x")).count(), "counted")
    until = time.time() + 20
    while shuffled() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffled() - before
    assert table.count() == 100


def test_lines_without_a_neighbour_are_written_once(spark):
    """Lines are kept, and not their keys, which take several times their room."""
    folder = Path(scratch_root(spark)) / "searchlog"

    def held():
        return {path: path.stat().st_size for path in folder.rglob("*.parquet") if path.is_file()}

    rng, before = random.Random(3), held()
    some = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=100)) for _ in range(5000)]
    near = some[0][:50] + "-" + some[0][51:]
    frame = spark.createDataFrame([(bytes(line, "ascii")[:16], line) for line in some] + [(b"near", near)] * 3, "line_id binary, line string")
    pairs = [set(map(bytes, r)) for r in lines.near_lines(frame).collect()]
    assert {frozenset(pair) for pair in pairs} == {frozenset([bytes(some[0], "ascii")[:16], b"near"])}
    assert sum(size for path, size in held().items() if path not in before) < 2 * sum(map(len, some))


# --- 9 ---


def test_toxicity_grammar():
    def patterns(text):
        return toxicity.clause_patterns(text.encode().split())

    assert patterns("the weather is fine") == []
    assert patterns("you are an idiot") == ["insult+aimed"]
    assert patterns("idiot you") == ["insult+aimed"]
    assert patterns("this is no idiot") == ["insult+negated"]
    assert patterns("mary said the idiot left") == ["insult+reported"]
    assert patterns("a stupid worthless thing") == ["insult", "insult+repeated"]
    assert patterns("i will kill you") == ["threat+aimed"]
    assert toxicity.features(None) == toxicity.features("") == toxicity.features("fine words. " * 50)


def test_toxicity_grammar_against_its_definition():
    rng = random.Random(6)
    words = {"insult": "idiot", "threat": "kill", "stem": "abcde", "target": "you", "negation": "not", "report": "said", "other": "x"}
    for _ in range(3000):
        kinds = [rng.choice([*words, "other", "other"]) for _ in range(rng.randrange(14))]
        expected = []
        for i, kind in enumerate(kinds):
            if kind in ("insult", "threat", "stem"):
                near = range(max(0, i - toxicity.REACH), i)
                marks = {
                    "negated": any(kinds[j] == "negation" for j in near),
                    "reported": "report" in kinds[:i],
                    "aimed": any(kinds[j] == "target" for j in [*near, *range(i + 1, min(len(kinds), i + 1 + toxicity.REACH))]),
                    "repeated": any(k in ("insult", "threat", "stem") for k in kinds[:i]),
                }
                expected.append("+".join([kind, *[name for name, holds in marks.items() if holds]]))
        found = toxicity.clause_patterns([words[k].encode() for k in kinds], ("abcd",))
        assert found == expected and set(found) <= set(toxicity.PATTERNS)


def test_toxicity_stems(spark):
    """Words that no list holds, found by how they begin; a stem that is as frequent elsewhere is none."""
    rng = random.Random(8)
    ends = [f"{a}{b}" for a in "aeiou" for b in "bcdfgh"]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 5 == 0
        words = [rng.choice(["sun", "tree", "walks", "home."]) + rng.choice(ends) for _ in range(60)]
        words[:5] = [("grumpf" if toxic else "lampe") + rng.choice(ends) for _ in range(5)]
        rows.append((i, " ".join(rng.sample(words, len(words)))))
        labels.append((i, int(toxic)))
    docs, known = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")
    labelled = toxicity.labelled_texts(docs, known.filter("doc_id < 300"))
    stems = toxicity.learn_stems(labelled)
    assert stems and all("grumpf".startswith(stem[:6]) for stem in stems)
    weights = toxicity.fit_weights(labelled, stems)
    scored = {r["doc_id"]: r["score"] for r in toxicity.with_toxicity(docs, weights, stems).collect()}
    assert all((s >= toxicity.THRESHOLD) == (i % 5 == 0) for i, s in scored.items())
    assert toxicity.learn_stems(labelled.filter("_toxic = 0")) == toxicity.learn_stems(labelled.limit(0)) == ()


def test_toxicity_weights(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(200):
        words = [rng.choice(["the", "sun", "tree", "walks", "home."]) for _ in range(60)]
        if i % 4 == 0:
            words[rng.randrange(50)] = "moron"
            words[rng.randrange(50)] = "trash"
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0) if i % 50 else None))
    docs = spark.createDataFrame(rows, SCHEMA)
    weights = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    scored = {r["doc_id"]: r["score"] for r in toxicity.with_toxicity(docs, weights).collect()}
    assert all((s >= toxicity.THRESHOLD) == (i % 4 == 0) for i, s in scored.items())
    assert np.allclose(toxicity.fit(np.zeros((0, 1)), np.zeros(0)), toxicity.prior())


# --- 10 ---


def brute_contamination(texts, items, window):
    def tokens(text):
        lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)

    grams = {}
    for item, text in items:
        w = tokens(text)
        size = min(window, len(w))
        for i in range(len(w) - size + 1):
            if w:
                grams.setdefault(tuple(w[i : i + size]), set()).add(item)
    out = {}
    for i, text in enumerate(texts):
        w, hit, ids = tokens(text), set(), set()
        for size in {len(g) for g in grams}:
            for at in range(len(w) - size + 1):
                if tuple(w[at : at + size]) in grams:
                    hit |= set(range(at, at + size))
                    ids |= grams[tuple(w[at : at + size])]
        out[i] = (len(w), sorted(hit), sorted(ids))
    return out


@pytest.mark.parametrize("shard_words", [1000, 25])
def test_contamination(spark, shard_words):
    rng = random.Random(9)
    texts = random_texts(9, 80, 40, "abcd") + [None, "", "A-b_C.d" * 20, "É é ü", "a " * 300]
    items = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randrange(12)))) for i in range(20)]
    items += [(90, "É! é"), (91, ""), (92, None), (93, items[3][1]), (94, "b a a " * 9)]
    found = decontaminate.contamination(
        spark.createDataFrame(list(enumerate(texts)), SCHEMA),
        spark.createDataFrame(items, "item_id long, text string"),
        window=5, shard_words=shard_words,
    )
    rows = {
        r["doc_id"]: (r["n_words"], [p for s in r["spans"] for p in range(s["first"], s["end"])], r["item_ids"])
        for r in found.collect()
    }
    assert rows == brute_contamination(texts, items, 5)
    assert any(r[1] for r in rows.values()) and any(not r[1] for r in rows.values())


def test_cut():
    text = "One, TWO three! Four five."
    assert decontaminate.cut(text, [{"first": 1, "end": 3}]) == "One, ! Four five."
    assert decontaminate.cut(text, [{"first": 1, "end": 3}], longest=2) == text
    assert decontaminate.cut(None, None) is None
    assert unicodedata.normalize("NFC", decontaminate.cut("É b", [{"first": 0, "end": 1}])) == " b"
