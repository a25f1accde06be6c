"""Hard negatives, main text of pages and conversation tries against brute force, and on odd and empty tables."""

import hashlib
import random
import zlib
from collections import defaultdict
from math import floor

import numpy as np
import pytest
from pyspark.sql import functions as F

from oracle_check import data_dir
from searchlog.llm import conversations, negatives, pages
from searchlog.llm.queries import QUERIES

# --- 11 ---


def brute_negatives(rows, asks, positives=5, negatives_=5, low=80, high=100):
    points = {i: (label, [floor(256 * float(x)) for x in v]) for i, label, v in rows}

    def score(a, b):
        return sum(x * y for x, y in zip(points[a][1], points[b][1]))

    found = set()
    for a in points:
        if asks(a):
            order = sorted((b for b in points if b != a), key=lambda b: (-score(a, b), b))
            for p in [b for b in order if points[b][0] == points[a][0]][:positives]:
                s = score(a, p)
                fits = [b for b in order if points[b][0] != points[a][0] and low * s <= 100 * score(a, b) <= high * s]
                found |= {(a, p, n + 1, b, s, score(a, b)) for n, b in enumerate(fits[:negatives_])}
    return found


def mined(spark, rows, asks, **options):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    found = negatives.hard_negatives(frame, asks, **options)
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert found.columns == names
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def vectors(seed, n, groups, spread, size=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, size))
    points = centres[rng.integers(groups, size=n)] + spread * rng.normal(size=(n, size))
    points[rng.integers(n, size=n // 10)] = points[0]  # ties
    return [(i, [float(np.float32(x)) for x in p], int(rng.integers(4))) for i, p in enumerate(points)]


@pytest.mark.parametrize(("groups", "spread", "block"), [(1, 1.0, 40), (6, 0.2, 25), (3, 0.01, 500), (2, 0.0, 16)])
def test_hard_negatives(spark, groups, spread, block):
    rows = vectors(groups, 300, groups, spread)
    found = mined(spark, rows, F.col("vec_id") % 10 == 0, block=block)
    assert found == brute_negatives([(i, label, v) for i, v, label in rows], lambda i: i % 10 == 0)
    assert found


def test_hard_negatives_window(spark):
    rows = vectors(8, 120, 4, 0.3)
    options = {"positives": 3, "low": 50, "high": 90}
    found = mined(spark, rows, F.col("vec_id") < 20, negatives=2, block=32, **options)
    assert found == brute_negatives([(i, label, v) for i, v, label in rows], lambda i: i < 20, negatives_=2, **options)


def test_hard_negatives_on_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    fine = [(0, [1.0, 0.0], 1), (1, [0.9, 0.1], 1), (2, [0.8, 0.3], 2), (3, [0.8], 2), (4, [], 2), (5, [0.0, 0.0], 1)]
    fine += [(6, [1e5, -1e5], 2), (7, [-1.0, 0.5], 3)]
    odd = [(10, None, 1), (11, [1.0, None], 1), (12, [nan, 1.0], 2), (13, [inf, 1.0], 2), (14, [1.0, 0.0], None)]
    odd += [(None, [1.0, 0.0], 1), (15, [3e38, 0.0], 2), fine[1], fine[2]]  # the last two are repeated rows
    found = mined(spark, fine + odd, F.col("vec_id") >= 0)
    padded = [(i, label, (v + [0.0, 0.0])[:2]) for i, v, label in fine]
    assert found == brute_negatives(padded, lambda i: True)
    assert any(row[3] == 3 for row in found)


def test_hard_negatives_without_rows(spark):
    assert mined(spark, [], F.col("vec_id") >= 0) == set()
    assert mined(spark, [(1, [1.0], 1)], F.lit(False)) == set()
    assert mined(spark, [(1, [1.0], 1)], F.lit(True)) == set()


def test_cover_tree():
    rng = np.random.default_rng(5)
    points = rng.normal(size=(400, 3))
    points[100:200] = points[7]
    unit = negatives._unit(points, float((points**2).sum(axis=1).max()))
    tree = negatives.Cover(unit)

    def below(node):
        if tree.first[node] == tree.last[node]:
            return [tree.centre[node]]
        return [i for child in range(tree.first[node], tree.last[node]) for i in below(child)]

    assert sorted(below(0)) == list(range(400))  # every vector is one leaf
    for node in range(len(tree.centre)):
        angles = np.arccos(np.clip(unit[below(node)] @ unit[tree.centre[node]], -1, 1))
        assert (angles <= tree.angle[node] + 1e-5).all()


def test_descent_skips_nodes(spark):
    """On vectors in groups, far fewer are scored than there are."""
    rows = vectors(2, 2000, 40, 0.02, size=6)
    points = np.floor(256 * np.array([v for _, v, _ in rows]))
    squares = float((points**2).sum(axis=1).max())
    tree = negatives.Cover(negatives._unit(points, squares))
    search = negatives.Search(points[0], np.array([-negatives.EDGE]), np.array([negatives.EDGE]), 5)
    scored, waiting = 0, [(np.inf, 0)]
    while waiting:
        promise, node = max(waiting)
        waiting.remove((promise, node))
        if promise < search.bar.min():
            break
        for child in range(tree.first[node], tree.last[node]):
            score = points[tree.centre[child]] @ points[0]
            scored += 1
            if tree.first[child] == tree.last[child]:
                search.add(np.array([score]), np.array([tree.centre[child]]))
            else:
                bounds = search.bounds(np.array([score]), np.array([tree.angle[child]]), squares**0.5)
                waiting.append((search.promise(*bounds)[0], child))
    assert search.scores[0].tolist() == sorted((points @ points[0]).astype(int).tolist())[:-6:-1]
    assert scored < 500


# --- 12 ---

FILLER = "Long enough to be a paragraph of some article, with a number of words in it."


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("no markup", "no markup"),
        ("<article><h1>T</h1><p>a &lt; b&nbsp;&#x2014;\n c<br>d</p><p>e</p></article>", "T\na < b — c d\ne"),
        ("<article><p>un<b>bro</b>ken <i>words</i><p>next</article>", "unbroken words\nnext"),
        ("<p title=it's>a 'b' c</p>", "a 'b' c"),
        ("<p title='a > b'>x</p>", "x"),
        ("<article>a<!-- <p>no</p> -->b<script>if (a<b) '</p>'</script>c<style>p{}</style></article>", "abc"),
        ("<article>a<script>never closed", "a"),
        ("<article>&am; &amp &quot;q&quot;</article>", '&am; & "q"'),
        ("a < b and <3", "a < b and <3"),
        (f"<nav><a href=/>Home</a></nav><main><p>{FILLER}</p></main><footer>&copy; we</footer>", FILLER),
        (f'<div class="cookie-notice">We use cookies.</div><div id="content"><p>{FILLER}</p><p>End.</p></div>', f"{FILLER}\nEnd."),
        (f'<div class="site-header"><p>{FILLER}</p></div><div class="post-content"><p>Short.</p></div>', "Short."),
        (f'<article><header><h1>T</h1></header><p>a</p><div class="ad">{FILLER}</div><p>b</p></article>', "T\na\nb"),
        (f"<article><p>a</p><aside>{FILLER}</aside><form><p>Mail</p></form><p>b</p></article><aside>c</aside>", "a\nb"),
        (f'<article><p>a</p><section id="comments"><article><p>{FILLER}</p></article></section></article>', "a"),
        (f'<article>a</article><ol class="commentlist"><li>{FILLER}<li>{FILLER}</ol>', "a"),
        ('<body class="has-sidebar"><article class="no-sidebar"><p>a</p></article></body>', "a"),
        ('<article><p>a</p><h2 id="related-work">Related work</h2><p>b</p></article>', "a\nRelated work\nb"),
        (f"<div><a href=x>Home</a></div><div><a href=y>News</a></div><p>{FILLER}</p><p>End.</p>", f"{FILLER}\nEnd."),
        ("<nav><ul><li><a>x</a></ul></nav>", ""),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
        (f"<p>{FILLER}</p><div class=ad>x</div><p>too short</p>", FILLER),
    ],
)
def test_main_text(html, text):
    assert pages.main_text(html) == text


def test_stretches():
    #            surge          dive                 surge dive
    weights = [0, 0, 5, 0, 90, 7, 0, 0, 0, 3, 0, 0, 0, 0, 50]
    assert pages.stretches(weights) == [(2, 6, 97), (9, 10, 3), (14, 15, 50)]
    assert pages.stretches([]) == pages.stretches([0, 0]) == []


def test_random_pages():
    """Text of a page is found whatever stands around it and however its elements are closed."""
    rng = random.Random(4)
    words = ["der", "Text", "a<b", "&", "naïve", '"q"', "x", "文"]
    noise = [
        "<nav><ul><li><a href='/x'>Home</a><li>News</ul></nav>", "<div class='ad banner'>Buy <b>now</b></div>",
        "<!-- <article>no</article> -->", "<script>document.write('<p>no</p>')</script>", "<aside><p>no</p></aside>",
        "<form><input name=q><label>no</label></form>", "<footer>&copy; no</footer>", "<div id=comments><p>no</div>",
    ]
    for _ in range(200):
        blocks = [" ".join(rng.choices(words, k=rng.randrange(1, 30))) for _ in range(rng.randrange(1, 9))]
        body = ""
        for block in blocks:
            escaped = block.replace("&", "&amp;").replace("<", "&lt;").replace('"', rng.choice(["&quot;", "&#34;"]))
            tag = rng.choice(["p", "h2", "li", "blockquote", "div"])
            spaced = escaped.replace(" ", rng.choice([" ", "\n\t", "&nbsp; ", " <b></b>"]))
            body += f"<{tag} class=x>{spaced}" + ("" if tag in ("p", "li") and rng.random() < 0.5 else f"</{tag}>")
            if rng.random() < 0.3:
                body += rng.choice(noise)
        around = [rng.choice(noise) for _ in range(4)]
        html = f"<html><body>{around[0]}{around[1]}<article>{body}</article>{around[2]}{around[3]}"
        assert pages.main_text(html) == "\n".join(blocks)


def test_long_pages():
    assert pages.main_text("<div>" * 20_000 + "x" + "</section>" * 20_000 + "</div>" * 20_000) == "x"
    assert pages.main_text("<a" * 200_000).startswith("<a<a")
    paragraphs = [f"paragraph {i}" for i in range(50_000)]
    assert pages.main_text("<article><p>" + "<p>".join(paragraphs)) == "\n".join(paragraphs)


def test_main_text_of_tables(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, "<article>ä<p>b</article>", None), (3, "<article>ä<p>b</article>", None)]
    frame = spark.createDataFrame(rows, "page_id long, html string, text string").withColumn("n_chars", F.lit(7))
    found = sorted(tuple(r) for r in pages.with_main_text(frame).select("page_id", "text", "n_chars").collect())
    assert found == [(1, "", 0), (2, "", 0), (3, "ä\nb", 3), (3, "ä\nb", 3)]
    assert pages.with_main_text(frame.limit(0)).collect() == []


def test_op12(spark):
    folder = data_dir("0.001")
    rows = QUERIES["op12_pages"](spark, folder).collect()
    html = {r["page_id"]: r for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    assert len(rows) == len(html)
    for row in rows:
        page = html[row["page_id"]]
        inside = page["html"].split("<article>")[1].split("</article>")[0]
        for tag in ("h1", "p"):
            inside = inside.replace(f"<{tag}>", "\0").replace(f"</{tag}>", "\0")
        for mark in ("<b>", "</b>", "<br>"):
            inside = inside.replace(mark, "")
        blocks = inside.replace("&quot;", '"').replace("&lt;", "<").replace("&amp;", "&").split("\0")
        text = "\n".join(" ".join(b.split()) for b in blocks if b.strip())
        assert (row["url"], row["text"], row["n_chars"]) == (page["url"], text, len(text))


# --- 13 ---


def brute_trie(sequences):
    """Nodes of {conv: [(turn, size), …]} as tuples."""
    members = defaultdict(list)
    for conv, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(t for t, _ in turns[:d])].append(conv)
    sizes = {tuple(t for t, _ in turns[:d]): turns[d - 1][1] for turns in sequences.values() for d in range(1, len(turns) + 1)}
    children = defaultdict(list)
    for key in members:
        if key:
            children[key[:-1]].append(key)
    leaves, saved = {}, {}
    for key in sorted(members, key=len, reverse=True):
        leaves[key] = sum(leaves[c] for c in children[key]) or 1
        saved[key] = sum(saved[c] for c in children[key]) + (len(members[key]) - 1) * sizes.get(key, 0)
    rows = set()
    for key, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(sequences[c]) == len(key))
        rows.add(
            (min(convs), len(key), min(members[key[:-1]]) if key else None, len(convs), len(children[key]), leaves[key], saved[key],
             hashlib.sha256(ends.encode()).hexdigest())
        )
    return rows


NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_of(spark, sequences, **options):
    turns = [(c, d + 1, t.encode(), s) for c, turns in sequences.items() for d, (t, s) in enumerate(turns)]
    frame = spark.createDataFrame(turns, "conv_id long, depth long, turn_id binary, size long")
    convs = spark.createDataFrame([(c, len(t)) for c, t in sequences.items()], "conv_id long, length long")
    found = conversations.prefix_trie(frame, convs, **options)
    assert [t for _, t in found.select(*NAMES).dtypes] == ["bigint"] * 7 + ["string"]
    rows = [tuple(r) for r in found.select(*NAMES).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def random_sequences(seed, n, longest, letters):
    rng = random.Random(seed)
    found = {}
    for conv in rng.sample(range(-50, 1000), n):
        base = rng.choice([[], *found.values()])
        turns = base[: rng.randrange(len(base) + 1)] + [rng.choice(letters) for _ in range(rng.randrange(longest))]
        found[conv] = base if rng.random() < 0.3 else turns
    return {c: [(t, len(t)) for t in turns] for c, turns in ((c, [t[0] if isinstance(t, tuple) else t for t in s]) for c, s in found.items())}


@pytest.mark.parametrize(
    ("seed", "n", "longest", "letters", "options"),
    [
        (1, 120, 6, ["a", "bb", "ccc"], {}),
        (2, 120, 9, ["a", "bb"], {"slab": 3, "container": 4, "chunk": 2}),
        (3, 60, 30, ["a"], {"slab": 4, "container": 1, "chunk": 1}),  # every conversation is a prefix of a longer one
        (4, 80, 4, [f"t{i}" for i in range(50)], {"slab": 1, "container": 8}),
    ],
)
def test_prefix_trie(spark, seed, n, longest, letters, options):
    sequences = random_sequences(seed, n, longest, letters)
    assert trie_of(spark, sequences, **options) == brute_trie(sequences)


def test_prefix_trie_of_copies(spark):
    """Thousands of copies and one very long conversation."""
    sequences = {c: [("a", 1), ("b", 2)] for c in range(3000)}
    sequences |= {5000: [(str(i), 3) for i in range(2000)], 5001: [], 5002: [(str(i), 3) for i in range(1500)]}
    assert trie_of(spark, sequences, container=2, chunk=100) == brute_trie(sequences)


def test_prefix_trie_of_little(spark):
    assert trie_of(spark, {}) == set()
    for sequences in ({7: []}, {7: [], 3: []}, {7: [("a", 0)]}):
        assert trie_of(spark, sequences) == brute_trie(sequences)


def test_conversations(spark, tmp_path):
    rng = random.Random(9)
    rows = [(None, 1, "user", "no conversation"), (3, None, None, None), (3, None, "user", ""), (3, 1, "user", "x"), (3, 1, "user", "x")]
    rows += [(3, 1, "bot", "y"), (-7, 2, "user", "ä"), (2**40, -1, "user", "z" * 100_000)]
    for conv in range(10, 60):
        turns = [(conv, t, rng.choice(["user", "bot"]), rng.choice("abc")) for t in range(rng.randrange(1, 15))]
        rows += rng.sample(turns, len(turns))
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    frame.withColumns({"depth": F.lit("x"), "size": F.lit(1)}).write.parquet(f"{tmp_path}/conversations.parquet")

    own = defaultdict(list)
    for conv, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        own[conv].append(((role or "", text or ""), len((text or "").encode())))
    sequences = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 9
        sequences[conv] = own.get(conv - int(np.fmod(conv, 5)), [])[:h] + turns[h:]
    found = QUERIES["op13_conversations"](spark, str(tmp_path)).select(*NAMES).collect()
    assert {tuple(r) for r in found} == brute_trie(sequences) and len(found) == len(brute_trie(sequences))


def test_conversations_without_rows(spark, tmp_path):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    frame.write.parquet(f"{tmp_path}/conversations.parquet")
    assert QUERIES["op13_conversations"](spark, str(tmp_path)).collect() == []


def test_new_queries_without_rows(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert QUERIES["op11_negatives"](spark, str(tmp_path)).collect() == []
    assert QUERIES["op12_pages"](spark, str(tmp_path)).collect() == []
