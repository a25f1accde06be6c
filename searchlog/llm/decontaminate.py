"""Benchmark decontamination by a generalised suffix automaton (operator 10).

The normalised test items make one suffix automaton over word numbers. A document's words are streamed through it: each word
either extends the longest match or shortens it along suffix links. Where the match reaches the window length, the words of that
window are hit, and the automaton's state names the items that hold it. Runs of words that occur in no item can't take part in
a match, so only runs of known words that are long enough enter the stream.

The items are broadcast and each worker builds the automaton once. A large benchmark is dealt into shards of about
``SHARD_WORDS`` words, so that a broadcast and an automaton have a bounded size whatever the size of the benchmark; documents
then pass one shard after the other, without a shuffle.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from searchlog.llm.common import LOWER, alnum_words, bounded_batches, documents

WINDOW = 13

#: Words of the test items behind one automaton, on average over the shards.
SHARD_WORDS = 200_000

#: A document is contaminated if hit words are at least one in so many.
COVERAGE = 20


class SuffixAutomaton:
    """All runs of words of some items. ``windows`` marks where a window ends: by state, its length and its items."""

    def __init__(self, items: Iterable[tuple[int, list[bytes]]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        numbered = []
        for item_id, words in items:
            if words:
                numbered.append((item_id, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]))
        for _, words in numbered:
            last = 0  # an item starts at the root again, so no run goes from one item into the next
            for word in words:
                last = self._extend(last, word)
        self.shortest = min([window, *(len(words) for _, words in numbered)])
        self.windows: dict[int, dict[int, set[int]]] = {}
        for item_id, words in numbered:
            size = min(window, len(words))
            for end, (state, length) in enumerate(self.matches(words)):
                if end + 1 >= size:
                    self.windows.setdefault(self._at_length(state, size), {}).setdefault(size, set()).add(item_id)
        self._gather()

    def _copy(self, state: int, length: int) -> int:
        self.next.append(dict(self.next[state]))
        self.length.append(length)
        self.link.append(self.link[state])
        return len(self.length) - 1

    def _split(self, state: int, word: int) -> int:
        """The state one word on, cut off from a longer one where that is needed."""
        target = self.next[state][word]
        if self.length[target] == self.length[state] + 1:
            return target
        clone = self._copy(target, self.length[state] + 1)
        self.link[target] = clone
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = clone
            state = self.link[state]
        return clone

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split(last, word)
        new = len(self.length)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        state = last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._split(state, word)
        return new

    def _at_length(self, state: int, size: int) -> int:
        """The state that holds the last ``size`` words of a match."""
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state

    def _gather(self) -> None:
        """By state, the windows that end its runs: its own and those of the states it links to."""
        self.ending: list[tuple[tuple[int, frozenset[int]], ...]] = [()] * len(self.length)
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            own = tuple((size, frozenset(ids)) for size, ids in sorted(self.windows.get(state, {}).items()))
            self.ending[state] = self.ending[self.link[state]] + own

    def matches(self, words: list[int]) -> Iterable[tuple[int, int]]:
        """State and length of the longest match that ends at each word."""
        following, link, length = self.next, self.link, self.length
        state = matched = 0
        for word in words:
            while word not in following[state] and state:
                state = link[state]
                matched = length[state]
            if word in following[state]:
                state = following[state][word]
                matched += 1
            yield state, matched

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """The spans of words that windows cover, and the items of those windows."""
        known = self.vocabulary.get
        numbers = np.array([known(w, -1) for w in words], np.int64)
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (numbers >= 0).astype(np.int8), [0]))))
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        for start, end in edges.reshape(-1, 2):
            if end - start < self.shortest:
                continue
            for at, (state, matched) in enumerate(self.matches(numbers[start:end].tolist()), start + 1):
                for size, ids in self.ending[state]:
                    if size <= matched:
                        first, end_word = int(at) - size, int(at)
                        while spans and first <= spans[-1][1]:
                            first = min(first, spans.pop()[0])
                        spans.append((first, end_word))
                        items |= ids
        return spans, items


_built: dict[str, SuffixAutomaton] = {}


def _automaton(key: str, items: Broadcast, window: int) -> SuffixAutomaton:
    """The automaton of one shard, built once in a worker that has no other."""
    if key not in _built:
        _built.clear()
        _built[key] = SuffixAutomaton(items.value, window)
    return _built[key]


def _shard_items(benchmark: DataFrame, item_id: str, text: str, shard_words: int) -> Iterator[list]:
    """The items of one shard after the other, as the driver needs no more than one at a time."""
    words = F.regexp_count(F.col(text), F.lit("[^\\x00-\\x20]+"))
    total = benchmark.agg(F.sum(words)).first()[0] or 0
    n = max(1, -(-total // shard_words))
    items = benchmark.select(F.col(item_id).cast("long").alias("item"), F.col(text).alias("item_text"))
    for shard in range(n):
        rows = items.filter(F.pmod(F.xxhash64("item", "item_text"), F.lit(n)) == shard)
        yield [(row["item"], alnum_words(row["item_text"])) for row in rows.collect()]


_SPAN = pa.struct([("first", pa.int64()), ("end", pa.int64())])


def _united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, end in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((first, end))
    return out


_KIND = "struct<n_words:bigint,spans:array<struct<first:bigint,end:bigint>>,item_ids:array<bigint>>"
_NAMES = ["n_words", "spans", "item_ids"]


def _scan(items: Broadcast, window: int) -> Callable[..., Column]:
    """Adds what the items of one shard hit to what the shards before hit."""

    key = uuid.uuid4().hex

    @F.arrow_udf(_KIND)
    def scan(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        automaton = _automaton(key, items, window)
        for texts, before in batches:
            counts, all_spans, all_ids = [], [], []
            for value, known in zip(texts, before.to_pylist()):
                words = alnum_words(value.as_py())
                spans, ids = automaton.hits(words)
                if known:
                    spans = _united(spans + [(s["first"], s["end"]) for s in known["spans"]])
                    ids = ids.union(known["item_ids"])
                counts.append(len(words))
                all_spans.append([{"first": first, "end": end} for first, end in spans])
                all_ids.append(sorted(i for i in ids if i is not None))
            yield pa.StructArray.from_arrays(
                [
                    pa.array(counts, pa.int64()),
                    pa.array(all_spans, pa.list_(_SPAN)),
                    pa.array(all_ids, pa.list_(pa.int64())),
                ],
                _NAMES,
            )

    return scan


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """Every document row with ``n_words``, ``spans`` (first word and end of each run of hit words) and ``item_ids``.

    Words are runs of a-z, 0-9 and characters beyond ASCII after lower-casing A-Z. Null and empty texts have no words, items
    without words have no window, and an empty benchmark hits nothing. Repeated documents stay repeated; equal items all
    count. An input column that has the name of a result column is replaced. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    result = docs
    for shard, found in enumerate(_shard_items(benchmark, item_id, item_text, shard_words)):
        items = spark.sparkContext.broadcast(found)

        before = F.col("_hits") if shard else F.lit(None).cast(_KIND)
        result = result.withColumn("_hits", _scan(items, window)(F.col(text), before))
    kept = [c for c in docs.columns if c not in _NAMES]
    return result.select(*kept, *[F.col("_hits")[name].alias(name) for name in _NAMES])


def n_hit() -> Column:
    """Hit words of a row of ``contamination``."""
    return F.aggregate("spans", F.lit(0).cast("long"), lambda sum_, span: sum_ + span["end"] - span["first"])


def is_contaminated() -> Column:
    return (n_hit() > 0) & (COVERAGE * n_hit() >= F.col("n_words"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents whose hit words stay below the coverage limit, unchanged."""
    judged = contamination(docs.select(F.struct(*docs.columns).alias("_doc"), F.col(text).alias("_text")), benchmark, "_text")
    return judged.filter(~is_contaminated()).select("_doc.*")


_WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")


def cut(text: str | None, spans: list[dict] | None, longest: int = 0) -> str | None:
    """The text without the spans of more than ``longest`` words, from a span's first letter to its last."""
    if not text or not spans:
        return text
    lowered = text.encode().translate(LOWER).decode()
    places = [match.span() for match in _WORD.finditer(lowered)]
    kept, at = [], 0
    for span in spans:
        if span["end"] - span["first"] > longest:
            kept.append(text[at : places[span["first"]][0]])
            at = places[span["end"] - 1][1]
    return "".join(kept) + text[at:]


def without_spans(contaminated: DataFrame, text: str = "text", longest: int = 0) -> DataFrame:
    """Rows of ``contamination`` with the hit spans longer than ``longest`` words cut out of their texts."""

    @F.arrow_udf("string")
    def cut_all(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([cut(t, s, longest) for t, s in zip(texts.to_pylist(), spans.to_pylist())], pa.string())

    return contaminated.withColumn(text, cut_all(F.col(text), F.col("spans")))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = contamination(documents(spark, sf_dir, "doc_id", "text"), benchmark)
    ids = F.array_sort(F.col("item_ids").cast("array<string>"))
    return found.select(
        "doc_id",
        "n_words",
        n_hit().alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
    )
