"""Toxicity by a weighted finite-state pattern grammar (operator 9).

A lexicon transducer turns the words of a clause into word classes: insult, threat, stem, target, negation, report, other. Stems
are beginnings of words that labelled toxic documents hold far more often than others do; they are learned, and give the
grammar words of which no list knows. Four small transducers read the classes. Each keeps a state of its own and adds a mark to
an insult, threat or stem that it accepts: negated (a negation shortly before), reported (a verb of saying earlier in the
clause), aimed (a person shortly before or after; for those after, the transducer reads the clause from its end), repeated (not
the first of the clause). Their composition is one machine over tuples of states, built from the transducers as clauses need
it. What it gives for a clause is its matched patterns, such as ``insult+aimed``; every composed pattern has a weight. A
document is scored by its matched clauses and by how dense they are, and the weights start from the grammar's own and
are fitted on labelled documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from searchlog.llm.common import ALNUM, bounded_batches, documents, written

INSULTS = [
    "idiot", "idiots", "idiotic", "moron", "morons", "moronic", "stupid", "stupidity", "dumb", "dumbass", "fool",
    "fools", "loser", "losers", "clown", "clowns", "scum", "scumbag", "trash", "garbage", "worthless", "pathetic",
    "disgusting", "filthy", "vermin", "parasite", "parasites", "imbecile", "cretin", "jerk", "creep", "freak", "pig",
    "swine", "coward", "liar", "bastard", "asshole", "bitch", "shit", "crap", "fuck", "fucking", "retard",
    "retarded", "whore", "slut", "idiota", "imbécil", "estúpido", "estúpida", "basura", "escoria", "asqueroso",
    "patético", "inútil", "payaso", "imbécile", "crétin", "stupide", "abruti", "connard", "salaud", "ordure",
    "déchet", "minable", "dummkopf", "trottel", "abschaum", "arschloch", "widerlich", "wertlos", "erbärmlich",
    "blöd", "schwachkopf",
]
THREATS = [
    "kill", "murder", "destroy", "hurt", "punch", "stab", "shoot", "beat", "strangle", "hang", "burn", "matar",
    "mataré", "muere", "tuer", "tuerai", "crève", "töten", "umbringen", "stirb",
]
TARGETS = [
    "you", "your", "yours", "yourself", "u", "ur", "he", "him", "his", "she", "her", "they", "them", "their",
    "these", "those", "people", "everyone", "tú", "te", "ti", "usted", "ustedes", "tu", "toi", "vous", "ton",
    "votre", "du", "dich", "dir", "ihr", "sie", "euch",
]
NEGATIONS = [
    "not", "no", "never", "none", "neither", "nor", "cannot", "dont", "isnt", "arent", "wasnt", "nunca", "ningún",
    "jamais", "aucun", "nie", "niemals", "kein", "keine",
]
REPORTS = [
    "said", "says", "say", "saying", "wrote", "writes", "quoted", "quote", "called", "claims", "claimed", "reported",
    "dijo", "dice", "dit", "disait", "sagte", "schrieb",
]

#: Words over which a negation or a person reaches.
REACH = 4

#: At most so many labelled rows, by hash of their ids, fit the weights.
MAX_TRAINING_ROWS = 20_000

#: Learned stems, at most; their characters; toxic documents that must hold one, how many times oftener than others, and the
#: likelihood ratio from which that isn't chance.
MAX_STEMS, STEM_CHARS, STEM_SUPPORT, STEM_RATIO, STEM_EVIDENCE = 256, range(4, 9), 5, 5.0, 25.0

#: Words whose classes a worker remembers before it starts anew; only speed depends on it.
KNOWN_WORDS = 50_000

#: Weight of one matched clause before any label is seen, the sum over its pattern's parts, and of none.
PRIOR = {
    "insult": 2.5,
    "threat": 1.5,
    "stem": 0.5,
    "aimed": 1.0,
    "repeated": 0.5,
    "negated": -1.0,
    "reported": -0.5,
}
PRIOR_BIAS = -3.0

CLASSES = {
    **dict.fromkeys((w.encode() for w in REPORTS), "report"),
    **dict.fromkeys((w.encode() for w in NEGATIONS), "negation"),
    **dict.fromkeys((w.encode() for w in TARGETS), "target"),
    **dict.fromkeys((w.encode() for w in THREATS), "threat"),
    **dict.fromkeys((w.encode() for w in INSULTS), "insult"),
}
CORE = ("insult", "threat", "stem")

#: Ends of clauses.
_ENDS = bytes(0x0A if chr(b) in ".!?;:\n\r" else b for b in range(256))


# Transducers: (state, word class) to (next state, mark or None). All start in state 0.


def _negation(state: int, kind: str) -> tuple[int, str | None]:
    """Counts down the reach of the last negation."""
    if kind == "negation":
        return REACH, None
    return max(0, state - 1), "negated" if state else None


def _report(state: int, kind: str) -> tuple[int, str | None]:
    """A verb of saying covers the rest of its clause."""
    return (1, None) if kind == "report" else (state, "reported" if state else None)


def _aim(state: int, kind: str) -> tuple[int, str | None]:
    """A person within reach before the word."""
    if kind == "target":
        return REACH, None
    return max(0, state - 1), "aimed" if state else None


def _repeat(state: int, kind: str) -> tuple[int, str | None]:
    """The second insult or threat of a clause and those after it."""
    if kind in CORE:
        return 1, "repeated" if state else None
    return state, None


TRANSDUCERS = (_negation, _report, _aim, _repeat)
_steps: dict[tuple[tuple[int, ...], str, bool], tuple[tuple[int, ...], str | None]] = {}


class Lexicon(dict):
    """The lexicon transducer: classes of words, of which listed words come before learned stems."""

    def __init__(self, stems: tuple[str, ...] = ()) -> None:
        super().__init__(CLASSES)
        self.stems = tuple(stem.encode() for stem in stems)

    def __missing__(self, word: bytes) -> str:
        kind = "stem" if self.stems and word.startswith(self.stems) else "other"
        if len(self) > KNOWN_WORDS:
            self.clear()
            self.update(CLASSES)
        self[word] = kind
        return kind


_lexicons: dict[tuple[str, ...], Lexicon] = {}


def lexicon(stems: tuple[str, ...] = ()) -> Lexicon:
    """The lexicon of these stems, once per process."""
    if stems not in _lexicons:
        _lexicons.clear()
        _lexicons[stems] = Lexicon(stems)
    return _lexicons[stems]


def step(states: tuple[int, ...], kind: str, aimed: bool = False) -> tuple[tuple[int, ...], str | None]:
    """One step of the composition: the next states and the pattern, if the class is one that patterns are about.

    ``aimed`` is what the aim transducer gives for the word from the clause's end.
    """
    known = _steps.get((states, kind, aimed))
    if known is None:
        results = [transducer(state, kind) for transducer, state in zip(TRANSDUCERS, states)]
        marks = {mark for _, mark in results if mark} | ({"aimed"} if aimed else set())
        pattern = "+".join([kind, *[mark for mark in MARKS if mark in marks]]) if kind in CORE else None
        known = _steps[states, kind, aimed] = tuple(state for state, _ in results), pattern
    return known


def patterns_of(kinds: list[str]) -> list[str]:
    """Patterns of one clause, given by its word classes, in order."""
    after, state = [], 0
    for kind in reversed(kinds):
        state, mark = _aim(state, kind)
        after.append(mark is not None)
    states, found = (0,) * len(TRANSDUCERS), []
    for kind, aimed in zip(kinds, reversed(after), strict=True):
        states, pattern = step(states, kind, aimed)
        if pattern:
            found.append(pattern)
    return found


def clause_patterns(words: list[bytes], stems: tuple[str, ...] = ()) -> list[str]:
    """Patterns of one clause, given by its words, in order."""
    return patterns_of(list(map(lexicon(stems).__getitem__, words)))


MARKS = ("negated", "reported", "aimed", "repeated")
PATTERNS = ["+".join([kind, *marks]) for kind in CORE for n in range(len(MARKS) + 1) for marks in combinations(MARKS, n)]

#: Clauses with each composed pattern, all matched clauses, those beyond the first, and matched words in a thousand words.
FEATURES = [*PATTERNS, "matched", "several", "dense"]
_PLACE = {name: n for n, name in enumerate(FEATURES)}


def features(text: str | None, stems: tuple[str, ...] = ()) -> list[float]:
    """Log counts of the matched clauses. Texts without an insult, threat or stem, null ones included, have zeros only."""
    values = [0.0] * len(FEATURES)
    if not text:
        return values
    classes, data = lexicon(stems), text.encode()
    words = data.translate(ALNUM).split()
    matched_words = sum(kind in CORE for kind in map(classes.__getitem__, words))
    if not matched_words:
        return values
    counts: Counter = Counter()
    for clause in data.translate(_ENDS).split(b"\n"):
        kinds = list(map(classes.__getitem__, clause.translate(ALNUM).split()))
        found = set(patterns_of(kinds)) if not _core.isdisjoint(kinds) else ()
        counts.update(found)
        counts["matched"] += bool(found)
    counts["several"] = max(0, counts["matched"] - 1)
    counts["dense"] = 1000 * matched_words / len(words)
    for name, count in counts.items():
        values[_PLACE[name]] = math.log1p(count)
    return values


_core = frozenset(CORE)


def prior() -> np.ndarray:
    """Weights of the features, then the bias, before labels."""
    return np.array([sum(PRIOR.get(part, 0.0) for part in name.split("+")) for name in FEATURES] + [PRIOR_BIAS])


def fit(rows: np.ndarray, labels: np.ndarray, strength: float = 0.5, rounds: int = 50) -> np.ndarray:
    """Logistic weights by Newton's method, drawn to the grammar's own weights; those themselves without rows."""
    start = weights = prior()
    if not len(rows):
        return weights
    x = np.column_stack([rows, np.ones(len(rows))])
    pull = np.full(len(weights), strength)
    pull[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        gradient = x.T @ (p - labels) + pull * (weights - start)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(pull)
        move = np.linalg.solve(hessian, gradient)
        weights = weights - np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-8:
            break
    return weights


def _feature_column(stems: tuple[str, ...]):
    def column(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array([features(text.as_py(), stems) for text in batch], pa.list_(pa.float64()))

    return F.arrow_udf(column, T.ArrayType(T.DoubleType()))


def _stems(words: Iterable[bytes]) -> set[str]:
    return {word[:n] for word in (w.decode() for w in words) for n in STEM_CHARS if len(word) >= n}


def _stem_column(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in texts:
        found = [sorted(_stems(set((text.as_py() or "").encode().translate(ALNUM).split()))) for text in batch]
        yield pa.array(found, pa.list_(pa.string()))


def labelled_texts(
    docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``_text`` and ``_toxic`` of at most ``max_rows`` labels, chosen by hash of the id, as a stored table.

    Labels that are null or belong to no document are left out.
    """
    known = labels.select(F.col(id_column).alias("_id"), F.col("toxic").alias("_toxic"))
    known = known.filter(F.col("_toxic").isNotNull() & F.col("_id").isNotNull())
    chosen = known.orderBy(F.xxhash64("_id"), "_id", "_toxic").limit(max_rows)
    # The chosen labels are bounded, so they may go to every task.
    found = docs.select(F.col(id_column).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id")
    return written(found.select("_text", "_toxic"), "labelled-texts")


def learn_stems(labelled: DataFrame, most: int = MAX_STEMS) -> tuple[str, ...]:
    """Beginnings of words that tell toxic texts (``labelled_texts``) from others, the strongest first; none without both kinds.

    Evidence is the likelihood ratio of the documents with the stem among toxic and other ones. Of stems that begin with each
    other the strongest one stays.
    """
    bounded_batches(labelled.sparkSession)
    sizes = labelled.agg(F.count_if(F.col("_toxic") == 1), F.count_if(F.col("_toxic") != 1)).first()
    toxic, other = (float(n) for n in sizes)
    if not toxic or not other:
        return ()
    stems = labelled.select(F.explode(F.arrow_udf(_stem_column, "array<string>")("_text")).alias("stem"), "_toxic")
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    counts = stems.groupBy("stem").agg(F.count_if(F.col("_toxic") == 1).alias("a"), F.count_if(F.col("_toxic") != 1).alias("b"))
    counts = counts.filter((a >= STEM_SUPPORT) & (a / toxic >= STEM_RATIO * (b + 0.5) / other))

    def likelihood(hits: Column, of: float, rate: Column) -> Column:
        return F.when(hits > 0, hits * F.log(rate)).otherwise(0.0) + F.when(hits < of, (of - hits) * F.log1p(-rate)).otherwise(0.0)

    both = (a + b) / (toxic + other)
    apart = likelihood(a, toxic, a / toxic) + likelihood(b, other, b / other)
    evidence = 2 * (apart - likelihood(a, toxic, both) - likelihood(b, other, both))
    strongest = counts.withColumn("evidence", F.round(evidence, 6)).filter(F.col("evidence") >= STEM_EVIDENCE)
    # Stems of one word come in as many lengths as there are, which is all that can be in the way of others.
    found = strongest.orderBy(F.desc("evidence"), "stem").limit(most * len(STEM_CHARS)).select("stem").collect()
    kept: list[str] = []
    for (stem,) in found:
        if len(kept) < most and not any(stem.startswith(other_) or other_.startswith(stem) for other_ in kept):
            kept.append(stem)
    return tuple(kept)


def fit_weights(labelled: DataFrame, stems: tuple[str, ...] = ()) -> np.ndarray:
    """Weights from labelled texts; without any the grammar keeps its own."""
    bounded_batches(labelled.sparkSession)
    rows = labelled.select(_feature_column(stems)("_text").alias("x"), F.col("_toxic").cast("double").alias("y")).collect()
    return fit(np.array([r["x"] for r in rows]).reshape(len(rows), len(FEATURES)), np.array([r["y"] for r in rows]))


def train(
    docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS, id_column: str = "doc_id", text: str = "text"
) -> np.ndarray:
    """Weights of the listed words' patterns from ``labels`` (id and ``toxic`` 0 or 1), see ``labelled_texts``."""
    return fit_weights(labelled_texts(docs, labels, max_rows, id_column, text))


def with_toxicity(
    docs: DataFrame, weights: np.ndarray, stems: tuple[str, ...] = (), text: str = "text", score: str = "score"
) -> DataFrame:
    """Every row with the probability that its text is toxic.

    Whole texts are read, nothing is shuffled. Null and empty texts score like texts without any match. An input column named
    like the score is replaced; repeated rows stay repeated; an empty table gives an empty one.
    """
    bounded_batches(docs.sparkSession)
    values = [float(w) for w in weights]

    def score_all(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        w = np.array(values)
        for batch in texts:
            x = np.array([features(value.as_py(), stems) for value in batch]).reshape(len(batch), len(FEATURES))
            yield pa.array(1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30))), pa.float64())

    return docs.withColumn(score, F.arrow_udf(score_all, "double")(F.col(text)))


#: Score from which a document counts as toxic.
THRESHOLD = 0.7


def held_out(of: int, rest: int, id_column: str = "doc_id"):
    return F.pmod(F.crc32(F.col(id_column).cast("string")), F.lit(of)) == rest


def production_grammar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> tuple[np.ndarray, tuple[str, ...]]:
    """Weights and stems, learned from the labels that aren't held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    labelled = labelled_texts(docs, labels.filter(~held_out(3, 1)))
    stems = learn_stems(labelled)
    return fit_weights(labelled, stems), stems


def without_toxic(
    docs: DataFrame, weights: np.ndarray, stems: tuple[str, ...] = (), threshold: float = THRESHOLD
) -> DataFrame:
    """The documents that score below the threshold, unchanged."""
    rows = docs.select(F.struct(*docs.columns).alias("_doc"), F.col("text").alias("_text"))
    return with_toxicity(rows, weights, stems, "_text", "_score").filter(F.col("_score") < threshold).select("_doc.*")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    scored = with_toxicity(docs, *production_grammar(spark, docs, sf_dir))
    return scored.select(
        "doc_id",
        F.coalesce(held_out(3, 1), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
