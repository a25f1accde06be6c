"""Secret scans with a random forest that removes false positives (operator 4), in DataFrame functions only.

Every run of at least ``MIN_CHARS`` characters that keys and tokens are made of is a finding. Most are words, paths, identifiers or
checksums. A forest judges each finding by its length, the changes between kinds of characters along it, how much of it
common letter groups of words cover, whether it looks like a path, and the words around it. It is trained from labelled findings.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from searchlog.llm.common import documents

MIN_CHARS = 20

#: Characters of keys and tokens.
_RUN = f"[A-Za-z0-9+/=_-]{{{MIN_CHARS},}}"

#: Letter groups that words are full of and random strings are not.
GROUPS = [
    "tion", "ment", "ing", "the", "and", "ent", "ion", "for", "tha", "ere", "con", "ver", "com", "pro", "ation",
    "est", "all", "res", "ter", "ed", "er", "in", "an", "re", "on", "at", "en", "or", "es", "is", "it", "al",
]

_SECRET_WORDS = "(?i)token|secret|passw|pwd|api|key|auth|bearer|credential|private"
_HARMLESS_WORDS = "(?i)commit|sha|md5|hash|digest|checksum|etag|uuid|example|sample|dummy|test|version|rev"

#: Labelled findings for the fit, at most.
MAX_TRAINING_ROWS = 4000

THRESHOLD = 0.5
SEED = 7

FEATURES = ["length", "changes", "kinds", "digits", "covered", "distinct", "path", "secret_before", "harmless_near", "assigned"]


def findings(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per finding: id, ``place`` (number of the word), ``nth`` in that word, ``candidate`` and the words around it.

    Texts are searched whole. Null and empty texts have no findings, and repeated rows give theirs again.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.col(text).alias("body")).filter(F.col("body").rlike(_RUN))
    # One row per word that holds a run, so that no row carries a whole text on.
    words = F.split("body", "[ \\t\\n\\r\\f\\x0B]+")
    placed = rows.select("id", words.alias("words"))
    hits = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.get("words", i).rlike(_RUN))
    around = F.transform(
        hits,
        lambda i: F.struct(
            i.alias("place"),
            F.get("words", i).alias("word"),
            F.coalesce(F.get("words", i - 1), F.lit("")).alias("before"),
            F.coalesce(F.get("words", i - 2), F.lit("")).alias("before2"),
            F.coalesce(F.get("words", i + 1), F.lit("")).alias("after"),
        ),
    )
    found = placed.select("id", F.inline(around))
    return found.select(
        "id", "place", "word", "before", "before2", "after",
        F.posexplode(F.regexp_extract_all("word", F.lit(_RUN), F.lit(0))).alias("nth", "candidate"),
    ).withColumnRenamed("id", id_column)


def with_features(found: DataFrame) -> DataFrame:
    c = F.col("candidate")
    length = F.char_length(c).cast("double")

    def share(pattern: str) -> Column:
        return F.regexp_count(c, F.lit(pattern)) / length

    borders = "(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[+/=_-])(?=[^+/=_-])"
    nearby = F.concat_ws(" ", "before2", "before", F.call_function("substring_index", F.col("word"), c.substr(1, 8), F.lit(1)))
    everything = F.concat_ws(" ", nearby, "after", c)
    uncovered = F.char_length(F.regexp_replace(F.lower(c), "|".join(sorted(GROUPS, key=len, reverse=True)), ""))

    def flag(condition: Column) -> Column:
        return condition.cast("double")

    kinds = sum((flag(c.rlike(k)) for k in ("[a-z]", "[0-9]", "[+/=_-]")), flag(c.rlike("[A-Z]")))
    return found.select(
        "*",
        length.alias("length"),
        share(borders).alias("changes"),
        kinds.alias("kinds"),
        share("[0-9]").alias("digits"),
        (1 - uncovered / length).alias("covered"),
        (F.size(F.array_distinct(F.split(c, ""))) / F.least(length, F.lit(64.0))).alias("distinct"),
        flag(c.rlike("/[a-z._-]+/") | F.col("word").rlike("://|\\.[a-z]{2,4}$")).alias("path"),
        flag(nearby.rlike(_SECRET_WORDS)).alias("secret_before"),
        flag(everything.rlike(_HARMLESS_WORDS)).alias("harmless_near"),
        flag(nearby.rlike("[=:]\\s*[\"']?$")).alias("assigned"),
    )


def labelled_findings(docs: DataFrame, id_column: str = "doc_id", max_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """Findings with a ``label``, made from documents' ids: secrets as code and settings hold them, and harmless look-alikes.

    Stands in for findings that people have labelled, of which there are none here; any table with these columns will do.
    """
    ids = docs.select(F.col(id_column).cast("string").alias("seed")).filter(F.col("seed").isNotNull())
    ids = ids.orderBy(F.xxhash64("seed"), "seed").limit(max_rows)
    hex_ = F.sha2("seed", 256)
    base = F.regexp_replace(F.base64(F.unhex(hex_)), "=", "")
    word = F.array_join(
        F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.element_at(F.array(*map(F.lit, GROUPS)), F.pmod(F.xxhash64("seed", i), F.lit(len(GROUPS))).cast("int") + 1)),
        "",
    )
    uuid = F.concat_ws("-", hex_.substr(1, 8), hex_.substr(9, 4), hex_.substr(13, 4), hex_.substr(17, 4), hex_.substr(21, 12))
    quote = F.lit('"')

    def row(label: int, before2: str, before: str, word_: Column, after: str) -> Column:
        return F.struct(
            F.lit(label).alias("label"), word_.alias("word"), F.lit(before).alias("before"),
            F.lit(before2).alias("before2"), F.lit(after).alias("after"),
        )

    kinds = [
        row(1, "token", "=", F.concat(quote, hex_.substr(1, 40), quote), "for"),
        row(1, "api_key", ":", F.concat(quote, base.substr(1, 32), quote), ","),
        row(1, "the", "secret", base, "in"),
        row(1, "password", "=", base.substr(3, 24), "host"),
        row(1, "Authorization:", "Bearer", F.concat(base.substr(1, 20), F.lit("_"), base.substr(21, 20)), ""),
        row(1, "set", "export", F.concat(F.lit("API_TOKEN="), hex_.substr(7, 32)), ""),
        row(0, "in", "commit", hex_.substr(1, 40), "fixed"),
        row(0, "sha256", "checksum", hex_, "of"),
        row(0, "request", "uuid", uuid, "was"),
        row(0, "of", "the", word, "and"),
        row(0, "the", "key", word, "to"),
        row(0, "see", "file", F.concat(F.lit("/usr/lib/"), word.substr(1, 12), F.lit("/"), word.substr(5, 12)), "for"),
        row(0, "token", "=", F.concat(quote, F.lit("EXAMPLE-"), F.repeat(F.lit("x"), F.lit(24)), quote), ""),
        row(0, "a", "-", F.repeat(F.lit("="), F.lit(40)), ""),
        row(0, "is", "a", F.upper(word), "or"),
        row(0, "number", "is", F.repeat(F.crc32("seed").cast("string"), F.lit(3)), "and"),
    ]
    pick = F.element_at(F.array(*kinds), F.pmod(F.xxhash64("seed", F.lit(SEED)), F.lit(len(kinds))).cast("int") + 1)
    made = ids.select(pick.alias("f")).select("f.*")
    return made.select("*", F.explode(F.regexp_extract_all("word", F.lit(_RUN), F.lit(0))).alias("candidate"))


def train(labelled: DataFrame) -> RandomForestClassificationModel | None:
    """A forest of twenty trees, at most eight questions deep; none without labelled findings."""
    rows = _assembled(with_features(labelled).withColumn("label", F.col("label").cast("double")))
    if rows.isEmpty():
        return None
    return RandomForestClassifier(
        featuresCol="features", labelCol="label", numTrees=20, maxDepth=8, seed=SEED
    ).fit(rows)


def _assembled(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)


def scan(
    docs: DataFrame, model: RandomForestClassificationModel | None, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """All findings of ``docs`` with ``probability`` and ``is_secret``. Columns of ``docs`` other than the two are not read.

    Without a model findings have no probability and count as secrets, as nothing tells them from others.
    """
    found = with_features(findings(docs, id_column, text))
    kept = [id_column, "place", "nth", "candidate", "before", "after"]
    if model is None:
        return found.select(*kept, F.lit(None).cast("double").alias("probability"), F.lit(True).alias("is_secret"))
    judged = model.transform(_assembled(found))
    return judged.select(*kept, F.round(vector_to_array("probability")[1], 9).alias("probability")).withColumn(
        "is_secret", F.col("probability") >= THRESHOLD
    )


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    found = scan(docs, train(labelled_findings(docs)))
    return found.select(
        "doc_id", "place", "nth", F.sha2("candidate", 256).alias("candidate_sha256"),
        F.char_length("candidate").alias("length"), "probability", "is_secret",
    )
