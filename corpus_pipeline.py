"""Cleaning ``documents`` for training, stage by stage; each stage reads what the one before it has written.

Toxic documents go; repeated lines go, and documents that held nothing else; one document of each near-duplicate group
stays; documents that hold benchmark passages go; what is left is encoded, with a check that decoding gives the text back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from searchlog.llm import bpe, decontaminate, lines, simhash, toxicity
from searchlog.llm.common import row_key, written


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that score as toxic (operator 9); all others as they are."""
    return toxicity.without_toxic(docs, *toxicity.production_grammar(spark, docs, sf_dir))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated lines (operator 8). A document of which nothing is left was a copy throughout and goes.

    So does an exact copy that lost lines: its short lines, which operator 8 leaves alone, are all in the first copy.
    """
    keyed = docs.withColumns({"_copy_row": row_key("doc_id", "text"), "_copy_text": F.unhex(F.md5("text"))})
    cleaned = lines.without_repeated_lines(keyed)
    place = F.struct("doc_id", "_copy_row")
    first = keyed.filter(F.col("text").isNotNull()).groupBy("_copy_text").agg(F.min(place).alias("_first"), F.max(place).alias("_last"))
    first = first.filter(F.col("_first") != F.col("_last")).select("_copy_text", "_first")
    copy = F.col("_first").isNotNull() & (F.col("n_removed") > 0) & (place != F.col("_first"))
    cleaned = cleaned.join(first, "_copy_text", "left").filter(~F.coalesce(copy, F.lit(False)))
    emptied = (F.col("n_removed") > 0) & ~F.col("text").rlike("[^ \\t\\n\\r\\f\\x0B]")
    changed = F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return cleaned.filter(~F.coalesce(emptied, F.lit(False))).withColumn("n_chars", changed).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of equal or nearly equal fingerprints (operator 3)."""
    return simhash.one_of_each(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that test items contaminate (operator 10); all others as they are."""
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text (operator 1), and whether they decode to it."""
    tokens = bpe.with_tokens(docs, bpe.production_codec(spark))
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return tokens.select(
        "doc_id",
        "lang",
        "source",
        F.size("token_ids").cast("long").alias("n_tokens"),
        "token_ids",
        (F.col("decoded") == text).alias("round_trip"),
    )


STAGES = [
    ("toxicity", toxic_documents),
    ("line dedup", repeated_lines),
    ("near duplicates", near_duplicates),
    ("decontamination", benchmark_passages),
    ("token ids", token_ids),
]

#: SQL can express neither the toxicity scores nor the token ids; tests/llm/test_pipeline.py checks the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
