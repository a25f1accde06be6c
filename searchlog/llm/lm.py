"""Language-model scores by deleted interpolation (operator 6).

The probability of a word after another one mixes three estimates: how often the pair followed the first word, how often the
word occurs at all, and one over the number of words. The mixture depends on how frequent the first word is (a bucket for each
power of two). Its weights are learned by expectation-maximisation on held-out counts: a tenth of the training
documents is taken out of the counts, and their words are predicted by the rest. Scores use all training documents.

Counting and looking up are one exchange. Documents are dealt to blocks of a few megabytes. A block reduces its words and
pairs to distinct 64-bit hashes with counts, cuts the sorted hashes into ranges and sends each range, packed, to the bucket
that owns it. A bucket adds up what all blocks sent and answers each block with the totals of its hashes, in their
order. Hashes and totals travel as packed arrays, and both blocks and buckets grow in number with the text, not in size.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from searchlog.llm.common import bounded_batches, documents, lower_words, row_key, written

BLOCK_BYTES = 8 << 20

#: Buckets of context frequency: 0 for unseen, then one for each power of two.
LEVELS = 40

#: Steps of the grid, per factor of two, on which held-out estimates are counted for the weights.
GRID = 4

ROUNDS = 50

_END = np.uint64(xxhash.xxh64_intdigest(b" end"))
_START = np.uint64(xxhash.xxh64_intdigest(b" start"))
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xBF58476D1CE4E5B9)


def _pack(values: np.ndarray) -> bytes:
    """Unsigned numbers, byte plane by byte plane, so that leading zeros cost nothing."""
    width = values.dtype.itemsize
    return zstandard.ZstdCompressor(level=1).compress(values.view(np.uint8).reshape(-1, width).T.tobytes())


def _unpack(data: bytes, dtype: type) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, -1).T).reshape(-1).view(dtype)


def _pack_sorted(hashes: np.ndarray) -> bytes:
    return _pack(np.diff(hashes, prepend=np.uint64(0)))


def _unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data, np.uint64), dtype=np.uint64)


def is_held_out(doc_id: int | None) -> bool:
    """Documents that nothing is learned from."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


class Tokens:
    """Word and pair hashes of a block's documents, one after another; each document closes with its end."""

    def __init__(self, table: pa.Table):
        ids = table.column("id").to_pylist()
        parts, lengths = [], []
        for value in table.column("text"):
            tokens = lower_words(value.as_py())
            hashes = np.empty(len(tokens) + 1, np.uint64)
            hashes[:-1] = np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, len(tokens))
            hashes[-1] = _END
            parts.append(hashes)
            lengths.append(len(hashes))
        self.ids, self.lengths = ids, np.array(lengths)
        self.words = np.concatenate(parts)
        before = np.empty_like(self.words)
        before[1:] = self.words[:-1]
        self.firsts = np.cumsum(self.lengths) - self.lengths
        before[self.firsts] = _START
        pairs = (before * _MIX) ^ (self.words + (before >> np.uint64(29)))
        self.pairs = (pairs ^ (pairs >> np.uint64(32))) * _MIX2
        self.held_out = np.array([is_held_out(i) for i in ids])

    def spread(self, per_document: np.ndarray) -> np.ndarray:
        return np.repeat(per_document, self.lengths)

    def sums(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.firsts)


_REQUEST = "block int, bucket int, words binary, word_counts binary, pairs binary, pair_counts binary"
_REPLY = "block int, bucket int, word_train binary, word_deleted binary, pair_train binary, pair_deleted binary"


def _requests(block: int, tokens: Tokens, buckets: int) -> pa.Table:
    """A row for each bucket with the block's hashes in its range and how often training documents have them."""
    train = tokens.spread(~tokens.held_out)
    columns: dict[str, list] = {"block": [block] * buckets, "bucket": list(range(buckets))}
    edges = (np.arange(1, buckets, dtype=object) * (1 << 64) // buckets).astype(np.uint64)
    for name, hashes in (("word", tokens.words), ("pair", tokens.pairs)):
        unique, of = np.unique(hashes, return_inverse=True)
        counts = np.bincount(of, train, len(unique)).astype(np.uint32)
        cuts = [0, *np.searchsorted(unique, edges).tolist(), len(unique)]
        ranges = list(zip(cuts, cuts[1:]))
        columns[f"{name}s"] = [_pack_sorted(unique[a:b]) for a, b in ranges]
        columns[f"{name}_counts"] = [_pack(counts[a:b]) for a, b in ranges]
    return _table(columns)


def _table(columns: dict[str, list]) -> pa.Table:
    kinds = {"block": pa.int32(), "bucket": pa.int32()}
    return pa.table({name: pa.array(values, kinds.get(name, pa.binary())) for name, values in columns.items()})


def _replies(requests: pa.Table, blocks: int) -> pa.Table:
    """Totals for each block's hashes, and the bucket's own sums under block -1.

    Blocks from ``blocks`` on hold the deleted documents; only they need to know the totals of those.
    """
    bucket, asking = requests.column("bucket")[0].as_py(), requests.column("block").to_pylist()
    columns: dict[str, list] = {"block": [*asking, -1], "bucket": [bucket] * (len(asking) + 1)}
    sums = []
    for name in ("word", "pair"):
        asked = [_unpack_sorted(data) for data in requests.column(f"{name}s").to_pylist()]
        unique, of = np.unique(np.concatenate(asked), return_inverse=True)
        ends = np.cumsum([len(a) for a in asked])[:-1]
        counts = [_unpack(data, np.uint32) for data in requests.column(f"{name}_counts").to_pylist()]
        train = np.bincount(of, np.concatenate(counts), len(unique)).astype(np.uint64)
        counts = [c if block >= blocks else np.zeros_like(c) for c, block in zip(counts, asking)]
        deleted = np.bincount(of, np.concatenate(counts), len(unique)).astype(np.uint64)
        columns[f"{name}_train"] = [_pack(part) for part in np.split(train[of], ends)]
        columns[f"{name}_deleted"] = [
            _pack(part) if block >= blocks else b"" for part, block in zip(np.split(deleted[of], ends), asking)
        ]
        if name == "word":
            kept = train - deleted
            sums = [np.count_nonzero(train), train.sum(), np.count_nonzero(kept), kept.sum()]
    own = {"word_train": _pack(np.array(sums, np.uint64))}
    for name in ("word_train", "word_deleted", "pair_train", "pair_deleted"):
        columns[name].append(own.get(name, b""))
    return _table(columns)


class Counts:
    """A block's tokens with the totals of the whole corpus."""

    def __init__(self, docs: pa.Table, replies: pa.Table):
        self.tokens = Tokens(docs)
        replies = replies.sort_by("bucket")
        deleted = bool(replies.num_rows and replies.column("word_deleted")[0].as_py())
        self.columns = {}
        for name, hashes in (("word", self.tokens.words), ("pair", self.tokens.pairs)):
            _, of = np.unique(hashes, return_inverse=True)
            for what in ("train", "deleted") if deleted else ("train",):
                parts = [_unpack(data, np.uint64) for data in replies.column(f"{name}_{what}").to_pylist()]
                self.columns[name, what] = np.concatenate(parts)[of].astype(np.float64)

    def of(self, kept: bool, documents: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts of each token's word, of the word before and of the pair; all training documents or those kept."""
        word, pair = self.columns["word", "train"], self.columns["pair", "train"]
        if kept:
            word, pair = word - self.columns["word", "deleted"], pair - self.columns["pair", "deleted"]
        before = np.empty_like(word)
        before[1:] = word[:-1]
        before[self.tokens.firsts] = documents
        return word, before, pair


def _estimates(word: np.ndarray, before: np.ndarray, pair: np.ndarray, total: float, types: float):
    return np.divide(pair, before, out=np.zeros_like(pair), where=before > 0), word / max(total, 1), 1 / (types + 1)


def level(before: np.ndarray) -> np.ndarray:
    """Bucket of a context's frequency."""
    return np.minimum(np.frexp(before)[1], LEVELS - 1)


def _on_grid(p: np.ndarray) -> np.ndarray:
    return np.where(p > 0, np.round(np.log2(np.maximum(p, 1e-300)) * GRID), 1).astype(np.int32)


def _off_grid(cell: np.ndarray) -> np.ndarray:
    return np.where(cell > 0, 0.0, 2.0 ** (np.minimum(cell, 0) / GRID))


def learn_weights(cells: np.ndarray, base: float, rounds: int = ROUNDS) -> np.ndarray:
    """Weights of pair, word and base estimate by level, from rows of level, pair cell, word cell and count.

    Levels without held-out words keep the weights of the level below, as frequencies next to each other mix alike.
    """
    weights = np.full((LEVELS, 3), 1 / 3)
    if not len(cells):
        return weights
    levels, n = cells[:, 0].astype(int), cells[:, 3].astype(float)
    p = np.column_stack([_off_grid(cells[:, 1]), _off_grid(cells[:, 2]), np.full(len(cells), base)])
    for _ in range(rounds):
        share = p * weights[levels]
        share *= (n / share.sum(axis=1))[:, None]
        sums = np.zeros((LEVELS, 3))
        np.add.at(sums, levels, share)
        seen = sums.sum(axis=1) > 0
        weights[seen] = (sums[seen] + 1e-3) / (sums[seen] + 1e-3).sum(axis=1, keepdims=True)
    for b in range(1, LEVELS):
        if not seen[b] and seen[b - 1]:
            weights[b], seen[b] = weights[b - 1], True
    return weights


def _count(docs: DataFrame, blocks: int) -> DataFrame:
    """The answers to all blocks, as a table."""

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        return _requests(key[0].as_py(), Tokens(table), blocks)

    def answer(table: pa.Table) -> pa.Table:
        return _replies(table, blocks)

    asked = docs.groupBy("block").applyInArrow(ask, _REQUEST)
    return written(asked.groupBy("bucket").applyInArrow(answer, _REPLY), "lm-counts")


def _held_out_cells(docs: DataFrame, replies: DataFrame, kept_documents: int, types: float, total: float) -> np.ndarray:
    def cells(key: tuple, docs: pa.Table, replies: pa.Table) -> pa.Table:
        levels = pair_cells = word_cells = np.empty(0, np.int32)
        if docs.num_rows:
            counts = Counts(docs, replies)
            word, before, pair = counts.of(True, kept_documents)
            pair_p, word_p, _ = _estimates(word, before, pair, total, types)
            levels, pair_cells, word_cells = level(before), _on_grid(pair_p), _on_grid(word_p)
        columns, n = np.unique(np.column_stack([levels, pair_cells, word_cells]), axis=0, return_counts=True)
        return pa.table(
            {
                "level": pa.array(columns[:, 0].astype(np.int32)),
                "pair": pa.array(columns[:, 1].astype(np.int32)),
                "word": pa.array(columns[:, 2].astype(np.int32)),
                "n": pa.array(n.astype(np.int64)),
            }
        )

    # Levels and grid bound the number of cells, whatever the number of words.
    found = docs.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(
        cells, "level int, pair int, word int, n bigint"
    )
    rows = found.groupBy("level", "pair", "word").agg(F.sum("n").alias("n")).collect()
    return np.array([tuple(r) for r in rows], dtype=np.int64).reshape(-1, 4)


def lm_scores(
    df: DataFrame, id_column: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """One row per input row: id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    Words are lower-cased (A-Z) runs without white space; each text closes with an end, which counts as a token. Documents with
    crc32(id) mod 7 = 2 teach nothing; a null id counts as a training document. Null texts are empty ones: only the end. Repeated
    rows all count. With nothing to learn from, all probability is spread evenly. Other columns are not read.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    docs = df.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text"))
    number = F.crc32(F.col("id").cast("string"))
    train = F.coalesce(F.pmod(number, F.lit(7)) != 2, F.lit(True))
    deleted = F.coalesce(train & (F.pmod(F.floor(number / 7), F.lit(10)) == 0), F.lit(False))
    sizes = docs.agg(
        F.sum(F.octet_length("text") + 32).alias("bytes"),
        F.count_if(train).alias("train"),
        F.count_if(train & ~deleted).alias("kept"),
    ).first()
    blocks = max(1, -(-(sizes["bytes"] or 0) // block_bytes))
    place = F.xxhash64(row_key("id", "text"))
    block = F.when(deleted, blocks + F.pmod(place, F.lit(-(-blocks // 10)))).otherwise(F.pmod(place, F.lit(blocks)))
    docs = docs.withColumn("block", block.cast("int"))

    replies = _count(docs, blocks)
    types, total, kept_types, kept_total = (0.0,) * 4
    for row in replies.filter("block = -1").select("word_train").toLocalIterator():  # a few bytes for each bucket
        own = _unpack(row[0], np.uint64)
        types, total = types + float(own[0]), total + float(own[1])
        kept_types, kept_total = kept_types + float(own[2]), kept_total + float(own[3])
    answers = replies.filter("block >= 0")
    taken_out = F.col("block") >= blocks
    cells = _held_out_cells(docs.filter(taken_out), answers.filter(taken_out), sizes["kept"], kept_types, kept_total)
    weights = learn_weights(cells, 1 / (kept_types + 1))
    n_train = sizes["train"]

    def score(key: tuple, docs: pa.Table, replies: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _SCORES.empty_table()
        counts = Counts(docs, replies)
        tokens = counts.tokens
        word, before, pair = counts.of(False, n_train)
        pair_p, word_p, base = _estimates(word, before, pair, total, types)
        w = weights[level(before)]
        p = w[:, 0] * pair_p + w[:, 1] * word_p + w[:, 2] * base
        return pa.table(
            {
                "id": pa.array(tokens.ids, pa.int64()),
                "held_out": pa.array(tokens.held_out),
                "n_tokens": pa.array(tokens.lengths.astype(np.int64)),
                "n_known": pa.array(tokens.sums((word > 0).astype(np.int64))),
                "train_tokens": pa.array(np.full(len(tokens.ids), int(total))),
                "base_score": pa.array(tokens.sums(np.log10((word + 1) / (total + types + 1)))),
                "score": pa.array(tokens.sums(np.log10(p))),
            }
        ).cast(_SCORES)

    scored = docs.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        score,
        "id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    )
    return scored.withColumnRenamed("id", id_column)


_SCORES = pa.schema(
    [
        ("id", pa.int64()),
        ("held_out", pa.bool_()),
        ("n_tokens", pa.int64()),
        ("n_known", pa.int64()),
        ("train_tokens", pa.int64()),
        ("base_score", pa.float64()),
        ("score", pa.float64()),
    ]
)


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(documents(spark, sf_dir, "doc_id", "text"))
