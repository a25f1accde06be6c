"""Byte-level BPE encoding and decoding (operator 1).

A vocabulary token is a byte string with a rank. Tokens and text pieces are mapped byte by byte to Latin-1 characters, so
that the trie of an Aho-Corasick automaton over characters gives the longest token that starts at a byte. Encoding
takes the longest match, steps on, and backtracks to the next shorter token (the longest proper prefix that is itself a token)
where two neighbours can't stand side by side. Two tokens are compatible if undoing their merges, the latest first, shows no
earlier merge across their border; the answers are memoised. The result is the sequence that merging by rank gives,
without a priority queue, and every byte position is left at most once, so the time is linear in the piece.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from searchlog.llm.common import bounded_batches, documents

#: Entries that a worker's memos hold before the half not used lately goes, and the length of what is kept; only speed depends on them.
MEMO_ENTRIES, MEMO_LENGTH = 600_000, 64


class Memo(dict):
    """Results of ``function`` by argument, in two generations: when the young one is full, it becomes the old one."""

    def __init__(self, function: Callable, entries: int = MEMO_ENTRIES):
        super().__init__()
        self.function, self.old, self.half = function, {}, entries // 2

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.function(key)
        if len(key) > MEMO_LENGTH:
            return value
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Bpe:
    """One vocabulary: ``ranks`` maps token bytes to ids; every single byte must be a token."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.latin = {token.decode("latin-1"): rank for token, rank in ranks.items()}
        self.most = max(map(len, ranks))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        # For every node of the trie the longest token on the way to it.
        self.on_way: dict[str, int] = {}
        for token, rank in self.latin.items():
            self.automaton.add_word(token, rank)
            longest = rank
            for end in range(1, len(token) + 1):
                longest = self.latin.get(token[:end], longest)  # one byte is always a token
                self.on_way[token[:end]] = longest
        self.prefix: dict[int, int | None] = {}
        self.lengths = {rank: len(token) for token, rank in ranks.items()}
        self._undo_merges()
        self.compatible = Memo(lambda pair: self._side_by_side(*pair))
        self.pieces = Memo(lambda piece: self.encode_piece(piece.encode()))

    def _undo_merges(self) -> None:
        """For every token its longest proper prefix token and the pair that it is merged from (itself if from none)."""
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for token, rank in sorted(self.ranks.items(), key=lambda item: item[1]):
            cuts = [i for i in range(len(token) - 1, 0, -1) if token[:i] in self.ranks]
            self.prefix[rank] = self.ranks[token[: cuts[0]]] if cuts else None
            self.parts[rank] = (rank, rank)
            for cut in cuts:
                left, right = self.ranks[token[:cut]], self.ranks.get(token[cut:])
                if right is not None and left < rank and right < rank and self._side_by_side(left, right):
                    self.parts[rank] = (left, right)
                    self.merged[left, right] = rank
                    break

    def _side_by_side(self, left: int, right: int) -> bool:
        """Whether no merge across the border comes before those that made the two tokens."""
        limit = float("inf")
        while True:
            if self.merged.get((left, right), limit) < limit:
                return False
            # Of the two tokens, the one merged last is taken apart; ties go to the right one.
            if left > right and self.parts[left][0] != left:
                limit, left = left, self.parts[left][1]
            elif self.parts[right][0] != right:
                limit, right = right + 1, self.parts[right][0]
            elif self.parts[left][0] != left:
                limit, left = left, self.parts[left][1]
            else:
                return True

    def _longest(self, text: str, at: int) -> int:
        """The longest token that starts at a place: down the trie as far as it goes, and the last token on that way."""
        rest = text[at : at + self.most]
        return self.on_way[rest[: self.automaton.longest_prefix(rest)]]

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one piece. A piece that is a token is that token, however it was merged."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        n, lengths, prefix, compatible = len(piece), self.lengths, self.prefix, self.compatible
        text, longest = piece.decode("latin-1"), [-1] * n
        dead = bytearray(n + 1)
        ids: list[int] = []
        at, token = 0, self._longest(text, 0)
        while True:
            end = at + lengths[token]
            if not dead[end] and (not ids or compatible[ids[-1], token]):
                ids.append(token)
                at = end
                if at == n:
                    return tuple(ids)
                token = longest[at]
                if token < 0:
                    token = longest[at] = self._longest(text, at)
                continue
            token = prefix[token]
            while token is None:  # nothing that starts here fits: the token before gives way to a shorter one
                dead[at] = 1
                token = ids.pop()
                at -= lengths[token]
                token = prefix[token]

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.pattern.findall(text)))) if text else []

    def decode(self, ids: list[int] | None) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids or ()))


_loaded: dict[tuple[str, str], Bpe] = {}


def load(vocabulary: bytes, pattern: str, key: str) -> Bpe:
    """The vocabulary of a rank file (base64 token, space, rank on each line), once per process."""
    if (key, pattern) not in _loaded:
        lines = (line.split() for line in vocabulary.splitlines() if line)
        _loaded[key, pattern] = Bpe({base64.b64decode(token): int(rank) for token, rank in lines}, pattern)
    return _loaded[key, pattern]


class Codec:
    """Column functions of one rank file. The file (under a megabyte) is read by the driver and broadcast."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        with open(path, "rb") as file:
            vocabulary = spark.sparkContext.broadcast(file.read())

        def bpe() -> Bpe:
            return load(vocabulary.value, pattern, path)

        def coded(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in texts:
                ids, ends, decoded = array("i"), [0], []
                for text in batch:
                    found = bpe().encode(text.as_py())
                    ids.extend(found)
                    ends.append(len(ids))
                    decoded.append(bpe().decode(found))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(ids, np.int32)))
                yield pa.StructArray.from_arrays([lists, pa.array(decoded, pa.binary())], names=["ids", "decoded"])

        def decode(ids: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in ids:
                yield pa.array([bpe().decode(row.as_py()) for row in batch], pa.binary())

        self._coded = F.arrow_udf(coded, "struct<ids array<int>, decoded binary>")
        self._decode = F.arrow_udf(decode, "binary")

    def coded(self, text: str | Column) -> Column:
        """``ids``, the token ids of a text column, and ``decoded``, the bytes that they stand for.

        There are no special tokens. Null and empty texts have no ids, an empty array, and empty bytes.
        """
        return self._coded(text)

    def encode(self, text: str | Column) -> Column:
        """Token ids of a text column, without special tokens. Null and empty texts have none: an empty array."""
        return self._coded(text)["ids"]

    def decode(self, ids: str | Column) -> Column:
        """The bytes that an array of token ids stands for. Null and empty arrays give empty bytes."""
        return self._decode(ids)


def with_tokens(df: DataFrame, codec: Codec, text: str = "text", ids: str = "token_ids", decoded: str = "decoded") -> DataFrame:
    """Every row with its token ids and the bytes they decode to.

    Nothing is shuffled and every text is encoded whole, in a time linear in its length. Repeated rows stay repeated. An
    input column that has the name of a result column is replaced by it; an empty table gives an empty one.
    """
    bounded_batches(df.sparkSession)
    rows = df.withColumn("_coded", codec.coded(F.col(text)))
    return rows.withColumns({ids: F.col("_coded.ids"), decoded: F.col("_coded.decoded")}).drop("_coded")


def production_codec(spark: SparkSession) -> Codec:
    import public_tokenizers

    return Codec(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = with_tokens(documents(spark, sf_dir, "doc_id", "text"), production_codec(spark))
    return tokens.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
