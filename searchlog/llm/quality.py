"""Quality classifier: a byte-level convolutional network in numpy (operator 7).

Bytes become short vectors, filters over eight bytes move over the whole document four bytes at a time, and each filter keeps
its largest response in every chunk. Chunks share their border bytes, so no step is lost between them. A pattern is seen whole
only where it begins at a step, so scores change a little when bytes are put in front of a text. A document is described by
the maximum of each filter over its chunks and by the mean over its chunks, which a logistic layer combines into one
probability. The filters and the layer are learned by gradient descent; the maxima pass gradients only to the places they
came from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from searchlog.llm.common import bounded_batches, documents, written

#: Bytes of a step, of a filter (two steps), steps of a chunk.
STEP, CHUNK_STEPS = 4, 128
FILTERS = 24

#: Bytes that go through the network at once; longer documents go in parts that overlap by a step.
PART_BYTES = 1 << 18

#: The fit reads at most so many labelled rows, chosen by hash of their ids, and so many bytes in all; it reads them whole.
MAX_TRAINING_ROWS, MAX_TRAINING_BYTES = 2000, 1 << 24

#: Chunks that the fit has as vectors at once.
FIT_CHUNKS = 256

EPOCHS = 30
BATCH = 64
SEED = 11

THRESHOLD = 0.3


def byte_vectors() -> np.ndarray:
    """What a byte looks like: classes of characters, and a few fixed random directions that tell bytes apart."""
    values = np.zeros((256, 12), np.float32)
    for byte in range(256):
        c = chr(byte)
        kinds = [c.islower(), c.isupper(), c.isdigit(), c == " ", c == "\n", c in "!?", c in ".,;:"]
        ascii_kinds = [k and byte < 0x80 for k in kinds]
        other = byte < 0x80 and c.isprintable() and not any(ascii_kinds)
        values[byte, :9] = [*ascii_kinds, other, byte >= 0x80]
    values[:, 9:] = np.random.default_rng(SEED).normal(0, 0.5, (256, 3))
    values[0] = 0  # padding
    return values


_BYTES = byte_vectors()
WIDTH = 2 * STEP * _BYTES.shape[1]


class Network:
    """Filters (WIDTH x FILTERS) with offsets, and the layer over maxima and means with its offset."""

    def __init__(self, filters: np.ndarray, offsets: np.ndarray, layer: np.ndarray, bias: float):
        self.filters, self.offsets, self.layer, self.bias = filters, offsets, layer, bias

    @classmethod
    def start(cls) -> Network:
        rng = np.random.default_rng(SEED)
        filters = rng.normal(0, 1 / np.sqrt(2 * STEP), (WIDTH, FILTERS)).astype(np.float32)
        return cls(filters, np.zeros(FILTERS, np.float32), rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32), 0.0)

    def cells(self, data: bytes) -> np.ndarray:
        """Byte vectors by steps: one row of STEP bytes after the other, padded, and one empty row at the end."""
        rows = -(-len(data) // STEP) + 1
        padded = np.zeros(rows * STEP, np.uint8)
        padded[: len(data)] = np.frombuffer(data, np.uint8)
        return _BYTES[padded].reshape(rows, -1)

    def responses(self, cells: np.ndarray) -> np.ndarray:
        """Of each filter at each step."""
        half = WIDTH // 2
        out = cells[:-1] @ self.filters[:half]
        out += cells[1:] @ self.filters[half:]
        out += self.offsets
        return np.maximum(out, 0, out=out)

    def describe(self, data: bytes) -> np.ndarray:
        """Maximum over and mean over the chunks of each filter's largest response; zeros for no bytes."""
        if not data:
            return np.zeros(2 * FILTERS, np.float32)
        top, total, chunks = np.zeros(FILTERS, np.float32), np.zeros(FILTERS, np.float64), 0
        for at in range(0, len(data), PART_BYTES):
            out = self.responses(self.cells(data[at : at + PART_BYTES + STEP])[: PART_BYTES // STEP + 1])
            best = np.maximum.reduceat(out, np.arange(0, len(out), CHUNK_STEPS))
            top = np.maximum(top, best.max(axis=0))
            total += best.sum(axis=0)
            chunks += len(best)
        return np.concatenate([top, (total / chunks).astype(np.float32)])

    def score(self, text: str | None) -> float:
        z = float(self.describe((text or "").encode()) @ self.layer + self.bias)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def training_chunks(text: str | None) -> list[bytes]:
    """All chunks of a text, each with the step after it."""
    data, size = (text or "").encode(), STEP * CHUNK_STEPS
    return [data[at : at + size + STEP] for at in range(0, len(data), size)]


class _Adam:
    def __init__(self, rate: float = 0.01):
        self.rate, self.t, self.state = rate, 0, {}

    def step(self, parameters: dict[str, np.ndarray], gradients: dict[str, np.ndarray]) -> None:
        self.t += 1
        for name, gradient in gradients.items():
            m, v = self.state.get(name, (0.0, 0.0))
            m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
            self.state[name] = m, v
            parameters[name] -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


def fit(samples: list[list[bytes]], labels: list[int], epochs: int = EPOCHS) -> Network:
    """A network for documents given by their chunks. Without samples it scores all documents alike."""
    net = Network.start()
    if not samples:
        return net
    rng, adam = np.random.default_rng(SEED), _Adam()
    chunks = [_padded(sample) for sample in samples]
    y = np.array(labels, np.float32)
    parameters = {"filters": net.filters, "offsets": net.offsets, "layer": net.layer, "bias": np.zeros(1, np.float32)}
    parameters["bias"][0] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    for _ in range(epochs):
        order = rng.permutation(len(samples))
        for start in range(0, len(order), BATCH):
            chosen = order[start : start + BATCH]
            gradients = {name: np.zeros_like(p) for name, p in parameters.items()}
            for i in chosen:
                _add_gradients(net, parameters, gradients, chunks[i], y[i])
            for name, g in gradients.items():
                g /= len(chosen)
                if name == "layer":
                    g += 1e-3 * parameters[name]
            adam.step(parameters, gradients)
            net.bias = float(parameters["bias"][0])
    return net


def _padded(sample: list[bytes]) -> np.ndarray:
    """Bytes by chunk and step, padded with zeros; a few of them become vectors at a time."""
    out = np.zeros((len(sample), (CHUNK_STEPS + 2) * STEP), np.uint8)
    for row, chunk in zip(out, sample):
        row[: len(chunk)] = np.frombuffer(chunk, np.uint8)
    return out.reshape(len(sample), CHUNK_STEPS + 2, STEP)


def _add_gradients(net: Network, parameters: dict, gradients: dict, chunks: np.ndarray, label: float) -> None:
    """Forward over all chunks, some at a time, then back to the places of the largest responses."""
    half, n = WIDTH // 2, len(chunks)
    if not n:
        error = 1 / (1 + np.exp(-parameters["bias"][0])) - label
        gradients["bias"] += error
        return

    def cells_of(at: int) -> np.ndarray:
        part = chunks[at : at + FIT_CHUNKS]
        return _BYTES[part].reshape(*part.shape[:2], -1)

    places, best = [], []
    for at in range(0, n, FIT_CHUNKS):
        cells = cells_of(at)
        out = cells[:, :-1].reshape(-1, half) @ net.filters[:half] + cells[:, 1:].reshape(-1, half) @ net.filters[half:]
        out = np.maximum(out + net.offsets, 0).reshape(len(cells), -1, FILTERS)
        places.append(out.argmax(axis=1))  # chunk, filter
        best.append(np.take_along_axis(out, places[-1][:, None, :], 1)[:, 0])
    best = np.concatenate(best)
    winner = best.argmax(axis=0)
    features = np.concatenate([best[winner, np.arange(FILTERS)], best.mean(axis=0)])
    z = np.clip(features @ net.layer + parameters["bias"][0], -30, 30)
    error = 1 / (1 + np.exp(-z)) - label
    gradients["bias"] += error
    gradients["layer"] += error * features
    back = np.repeat(error * net.layer[FILTERS:][None] / n, n, axis=0)
    back[winner, np.arange(FILTERS)] += error * net.layer[:FILTERS]
    back *= best > 0
    for at, place in zip(range(0, n, FIT_CHUNKS), places, strict=True):
        cells, some = cells_of(at), back[at : at + FIT_CHUNKS]
        chunk = np.arange(len(cells))[:, None]
        gradients["filters"][:half] += np.einsum("cf,cfw->wf", some, cells[chunk, place])
        gradients["filters"][half:] += np.einsum("cf,cfw->wf", some, cells[chunk, place + 1])
    gradients["offsets"] += back.sum(axis=0)


@F.arrow_udf(T.ArrayType(T.BinaryType()))
def _chunk_column(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in texts:
        yield pa.array([training_chunks(text.as_py()) for text in batch], pa.list_(pa.binary()))


def train(
    docs: DataFrame,
    labels: DataFrame,
    max_rows: int = MAX_TRAINING_ROWS,
    id_column: str = "doc_id",
    text: str = "text",
    max_bytes: int = MAX_TRAINING_BYTES,
) -> Network:
    """A network from ``labels`` (id and ``quality`` 0 or 1), of which at most ``max_rows``, chosen by hash of the id, are used.

    Their texts are read whole. Rows with which the sample would hold more than ``max_bytes`` are left out of it, in the order
    of the hash, as are labels that are null or belong to no document.
    """
    bounded_batches(docs.sparkSession)
    known = labels.select(F.col(id_column).alias("_id"), F.col("quality").alias("_label"))
    known = known.filter(F.col("_label").isNotNull() & F.col("_id").isNotNull())
    chosen = known.orderBy(F.xxhash64("_id"), "_id", "_label").limit(max_rows)
    # The chosen labels are bounded, so they may go to every task, and their texts to the driver.
    found = docs.select(F.col(id_column).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id")
    found = written(found.withColumn("_bytes", F.coalesce(F.octet_length("_text"), F.lit(0)).cast("long")), "labelled-texts")
    order = Window.orderBy(F.xxhash64("_id"), "_id", "_label", F.md5("_text"))  # over the chosen rows
    sizes = found.filter(F.col("_bytes") <= max_bytes).select("*", F.sum("_bytes").over(order).alias("_sum"))
    rows = sizes.filter(F.col("_sum") <= max_bytes).select("_id", _chunk_column("_text").alias("x"), F.col("_label").alias("y")).collect()
    rows.sort(key=lambda r: (r["_id"], r["y"], r["x"]))
    return fit([[bytes(c) for c in r["x"]] for r in rows], [int(r["y"]) for r in rows])


def with_quality(docs: DataFrame, network: Network, text: str = "text", score: str = "score") -> DataFrame:
    """Every row with the probability that its text is of good quality.

    Whole texts are read, nothing is shuffled. Null and empty texts all get one score. An input column named like the score
    is replaced; repeated rows stay repeated; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(network)

    @F.arrow_udf("double")
    def score_all(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array([shared.value.score(value.as_py()) for value in batch], pa.float64())

    return docs.withColumn(score, score_all(F.col(text)))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))
    scored = with_quality(docs, train(docs, labels.filter(~held_out)))
    return scored.select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
