"""Quality of texts: random-indexing word vectors, pooled per document, into a small network.

Every word has a sparse random index vector, given by its hash. Its word vector
is the sum of the index vectors of its neighbours over the whole corpus. A
document is the mean and the spread of its words' vectors; a network of two
layers, trained in numpy on labelled rows, scores it, with a temperature fitted
on rows that training left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import chunks_of, first_by_hash, table_of, texts_of
from larder.session import settled

#: Words are told apart by a hash of this many values.
BUCKETS = 1 << 14
#: Length of the vectors, and how many of an index vector's numbers are +1 or -1.
WIDTH, MARKS = 64, 4
#: Buckets of a row of the table of sums.
ROWS = 64
#: Labelled rows that the network learns from at most, in the order of their ids' hash; the share kept for the temperature.
SAMPLE, HELD = 20_000, 0.2
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 30, 256, 3e-3, 1e-4
SLICE = 4 << 20


class Buckets(dict):
    """word -> its bucket. Signs at its end and capitals are part of what is hashed, letters inside by their case only where it is even."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        bare = word.rstrip(b"*#$%&!|.,;:?")
        signs = word[len(bare):]
        # A word with a run of signs, or all in capitals, stands for its kind: such words rarely come back.
        if len(signs) > 1 or not bare:
            key = b"\x00signs" + bytes(sorted(set(signs)))
        elif len(bare) > 1 and bare.isupper():
            key = b"\x00capitals" + signs
        else:
            key = bare.lower()
        found = self[word] = crc32(key) % BUCKETS
        return found


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """(bucket, mark) positions and signs of the index vectors, the same on every machine."""
    rng = np.random.default_rng(20240229)
    return rng.integers(0, WIDTH, (BUCKETS, MARKS)), rng.choice([-1.0, 1.0], (BUCKETS, MARKS))


def word_sums(docs: DataFrame) -> DataFrame:
    """(row, sums): the neighbours' index vectors summed for every bucket over all texts, ROWS buckets to a row."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors()
        buckets = Buckets()
        total = np.zeros(BUCKETS * WIDTH)
        for batch in batches:
            for part in chunks_of(batch, "text", SLICE):
                for text in texts_of(part, "text"):
                    own = text.split()
                    b = np.fromiter(map(buckets.__getitem__, own), np.int64, len(own))
                    # The pairs of neighbours, counted first, so that a frequent pair is one addition.
                    pair, n = np.unique(np.concatenate([b[:-1] * BUCKETS + b[1:], b[1:] * BUCKETS + b[:-1]]), return_counts=True)
                    word, other = pair // BUCKETS, pair % BUCKETS
                    for m in range(MARKS):
                        np.add.at(total, word * WIDTH + places[other, m], n * signs[other, m])
        table = total.reshape(BUCKETS // ROWS, ROWS * WIDTH)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(table))), pa.array([r.tobytes() for r in table])], ["row", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for row, sums in zip(batch.column("row").to_pylist(), batch.column("sums").to_pylist()):
                total[row] = total.get(row, 0) + np.frombuffer(sums)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([s.tobytes() for s in total.values()])], ["row", "sums"])

    each = table_of(docs, "text").mapInArrow(of, "row long, sums binary")
    return each.repartition("row").mapInArrow(add, "row long, sums binary")


def word_vectors(docs: DataFrame) -> np.ndarray:
    """(bucket, WIDTH) vectors of length 1, without the mean that all words share; 4 MB whatever the corpus."""
    total = np.zeros((BUCKETS // ROWS, ROWS * WIDTH))
    for r in word_sums(docs).collect():
        total[r["row"]] = np.frombuffer(r["sums"])
    total = total.reshape(BUCKETS, WIDTH)
    norm = np.linalg.norm(total, axis=1, keepdims=True)
    unit = np.divide(total, norm, out=np.zeros_like(total), where=norm > 0)
    used = norm[:, 0] > 0
    if used.any():
        unit[used] -= unit[used].mean(axis=0)
    norm = np.linalg.norm(unit, axis=1, keepdims=True)
    return np.divide(unit, norm, out=np.zeros_like(unit), where=norm > 1e-9).astype(np.float32)


def pooled(texts: list[bytes], vectors: np.ndarray, buckets: Buckets) -> np.ndarray:
    """(text, 2 WIDTH) mean and spread of the words' vectors; zeros without words."""
    out = np.zeros((len(texts), 2 * WIDTH), np.float32)
    for i, text in enumerate(texts):
        own = text.split()
        if own:
            b = np.fromiter(map(buckets.__getitem__, own), np.int64, len(own))
            distinct, n = np.unique(b, return_counts=True)
            v, w = vectors[distinct], (n / len(own)).astype(np.float32)
            mean = w @ v
            out[i, :WIDTH] = mean
            out[i, WIDTH:] = np.sqrt(np.maximum(w @ (v * v) - mean * mean, 0))
    return out


def with_pooled(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    """(doc_id, x) per row: the pooled vector as 32-bit numbers."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets()
        for batch in batches:
            for part in chunks_of(batch, "text", SLICE):
                x = pooled(texts_of(part, "text"), vectors, buckets)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return table_of(docs, "doc_id", "text").mapInArrow(of, f"doc_id {kind}, x binary")


@dataclass
class Network:
    """Two layers on scaled inputs, and the temperature that divides the last one's output."""

    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.maximum((x - self.mean) / self.scale @ w1 + b1, 0) @ w2 + b2[0]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))


def train(x: np.ndarray, y: np.ndarray) -> Network:
    """Adam on the cross-entropy of HELD-out-free rows; the temperature minimises that of the rows held out."""
    rng = np.random.default_rng(7)
    order = rng.permutation(len(x))
    held, rest = order[:int(HELD * len(x))], order[int(HELD * len(x)):]
    mean, scale = x[rest].mean(axis=0), x[rest].std(axis=0) + 1e-3
    layers = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(1)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in layers]
    z = (x - mean) / scale
    step = 0
    for _ in range(max(EPOCHS, 2000 * BATCH // max(len(rest), 1))):
        for at in range(0, len(rest), BATCH):
            rows = rest[at:at + BATCH]
            w1, b1, w2, b2 = layers
            hidden = np.maximum(z[rows] @ w1 + b1, 0)
            error = (1 / (1 + np.exp(-np.clip(hidden @ w2 + b2[0], -60, 60))) - y[rows]) / len(rows)
            back = np.outer(error, w2) * (hidden > 0)
            grads = [z[rows].T @ back + DECAY * w1, back.sum(axis=0), hidden.T @ error + DECAY * w2, np.array([error.sum()])]
            step += 1
            for p, g, (m, s) in zip(layers, grads, moments):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                p -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.999 ** step)) + 1e-8)
        rest = rng.permutation(rest)
    net = Network(mean, scale, layers, 1.0)
    if len(held):
        logit, target = net.logits(x[held]), y[held]
        loss = lambda t: np.mean(np.logaddexp(0, logit / t) - target * logit / t)
        net.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return net


def scored(docs: DataFrame, labels: DataFrame, learn: Column, most: int = SAMPLE) -> DataFrame:
    """(doc_id, score) per row: the probability of quality 1.

    ``learn`` is a condition on doc_id of the rows whose labels may be learnt
    from. A document labelled more than once counts with the mean of its labels;
    null labels teach nothing. Null and empty texts get the score of a text
    without words. Without labels of both kinds all scores are the share of 1
    among them, a half without any. No row gives no row.
    """
    vectors = word_vectors(docs)
    table = settled(with_pooled(docs, vectors), "pooled")
    own = table_of(labels, "doc_id", "quality").where("doc_id is not null and quality is not null").where(learn).groupBy("doc_id").agg(
        F.avg("quality").alias("y"))
    # At most ``most`` rows of two numbers.
    chosen = F.broadcast(first_by_hash(own, "doc_id", most))
    rows = table.join(chosen, "doc_id").select("doc_id", "x", "y").toPandas().sort_values(["doc_id", "x"], kind="stable")
    y = rows["y"].to_numpy(float)
    net, flat = None, float(y.mean()) if len(y) else 0.5
    if len(y) and 0 < flat < 1:
        net = train(np.stack([np.frombuffer(b, np.float32) for b in rows["x"]]).astype(float), y)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.float32).reshape(-1, 2 * WIDTH).astype(float)
            p = net.probabilities(x) if net else np.full(len(x), flat)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p)], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return table.mapInArrow(of, f"doc_id {kind}, score double")
