"""Toxicity as an ordinal grade: cumulative-link regression on sparse text features.

P(grade <= k) = sigmoid(threshold_k - weights . features), with one weight
vector for all thresholds, which rise. Features are the words of a text and the
first letters of its longer words, present or not; those that tell toxic from
other labelled texts are kept. The labels say toxic or not: a toxic text's grade
comes from the number of distinct cues in it, at the cuts that share the labelled
toxic texts evenly.

Fitting reads a bounded, documented sample of labelled rows; scoring reads every
text whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import chunks_of, first_by_hash, table_of, texts_of, words
from larder.session import settled

#: Labelled rows that fitting reads at most, in the order of their ids' hash.
SAMPLE = 25_000
#: Features kept at most, the likelihood ratio (G2) that one needs, and how many
#: times its share among toxic texts must be its share among the others: longer
#: texts hold more of every word, and lift alone is blind to chance.
FEATURES, LEAST_RATIO, LEAST_LIFT = 4096, 15.0, 8.0
#: Letters of a word's start that are features of their own.
STARTS = (4, 5, 6)
TOXIC_GRADES = 3
SLICE = 4 << 20
EDGES = b".,;:!?\"'()[]{}<>*#$%&|-_"


def features_of(word: bytes) -> list[bytes]:
    """A word without the signs at its ends, and the starts of a longer one, marked by a blank."""
    bare = word.strip(EDGES)
    if not bare:
        return []
    letters = bare.decode("utf-8", "replace")
    return [bare] + [b" " + letters[:n].encode() for n in STARTS if len(letters) > n]


class Parts(dict):
    """word -> its features; emptied when large."""

    def __missing__(self, word: bytes) -> list[bytes]:
        if len(self) > 200_000:
            self.clear()
        found = self[word] = features_of(word)
        return found


class FeatureSets(dict):
    """word -> its kept features as numbers; filled as words come, emptied when large."""

    def __init__(self, index: dict[bytes, int]):
        super().__init__()
        self.index = index

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) > 400_000:
            self.clear()
        found = self[word] = tuple(self.index[f] for f in features_of(word) if f in self.index)
        return found


@dataclass
class Model:
    """Feature numbers, their weights, and the rising thresholds between the grades."""

    index: dict[bytes, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def probabilities(self, total: np.ndarray) -> np.ndarray:
        """(row, grade) from the summed weights."""
        below = 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - total[:, None], -500, 500)))
        return np.diff(np.concatenate([np.zeros((len(total), 1)), below, np.ones((len(total), 1))], axis=1), axis=1)


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(toxic, text) of the sampled labelled documents.

    A document labelled more than once is toxic if any of its labels says so;
    a null label or id teaches nothing, a text that several documents share teaches once.
    """
    own = table_of(labels, "doc_id", "toxic").where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(
        F.max("toxic").alias("toxic"))
    chosen = first_by_hash(own, "doc_id", most)
    # At most ``most`` rows of two numbers.
    return table_of(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy(
        "toxic", F.xxhash64("text")).agg(F.first("text").alias("text")).select("toxic", "text")


def feature_counts(rows: DataFrame) -> DataFrame:
    """(feature, toxic, other): texts of each class that hold the feature."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: tuple[Counter, Counter] = (Counter(), Counter())
        parts = Parts()

        def flush() -> pa.RecordBatch:
            names = list(count[0].keys() | count[1].keys())
            out = pa.RecordBatch.from_arrays(
                [pa.array(names, pa.binary()), *[pa.array([c[n] for n in names], pa.int64()) for c in (count[1], count[0])]],
                ["feature", "toxic", "other"])
            for c in count:
                c.clear()
            return out

        for batch in batches:
            for toxic, text in zip(batch.column("toxic").to_pylist(), texts_of(batch, "text")):
                count[toxic == 1].update(set(chain.from_iterable(map(parts.__getitem__, set(words(text))))))
                if len(count[0]) + len(count[1]) > 300_000:
                    yield flush()
        yield flush()

    return rows.mapInArrow(of, "feature binary, toxic long, other long").groupBy("feature").agg(
        F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def chosen_features(counts: DataFrame, toxic: int, other: int, most: int = FEATURES, least: float = LEAST_RATIO, lift: float = LEAST_LIFT) -> list[bytes]:
    """The features that speak for toxic with the largest likelihood ratios; ties by the feature."""
    n = float(toxic + other)
    held = F.col("toxic") + F.col("other")

    def term(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(F.lit(0.0))

    ratio = 2 * (
        term(F.col("toxic"), held * toxic / n) + term(F.col("other"), held * other / n)
        + term(toxic - F.col("toxic"), (n - held) * toxic / n) + term(other - F.col("other"), (n - held) * other / n))
    lifted = (F.col("toxic") + 0.5) / (toxic + 1) >= lift * (F.col("other") + 0.5) / (other + 1)
    best = counts.where(lifted).withColumn("ratio", ratio).where(F.col("ratio") >= least).orderBy(F.desc("ratio"), "feature").limit(most)
    return [bytes(r["feature"]) for r in best.select("feature").collect()]


def present(text: bytes, sets: FeatureSets) -> list[int]:
    """The numbers of the kept features that a text holds."""
    found: set[int] = set()
    found.update(*filter(None, map(sets.__getitem__, set(words(text)))))
    return list(found)


def fit_link(rows: list[np.ndarray], grades: np.ndarray, n_features: int, n_grades: int, steps: int = 800, rate: float = 0.1, decay: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by Adam on the mean log-likelihood; the gaps between thresholds are kept positive."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    feature = np.concatenate(rows).astype(np.int64) if len(at) else np.zeros(0, np.int64)
    n = len(grades)
    share = np.array([np.mean(grades <= k) for k in range(n_grades - 1)])
    share = np.clip(share, 1e-3, 1 - 1e-3)
    first = np.log(share / (1 - share))
    gaps = np.log(np.maximum(np.diff(first), 1e-2))
    params = np.concatenate([np.zeros(n_features), first[:1], gaps])
    m, s = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, steps + 1):
        w, low, gap = params[:n_features], params[n_features], np.exp(params[n_features + 1:])
        cuts = low + np.concatenate(([0.0], np.cumsum(gap)))
        total = np.bincount(at, weights=w[feature], minlength=n)
        below = 1 / (1 + np.exp(-np.clip(cuts[None, :] - total[:, None], -60, 60)))
        full = np.concatenate([np.zeros((n, 1)), below, np.ones((n, 1))], axis=1)
        slope = full * (1 - full)
        r = np.arange(n)
        p = np.maximum(full[r, grades + 1] - full[r, grades], 1e-9)
        # Derivatives of -log p by the cut above and the cut below the grade.
        up, down = -slope[r, grades + 1] / p, slope[r, grades] / p
        g_total = -(up + down)
        g_cut = np.zeros(n_grades + 1)
        np.add.at(g_cut, grades + 1, up)
        np.add.at(g_cut, grades, down)
        g_cut = g_cut[1:-1]
        grad = np.concatenate([
            np.bincount(feature, weights=g_total[at], minlength=n_features) / n + decay * w,
            [g_cut.sum() / n], [g_cut[k + 1:].sum() * gap[k] / n for k in range(len(gap))]])
        m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad * grad
        params = params - rate * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.999 ** step)) + 1e-8)
    gap = np.exp(params[n_features + 1:])
    return params[:n_features], params[n_features] + np.concatenate(([0.0], np.cumsum(gap)))


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    """The model of the labelled sample. Without labels of both classes it grades every text 0."""
    rows = settled(sample(docs, labels, most), "labelled")
    size = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    toxic, other = size.get(1, 0), size.get(0, 0)
    if not toxic or not other:
        return Model({}, np.zeros(0), np.array([20.0]))
    index = {f: i for i, f in enumerate(chosen_features(feature_counts(rows), toxic, other))}

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = FeatureSets(index)
        for batch in batches:
            texts = texts_of(batch, "text")
            found = [sorted(present(t, sets)) for t in texts]
            spoken = [sum(1 for w in set(words(t)) if sets[w]) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic").cast(pa.int32()), pa.array(found, pa.list_(pa.int32())), pa.array(spoken, pa.int32())],
                ["toxic", "found", "cues"])

    # The sample's kept features, at most FEATURES numbers for each of its rows.
    kept = rows.mapInArrow(held, "toxic int, found array<int>, cues int").toPandas()
    kept = kept.assign(key=kept["found"].map(lambda x: tuple(x))).sort_values(["toxic", "cues", "key"], kind="stable")
    found = [np.asarray(x, np.int64) for x in kept["found"]]
    label, said = kept["toxic"].to_numpy(), kept["cues"].to_numpy()
    cuts = np.unique(np.quantile(said[label == 1], np.arange(1, TOXIC_GRADES) / TOXIC_GRADES, method="lower"))
    grades = np.where(label == 1, 1 + np.searchsorted(cuts, said), 0).astype(np.int64)
    order = np.unique(grades, return_inverse=True)[1]
    weights, thresholds = fit_link(found, order, len(index), int(order.max()) + 1)
    return Model(index, weights, thresholds)


def totals(model: Model, texts: list[bytes], sets: FeatureSets) -> np.ndarray:
    """The summed weights of each text's features, in the order of their numbers."""
    return np.array([model.weights[sorted(present(t, sets))].sum() for t in texts], float)


def graded(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, severity (expected grade), grade (likeliest), probability (of any toxic grade), toxic.

    toxic: the probability is at least a half. Null and empty texts have no
    feature; the thresholds alone grade them. Repeated rows get equal grades.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = FeatureSets(model.index)
        for batch in batches:
            for part in chunks_of(batch, "text", SLICE):
                p = model.probabilities(totals(model, texts_of(part, "text"), sets))
                any_grade = 1 - p[:, 0]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(p @ np.arange(p.shape[1])), pa.array(p.argmax(axis=1).astype(np.int32)), pa.array(any_grade), pa.array(~(p[:, 0] > 0.5))],
                    ["doc_id", "severity", "grade", "probability", "toxic"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return table_of(docs, "doc_id", "text").mapInArrow(of, f"doc_id {kind}, severity double, grade int, probability double, toxic boolean")


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose text the model doesn't find toxic, all columns kept."""

    def of(texts: pa.Array) -> pa.Array:
        sets = FeatureSets(model.index)
        raw = [t or b"" for t in texts.cast(pa.binary()).to_pylist()]
        return pa.array(model.probabilities(totals(model, raw, sets))[:, 0] > 0.5)

    return docs.where(F.arrow_udf(of, "boolean", F.ArrowUDFType.SCALAR)(docs["text"]))
