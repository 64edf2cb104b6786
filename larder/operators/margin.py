"""A ranker with a margin: a small network whose score of the chosen side must exceed that of the rejected one by a margin.

The pairs stay distributed. Every step sends the weights out with the plan, the
groups of rows give their summed gradients, and these are summed over groups in
a tree, always in the same order: rows are dealt to groups by a hash of their key
and sorted inside, so the result does not depend on how a table is partitioned.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from larder.session import settled

#: Rows to a group, and groups whose sums are added in one task.
ROWS, FAN = 4096, 64
BETA1, BETA2, TINY = 0.9, 0.999, 1e-8
SUMS = "node long, grads binary, loss double, n long"


class Network:
    """Layers with rectified units between them and one score at the end; the weights are one vector."""

    def __init__(self, sizes: tuple, weights: np.ndarray):
        self.sizes, self.weights = sizes, weights
        self.layers, at = [], 0
        for a, b in zip(sizes, sizes[1:]):
            self.layers.append((weights[at:at + a * b].reshape(a, b), weights[at + a * b:at + a * b + b]))
            at += a * b + b

    @staticmethod
    def random(sizes: tuple, seed: int) -> "Network":
        rng = np.random.default_rng(seed)
        parts = []
        for a, b in zip(sizes, sizes[1:]):
            parts += [rng.uniform(-1, 1, a * b) / math.sqrt(a), np.zeros(b)]
        return Network(sizes, np.concatenate(parts))

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self._run(x)[-1][:, 0]

    def _run(self, x: np.ndarray) -> list[np.ndarray]:
        out = [x]
        for i, (w, b) in enumerate(self.layers):
            x = x @ w + b
            if i + 1 < len(self.layers):
                x = np.maximum(x, 0.0)
            out.append(x)
        return out

    def _back(self, out: list[np.ndarray], grad: np.ndarray) -> np.ndarray:
        parts = []
        for i in range(len(self.layers) - 1, -1, -1):
            parts = [(out[i].T @ grad).ravel(), grad.sum(axis=0), *parts]
            grad = (grad @ self.layers[i][0].T) * (out[i] > 0)
        return np.concatenate(parts)

    def gradient(self, chosen: np.ndarray, rejected: np.ndarray, margin: float) -> tuple[np.ndarray, float]:
        """(gradient, loss) of the hinge margin - (score of chosen - score of rejected), summed over rows."""
        good, bad = self._run(chosen), self._run(rejected)
        lack = margin - (good[-1] - bad[-1])
        wrong = (lack > 0).astype(float)
        return self._back(good, -wrong) + self._back(bad, wrong), float(np.maximum(lack, 0.0).sum())


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(lists), -1)


def _gradients(network: Network, margin: float) -> Callable:
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("_key", "ascending")])
        grads, loss = network.gradient(_matrix(rows.column("chosen")), _matrix(rows.column("rejected")), margin)
        return pa.table({"node": [key[0].as_py()], "grads": [grads.tobytes()], "loss": [loss], "n": [rows.num_rows]})

    return run


def _summed(key: tuple, rows: pa.Table) -> pa.Table:
    rows = rows.sort_by([("node", "ascending")])
    grads = np.sum([np.frombuffer(g) for g in rows.column("grads").to_pylist()], axis=0)
    return pa.table({
        "node": [key[0].as_py()], "grads": [grads.tobytes()], "loss": [math.fsum(rows.column("loss").to_pylist())], "n": [sum(rows.column("n").to_pylist())]})


def fit_margin_ranker(
    pairs: DataFrame, key: str = "pair_id", hidden: tuple = (128, 64), margin: float = 1.0, steps: int = 20, rate: float = 1e-2, seed: int = 7,
) -> tuple[Network, list[float]]:
    """(network, mean loss ahead of every step) from arrays ``chosen`` and ``rejected`` of one length.

    Pairs without either side take no part. The same pairs give the same weights however
    they are partitioned; without pairs the network is the one that the seed gives.
    """
    rows = settled(pairs.where(F.col("chosen").isNotNull() & F.col("rejected").isNotNull()).select(
        F.concat_ws(":", F.col(key).cast("string"), F.md5(F.to_json(F.struct("chosen", "rejected")))).alias("_key"), "chosen", "rejected"), "pairs")
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("chosen"))).first()
    network = Network.random((width or 1, *hidden, 1), seed)
    if not n:
        return network, []
    groups = math.ceil(n / ROWS)
    rows = settled(rows.withColumn("_group", F.pmod(F.xxhash64("_key"), F.lit(groups))), "groups")
    first, second, losses = np.zeros_like(network.weights), np.zeros_like(network.weights), []
    for step in range(1, steps + 1):
        sums, nodes = rows.groupBy("_group").applyInArrow(_gradients(network, margin), SUMS), groups
        while nodes > 1:
            sums, nodes = sums.groupBy((F.col("node") / FAN).cast("long").alias("_above")).applyInArrow(_summed, SUMS), math.ceil(nodes / FAN)
        total = sums.first()
        grad = np.frombuffer(bytes(total["grads"])) / total["n"]
        losses.append(total["loss"] / total["n"])
        first = BETA1 * first + (1 - BETA1) * grad
        second = BETA2 * second + (1 - BETA2) * grad * grad
        move = (first / (1 - BETA1 ** step)) / (np.sqrt(second / (1 - BETA2 ** step)) + TINY)
        network = Network(network.sizes, network.weights - rate * move)
    return network, losses


def network_score(vector: Column, network: Network) -> Column:
    """The score of a vector; null for null."""

    @pandas_udf("double")
    def score(vectors):
        given = vectors.notna()
        out = vectors.astype(object).where(given, None)
        if given.any():
            out[given] = network.scores(np.stack(vectors[given].to_numpy()).astype(float))
        return out.astype(float)

    return score(vector)


def score_with(pairs: DataFrame, network: Network) -> DataFrame:
    return pairs.withColumns({
        "score_chosen": network_score(F.col("chosen"), network), "score_rejected": network_score(F.col("rejected"), network)})
