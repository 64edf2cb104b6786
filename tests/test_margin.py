"""The ranker with a margin: gradients by differences, one result for any partitioning, accuracy on pairs it has not seen."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.operators import margin, ranking


def test_gradients_by_differences():
    rng = np.random.default_rng(1)
    network = margin.Network.random((3, 5, 4, 1), 2)
    a, b = rng.normal(size=(6, 3)), rng.normal(size=(6, 3))
    grads, _ = network.gradient(a, b, 1.0)
    for i in range(len(network.weights)):
        step = np.zeros_like(network.weights)
        step[i] = 1e-6
        up, down = (margin.Network(network.sizes, network.weights + s * step).gradient(a, b, 1.0)[1] for s in (1, -1))
        assert grads[i] == pytest.approx((up - down) / 2e-6, abs=1e-4)


@pytest.fixture(scope="module")
def pairs(spark):
    """What is chosen lies nearer a ring than what is rejected: no linear score tells them apart."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(900):
        x, y = (rng.normal(size=2) for _ in range(2))
        good, bad = sorted((x, y), key=lambda v: abs(float(np.hypot(*v)) - 1.0))
        rows.append((i, [float(v) for v in good], [float(v) for v in bad]))
    rows += [(1000, None, [0.0, 0.0]), (1001, [0.0, 0.0], None)]
    return spark.createDataFrame(rows, "pair_id int, chosen array<double>, rejected array<double>")


def test_accuracy_above_the_linear_ranker(spark, pairs):
    learn, held = pairs.where("pair_id % 5 > 0"), pairs.where("pair_id % 5 = 0 AND pair_id < 1000")
    network, losses = margin.fit_margin_ranker(learn, steps=25, rate=3e-2)
    assert losses[-1] < 0.7 * losses[0]
    got = ranking.pair_accuracy(margin.score_with(held, network)).first()["accuracy"]
    linear = ranking.fit_pair_ranker(learn.where("chosen IS NOT NULL AND rejected IS NOT NULL")).coefficients
    assert got > 0.8 > ranking.pair_accuracy(ranking.score_pairs(held, linear)).first()["accuracy"]


def test_one_result_for_any_partitioning(spark, pairs, monkeypatch):
    monkeypatch.setattr(margin, "ROWS", 8)
    monkeypatch.setattr(margin, "FAN", 4)
    weights = [margin.fit_margin_ranker(pairs.repartition(n), steps=2)[0].weights for n in (1, 7)]
    assert (weights[0] == weights[1]).all()


def test_no_pairs_and_null_vectors(spark, pairs):
    network, losses = margin.fit_margin_ranker(pairs.where("false"))
    assert losses == [] and network.sizes[0] == 1
    network, _ = margin.fit_margin_ranker(pairs, steps=1)
    scored = margin.score_with(pairs.where("pair_id >= 1000"), network).orderBy("pair_id").collect()
    assert scored[0]["score_chosen"] is None and scored[0]["score_rejected"] is not None and scored[1]["score_rejected"] is None
