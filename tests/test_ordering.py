import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.operators import ordering
from larder.operators.quantiles import WHOLE, exact_quantiles

PROBS = {"q25": 0.25, "q50": 0.5, "q75": 0.75, "q0": 0.0, "q100": 1.0}


def skewed(n=3000, seed=3):
    rng = random.Random(seed)
    return [(0 if rng.random() < 0.4 else rng.randint(1, 20), i, rng.choice([rng.random() * 100, float(rng.randint(0, 3))])) for i in range(n)]


def test_running_number(spark):
    data = skewed()
    df = spark.createDataFrame(data, "k int, id int, v double").repartition(7)
    got = {(r.k, r.id): r.row_number for r in ordering.running_number(df, ["k"], ["v", "id"], F.floor("v")).collect()}
    want = {}
    for key in {d[0] for d in data}:
        for n, d in enumerate(sorted((v, i) for k, i, v in data if k == key), 1):
            want[key, d[1]] = n
    assert got == want


def test_running_number_keeps_null_keys(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (1, 3)], "k int, id int")
    got = sorted((r.id, r.row_number) for r in ordering.running_number(df, ["k"], ["id"], F.lit(0)).collect())
    assert got == [(1, 1), (2, 2), (3, 1)]


def test_rank_with_ties(spark):
    data = skewed(500)
    df = spark.createDataFrame(data, "k int, id int, score double")
    got = {(r.k, r.id): r.rank for r in ordering.rank_within(df, ["k"], "score").collect()}
    for k, i, v in data:
        assert got[k, i] == 1 + sum(1 for k2, _, v2 in data if k2 == k and v2 > v)


def test_rank_of_shared_and_missing_scores(spark):
    """A third of the rows share one score; null scores rank behind all others, together."""
    data = [(1, i, 7.0 if i % 3 == 0 else None if i % 10 == 1 else float(i)) for i in range(600)]
    df = spark.createDataFrame(data, "k int, id int, score double").repartition(5)
    got = {r.id: r.rank for r in ordering.rank_within(df, ["k"], "score").collect()}
    low = float("-inf")
    values = [low if v is None else v for _, _, v in data]
    assert len(got) == 600
    for (_, i, _), v in zip(data, values):
        assert got[i] == 1 + sum(1 for x in values if x > v)


@pytest.mark.parametrize("whole", [0, 50, WHOLE])
def test_quantiles_equal_numpy(spark, whole):
    """Whether all keys are cut into slices, the large ones or none."""
    data = skewed() + [(None, -1, 5.0), (None, -2, 7.0), (21, -3, None), (22, -4, 1.0)]
    df = spark.createDataFrame(data, "k int, id int, v double").repartition(5)
    got = {r.k: r for r in exact_quantiles(df, ["k"], "v", PROBS, whole).collect()}
    keys = {k for k, _, v in data if v is not None}
    assert set(got) == keys
    for k in keys:
        values = [v for k2, _, v in data if k2 == k and v is not None]
        for name, p in PROBS.items():
            assert abs(got[k][name] - np.quantile(values, p)) < 1e-9


def test_arg_max_and_first_n(spark):
    data = skewed(400)
    df = spark.createDataFrame(data, "k int, id int, v double")
    best = {r.k: r.id for r in ordering.arg_max_first(df, ["k"], "v", ["id"]).collect()}
    first = {}
    for r in ordering.first_n_per(df, ["k"], ["id"], 2).collect():
        first.setdefault(r.k, set()).add(r.id)
    for key in {d[0] for d in data}:
        mine = [(i, v) for k, i, v in data if k == key]
        assert best[key] == min(mine, key=lambda x: (-x[1], x[0]))[0]
        assert first[key] == {i for i, _ in sorted(mine)[:2]}


def test_split_does_not_depend_on_partitions(spark):
    df = spark.range(2000)
    weights = {"train": 80, "test": 20}
    a = ordering.hash_split(df.repartition(3), "id", weights).groupBy("split").count().collect()
    b = ordering.hash_split(df.repartition(11), "id", weights).groupBy("split").count().collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    assert 0.75 < dict(map(tuple, a))["train"] / 2000 < 0.85


def test_quota_sample(spark):
    df = spark.range(1000).withColumn("s", F.when(F.col("id") % 10 == 0, "a").when(F.col("id") % 10 < 5, "b").otherwise("c"))
    got = dict(map(tuple, ordering.quota_sample(df, "s", {"a": 500, "b": 30}, "id").groupBy("s").count().collect()))
    assert got == {"a": 100, "b": 30}


def test_slices_never_decrease(spark):
    df = spark.createDataFrame([(float(v),) for v in range(5000)] + [(2.5,)] * 900 + [(None,)], "v double")
    cuts = df.agg(ordering.cut_points("v")).scalar()
    got = df.withColumn("c", cuts).select("v", ordering.slice_of(F.col("v"), F.col("c")).alias("s")).collect()
    got = sorted((r.v, r.s) for r in got if r.v is not None)
    assert all(a[1] <= b[1] for a, b in zip(got, got[1:])) and got[0][1] == 0 and got[-1][1] == 255
