"""Pairwise preference ranking."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.text import hash_bucket
from larder.operators.ordering import arg_max_first, rank_within
from larder.session import settled


def difference(chosen: Column, rejected: Column) -> Column:
    return F.zip_with(chosen, rejected, lambda a, b: (a - b).cast("double"))


def fit_pair_ranker(pairs: DataFrame, key: str = "pair_id", max_iter: int = 50, reg: float = 0.01) -> LogisticRegressionModel:
    """Linear ranker on (chosen - rejected): logistic loss without intercept.

    Half of the pairs, by the hash of their key, are mirrored so that both labels occur.
    """
    mirrored = hash_bucket(F.col(key), 2) == 1
    diff = difference(F.col("chosen"), F.col("rejected"))
    rows = pairs.select(
        array_to_vector(F.when(mirrored, F.transform(diff, lambda x: -x)).otherwise(diff)).alias("features"),
        F.when(mirrored, 0.0).otherwise(1.0).alias("label"),
    )
    return LogisticRegression(
        maxIter=max_iter, regParam=reg, fitIntercept=False, standardization=False
    ).fit(rows)


def dot(vector: Column, weights) -> Column:
    """Score of a vector: a product and a sum inside the JVM."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    return F.aggregate(F.zip_with(vector, w, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def score_pairs(pairs: DataFrame, weights) -> DataFrame:
    return pairs.withColumns({
        "score_chosen": dot(F.col("chosen"), weights), "score_rejected": dot(F.col("rejected"), weights)
    })


def pair_accuracy(scored: DataFrame) -> DataFrame:
    """Share of pairs whose chosen side scores strictly higher."""
    return scored.agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.avg((F.col("score_chosen") > F.col("score_rejected")).cast("double")).alias("accuracy"),
    )


def rank_candidates(scored: DataFrame, key: str = "request_id") -> DataFrame:
    """Competition rank per request; the scores are written once, so that no branch computes them again."""
    return rank_within(settled(scored, "scored"), [key], "score")


def score_and_pick(candidates: DataFrame, weights, key: str = "request_id", candidate: str = "candidate_id") -> DataFrame:
    """The best candidate per request; the lowest id among equal scores."""
    scored = candidates.select(key, candidate, dot(F.col("features"), weights).alias("score"))
    return arg_max_first(scored, [key], "score", [candidate])


def ordered_by_score(scored: DataFrame, key: str = "request_id", place: str = "place") -> DataFrame:
    """Candidates with their ``position`` by falling score; equal scores keep the order of their places, null scores come last."""
    after = Window.partitionBy(key).orderBy(F.desc_nulls_last("score"), place)
    return scored.withColumn("position", F.row_number().over(after))
