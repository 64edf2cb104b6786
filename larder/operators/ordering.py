"""Order-dependent operators that keep one hot key off a single task.

A plain window over a key sorts all rows of that key in one task. The helpers
here count per (key, bucket) first, where the bucket is any expression that
never decreases along the order (a day, a range of scores), turn the counts
into offsets over the few buckets of a key, and sort only inside a bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.text import hash_bucket, once
from larder.functions.units import lookup


def packed(*cols) -> Column:
    """Columns as one struct: equal where all fields are equal or both null, so null keys join like any other.

    Grouping, joining and windows on the same packed column share one shuffle.
    """
    return F.struct(*cols)


def running_number(df: DataFrame, keys, order, bucket: Column, name: str = "row_number") -> DataFrame:
    """Row number per key along ``order``; ``bucket`` must never decrease along the order."""
    parts = df.withColumns({"_key": packed(*keys), "_bucket": packed(bucket.alias("at"))})
    return _shifted(parts, F.col("_bucket").asc(), F.row_number(), order, name).select(*df.columns, name)


def _shifted(parts: DataFrame, bucket_order: Column, number: Column, order, name: str, most=None) -> DataFrame:
    """``number`` along ``order`` inside each (_key, _bucket), shifted by the rows of the buckets ahead.

    With ``most`` (a column of the key) only buckets that begin below it are kept and sorted.
    """
    counts = parts.groupBy("_key", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    # One row per (key, bucket) from here on, so this window is small even for a hot key.
    ahead = Window.partitionBy("_key").orderBy(bucket_order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_key", "_bucket", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_offset"))
    if most is not None:
        offsets = offsets.filter(F.col("_offset") < most)
    inside = Window.partitionBy("_key", "_bucket").orderBy(*order)
    return parts.join(offsets, ["_key", "_bucket"]).withColumn(name, F.col("_offset") + number.over(inside))


def first_n_per(df: DataFrame, keys, order, n: int) -> DataFrame:
    """The first ``n`` rows per key along ``order``.

    The constant limit reaches the tasks ahead of the shuffle (window group
    limit, up to n = 1000 by default), so at most ``n`` rows per key and task are
    moved. For a larger ``n`` filter ``running_number``.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def arg_max_first(df: DataFrame, keys, score: str, tie) -> DataFrame:
    """The row with the highest score per key, the first along ``tie`` among equals.

    One aggregation with partial results per task, not a sort per key.
    """
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(F.col(score), *[(-F.col(t)) for t in tie]))
    return df.groupBy(*keys).agg(best.alias("_best")).select(*keys, "_best.*")


def quota_sample(df: DataFrame, stratum: str, quotas: dict, key: str) -> DataFrame:
    """At most ``quotas[stratum]`` rows per stratum, picked by the md5 of the key.

    Rows are bucketed by the first three hex digits; only the buckets that a
    quota reaches into are sorted, so a hot stratum costs a count and not a sort.
    """
    wanted = {k: int(v) for k, v in quotas.items()}
    digest = F.md5(F.col(key).cast("string"))
    parts = df.filter(F.col(stratum).isin(list(quotas))).withColumns({
        "_key": packed(stratum), "_digest": digest, "_bucket": F.substring(digest, 1, 3),
    })
    quota = lookup(wanted, F.col(f"_key.{stratum}"))
    picked = _shifted(parts, F.asc("_bucket"), F.row_number(), ["_digest", key], "_rn", quota)
    return picked.filter(F.col("_rn") <= quota).select(*df.columns)


def hash_split(df: DataFrame, key: str, weights: dict, salt: str = "") -> DataFrame:
    """A split label per row by the md5 of its key: the same under any partitioning."""
    total = sum(weights.values())
    bucket = hash_bucket(F.col(key), total, salt)
    label, reached = None, 0
    for name, weight in weights.items():
        reached += weight
        label = F.when(bucket < reached, name) if label is None else label.when(bucket < reached, name)
    return df.withColumn("split", label)


# Cut points come in FAN groups of FAN, so that a value is placed by two short scans.
FAN = 16


def cut_points(value: str) -> Column:
    """Aggregate: 255 approximate quantiles, whole and every 16th one; null without values."""
    cuts = F.approx_percentile(value, [i / FAN**2 for i in range(1, FAN**2)], 10000)
    return F.struct(cuts.alias("fine"), F.filter(cuts, lambda _, i: (i + 1) % FAN == 0).alias("coarse"))


def slice_of(value: Column, cuts: Column) -> Column:
    """How many cut points are not above the value: 0 to 255, never decreasing with it; 0 for null."""
    def below(points: Column) -> Column:
        return F.coalesce(F.size(F.filter(points, lambda c: c <= value)), F.lit(0))

    def place(group: Column) -> Column:
        return group * FAN + below(F.slice(cuts["fine"], group * FAN + 1, F.lit(FAN - 1)))

    return F.when(value.isNull() | cuts["fine"].isNull(), 0).otherwise(once(below(cuts["coarse"]), place))


def rank_within(df: DataFrame, keys, score: str) -> DataFrame:
    """Competition rank by descending score per key.

    Rows are counted per (key, score) first, and only the counts are sorted: a
    score that a third of the rows share is one row there. A sketch of the
    distinct scores gives the cut points; ranks inside a slice of scores are
    computed apart and shifted by the rows of the higher slices, so the sketch
    balances the work and does not enter the result. The rows then meet their
    rank by (key, score), where Spark splits what is large.
    """
    keyed = df.withColumns({"_key": packed(*keys), "_score": packed(F.col(score).alias("at"))})
    counts = keyed.groupBy("_key", "_score").agg(F.count(F.lit(1)).alias("_n"))
    at = F.col("_score.at")
    cuts = counts.agg(cut_points("_score.at")).scalar()
    sliced = counts.withColumn("_cuts", cuts).withColumn("_bucket", slice_of(at, F.col("_cuts"))).drop("_cuts")
    higher = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = sliced.groupBy("_key", "_bucket").agg(F.sum("_n").alias("_n")).select(
        "_key", "_bucket", higher(Window.partitionBy("_key").orderBy(F.desc("_bucket"))).alias("_offset"))
    inside = higher(Window.partitionBy("_key", "_bucket").orderBy(F.desc(at)))
    ranks = sliced.withColumn("_inside", inside).join(ahead, ["_key", "_bucket"]).select(
        "_key", "_score", (F.col("_offset") + F.col("_inside") + 1).alias("rank"))
    return keyed.join(ranks, ["_key", "_score"]).select(*df.columns, "rank")


def with_share_of_max(df: DataFrame, col: str, floor: float = 1.0) -> DataFrame:
    """The column as a percentage of its maximum (at least ``floor``)."""
    top = df.agg(F.greatest(F.max(col).cast("double"), F.lit(floor))).scalar()
    return df.withColumn("share_of_max", F.col(col) / top * 100)


def latest_run(runs: DataFrame, run_col: str = "run_ts") -> DataFrame:
    """The rows of the newest run."""
    return runs.filter(F.col(run_col) == runs.agg(F.max(run_col)).scalar())


def sorted_summary(df: DataFrame, keys) -> DataFrame:
    return df.orderBy(*keys)
