"""Exact quantiles without holding a group in one task.

``percentile`` keeps every distinct value of a group in one aggregation buffer.
Here a sketch brackets every wanted position between two cut points, the rows
are counted per slice between the cuts, and only the values of slices that hold
a wanted position are counted, moved and sorted: with a sound sketch 0.4 % of
the rows per position. The result is exact whatever the sketch says; it only
decides how many rows move.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.operators.ordering import packed
from larder.session import settled

# Values of a key that are one slice, and the tasks that share a larger key's join to its cut points.
WHOLE, SALTS = 4096, 16
# The sketch's size, and how far beside a wanted position the cut points lie: three times its rank error (99 %).
SKETCH, BESIDE = 4096, 0.002


def as_number(c: Column) -> Column:
    """As a double; minus zero becomes zero."""
    return c.cast("double") + F.lit(0.0)


def keyed_values(df: DataFrame, keys, value: str) -> DataFrame:
    """(_key, _v) per row."""
    return df.select(packed(*keys).alias("_key"), as_number(F.col(value)).alias("_v"))


def sketched(v: Column) -> list:
    """Aggregates: the number of values and their sketch, which takes no NaN; NaN sorts behind infinity."""
    return [F.count(v).alias("n"), F.kll_sketch_agg_double(F.nanvl(v, F.lit(float("inf"))), SKETCH).alias("_sketch")]


def moments(v: Column) -> list:
    """Aggregates: mean, sample deviation, min and max."""
    return [F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max")]


def with_cuts(marks: DataFrame, probs: dict) -> DataFrame:
    """The sketch turned into two cut points per wanted position."""
    near = [F.lit(min(max(p + d, 0.0), 1.0)) for p in probs.values() for d in (-BESIDE, BESIDE)]
    cuts = F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("_sketch", F.array(*near)))
    return marks.withColumn("_cuts", cuts).drop("_sketch")


def slice_at(v: Column, cuts) -> Column:
    """Twice the number of cut points below the value, and one for each that it equals: a cut point is a slice of its own."""
    return reduce(lambda a, b: a + b, [F.when(c < v, 2).when(c == v, 1).otherwise(0) for c in cuts])


def exact_quantiles(df: DataFrame, keys, value: str, probs: dict, whole: int = WHOLE) -> DataFrame:
    """Linear-interpolated quantiles per key, nulls left out; ``probs`` names them. The values are written once."""
    rows = settled(keyed_values(df, keys, value), "values")
    marks = settled(with_cuts(rows.groupBy("_key").agg(*sketched(F.col("_v"))), probs), "marks")
    return quantiles(rows, marks, probs, whole).select("_key.*", *probs)


def _sliced(rows: DataFrame, cuts: DataFrame, n_cuts: int) -> DataFrame:
    """Rows with the slice of their value; a key without cuts is slice 0.

    Keys meet their cuts by a salt beside the key, so that a hot key is not one task of this join.
    """
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    salted = rows.filter(F.col("_v").isNotNull()).withColumn("_salt", F.pmod(F.xxhash64("_v"), F.lit(SALTS)).cast("int"))
    at = slice_at(F.col("_v"), [F.get("_cuts", F.lit(i)) for i in range(n_cuts)])
    return salted.join(cuts.withColumn("_salt", salts), ["_key", "_salt"], "left").withColumn("_slice", at)


def quantiles(rows: DataFrame, marks: DataFrame, probs: dict, whole: int = WHOLE) -> DataFrame:
    """Quantiles per key of (_key, _v) rows; ``marks`` has n and _cuts per key. Both are read twice.

    Keys of at most ``whole`` values are one slice.
    """
    cuts = marks.filter(F.col("n") > whole).select("_key", "_cuts")
    totals = _sliced(rows, cuts, 2 * len(probs)).groupBy("_key", "_slice").agg(F.count(F.lit(1)).alias("_m"))
    positions = settled(_positions(totals, probs), "positions")
    held = cuts.join(positions.groupBy("_key").agg(F.collect_list("_slice").alias("_held")), "_key")
    counts = (
        _sliced(rows, held, 2 * len(probs))
        .filter(F.col("_held").isNull() | F.array_contains("_held", F.col("_slice")))
        .groupBy("_key", "_slice", "_v").agg(F.count(F.lit(1)).alias("_c"))
    )
    return _at_positions(counts, positions, probs)


def _positions(totals: DataFrame, probs: dict) -> DataFrame:
    """Positions wanted per key, and the slices they fall in, from the rows per slice: few rows per key."""
    ahead = Window.partitionBy("_key").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    wanted = []
    for name, p in probs.items():
        at = F.lit(p) * (F.col("_total") - 1)
        for upper, pos in ((False, F.floor(at)), (True, F.ceil(at))):
            wanted.append(F.struct(
                F.lit(name).alias("q"), pos.alias("pos"), (at - F.floor(at)).alias("frac"), F.lit(upper).alias("upper")
            ))
    return (
        totals.withColumn("_ahead", F.coalesce(F.sum("_m").over(ahead), F.lit(0)))
        .withColumn("_total", F.sum("_m").over(Window.partitionBy("_key")))
        .withColumn("_wanted", F.filter(
            F.array(*wanted),
            lambda w: (w["pos"] >= F.col("_ahead")) & (w["pos"] < F.col("_ahead") + F.col("_m")),
        ))
        .filter(F.size("_wanted") > 0)
        .select("_key", "_slice", "_ahead", "_wanted")
    )


def _at_positions(counts: DataFrame, positions: DataFrame, probs: dict) -> DataFrame:
    """Quantiles per key from the counted values of the slices that hold a position."""
    upto = Window.partitionBy("_key", "_slice").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    hits = (
        counts.join(positions, ["_key", "_slice"])
        .withColumn("_to", F.col("_ahead") + F.sum("_c").over(upto))
        .withColumn("_from", F.col("_to") - F.col("_c"))
        .withColumn("_w", F.explode("_wanted"))
        .filter((F.col("_w.pos") >= F.col("_from")) & (F.col("_w.pos") < F.col("_to")))
    )
    result = []
    for name in probs:
        is_q = F.col("_w.q") == name
        low = F.max(F.when(is_q & ~F.col("_w.upper"), F.col("_v")))
        high = F.max(F.when(is_q & F.col("_w.upper"), F.col("_v")))
        frac = F.max(F.when(is_q, F.col("_w.frac")))
        result.append((low + (high - low) * frac).alias(name))
    return hits.groupBy("_key").agg(*result)


def described(df: DataFrame, keys, value: str, probs: dict) -> DataFrame:
    """Moments and quantiles per key; keys and values are written once and read by all parts."""
    rows = settled(keyed_values(df, keys, value), "values")
    v = F.col("_v")
    marks = settled(with_cuts(rows.groupBy("_key").agg(*sketched(v), *moments(v)), probs), "marks")
    return marks.join(quantiles(rows, marks, probs), "_key", "left").select(
        "_key.*", "n", "mean", "std", "min", *probs, "max"
    )


def described_columns(df: DataFrame, columns, probs: dict) -> DataFrame:
    """Moments and quantiles of each column that has a value, as rows of ``column``.

    One scan for all sketches, then two of each column alone. The few cut points per column pass through the driver, so
    that the scans compare with constants; the rows neither are stacked nor join anything.
    """
    def key(c: str) -> Column:
        return packed(F.lit(c).alias("column")).alias("_key")

    def part(c: str) -> DataFrame:
        rows = df.select(as_number(F.col(c)).alias("_v")).filter(F.col("_v").isNotNull())
        return rows.withColumn("_slice", slice_at(F.col("_v"), [F.lit(x) for x in cuts[c]]))

    def union(parts) -> DataFrame:
        return reduce(lambda a, b: a.unionByName(b), parts)

    seen = [F.struct(key(c), *sketched(as_number(F.col(c))), *moments(as_number(F.col(c)))) for c in columns]
    rows = df.agg(F.array(*seen).alias("_rows")).select(F.explode("_rows").alias("r")).select("r.*")
    marks = settled(with_cuts(rows.filter(F.col("n") > 0), probs), "marks")
    cuts = {r[0]: r[1] for r in marks.select("_key.column", "_cuts").collect()}
    if not cuts:
        return marks.select("_key.*", "n", "mean", "std", "min", *[F.col("mean").alias(q) for q in probs], "max")
    totals = union(part(c).groupBy("_slice").agg(F.count(F.lit(1)).alias("_m")).select(key(c), "_slice", "_m") for c in cuts)
    positions = settled(_positions(totals, probs), "positions")
    held = {c: [] for c in cuts}
    for r in positions.select("_key.column", "_slice").collect():
        held[r[0]].append(r[1])
    counts = union(
        part(c).filter(F.col("_slice").isin(held[c])).groupBy("_slice", "_v").agg(F.count(F.lit(1)).alias("_c"))
        .select(key(c), "_slice", "_v", "_c") for c in cuts
    )
    return marks.join(_at_positions(counts, positions, probs), "_key", "left").select(
        "_key.*", "n", "mean", "std", "min", *probs, "max"
    )
