"""Mixing sources to target weights as a time-varying curriculum.

Every source has a weight schedule over the training time from 0 to 1, a line
whose integral is the source's target. The cumulative token demand of a source
is that integral up to a time; inverting it turns a document's place in its
source's token order into the time at which the mix reads it. The documents are
then sorted by that position across all sources.

DataFrame functions only. A source's rows are never ordered in one task: token
sums per (source, bucket of the order's hash) come first, and rows are ordered
inside their bucket only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from larder.llm.common import WORD, table_of
from larder.session import settled

#: Weights, dealt to the sources in order, again from the first after the last.
WEIGHTS = (5, 2, 1)
#: Slopes of the schedules, dealt likewise: a source's weight runs from 1 - slope to 1 + slope times its mean.
SLOPES = (-0.5, 0.0, 0.5)
#: Hexadecimal digits of the order's hash that name a bucket.
BUCKET_DIGITS = 3


def targets(sizes: DataFrame, share: float, most: float, weights: tuple = WEIGHTS) -> DataFrame:
    """(source, source_size, rank, target) from (source, source_size).

    The sources share ``share`` times all tokens by weight; a target stops at
    ``most`` times its source's size and the excess goes to the others by weight
    until none is above. Sorted by the weight at which a source is full, the full
    ones are a prefix, so that running sums give the level at which it ends.
    """
    ordered = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    dealt = ordered.withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") - 1) % len(weights) + 1))
    full = dealt.withColumns({"cap": F.col("source_size") * F.lit(most)}).withColumn("level", F.col("cap") / F.col("weight"))
    by_level = Window.orderBy("level", "rank")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    summed = full.withColumns({
        "caps": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "weights": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        "all": F.sum("source_size").over(everything) * F.lit(share),
    })
    # The level if this source and all above it share what the ones before leave.
    reached = summed.withColumn("reached", (F.col("all") - F.col("caps")) / F.col("weights"))
    last = reached.withColumn("final", F.max(F.when(F.col("reached") <= F.col("level"), F.col("reached"))).over(everything))
    target = F.least(F.col("cap"), F.coalesce(F.col("final"), F.col("level")) * F.col("weight"))
    return last.select("source", "source_size", "rank", target.alias("target"))


def position(share: F.Column, slope: F.Column) -> F.Column:
    """The time at which the given share of a source's demand is met: the inverse of (1-s)t + s t^2."""
    start = F.lit(1.0) - slope
    return F.when(slope == 0, share).otherwise((F.sqrt(start * start + F.lit(4.0) * slope * share) - start) / (F.lit(2.0) * slope))


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple = WEIGHTS, slopes: tuple = SLOPES) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, position, again; sorted by position.

    size: words of the text. A source's documents come in the order of the md5
    of their ids; the mix reads that order from its start until the target is
    met, a second time where the target is above the source's size. taken counts
    the words that it reads of the document, position and again are the times of
    the first and second reading (null where there is none).

    A null or empty text has size 0 and is never read; a null source is the last
    one; a null doc_id comes before the others; rows with the same id are read
    one after the other. ``most`` may not be above 2. No row gives no row.
    """
    own = table_of(docs, "doc_id", "source", "text").select(
        "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("order"),
    ).withColumn("bucket", F.substring("order", 1, BUCKET_DIGITS))
    # A null source gets a name of its own for the joins: names of sources keep their first letter.
    # Written once: sums and positions both need the sizes, and texts are read for them only here.
    own = settled(own.withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))), "sizes")
    buckets = own.groupBy("key", "bucket").agg(F.sum("size").alias("held"), F.min("source").alias("source"))
    sizes = buckets.groupBy("key").agg(F.sum("held").alias("source_size"), F.min("source").alias("source"))
    goals = sizes.select("key").join(targets(sizes.select("source", "source_size"), share, most, weights).withColumn(
        "key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))), "key")
    starts = buckets.select("key", "bucket", F.coalesce(F.sum("held").over(
        Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    plan = starts.join(goals.select("key", "source_size", "rank", "target"), "key")
    inside = Window.partitionBy("key", "bucket").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = own.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(plan, ["key", "bucket"])
    offset, words = F.col("start") + F.col("inside"), F.floor("target")
    read = lambda first: F.least(F.greatest(words - first, F.lit(0)), F.col("size"))
    first, second = read(offset), read(offset + F.col("source_size"))
    slope = F.element_at(F.array(*[F.lit(float(s)) for s in slopes]), (F.col("rank") - 1) % len(slopes) + 1)
    when = lambda start, n: F.when(n > 0, position((start + n / F.lit(2.0)) / F.col("target"), slope))
    return placed.select(
        "doc_id", "size", "source_size", "target", (first + second).cast("long").alias("taken"),
        when(offset, first).alias("position"), when(offset + F.col("source_size"), second).alias("again"),
    ).orderBy(F.col("position").asc_nulls_last(), "doc_id")
