"""Connected components of a table of links, by alternating large stars and small stars.

Links stay a distributed table throughout. The minima of a step are written
before they are joined, so that both sides of each join are plain shuffles, of
which Spark splits the large partitions: the hub of a star is no hot task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.session import settled


def star_step(links: DataFrame, large: bool) -> DataFrame:
    """Large star: every node's greater neighbours, small star: its lesser ones, hung below its least neighbour."""
    if large:
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = settled(both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least")), "least")
    hung = both.join(least, "u")
    if large:
        return hung.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("least").alias("v"))
    below = hung.where(F.col("v") != F.col("least")).select(F.col("v").alias("u"), F.col("least").alias("v"))
    return below.union(least.select("u", F.col("least").alias("v")))


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes that have a link; component is the smallest node reachable.

    ``links`` has columns u and v, long; repeated links and links to itself do no harm.
    """
    links = settled(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links")
    state = None
    while True:
        for large in (True, False):
            links = settled(star_step(links, large).where("u <> v").distinct(), "links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
