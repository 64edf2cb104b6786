"""Request counters and latency histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.text import normalize_path

# Upper bounds of the latency buckets in seconds.
BOUNDS = [0.05, 0.1, 0.2, 0.5, 1, 2, 5, 10]
LABELS = ["method", "path", "status"]


def labelled(requests: DataFrame) -> DataFrame:
    """Requests with the path label that keeps the number of series small."""
    return requests.withColumn("path", normalize_path(F.col("path")))


def request_counts(requests: DataFrame) -> DataFrame:
    return labelled(requests).groupBy(*LABELS).agg(F.count(F.lit(1)).alias("n"))


def bucket_counts(duration: Column, bounds=None) -> list:
    """Cumulative counts: every bucket holds all durations up to its bound."""
    return [F.count_if(duration <= b).alias(f"le_{str(b).replace('.', '_')}") for b in bounds or BOUNDS]


def latency_histogram(requests: DataFrame, bounds=None) -> DataFrame:
    """Cumulative buckets, sum and count of durations per label set, one row each."""
    d = F.col("duration_s")
    return labelled(requests).groupBy(*LABELS).agg(
        *bucket_counts(d, bounds), F.sum(d).alias("sum_s"), F.count(d).alias("n")
    )


def histogram_rows(histogram: DataFrame, bounds=None) -> DataFrame:
    """One row per (labels, bound) with the cumulative count."""
    rows = F.array(*[
        F.struct(F.lit(float(b)).alias("le"), F.col(f"le_{str(b).replace('.', '_')}").alias("n"))
        for b in bounds or BOUNDS
    ])
    return histogram.select(*LABELS, F.explode(rows).alias("r")).select(*LABELS, "r.*")
