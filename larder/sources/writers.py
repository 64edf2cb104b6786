"""Sinks: snapshots, JSON lines, partitioned and routed outputs, append logs, database append."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from larder.functions.clock import at


def write_snapshot(df: DataFrame, path: str, fmt: str = "parquet", **options) -> None:
    """A whole table, replacing the last snapshot."""
    writer = df.write.mode("overwrite").options(**options)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.format(fmt).save(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """UTF-8 JSON lines; null fields are written, so that every line has all keys."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_by_persona(df: DataFrame, path: str, col: str = "persona", max_rows: int = 1_000_000) -> None:
    """One folder per persona; a hot persona is split into files of at most ``max_rows`` rows.

    Reading ``path`` without a filter is the file of all personas. Every task moves its own files
    into place: with many personas the driver would be at it for longer than the tasks write.
    """
    df.write.mode("overwrite").partitionBy(col).option("maxRecordsPerFile", max_rows).option(
        "mapreduce.fileoutputcommitter.algorithm.version", 2).json(path)


def read_all_pairs(spark: SparkSession, paths, schema) -> DataFrame:
    """The union of all personas' pairs."""
    return spark.read.schema(schema).json(list(paths))


def write_routed(df: DataFrame, ok_path: str, bad_path: str, col: str = "route", ok: str = "accepted") -> None:
    """Accepted rows to one path, the others with their reason to another.

    The routed rows are written once, partitioned by route, next to the targets,
    and both outputs read that table: the judging ahead of it runs once, and a
    lost executor costs no more than its tasks.
    """
    spark = df.sparkSession
    staged = f"{ok_path.rstrip('/')}.routed"
    df.write.mode("overwrite").partitionBy(col).parquet(staged)
    routed = spark.read.schema(df.schema).parquet(staged)
    write_jsonl(routed.filter(F.col(col) == ok).drop(col, "reason"), ok_path)
    write_jsonl(routed.filter(~F.col(col).eqNullSafe(ok)).drop(col), bad_path)


def append_jdbc_json(df: DataFrame, url: str, table: str, json_cols=(), properties: dict | None = None) -> int:
    """Rows appended to a database table, JSON columns as text that the database casts; returns the row count."""
    seen = Observation("appended")
    ready = df.withColumns({c: F.col(c).cast("string") for c in json_cols}) if json_cols else df
    counted = ready.observe(seen, F.count(F.lit(1)).alias("n"))
    options = {"stringtype": "unspecified", "batchsize": "10000", **(properties or {})}
    counted.write.format("jdbc").options(url=url, dbtable=table, **options).mode("append").save()
    return seen.get["n"]


def append_log(df: DataFrame, path: str) -> None:
    """Rows added to a JSON-lines log."""
    write_jsonl(df, path, "append")


def register_run(
    spark: SparkSession, version: str, artifact: str, notes: str, as_of: datetime,
    eval_summary: str | None = None, bias_report: str | None = None,
) -> DataFrame:
    """One registry row, to be appended to the registry table."""
    return spark.range(1).select(
        F.lit(version).alias("version"), F.lit(artifact).alias("artifact"), F.lit(notes).alias("notes"),
        at(as_of).alias("registered_at"), F.lit(eval_summary).cast("string").alias("eval_summary"),
        F.lit(bias_report).cast("string").alias("bias_report"),
    )
