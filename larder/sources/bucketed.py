"""Tables kept in folders by a hash of their key, so that a change reads and writes only the folders it touches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.session import settled

BUCKET = "_bucket"


def _number(keys, buckets: int) -> Column:
    """The bucket of a key: equal keys of any number type meet, null is a key like others."""
    return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(buckets)).cast("int")


def _named(keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def write_bucketed(df: DataFrame, path: str, keys, buckets: int = 256) -> None:
    """A whole table in ``buckets`` folders. Choose so many that a folder is what a change may rewrite."""
    numbered = df.withColumn(BUCKET, _number(_named(keys), buckets))
    numbered.repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(path)


def read_bucketed(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of all buckets."""
    return spark.read.schema(schema).parquet(path).drop(BUCKET)


def touched_buckets(changes: DataFrame, keys, buckets: int) -> list[int]:
    """The buckets that hold the keys of some changes: never more than there are buckets."""
    return sorted(r[0] for r in changes.select(_number(_named(keys), buckets).alias(BUCKET)).distinct().collect())


def change_bucketed(spark: SparkSession, path: str, schema, keys, changes: DataFrame, change: Callable, buckets: int = 256) -> list[int]:
    """Apply ``change(rows, changes)`` to the buckets that hold keys of ``changes``; the numbers of the buckets rewritten.

    Other buckets are neither read nor written. The new rows are written aside
    first, so nothing is lost if that breaks off. The buckets then take their place
    one by one; if this breaks off, run the change again: a change that gives the
    same rows when it is applied twice (an update, a delete, an upsert, or an insert
    of keys that are not there) ends in the same table.
    """
    keys = _named(keys)
    changes = settled(changes, "changes")
    numbers = touched_buckets(changes, keys, buckets)
    if not numbers:
        return []
    typed = schema if isinstance(schema, str) else schema.toDDL()
    stored = spark.read.schema(f"{typed}, {BUCKET} int").parquet(path).where(F.col(BUCKET).isin(numbers)).drop(BUCKET)
    new = settled(change(stored, changes).withColumn(BUCKET, _number(keys, buckets)), "buckets")
    filled = {r[0] for r in new.select(BUCKET).distinct().collect()}
    if not filled <= set(numbers):
        raise ValueError("a change must leave rows in the buckets of the keys that it changes")
    new.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for n in set(numbers) - filled:
        fs.delete(at(f"{path}/{BUCKET}={n}"), True)
    return numbers


def absent(rows: DataFrame, new: DataFrame, keys) -> DataFrame:
    """The new rows whose key is not there yet, one per key: an insert that may run twice."""
    keys = _named(keys)
    return new.dropDuplicates(keys).join(rows.select(*keys).distinct(), keys, "left_anti").select(*new.columns)
