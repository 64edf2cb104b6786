"""Sinks of the streams; every one gives the same table when a batch is repeated."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_append(stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    """Events appended to a table, exactly once by the file sink's log."""
    return (
        stream.writeStream.format(fmt).outputMode("append").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start(path)
    )


def write_parts(stream: DataFrame, part, path: str, checkpoint: str) -> StreamingQuery:
    """``part`` of every batch, a DataFrame function, in a folder of its own, replaced when the batch is repeated."""

    def write(batch: DataFrame, batch_id: int) -> None:
        part(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _files(spark: SparkSession, path: str):
    """The file system of a path and a maker of paths in it."""
    jvm = spark._jvm.org.apache.hadoop.fs
    return jvm.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()), jvm.Path


def _numbered(spark: SparkSession, path: str, prefix: str = "") -> list[int]:
    """The numbers that the names in a folder end in, behind ``prefix``; none where there is no such folder."""
    fs, at = _files(spark, path)
    if not fs.exists(at(path)):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at(path))]
    return sorted(int(n[len(prefix):]) for n in names if n.startswith(prefix) and n[len(prefix):].isdigit())


def committed(spark: SparkSession, checkpoint: str) -> int | None:
    """The last batch that a stream has committed; it is never repeated. None before the first."""
    return max(_numbered(spark, f"{checkpoint}/commits"), default=None)


def _newest_base(spark: SparkSession, path: str) -> int | None:
    return max(_numbered(spark, f"{path}/_bases", "upto="), default=None)


def _stored(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """The rows of the newest base and of the batches behind it, with the number of their batch (of the base's last one)."""
    base = _newest_base(spark, path)
    batches = [n for n in _numbered(spark, path, "batch=") if (base is None or n > base) and (upto is None or n <= upto)]
    folders = [f"{path}/batch={n}" for n in batches]
    rows = None
    if folders:
        rows = spark.read.option("basePath", path).parquet(*folders).withColumn("batch", F.col("batch").cast("long"))
    if base is not None:
        old = spark.read.parquet(f"{path}/_bases/upto={base}")
        old = old if "batch" in old.columns else old.withColumn("batch", F.lit(base).cast("long"))
        rows = old if rows is None else old.unionByName(rows)
    return spark.read.parquet(path) if rows is None else rows


def all_parts(spark: SparkSession, path: str) -> DataFrame:
    """The parts of all batches, those of the newest base in place of the batches it holds."""
    return _stored(spark, path).drop("batch")


def compact(spark: SparkSession, path: str, upto: int, merge) -> int | None:
    """Merge the newest base and the batches up to a committed one into a new base; the number of the base that holds now.

    ``merge`` turns the stored rows, with their ``batch``, into fewer rows that mean
    the same. The base is written aside and takes its place by one rename, so a
    compaction that breaks off changes nothing that is read; run again, it does its
    work anew. Folders that the base replaces are removed afterwards, or by the next
    run: a reader that has planned its files before must have read them by then.
    """
    fs, at = _files(spark, path)
    base = _newest_base(spark, path)
    held = [n for n in _numbered(spark, path, "batch=") if n <= upto]
    if any(base is None or n > base for n in held):
        aside = f"{path}/_aside/{uuid.uuid4().hex}"
        merge(_stored(spark, path, upto)).write.parquet(aside)
        base = max(held)
        fs.mkdirs(at(f"{path}/_bases"))
        if not fs.rename(at(aside), at(f"{path}/_bases/upto={base}")):
            raise OSError(f"no base at {path}/_bases/upto={base}")
    for n in held:
        if base is not None and n <= base:
            fs.delete(at(f"{path}/batch={n}"), True)
    for n in _numbered(spark, f"{path}/_bases", "upto="):
        if n < base:
            fs.delete(at(f"{path}/_bases/upto={n}"), True)
    return base


def newest_rows(rows: DataFrame, keys) -> DataFrame:
    """The newest row per key of stored updates, with its batch: what a base of updates keeps."""
    values = [c for c in rows.columns if c not in [*keys, "batch"]]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_v"), F.max("batch").alias("batch"))
    return newest.select(*keys, "_v.*", "batch")


def write_updates(stream: DataFrame, path: str, checkpoint: str, transform=None) -> StreamingQuery:
    """Changed rows of every batch in a folder of their own, replaced when the batch is repeated."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch if transform is None else transform(batch)
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def latest_updates(spark: SparkSession, path: str, keys) -> DataFrame:
    """The newest row per key of a table of updates."""
    return newest_rows(_stored(spark, path), keys).drop("batch")


def alert_rows(batch: DataFrame, kind: str, message) -> DataFrame:
    """Alerts as rows (kind, user_id, id of the rating where there is one, message), the message built from the row."""
    return batch.select(F.lit(kind).alias("kind"), "user_id", *(["id"] if "id" in batch.columns else []), message.alias("message"))


def write_alerts(path: str, kind: str, message):
    """A ``foreachBatch`` function that writes the alerts of a batch, once per batch id."""

    def write(batch: DataFrame, batch_id: int) -> None:
        alert_rows(batch, kind, message).write.mode("overwrite").json(f"{path}/kind={kind}/batch={batch_id}")

    return write


def finish(query: StreamingQuery, timeout: float | None = None) -> StreamingQuery:
    """Wait for an available-now stream to its end, at most ``timeout`` seconds if given; its error, if any, is raised here."""
    if timeout is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout):
        query.stop()
        raise TimeoutError(f"stream not finished after {timeout} s")
    return query
