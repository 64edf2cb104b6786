"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", shuffle_partitions: str = "8", memory: str = "12g") -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("larder")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder; on a
    cluster a machine-local folder would be lost with its executor, so the
    setting is required there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_folder()


@lru_cache(maxsize=1)
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="larder-")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def task_count(spark: SparkSession) -> int:
    """Tasks of a shuffle as the session sets them; the cluster's cores where that is no number."""
    value = spark.conf.get("spark.sql.shuffle.partitions")
    return int(value) if value.isdigit() else spark.sparkContext.defaultParallelism


#: For every open ``passing`` block the paths that ``settled`` has written in it, the innermost last.
_passing: ContextVar[tuple] = ContextVar("passing", default=())
# Shuffle files go after the query that made them, not whenever the driver happens to collect its garbage.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that ``settled`` writes within the block go at its end, and what a write in it has shuffled goes with the write.

    Nothing that is read after the block may come from a table settled in it, unless that was settled as ``lasting``.
    """
    paths, before = [], spark.conf.get(RELEASE, None)
    token = _passing.set((*_passing.get(), paths))
    spark.conf.set(RELEASE, "true")
    try:
        yield
    finally:
        _passing.reset(token)
        spark.conf.unset(RELEASE) if before is None else spark.conf.set(RELEASE, before)
        at = spark._jvm.org.apache.hadoop.fs.Path
        for path in paths:
            at(path).getFileSystem(spark._jsc.hadoopConfiguration()).delete(at(path), True)


def settled(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """The rows written once below the shared folder and read back.

    For a table that a plan needs several times: its lineage ends here, so it is
    neither computed again by the other branches nor after a lost executor.
    Within ``passing`` the table is packed tighter and goes with the block; a
    ``lasting`` one belongs to the block around it, if there is one.
    """
    path, blocks = scratch_path(df.sparkSession, name), _passing.get()
    for paths in (blocks[:-1] if lasting else blocks)[-1:]:
        paths.append(path)
    df.write.parquet(path, compression="zstd" if blocks else None)
    return df.sparkSession.read.schema(df.schema).parquet(path)
