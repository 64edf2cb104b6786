"""Changes of a bucketed table against the same changes of a plain one."""

import pytest
from pyspark.sql import functions as F

from larder.sources import bucketed, changes

SCHEMA = "item_id long, user_id long, item_name string, quantity double, unit string, category string"


@pytest.fixture
def items(spark):
    return spark.range(2000).select(
        F.col("id").alias("item_id"), (F.col("id") % 7).alias("user_id"), F.concat(F.lit("item "), F.col("id")).alias("item_name"),
        (F.col("id") / 10).alias("quantity"), F.lit("kg").alias("unit"), F.lit("pantry").alias("category"))


@pytest.fixture
def path(items, tmp_path):
    path = str(tmp_path / "items")
    bucketed.write_bucketed(items, path, "item_id", 64)
    return path


def stored(tmp_path):
    return {p.name: sorted((f.name, f.stat().st_mtime_ns) for f in p.iterdir()) for p in (tmp_path / "items").iterdir() if p.name.startswith("_bucket=")}


def test_a_change_touches_its_buckets_only(spark, items, path, tmp_path, rows):
    new = spark.createDataFrame([(i, 0.5, None) for i in range(0, 1000, 100)], "item_id long, quantity double, unit string")
    before = stored(tmp_path)

    def change(held, given):
        return changes.update_items(held, given, ["item_id"])

    for _ in range(2):
        numbers = bucketed.change_bucketed(spark, path, SCHEMA, "item_id", new, change, 64)
        assert 0 < len(numbers) <= 10
        after = stored(tmp_path)
        assert {b for b in before if before[b] != after.get(b)} == {f"_bucket={n}" for n in numbers}
        assert rows(bucketed.read_bucketed(spark, path, SCHEMA)) == rows(changes.update_items(items, new, ["item_id"]))


def test_upsert_delete_and_insert(spark, items, path, rows):
    new = spark.createDataFrame([(5, 9, "five", 1.0, "g", "new"), (9999, 9, "more", 2.0, "g", "new"), (None, 9, "none", 2.0, "g", "new")], SCHEMA)
    bucketed.change_bucketed(spark, path, SCHEMA, "item_id", new, lambda held, given: changes.upsert(held, given, "item_id"), 64)
    want = changes.upsert(items, new, "item_id")
    assert rows(bucketed.read_bucketed(spark, path, SCHEMA)) == rows(want)
    gone = spark.createDataFrame([(9999,), (6,), (123456,)], "item_id long")
    bucketed.change_bucketed(spark, path, SCHEMA, "item_id", gone, changes.delete_items, 64)
    want = changes.delete_items(want, gone)
    assert rows(bucketed.read_bucketed(spark, path, SCHEMA)) == rows(want)
    added = spark.createDataFrame([(6, 1, "six"), (7, 1, "seven again")], "item_id long, user_id long, item_name string")
    for _ in range(2):
        bucketed.change_bucketed(
            spark, path, SCHEMA, "item_id", added, lambda held, given: changes.insert_items(held, bucketed.absent(held, given, "item_id")), 64)
    assert rows(bucketed.read_bucketed(spark, path, SCHEMA)) == rows(changes.insert_items(want, added.where("item_id = 6")))


def test_emptied_buckets_go(spark, path, tmp_path, rows):
    everything = spark.range(2000).select(F.col("id").alias("item_id"))
    bucketed.change_bucketed(spark, path, SCHEMA, "item_id", everything, changes.delete_items, 64)
    assert stored(tmp_path) == {}
    assert bucketed.change_bucketed(spark, path, SCHEMA, "item_id", everything.limit(0), changes.delete_items, 64) == []


def test_a_change_that_moves_rows_elsewhere_is_refused(spark, path):
    one = spark.range(1).select(F.col("id").alias("item_id"))
    with pytest.raises(ValueError):
        bucketed.change_bucketed(spark, path, SCHEMA, "item_id", one, lambda held, _: held.withColumn("item_id", F.col("item_id") + 1), 64)


def test_one_bucket_in_a_million_rows(spark, tmp_path):
    path = str(tmp_path / "many")
    bucketed.write_bucketed(spark.range(1_000_000).withColumn("v", F.lit(0)), path, "id", 128)
    new = spark.createDataFrame([(i * 99_999, 1) for i in range(10)], "id long, v int")
    numbers = bucketed.change_bucketed(spark, path, "id long, v int", "id", new, lambda held, given: changes.upsert(held, given, "id"), 128)
    assert len(numbers) <= 10
    assert bucketed.read_bucketed(spark, path, "id long, v int").agg(F.count("*"), F.sum("v"), F.countDistinct("id")).first()[:] == (1_000_000, 10, 1_000_000)
