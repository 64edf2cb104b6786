"""What a run leaves behind, and cooking against brute force."""

import random
import time

import pytest
from pyspark.sql import functions as F

from larder import session
from larder.operators import matching
from larder.operators.stock import deduction_amount
from larder.plans import jobs

INVENTORY = "user_id int, item_id int, item_name string, quantity double, unit string"


@pytest.fixture
def folder(monkeypatch, tmp_path):
    """A shared folder of the test's own."""
    shared = tmp_path / "shared"
    shared.mkdir()
    monkeypatch.setattr(session, "shared_folder", lambda spark: str(shared))
    return shared


def shuffled(spark) -> set:
    """Names of Spark's shuffle files."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def left_of(spark, before: set) -> set:
    """Shuffle files that came after ``before`` and stay: removing them takes a moment."""
    for _ in range(40):
        left = shuffled(spark) - before
        if not left:
            break
        time.sleep(0.25)
    return left


def test_a_cook_job_leaves_only_its_tables(spark, folder, tmp_path, rows):
    recipes = [(i, i % 5, f'{{"main_ingredients": ["{i % 3 + 1} kg rice", "1 kg bread rolls"]}}', 1, False) for i in range(200)]
    history = spark.createDataFrame(recipes, "id int, user_id int, recipe_json string, servings int, is_cooked boolean")
    inventory = spark.createDataFrame([(u, 1, "Rice", 90.0, "kg") for u in range(5)] + [(u, 2, "bread roll", 50.5, "kg") for u in range(5)], INVENTORY)
    ids = spark.createDataFrame([(i % 100,) for i in range(150)], "id int")
    before = shuffled(spark)
    done = jobs.cook_job(history, inventory, ids, str(tmp_path / "out"))
    assert left_of(spark, before) == set() and list(folder.iterdir()) == []
    rice = {u: 90.0 - sum(i % 3 + 1 for i in range(100) if i % 5 == u) for u in range(5)}
    assert rows(done["inventory"].select("user_id", "item_id", "quantity")) == sorted(
        [(u, 1, rice[u]) for u in range(5)] + [(u, 2, 30.5) for u in range(5)], key=str)
    assert rows(done["history"].select("id", "is_cooked")) == sorted([(i, i < 100) for i in range(200)], key=str)
    assert rows(spark.read.parquet(str(tmp_path / "out/cooked")).select("id")) == sorted([(i,) for i in range(100)], key=str)


def test_a_settled_history_goes_before_the_stock_is_read(spark, folder, tmp_path, rows, monkeypatch):
    recipes = [(1, 1, '{"main_ingredients": ["1 kg rice"]}', 1, False), (2, 1, '{"main_ingredients": ["2 kg rice"]}', 1, None)]
    history = spark.createDataFrame(recipes, "id int, user_id int, recipe_json string, servings int, is_cooked boolean")
    seen, apply = [], matching.apply_cooked
    monkeypatch.setattr(matching, "apply_cooked", lambda *a: seen.append([p.name for p in folder.iterdir()]) or apply(*a))
    done = jobs.cook_job(lambda: session.settled(history, "history"), spark.createDataFrame([(1, 1, "Rice", 9.0, "kg")], INVENTORY),
                         lambda h: h.where("id = 2").select("id"), str(tmp_path / "out"))
    assert seen == [[]] and rows(done["inventory"].select("quantity")) == [(7.0,)]
    assert rows(done["history"].select("id", "is_cooked")) == [(1, False), (2, True)]


def test_tables_go_with_their_block(spark, folder):
    before = spark.conf.get(session.RELEASE)
    with session.passing(spark):
        outer = session.settled(spark.range(10), "outer")
        with session.passing(spark):
            inner, lasting = session.settled(spark.range(3), "inner"), session.settled(spark.range(4), "lasting", lasting=True)
            assert inner.count() == 3
        assert sorted(p.name.split("-")[0] for p in folder.iterdir()) == ["lasting", "outer"]
        assert (outer.count(), lasting.count(), spark.conf.get(session.RELEASE)) == (10, 4, "true")
    assert list(folder.iterdir()) == []
    with pytest.raises(ValueError), session.passing(spark):
        session.settled(spark.range(3), "broken")
        raise ValueError
    assert list(folder.iterdir()) == [] and spark.conf.get(session.RELEASE) == before
    # Outside of a block tables stay, those that last beyond the only block too.
    with session.passing(spark):
        stays = session.settled(spark.range(4), "lasting", lasting=True)
    assert (stays.count(), session.settled(spark.range(5), "own").count(), len(list(folder.iterdir()))) == (4, 5, 2)


def test_an_event_counts_once(spark, rows):
    events = [(i, f"a{i}") for i in range(50)] + [(7, "a7")] * 30 + [(8, "a8"), (None, "n"), (None, "n")]
    once = matching._once(spark.createDataFrame(events, "id int, v string").repartition(5), "id")
    assert once.columns == ["id", "v"] and rows(once) == sorted(set(events), key=str)
    assert rows(matching._once(spark.createDataFrame([(None, "n"), (1, "a")], "id int, v string"), "id")) == sorted([(None, "n"), (1, "a")], key=str)


def test_deductions_equal_every_text_matched_by_itself(spark, rows):
    rng = random.Random(3)
    words = ["chicken", "breast", "rice", "almond", "milk", "tomato", "oil", "red", "onion", "egg"]

    def name():
        return " ".join(rng.sample(words, rng.randint(1, 3)))

    long = "long " + "abcde" * 60
    items = [(rng.randint(0, 4), i, rng.choice([name(), name().upper(), "", long]), i / 3, rng.choice(["kg", "g", "L", "pcs"])) for i in range(80)]
    cooked = [(i, rng.randint(0, 5), [f"{rng.randint(1, 9)} {rng.choice(['kg', 'cups', 'pieces'])} {rng.choice([name(), long, '??', 'zzz'])}" for _ in range(3)], rng.choice([0, 1, 2, None]))
              for i in range(60)]
    inventory = spark.createDataFrame(items, INVENTORY)
    recipes = spark.createDataFrame(cooked, "id int, user_id int, main_ingredients array<string>, servings int")
    used = matching.parsed_ingredients(recipes)
    want = used.join(matching.best_item_match(used, inventory), ["user_id", "ingredient"]).join(
        inventory.select("user_id", "item_id", F.col("unit").alias("item_unit")), ["user_id", "item_id"]).select(
        "user_id", "item_id", "ingredient_text", deduction_amount(F.col("qty"), F.col("unit"), F.col("item_unit"), F.col("servings")).alias("amount"))
    got = matching.cook_deductions(recipes, inventory)
    assert got.columns == want.columns and rows(got) == rows(want) and got.count() > 50
