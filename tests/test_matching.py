import random
from difflib import SequenceMatcher
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.functions import similarity as sim
from larder.operators import matching

WORDS = ["chicken", "breast", "rice", "almond", "milk", "tomato", "cherry", "oil", "red", "onion", "egg", "eggplant"]


def norm(s):
    return re.sub(r"[^a-z0-9\s]", " ", s.lower()).strip()


def score(a, b):
    a, b = norm(a), norm(b)
    return SequenceMatcher(None, a, b).ratio() if a and b else 0.0


def best(items, name):
    found, top = None, 0.0
    for item_id, item in sorted(items):
        s = score(item, name)
        if s > top:
            found, top = item_id, s
    return (found, top) if top >= 0.45 else None


@pytest.fixture(scope="module")
def fixture(spark):
    """Ten users, one of which owns and asks for a third of everything; two names are longer than 200."""
    rng = random.Random(7)

    def name():
        return " ".join(rng.sample(WORDS, rng.randint(1, 3)))

    items, wanted = [], []
    for i in range(240):
        user = 0 if i % 3 == 0 else rng.randint(1, 9)
        items.append((user, i, rng.choice([name(), name().upper(), name() + "!", "", "x" * 3])))
        wanted.append((user, i, rng.choice([name(), name() + " (cut)", "zzz", "??", "ri"])))
    long = ("long " + "abcde" * 60)
    items += [(1, 900, long), (0, 901, long + "q")]
    wanted += [(1, 900, long), (0, 901, long)]
    inventory = spark.createDataFrame(items, "user_id int, item_id int, item_name string").withColumns(
        {"quantity": F.col("item_id") % 5 / 10, "unit": F.lit("kg")})
    ingredients = spark.createDataFrame(wanted, "user_id int, recipe_id int, ingredient string")
    return items, wanted, inventory, ingredients


@pytest.mark.parametrize("block", [3, 512])
def test_best_match_equals_brute_force(fixture, block):
    items, wanted, inventory, ingredients = fixture
    want = {}
    for user, _, name in wanted:
        found = best([(i, n) for u, i, n in items if u == user], name)
        if found:
            want[user, name] = (found[0], pytest.approx(found[1]))
    got = {(r.user_id, r.ingredient): (r.item_id, r.score)
           for r in matching.best_item_match(ingredients, inventory, block=block).collect()}
    assert got == want


@pytest.mark.parametrize("block", [3, 512])
def test_matching_items_equals_brute_force(fixture, block):
    items, wanted, inventory, ingredients = fixture
    want = {}
    for user, _, name in wanted:
        if not norm(name):
            continue
        names = {norm(n) for u, _, n in items if u == user and norm(n)}
        want[user, name] = sum(
            1 for n in names if set(n.split()) & set(norm(name).split()) or score(n, name) >= 0.45)
    got = {(r.user_id, r.ingredient): r.n_matches
           for r in matching.matching_items(ingredients, inventory, block=block).collect()}
    assert got == want


def test_containment_equals_brute_force(fixture):
    items, wanted, inventory, ingredients = fixture

    def fold(s):
        return re.sub(r"\s+", " ", norm(s))

    want = {}
    for user, _, name in wanted:
        hits = [i for u, i, n in items if u == user and fold(n) and fold(name)
                and (fold(name) in fold(n) or fold(n) in fold(name))]
        if hits:
            want[user, name] = min(hits)
    got = {(r.user_id, r.ingredient): r.item_id for r in matching.containing_item(ingredients, inventory).collect()}
    assert got == want
    states = matching.ingredient_availability(ingredients, inventory).collect()
    assert len(states) == len(wanted)
    assert all(r.missing == ((r.user_id, r.ingredient) not in want) for r in states)


def test_similarity_cases(spark):
    pairs = [("Chicken", "chicken"), ("chicken", "chicken breast"), ("rice", "chicken"), ("", "x"), ("rice", "pasta"), (None, "x")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r[0] for r in df.select(sim.similarity(F.col("a"), F.col("b"))).collect()]
    assert got[0] == 1.0 and 0.5 < got[1] < 1 and got[2] == pytest.approx(0.545, abs=0.001) and got[3] == 0.0 and got[5] is None
    words = [("breast chicken", "chicken breast"), ("tomato", "cherry tomato"), ("milk", "almond milk"), ("chicken", "beef"), ("rice", "pasta")]
    df = spark.createDataFrame(words, "a string, b string")
    assert [r[0] for r in df.select(sim.is_match(F.col("a"), F.col("b"))).collect()] == [True, True, True, False, False]


def test_bound_is_never_below_the_score():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc é") for _ in range(rng.randint(1, 12))) for _ in range(2))
        bound = sim.upper_bounds(sim.letter_counts([a]), sim.np.array([len(a)]), sim.letter_counts([b])[0], len(b))[0]
        assert bound >= SequenceMatcher(None, a, b).ratio()


def test_rule_hits(spark):
    ingredients = spark.createDataFrame([(1, "graham cracker"), (2, "eggplant"), (3, "x" * 150 + "y")], "id int, ingredient string")
    rules = spark.createDataFrame(
        [("meat", "ham", 2), ("meat", "cracker", 1), ("egg", "egg", 1), ("long", "x" * 140 + "y", 1), ("long", "x" * 120 + "z", 0)],
        "class string, keyword string, ord int")
    got = sorted(tuple(r) for r in matching.rule_hits(ingredients, rules).select("id", "class", F.length("keyword")).collect())
    assert got == [(1, "meat", 7), (2, "egg", 3), (3, "long", 141)]


def test_a_named_protein_must_be_in_stock(spark):
    inventory = spark.createDataFrame([(1, 1, "Rice", 1.0), (2, 1, "Chicken Thighs", 1.0), (2, 2, "rice", 1.0)],
                                      "user_id int, item_id int, item_name string, quantity double")
    ingredients = spark.createDataFrame([(1, 7, "rice"), (2, 8, "rice")], "user_id int, recipe_id int, ingredient string")
    requests = spark.createDataFrame([(1, 7, "CHICKEN and rice"), (2, 8, "chicken soup")], "user_id int, recipe_id int, request string")
    got = {r.recipe_id: r.has_missing for r in matching.recipes_missing_items(ingredients, inventory, requests).collect()}
    assert got == {7: True, 8: False}
    assert not any(r.has_missing for r in matching.recipes_missing_items(ingredients, inventory).collect())


def test_cooked_recipe(spark):
    inventory = spark.createDataFrame(
        [(1, 1, "Chicken Breast", 2.0, "lb"), (1, 2, "Rice", 1.5, "kg"), (1, 3, "Tomatoes", 0.05, "kg"), (2, 1, "Rice", 9.0, "kg")],
        "user_id int, item_id int, item_name string, quantity double, unit string")
    cooked = spark.createDataFrame(
        [(7, 1, ["2 lb chicken breast", "1 kg rice", ""], 2), (7, 1, ["2 lb chicken breast", "1 kg rice", ""], 2)],
        "id int, user_id int, main_ingredients array<string>, servings int")
    left = {(r.user_id, r.item_id): r.quantity for r in matching.apply_cooked(cooked, inventory).collect()}
    assert left == {(1, 1): 0.0, (1, 2): 0.0, (1, 3): 0.05, (2, 1): 9.0}
    # Units of another kind take one piece per serving; no servings count as one.
    pieces = spark.createDataFrame([(1, 1, ["3 pcs rice"], 0)], "id int, user_id int, main_ingredients array<string>, servings int")
    left = {(r.user_id, r.item_id): r.quantity for r in matching.apply_cooked(pieces, inventory).collect()}
    assert left[1, 2] == 0.5


def test_keys_are_numbered_alike_by_table_and_by_sorting():
    keys = np.array([7, 3, 3, 9, 0, 7], dtype=np.int64)
    for space in (10, 1000):
        found, at = sim._numbered(keys, space)
        assert found.tolist() == [0, 3, 7, 9] and found[at].tolist() == keys.tolist()
    assert [len(x) for x in sim._numbered(keys[:0], 0)] == [0, 0]
