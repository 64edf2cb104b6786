"""Sorted suffixes and the automaton against comparisons of all pairs."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larder.operators import containment


def frame(spark, values, name):
    return spark.createDataFrame([(v,) for v in values], f"{name} string").repartition(3)


def contained(spark, names, parts):
    found = containment.contained(frame(spark, names, "_name"), frame(spark, parts, "_part")).collect()
    assert len(found) == len({tuple(r) for r in found})
    return {tuple(r) for r in found}


@pytest.mark.parametrize("letters,sample", [("ab", 64), ("ab c", 1), ("abcdé", 2)])
def test_contained_by_all_pairs(spark, monkeypatch, letters, sample):
    monkeypatch.setattr(containment, "SAMPLE", sample)
    rng = random.Random(sample)
    names = {"".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) for _ in range(150)}
    parts = {"".join(rng.choice(letters) for _ in range(rng.randint(0, 6))) for _ in range(80)} | set(list(names)[:20]) | {"", "a" * 40}
    assert contained(spark, names, parts) == {(n, p) for n in names for p in parts if p and p in n}


def test_many_lengths_and_a_suffix_of_all_names(spark):
    text = "".join(random.Random(1).choice("abcd") for _ in range(400))
    names = {f"{i} tomatoes" for i in range(200)} | {text}
    parts = {text[i:i + 1 + i] for i in range(200)} | {"es", "tomatoes", "1 tomatoes", "s"}
    assert len({len(p) for p in parts}) >= 200
    assert contained(spark, names, parts) == {(n, p) for n in names for p in parts if p in n}


def test_nothing_to_find(spark):
    assert contained(spark, [], ["a"]) == contained(spark, ["a"], []) == contained(spark, ["a"], ["b", ""]) == set()


def test_parts_reach_later_slices():
    bounds = ["ab", "abc", "abd", "b"]
    rows = pa.record_batch({"key": ["a", "ab", "abc", "abcx", "b", "c"], "part": [True, True, True, False, True, True]})
    dealt = next(containment._dealt(bounds)(iter([rows]))).to_pylist()
    by_key = {}
    for r in dealt:
        by_key.setdefault(r["key"], []).append(r["slice"])
    assert {k: sorted(v) for k, v in by_key.items()} == {"a": [0, 1, 2, 3], "ab": [1, 2, 3], "abc": [2], "abcx": [2], "b": [4], "c": [4]}


def first_rules(texts, rules):
    want = {}
    for text in texts:
        for kind, word, order in rules:
            if word and word in text:
                rank = (order is None, order or 0, word)
                if (text, kind) not in want or rank < want[text, kind][0]:
                    want[text, kind] = rank, word
    return {(t, k, w) for (t, k), (_, w) in want.items()}


@pytest.mark.parametrize("shard", [3, 50, 1 << 20])
def test_keywords_by_all_pairs(spark, shard):
    rng = random.Random(shard)
    texts = {"".join(rng.choice("abcé ") for _ in range(rng.randint(0, 30))) for _ in range(60)}
    rules = [(rng.choice(["x", "y", None]), "".join(rng.choice("abcé") for _ in range(rng.randint(0, 4))), rng.choice([None, 1, 2, 3])) for _ in range(70)]
    found = containment.keyword_hits(frame(spark, texts, "text"), spark.createDataFrame(rules, "class string, keyword string, ord int"), shard, 100).collect()
    assert {tuple(r) for r in found} == first_rules(texts, rules) and len(found) == len({tuple(r)[:2] for r in found})


def test_no_rules_and_no_texts(spark):
    rules = spark.createDataFrame([("x", "a", 1), ("x", None, 2), ("x", "", 0)], "class string, keyword string, ord int")
    assert containment.keyword_hits(frame(spark, ["ba"], "text"), rules.where("false")).collect() == []
    assert containment.keyword_hits(frame(spark, [], "text"), rules).collect() == []
    assert [tuple(r) for r in containment.keyword_hits(frame(spark, ["ba", ""], "text"), rules).collect()] == [("ba", "x", "a")]


def test_a_hundred_thousand_keywords(spark):
    rules = spark.range(100_000).select(
        F.concat(F.lit("c"), F.col("id") % 3).alias("class"), F.concat(F.lit("<"), F.col("id"), F.lit(">")).alias("keyword"), F.col("id").alias("ord"))
    texts = spark.range(3000).select(F.concat(F.lit("x <"), F.col("id") * 7, F.lit("><"), F.col("id") * 7 + 3, F.lit("> <none>")).alias("text"))
    found = containment.keyword_hits(texts, rules, shard=200_000).collect()
    assert len(found) == 3000 and all(r["keyword"] == r["text"].split()[1].split(">")[0] + ">" for r in found)
