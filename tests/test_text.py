import json
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larder.functions import diet, text
from larder.functions.json_recovery import recover_json, recover_text, recover_texts
from larder.functions.rates import pct, whole_pct


def apply(spark, values, column, schema="t string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], schema).select(column).collect()]


def t():
    return F.col("t")


def test_small_text_operators(spark):
    assert apply(spark, [" Fresh, RED-pepper! ", "a  b", None], text.norm_text(t())) == ["fresh  red pepper", "a  b", None]
    assert apply(spark, ["a  b\t\nc", "Red\u00a0 Ring\n", "plain name", "", " "], text.norm_text(t(), collapse=True)) == [
        "a b c", "red ring", "plain name", "", ""]
    assert apply(spark, ["ab\n", "x  y"], text.norm_text(t())) == ["ab", "x  y"]
    assert apply(spark, [" a , b,, c ", "", None], text.comma_list(t())) == [["a", "b", "c"], [], None]
    assert apply(spark, ["07:30", "11:00", "16:59", "21:00", "22:00", "noon", "7.5:00", ""], text.meal_type(t())) == [
        "breakfast", "lunch", "snack", "dinner", "late night snack", "meal", "meal", "meal"]
    assert apply(spark, ["", None, "x"], text.default_if_empty(t(), "none")) == ["none", "none", "x"]
    assert apply(spark, ["/users/12/items/3x", "/a"], text.normalize_path(t())) == ["/users/:id/items/:idx", "/a"]
    assert apply(spark, ["  a b\n c ", ""], text.token_count(t())) == [3, 0]
    assert apply(spark, [" ", " \t", "x", None], text.is_blank(t())) == [True, True, False, True]


def test_oxford_list(spark):
    cases = [["a"], ["a", "b"], ["a", "b", "c"], [], None]
    assert apply(spark, cases, text.oxford_list(t()), "t array<string>") == ["a", "a and b", "a, b, and c", "", ""]


def test_steps(spark):
    cases = {
        "Step 1. Chop. Step 2: Fry": ["Chop.", "Fry"],
        "First. STEP 1 - Boil": ["- Boil"],
        "- cut\n* fry\n\nserve": ["cut", "fry", "serve"],
        "Cut it. Fry it! Done?\nServe": ["Cut it.", "Fry it!", "Done?", "Serve"],
        "": [],
        "  \r\n ": [],
    }
    assert apply(spark, list(cases), text.split_steps(t())) == list(cases.values())


def test_prompt_cuts(spark):
    assert apply(spark, ['{"a": 1}<|eot_id|>{', "x }", " {} "], text.clean_variant(t())) == ['{"a": 1}', "x }", "{}"]
    head = "<|start_header_id|>assistant<|end_header_id|>"
    outputs = [f"u{head}\n```json\n{{1}}\n```<|eot_id|>z", f"u{head} say {{1}} end", f"u{head} }} {{", f"u{head} plain ", " none ",
               f"u{head}```json {{2}}"]
    assert apply(spark, outputs, text.assistant_part(t())) == ["{1}", "{1}", "", "plain", "none", "```json {2}"]


def test_error_recipes(spark):
    rows = [
        ("fine", "Soup", ["boil", "an error may happen"]), ("Unable to cook", "Soup", []), ("", "ERROR", []), ("", "", []),
        (None, None, None), ("", "Soup", ["error", "it failed"]), ("", "Soup", ["not possible here", "boil"]),
    ]
    df = spark.createDataFrame(rows, "raw string, name string, steps array<string>")
    got = [r[0] for r in df.select(text.is_error_recipe(F.col("raw"), F.col("name"), F.col("steps"))).collect()]
    assert got == [False, True, True, True, True, True, True]


def test_rates(spark):
    df = spark.createDataFrame([(49, 400), (1, 0), (1, 3)], "a int, b int")
    assert [tuple(r) for r in df.select(pct(F.col("a"), F.col("b")), whole_pct(F.col("a"), F.col("b"))).collect()] == [
        (12.2, 12), (0.0, 0), (33.3, 33)]


JSON = '{"recipe": {"name": "x"}}'
TEXTS = {
    # text: readable by (service, eval, greedy, judge)
    JSON: (1, 1, 1, 1),
    f"```json\n{JSON}\n```": (1, 1, 1, 1),
    f"```\n{JSON}\n``` and {{": (1, 1, 1, 1),
    f"Sure: {JSON} enjoy": (1, 1, 1, 1),
    f"{JSON} {JSON}": (1, 1, 0, 0),
    '{"a": "brace } inside"}': (1, 0, 1, 1),
    '{"a": "quote \\" and }"}': (1, 0, 1, 1),
    '{"a": 1': (0, 0, 0, 0),
    "no object": (0, 0, 0, 0),
    "[1, 2]": (0, 0, 1, 0),
    "```json\n{bad}\n``` {\"a\": 1}": (0, 0, 0, 0),
    '{"a": NaN}': (1, 1, 1, 1),
    '{"a": 1, "a": 2}': (1, 1, 1, 1),
    '{bad} {"a": 1}': (0, 0, 0, 0),
}


@pytest.mark.parametrize("i,policy", list(enumerate(["service", "eval", "greedy", "judge"])))
def test_json_policies(spark, i, policy):
    got = apply(spark, [*TEXTS, None, ""], recover_json(t(), policy)["valid"])
    assert got == [bool(v[i]) for v in TEXTS.values()] + [False, False]


def test_json_value():
    assert json.loads(recover_text('{"a": 1, "a": 2, "b": NaN, "c": "é"}', "service")[1]) == {"a": 2, "b": None, "c": "é"}
    # A long text is read to its end.
    long = "x" * 200_000 + JSON
    assert recover_text(long, "service") == (True, JSON)


CHAT = "<|user|>q<|assistant|>{}<|end|>tail"
PANTRY = "Selected ingredients from your pantry:"


def test_selected_items(spark):
    cases = [
        CHAT.format(f"Hi\n{PANTRY}\n- Rice\n -  Ham \n-\nSuggested additions\n- Oil\nInstructions:\n- fry"),
        CHAT.format(f"{PANTRY}\n- Rice\nno dash\nInstructions: x\n- fry"),
        CHAT.format("nothing"), "no assistant", CHAT.format(f"{PANTRY}\n- a\nSuggested: b\n- c\nInstructions:\n- d"),
    ]
    assert apply(spark, cases, diet.selected_items(t(), "validator")) == [
        ["rice", "ham"], ["rice"], [], [], ["a", "c"]]
    assert apply(spark, cases, diet.selected_items(t(), "cleaner")) == [
        ["rice", "ham", ""], ["rice"], [], [], ["a"]]


def test_diet_messages(spark):
    rows = [
        (["vegetarian"], ["graham cracker", "rice"]), (["vegan"], ["eggplant", "peanut butter"]), (["dairy-free"], ["cream cheese"]),
        ([], ["ham"]), (None, ["ham"]), (["gluten-free"], ["bread"]),
    ]
    df = spark.createDataFrame(rows, "tags array<string>, items array<string>")
    got = [r[0] for r in df.select(diet.diet_violations(F.col("tags"), F.col("items"))).collect()]
    assert got == [
        ["VEGETARIAN: graham cracker (contains: ham)"], ["VEGAN: peanut butter (dairy: butter)", "VEGAN: eggplant (egg)"],
        ["DAIRY-FREE: cream cheese (contains: cheese)"], [], [], []]
    by_word = [r[0] for r in df.select(diet.diet_violations(F.col("tags"), F.col("items"), match="word")).collect()]
    assert by_word[0] == [] and by_word[1] == ["VEGAN: peanut butter (dairy: butter)"]
    documented = [r[0] for r in df.select(diet.diet_violations(F.col("tags"), F.col("items"), "documented")).collect()]
    assert documented[5] == ["GLUTEN-FREE: bread (contains: bread)"]


def test_recovery_holds_a_slice_of_a_batch():
    """What a batch of texts costs in Python objects doesn't grow with the batch."""
    text = json.dumps({"status": "ok", "recipe": {"steps": "é stir " * 350}}, ensure_ascii=False)
    peaks = []
    for n in (2_000, 20_000):
        batch = pa.array([text, None, "", "no object"] * (n // 4))
        tracemalloc.start()
        found = [(p.field("valid").true_count, len(p)) for p in recover_texts(iter([batch]), "service")]
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert [sum(c) for c in zip(*found)] == [n // 4, n]
    assert peaks[1] < 2 * peaks[0]
    assert sum(len(p) for p in recover_texts(iter([pa.array([], pa.string()), pa.array([text])]), "service")) == 1
