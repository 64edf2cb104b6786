"""Random texts: the column expressions against plain Python readings of the same rules."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larder.functions import diet, text, units
from larder.functions.json_recovery import _first_object
from larder.functions.similarity import Pairs, Remembered, best_of_lists, counts_of_lists, ratio


def texts(pieces, n=600, most=10, seed=5):
    rng = random.Random(seed)
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(0, most))) for _ in range(n)]


def run(spark, values, column):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "t string").coalesce(1).select(column).collect()]


def unit_of(word):
    low = (word or "").lower().strip()
    return units.ALIASES.get(low, low) or "pcs"


def number_of(word):
    parts = word.split("/")
    try:
        values = [float(p) for p in parts]
        return {1: lambda: values[0], 2: lambda: values[0] / values[1]}[len(parts)]()
    except (ValueError, KeyError, ZeroDivisionError):
        return 1.0


def ingredient_of(raw):
    raw = raw.strip()
    m = re.search(units.LEADING, raw)
    if m:
        return number_of(m[1]), unit_of(m[2]), m[3].strip()
    m = re.search(units.IN_PARENTHESES, raw)
    if m:
        return number_of(m[2]), unit_of(m[3]), m[1].strip()
    m = re.search(units.INLINE, raw)
    return (number_of(m[1]), unit_of(m[2]), raw) if m else (1.0, "pcs", raw)


def test_ingredients(spark):
    values = texts(["1", "2.5", "/", ".", " ", "  ", "lb", "Cups", "rice", "(", ")", ",", "é", "\t", "\n", "kg", "0"])
    got = [tuple(r) for r in run(spark, values, units.parse_ingredient(F.col("t")))]
    assert got == [ingredient_of(v) for v in values]


def steps_of(raw):
    raw = raw.replace("\r", "").strip()
    if not raw:
        return []
    marks = list(re.finditer(r"(?i)step\s*\d+[.:-]?\s*", raw))
    if marks:
        ends = [m.start() for m in marks[1:]] + [len(raw)]
        found = [raw[m.end():e].strip() for m, e in zip(marks, ends)]
        if any(found):
            return [f for f in found if f]
    lines = re.split(r"\n+", raw)
    if re.search(r"(?m)^\s*[-*]\s+", raw):
        parts = [re.sub(r"^\s*[-*]\s+", "", line) for line in lines]
    elif re.search(r"(?i)(?:^|\n)\s*step\s*\d+", raw):
        parts = re.split(r"(?i)(?:^|\n)\s*step\s*\d+[.:\-\s]*", raw)
    else:
        parts = [p for line in lines for p in re.split(r"(?<=[.!?])\s+", line)]
    return [p.strip() for p in parts if p.strip()]


def test_steps(spark):
    values = texts(["Step ", "step", "1", "2.", ":", "\n", " ", "- ", "* ", "Cut it.", "fry!", "\r", "a"], 900)
    assert run(spark, values, text.split_steps(F.col("t"))) == [steps_of(v) for v in values]


def validator_of(raw):
    if raw.count(diet.ASSISTANT) == 0:
        return []
    answer = raw.split(diet.ASSISTANT)[1].split(diet.END)[0]
    if diet.SELECTED not in answer:
        return []
    part = answer.split(diet.SELECTED)[1]
    for stop in ("Suggested additions", "Instructions:"):
        if stop in part:
            part = part.split(stop)[0]
            break
    lines = [line.strip() for line in part.strip().split("\n")]
    return [line[1:].strip().lower() for line in lines if line.startswith("-") and line[1:].strip()]


def cleaner_of(raw):
    if raw.count(diet.ASSISTANT) == 0:
        return []
    found, opened = [], False
    for line in raw.split(diet.ASSISTANT)[1].split(diet.END)[0].split("\n"):
        if diet.SELECTED in line:
            opened = True
        elif opened:
            low = line.strip()
            if low.startswith("-"):
                found.append(low[1:].strip().lower())
            elif low.startswith(("Suggested", "Instructions")):
                break
    return found


@pytest.mark.parametrize("policy,read", [("validator", validator_of), ("cleaner", cleaner_of)])
def test_selected_items(spark, policy, read):
    pieces = [diet.ASSISTANT, diet.END, diet.SELECTED, "\n", "\n", "- Rice", "-", " ", "Suggested additions", "Suggested",
              "Instructions:", "Instructions", "x", "- ham and Egg", "\t- a"]
    values = texts(pieces, 1500, 14) + [diet.ASSISTANT + v for v in texts([p for p in pieces if p != diet.END], 1500, 14, 8)]
    got = run(spark, values, diet.selected_items(F.col("t"), policy))
    assert got == [read(v) for v in values]


def answer_of(raw):
    head = "<|start_header_id|>assistant<|end_header_id|>"
    if head not in raw:
        return raw.strip()
    answer = raw.split(head)[1].split("<|eot_id|>")[0].strip()
    if "```json" in answer:
        at = answer.index("```json") + 7
        end = answer.find("```", at)
        return answer[at:end].strip() if end > at else answer
    if "{" in answer and "}" in answer:
        return answer[answer.index("{"):answer.rindex("}") + 1]
    return answer


def test_assistant_part(spark):
    values = texts(["<|start_header_id|>assistant<|end_header_id|>", "<|eot_id|>", "```json", "```", "{", "}", " ", "a", "\n"], 1500)
    assert run(spark, values, text.assistant_part(F.col("t"))) == [answer_of(v) for v in values]


def object_of(raw, strings):
    start = raw.find("{")
    depth, quoted, skip = 0, False, False
    for i in range(max(start, 0), len(raw) if start >= 0 else 0):
        ch = raw[i]
        if strings and (skip or ch == "\\"):
            skip = not skip
        elif strings and ch == '"':
            quoted = not quoted
        elif not quoted and ch in "{}":
            depth += 1 if ch == "{" else -1
            if depth == 0:
                return raw[start:i + 1]
    return None


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet='{}"\\a\n', max_size=20), st.booleans())
def test_first_object(raw, strings):
    assert _first_object(raw, strings) == object_of(raw, strings)


def first_best(items, name):
    scores = [ratio(i, name) for i in items]
    top = max(scores, default=0.0)
    return {"at": scores.index(top), "score": top} if top >= 0.45 and top > 0 else None


ROWS = st.lists(st.tuples(st.lists(st.text("abc ", max_size=8), max_size=6), st.lists(st.text("abc ", min_size=1, max_size=8), max_size=6)), max_size=5)


@settings(max_examples=300, deadline=None)
@given(ROWS)
def test_best_of_is_the_first_highest_score(rows):
    got = best_of_lists([r[0] for r in rows], [r[1] for r in rows], 0.45, Remembered())
    assert got == [[first_best(items, n) for n in names] for names, items in rows]


NAMES = st.lists(st.one_of(st.text("abc ", min_size=1, max_size=12), st.text("ab é", min_size=55, max_size=75)), min_size=1, max_size=5)


@settings(max_examples=300, deadline=None)
@given(NAMES, NAMES, NAMES)
def test_bounds_and_counts(names, items, others):
    rows = [(names, items), (others, items), (names, others)]
    lefts, rights = [r[0] for r in rows], [r[1] for r in rows]
    pairs = Pairs(lefts, rights, Remembered())
    for a, b, bound in zip(pairs.a, pairs.b, pairs.bounds(0.0)):
        assert bound >= ratio(pairs.right.names[b], pairs.left.names[a])
    assert counts_of_lists(lefts, rights, 0.45, Remembered()) == [
        [sum(1 for i in right if ratio(i, n) >= 0.45 or set(i.split()) & set(n.split())) for n in left] for left, right in rows]
    assert best_of_lists(lefts, rights, 0.45, Remembered()) == [[first_best(right, n) for n in left] for left, right in rows]


def test_a_pair_is_scored_once_however_many_users_have_it(monkeypatch):
    memory, asked = Remembered(), []
    whole = memory.scores

    def scores(pairs):
        asked.extend(pairs)
        return whole(pairs)

    monkeypatch.setattr(memory, "scores", scores)
    lists = [(["red onion", "rice"], ["onion red", "brown rice", "egg"])] * 50
    best_of_lists([a for a, _ in lists], [b for _, b in lists], 0.45, memory)
    assert len(asked) == len(set(asked)) <= 6
