"""Spelling variants against a comparison of all words by deletion."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from larder.llm import spelling
from larder.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, word string, n long, near string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "w", 1, "v") for r in rows], SCHEMA)


def counted(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def near_of(words):
    holes = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            holes[w[:i] + w[i + 1:]].add(w)
        holes[w].add(w)
    return {w: {v for i in range(len(w)) for v in holes[w[:i] + w[i + 1:]] | holes[w] if apart(v, w)} for w in words}


def expected(n):
    near, out = near_of(n), {}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def result(df):
    rows = df.select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: tuple(r)[1:] for r in rows}


def test_tables_by_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = expected(counted(rows))
    assert any(v[0] for v in want.values())
    assert result(QUERIES["op12_spelling"](spark, SF)) == want


@pytest.mark.parametrize("part", [1, 7, 4096])
def test_made_up_words(spark, part):
    rng = random.Random(part)
    stems = ["".join(rng.choice("aeéstxyzÿ") for _ in range(rng.randint(5, 9))) for _ in range(60)]
    n = {}
    for s in stems:
        for _ in range(8):
            i = rng.randrange(len(s))
            w = rng.choice([s, s[:i] + s[i + 1:], s[:i] + rng.choice("aestx") + s[i:], s[:i] + rng.choice("aestx") + s[i + 1:]])
            n[w] = rng.choice([5, 6, 25, 30, 130, 700, 4000])
    df = spark.createDataFrame([(w, k, "x") for w, k in n.items()], "word string, n long, form string").repartition(3)
    assert result(spelling.variants(df, part=part)) == expected(n)


def test_odd_rows(spark):
    rows = [(None, "Strasse straße STRASSE strasser " * 6), (1, None), (2, ""), (2, "×÷ abcdef- abcdeg Ābcdefg " * 9), (2, "abcdef " * 5)]
    rows += [(3, "z" * 3000 + " " + "q" * 3001), (3, ("z" * 3000 + " ") * 5 + ("z" * 3001 + " ") * 30)] + [(4, "equal words equal words")] * 5 + [(5, "ÀÁÂÃÄÅ " * 5 + "àáâãäå " * 5)]
    want = expected(counted(rows))
    assert {"strasse", "strasser", "abcdef", "abcdeg"} <= set(want)
    assert result(spelling.variants(spelling.vocabulary(frame(spark, rows)))) == want


def test_empty_table(spark):
    assert spelling.variants(spelling.vocabulary(frame(spark, []).where("false"))).collect() == []
    assert spelling.variants(spelling.vocabulary(frame(spark, [(1, None)]))).collect() == []


def test_one_apart():
    words = ["abc", "abd", "ab", "abcd", "xabc", "abcabc", "acb", "", "a", "aab", "aabb"]
    pairs = [(a, b) for a in words for b in words]
    a, b = (spelling.Codes([p[i] for p in pairs]) for i in (0, 1))
    at = np.arange(len(pairs))
    assert spelling.verified(a, at, b, at).tolist() == [apart(*p) for p in pairs]
