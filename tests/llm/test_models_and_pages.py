"""Search, language model, quality, licenses and pages against brute force, on held-out rows and on odd rows."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.llm import licenses, lm, pages, quality, topk
from larder.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, row long, word string, part int"
ODD = [(1, None, 0, "w", 0), (2, "", 0, "w", 0), (3, " \t\n", 0, "w", 0), (4, "one", 0, "w", 0), (4, "one", 0, "w", 0), (None, "one two", 0, "w", 0), (5, "long word " * 5000, 0, "w", 0)]


def brute_top(rows, k, queries):
    out = []
    for q, x in rows:
        if q in queries:
            best = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in rows if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def test_top_k_by_brute_force(spark):
    rows = sorted((r["vec_id"], [math.floor(1024 * x) for x in r["embedding"]]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect())
    got = sorted(tuple(r)[:4] for r in QUERIES["op1_topk"](spark, SF).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute_top(rows, 10, {i for i, _ in rows if i % 100 == 0})


def test_top_k_of_odd_vectors(spark, monkeypatch):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, -2.0]), (1, None), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, [1.0, None]), (5, []), (6, [0.5]), (7, [1.0, -2.0]), (8, [1.0, -2.0]), (9, [3e6, -1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame([(*r, "q", 1.0) for r in rows], "vec_id long, embedding array<float>, part string, norm double")
    for block, group in ((2048, 256), (2, 1)):
        monkeypatch.setattr(topk, "BLOCK", block)
        monkeypatch.setattr(topk, "GROUP", group)
        got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 7 == 0, 3).collect())
        whole = [(i, [math.floor(1024 * x) for x in v] + [0] * (2 - len(v))) for i, v in rows if i in (0, 5, 6, 7, 8, 9)]
        assert got == brute_top(whole, 3, {0, 7})
    assert topk.top_k(df.where("vec_id < 0"), F.col("vec_id") % 7 == 0).count() == 0


def test_every_row_of_a_repeated_id_is_a_candidate(spark):
    """A third of the rows share the id of a query, another third that of a candidate."""
    rng = np.random.default_rng(7)
    rows = [(i if i % 3 == 0 else 7 if i % 3 == 1 else 1, [float(x) for x in rng.normal(size=3)]) for i in range(300)] + [(1, [0.5, 0.0, 0.0]), (1, [0.9, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows]
    want = []
    for q in sorted({i for i, _ in whole if i % 7 == 0}):
        asks = min((v, n) for n, (i, v) in enumerate(whole) if i == q)
        best = sorted((-sum(a * b for a, b in zip(asks[0], v)), i) for n, (i, v) in enumerate(whole) if n != asks[1])[:4]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 7 == 0, 4).collect()) == want


def test_top_k_prunes_nothing_that_counts():
    rng = np.random.default_rng(3)
    x = rng.integers(-2000, 2000, (3000, 40)) * rng.lognormal(size=(3000, 1))
    x = np.round(x).astype(np.int64)
    x = x[np.argsort(-np.sqrt((x.astype(float) ** 2).sum(axis=1)), kind="stable")]
    ids = rng.permutation(3000)
    turn = np.linalg.eigh(x.T.astype(float) @ x)[1][:, ::-1]
    q = x[::300]
    numbers = np.arange(3000)
    kept = topk.best(q, numbers[::300], np.full(len(q), -np.inf), x, ids, numbers, turn, 10)
    for n in range(len(q)):
        s = x @ q[n]
        assert kept[n] == [(int(s[i]), int(ids[i])) for i in np.lexsort((ids, -s)) if ids[i] != ids[::300][n]][:10]


def test_base_score_by_brute_force(spark):
    docs = {r["doc_id"]: (r["text"] or "").encode().lower().split() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    count, ends = Counter(), 0
    for d, w in docs.items():
        if zlib.crc32(str(d).encode()) % 7 != 2:
            count.update(w)
            ends += 1
    n, unit = sum(count.values()) + ends, sum(count.values()) + ends + len(count) + 2
    got = QUERIES["op2_lm"](spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        w = docs[r["doc_id"]]
        base = sum(math.log10(count[x] + 1) for x in w) + math.log10(ends + 1) - (len(w) + 1) * math.log10(unit)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2, len(w) + 1, sum(x in count for x in w) + 1, n)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
    assert sum(r["score"] for r in got if r["held_out"]) > sum(r["base_score"] for r in got if r["held_out"])


def test_texts_have_proper_probabilities(spark, monkeypatch):
    """Over all texts of up to two words of a small vocabulary and one unseen word, the probabilities sum to less than one, and to nearly all of the first step."""
    monkeypatch.setattr(lm, "HEAD", 3)
    vocabulary = ["a", "b", "c", "d", "unseen"]
    train = [(i, t) for i, t in enumerate(["a b c", "a a", "b d", "a", "c d a b"])]
    every = [(100, "")] + [(101 + i, w) for i, w in enumerate(vocabulary)] + [(200 + 10 * i + j, f"{w} {x}") for i, w in enumerate(vocabulary) for j, x in enumerate(vocabulary)]
    df = spark.createDataFrame(train + every, "doc_id long, text string")
    got = {r["doc_id"]: r for r in lm.scored(df, F.col("doc_id") < 100, rounds=1).collect()}
    total = sum(10 ** got[d]["score"] for d, _ in every)
    assert 0.2 < total < 1
    assert got[105]["n_known"] == 1 and got[101]["n_known"] == 2


def test_gradients_of_the_network():
    rng = np.random.default_rng(2)
    counts = lm.Counts(1000, 50, 20, [b"w%d" % i for i in range(40)], np.arange(40, 0, -1))
    net = lm.Network.initial(counts)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    inputs, targets = rng.integers(0, 40, (5, 3)), rng.integers(0, 40, (5, 3))
    targets[4, 1] = -1
    targets[2, 0] = lm.OTHER
    keep = np.ones((5, 3))
    keep[0] = keep[3, 2] = 0
    h = np.zeros((3, lm.STATE))

    def loss(n):
        gates = n.w["embed"][inputs] @ n.w["input"] + n.w["offset"]
        states, _ = n.states(gates, keep, h)
        valid = targets >= 0
        return -n.log_probabilities(states[valid], targets[valid])[0].mean()

    grads, _ = net.window(inputs, targets, keep, h)
    for k, g in grads.items():
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        sides = []
        for e in (1e-2, -1e-2):
            other = lm.Network({n: v.copy() for n, v in net.w.items()})
            other.w[k][at] += e
            sides.append(loss(other))
        assert abs((sides[0] - sides[1]) / 2e-2 - g[at]) < 0.03 * abs(g[at]) + 1e-5, k


def test_network_word_by_word():
    """States and probabilities of several lanes against the formulas for one word at a time, also where exponentials leave their range."""
    rng = np.random.default_rng(4)
    net = lm.Network.initial(lm.Counts(1000, 50, 20, [b"w%d" % i for i in range(40)], np.arange(40, 0, -1)))
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    net.w["member_offset"][0, :5] = 900
    inputs, targets, keep = rng.integers(0, 40, (6, 3)), rng.integers(0, lm.OTHER + 1, (6, 3)), np.ones((6, 3))
    keep[0] = keep[4, 1] = 0
    start, w = rng.normal(size=(3, lm.STATE)), net.w
    got, last = net.states(net.gates(w["embed"][inputs]), keep, start)
    logs = net.log_probabilities(got.reshape(-1, lm.STATE), targets.ravel())[0].reshape(6, 3)
    for k in range(3):
        h = start[k]
        for t in range(6):
            h = h * keep[t, k]
            a, b = w["embed"][inputs[t, k]] @ w["input"] + w["offset"], h @ w["state"]
            z, r = np.split(1 / (1 + np.exp(-(a + b)[:2 * lm.STATE])), 2)
            n = np.tanh(a[2 * lm.STATE:] + r * b[2 * lm.STATE:])
            h = (1 - z) * n + z * h
            c, m = divmod(int(targets[t, k]), lm.MEMBERS)
            log = (x := h @ w["class"] + w["class_offset"])[c] - np.logaddexp.reduce(x)
            if c < lm.CLASSES:
                log += (x := h @ w["member"][c] + w["member_offset"][c])[m] - np.logaddexp.reduce(x)
            assert np.allclose(got[t, k], h) and math.isclose(logs[t, k], log, rel_tol=1e-9)
        assert np.allclose(last[k], h)
    ordinary, far = rng.normal(size=(4, 7)), rng.normal(size=(4, 7)) * 500
    for logits in (ordinary, far):
        assert np.allclose(lm.softmax_of(logits.copy(), np.arange(4))[0], [x[i] - np.logaddexp.reduce(x) for i, x in enumerate(logits)])


def test_state_goes_on_over_windows():
    counts = lm.Counts(1000, 50, 20, [b"w%d" % i for i in range(40)], np.arange(40, 0, -1))
    net = lm.Network.initial(counts)
    text = np.random.default_rng(1).integers(1, 40, 3 * lm.LONG_STEPS + 5).astype(np.int32)
    whole = lm.log_likelihoods(net, [text])
    among = lm.log_likelihoods(net, [text[:7], text, text[:100]])
    assert abs(whole[0] - among[1]) < 1e-2
    gates = net.w["embed"][np.append(0, text)] @ net.w["input"] + net.w["offset"]
    keep = np.ones((len(text) + 1, 1), np.float32)
    states, _ = net.states(gates[:, None], keep, np.zeros((1, lm.STATE), np.float32))
    assert abs(net.log_probabilities(states[:, 0], np.append(text, 0))[0].sum() - whole[0]) < 1e-2


def test_language_model_of_odd_rows(spark):
    df = spark.createDataFrame(ODD, DOCS)
    got = lm.scored(df, F.col("doc_id") != 4).collect()
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"]) for r in got) == sorted([("1", False, 1), ("2", False, 1), ("3", False, 1), ("4", True, 2), ("4", True, 2), ("None", True, 3), ("5", False, 10001)])
    assert all(r["score"] < 0 for r in got)
    assert lm.scored(df.where("doc_id > 99"), F.col("doc_id") != 4).count() == 0
    alone = lm.scored(df, F.lit(False)).collect()
    assert len(alone) == len(ODD) and all(r["n_known"] == 0 and r["train_tokens"] == 0 for r in alone)


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in QUERIES["op3_quality"](spark, sf).collect() if r["held_out"] and r["doc_id"] in truth]
    assert all(r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in got)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in got) >= 0.95 * len(got)
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)


def test_quality_of_odd_rows(spark):
    df = spark.createDataFrame(ODD, DOCS)
    labels = spark.createDataFrame([(3, 1, "x"), (4, 0, "x"), (4, 1, "x"), (5, None, "x"), (None, 1, "x"), (2, 0, "x")], "doc_id long, quality int, x string")
    for own in (labels, labels.where("doc_id = 3"), labels.where("doc_id > 9")):
        got = quality.scored(df, own, F.lit(True)).collect()
        assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in quality.scored(df, labels.where("doc_id > 9"), F.lit(True)).collect()} == {0.5}
    assert quality.scored(df.where("doc_id > 99"), labels, F.lit(True)).count() == 0


def test_word_vectors_by_brute_force(spark):
    texts = ["a b a c", "b c", "", "a"]
    places, signs = quality.index_vectors()
    want = np.zeros((quality.BUCKETS, quality.WIDTH))
    of = quality.Buckets()
    for t in texts:
        b = [of[w.encode()] for w in t.split()]
        for x, y in zip(b, b[1:]):
            for m in range(quality.MARKS):
                want[x, places[y, m]] += signs[y, m]
                want[y, places[x, m]] += signs[x, m]
    got = np.zeros((quality.BUCKETS // quality.ROWS, quality.ROWS * quality.WIDTH))
    for r in quality.word_sums(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)).collect():
        got[r["row"]] = np.frombuffer(r["sums"])
    assert (got.reshape(want.shape) == want).all()


def test_licenses_by_exact_lines(spark):
    sf = "/root/testdata/sf0.01"
    lines = {t: n for n, t in licenses.WORDINGS}
    want = Counter((r["doc_id"], lines[x]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() for x in r["text"].split("\n") if x in lines)
    assert want and Counter((r["doc_id"], r["license"]) for r in QUERIES["op5_licenses"](spark, sf).collect()) == want


@pytest.mark.parametrize("text, want", [
    ("x\nlicensed under cc by 4.0\ny", ["CC-BY-4.0"]),
    ("x\nLicensed under CC BY-NC 3.0.\ny", []),
    ("words " * 900 + "Released under the MIT License. " + "words " * 900, ["MIT"]),
    ("The license of my car is new and the public domain is wide.", []),
    ("This program is free software: you can redistribute it and / or modify it under the terms of the GNU General Public\nLicense as published by the Free Software Foundation, "
     "either version 3 of the License, or (at your option) any later version.", ["GPL-3.0"]),
    ("Licensed under the Apache License, Version 2.0.\nReleased under the MIT License.", ["Apache-2.0", "MIT"]),
])
def test_license_wordings(text, want):
    assert [n[0] for n in licenses.notices(text, [licenses.Wording(*w) for w in licenses.WORDINGS])] == want


LONG_APACHE = next(t for n, t in licenses.WORDINGS if n == "Apache-2.0" and "obtain" in t).replace("this file", "that file")


def test_license_that_saves_most_is_the_notice():
    # The short wording is there word by word, the long one with a word changed: it explains more of the text.
    text = f"Some words ahead. {LONG_APACHE} an address."
    assert [(n[0], text[n[1]:n[2]]) for n in licenses.notices(text, [licenses.Wording(*w) for w in licenses.WORDINGS])] == [("Apache-2.0", LONG_APACHE)]


def test_license_wordings_are_ranked_by_bytes_saved():
    ready = [licenses.Wording(*w) for w in licenses.WORDINGS]
    alone = licenses.zstandard.ZstdCompressor(level=licenses.LEVEL)
    found = licenses.ranked([licenses.bare(w) for w in LONG_APACHE.split()], 0, ready, alone)
    assert found[0][-1].text == LONG_APACHE.replace("that file", "this file")
    assert [f[0] for f in found] == sorted((f[0] for f in found), reverse=True) and all(f[0] >= f[-1].floor for f in found)
    assert not licenses.ranked("a licence of the driver was lost on monday".split(), 1, ready, alone)


def test_license_without_savings_is_none(monkeypatch):
    ready = [licenses.Wording(*w) for w in licenses.WORDINGS]
    assert len(licenses.notices(f"ahead {LONG_APACHE} behind", ready)) == 1
    monkeypatch.setattr(licenses.Wording, "saved", lambda self, block, plain: 0)
    assert licenses.notices(f"ahead {LONG_APACHE} behind", ready) == []


def test_license_with_a_word_to_a_line():
    ready = [licenses.Wording(*w) for w in licenses.WORDINGS]
    for name, text in licenses.WORDINGS:
        assert [n[0] for n in licenses.notices("\n".join(f"ahead {text} behind".split()), ready)] == [name]


def test_licenses_of_odd_rows(spark):
    df = spark.createDataFrame(ODD + [(None, "Licensed under CC0 1.0.", 0, "w", 0)], DOCS)
    assert [(r["doc_id"], r["license"], r["start"], r["stop"]) for r in licenses.licensed(df).collect()] == [(None, "CC0-1.0", 0, 23)]


def main_of(spark, html, url="https://h.example/x"):
    rows = html if isinstance(html, list) else [html]
    df = spark.createDataFrame([(i, url, h, "host", 1) for i, h in enumerate(rows)], "page_id long, url string, html string, host string, page int")
    return [r["text"] for r in pages.extracted(df).orderBy("page_id").collect()]


PAGE = (
    '<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href="/a">A</a></li></ul></nav>'
    '<div class="cookie-notice">We use cookies</div><main><article><h1>Head &amp; all</h1><p>One  <b>two</b>\n three&nbsp;four<p>Five<br>six<form>Name <input></form>'
    '<aside>Beside</aside><ul><li>x<li>y</ul><table><tr><td>1<td>2</table></article><section id="comments"><p>Reader said</p></section></main>'
    '<div id="sidebar-2">Side</div><footer>&copy; me</footer></body></html>')


def test_page_of_many_parts(spark):
    assert main_of(spark, PAGE) == ["Head & all\nOne two three four\nFive six\nx\ny\n1\n2"]


def test_template_text_without_elements_of_meaning(spark):
    page = '<div class="a%d"><div class="top">Our site</div><div class="b"><p>Text %d</p><p>More &lt;%d&gt;</p></div><div class="low">All rights</div></div>'
    assert main_of(spark, [page % (i, i, i) for i in range(5)]) == [f"Text {i}\nMore <{i}>" for i in range(5)]
    # A page alone has no template text.
    assert main_of(spark, page % (1, 1, 1)) == ["Our site\nText 1\nMore <1>\nAll rights"]


def test_odd_pages(spark):
    assert main_of(spark, [None, "", "plain & simple", "<p", "<p class='x>a", "<article>" + "w " * 50000 + "</article>"][:1]) == [""]
    got = main_of(spark, ["", "plain &am", "<article><p>cut &amp; dr", "<article>" + "w " * 50000, "</p></div>a</b>c"])
    assert got[0] == "" and got[2] == "cut & dr" and len(got[3]) == 99999
    df = spark.createDataFrame([(None, None, "<p>a</p>"), (1, "no url", "<p>a</p>"), (1, "no url", "<p>a</p>")], "page_id long, url string, html string")
    assert [r["text"] for r in pages.extracted(df).collect()] == ["a", "a", "a"]
    assert pages.extracted(df.limit(0)).count() == 0


def test_pages_keep_the_whole_article(spark):
    import html as h
    import re

    sf = "/root/testdata/sf0.01"
    raw = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in QUERIES["op6_pages"](spark, sf).collect():
        article = re.search(r"<article>(.*?)</article>", raw[r["page_id"]], re.S).group(1).replace("<br>", " ")
        blocks = [" ".join(h.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_slots_lie_between_the_tokens_of_a_class(spark):
    page = "<body>Our site<div class='b'><p>Text %d</p></div>Story %d<div class='c'></div>All rights</body>"
    assert main_of(spark, [page % (i, i) for i in range(5)]) == [f"Text {i}\nStory {i}" for i in range(5)]


def test_classes_hold_tokens_of_one_vector_in_one_order(spark):
    part = "<div class='%s'><p>x</p></div>"
    rows = [(i, "h", "<body>" + part % "a" + (part % "m" + part % "n" if i % 2 else part % "n" + part % "m") + (part % "o" if i > 2 else "") + part % f"only{chr(97 + i)}" + "</body>") for i in range(20)]
    df = spark.createDataFrame(rows, "page long, host string, html string")
    own = {t["path"]: t["class"] for t in pages.templates(df).first()["tokens"]}
    assert set(own) == {"", "body", *(f"body/div.{k}" for k in "amno")}
    assert own[""] == own["body"] == own["body/div.a"] and len(set(own.values())) == 4


def test_pages_without_article_on_a_host_with_articles(spark):
    rows = [f"<body><article><p>Own text {i}</p></article><div class='more'>Less {i}</div></body>" if i % 3 == 0 else f"<body><div class='content'><p>Other text {i}</p></div></body>" for i in range(9)]
    assert main_of(spark, rows) == [f"Own text {i}" if i % 3 == 0 else f"Other text {i}" for i in range(9)]


@pytest.mark.parametrize("page, want", [
    ("<div class='has-sidebar'><article class='post comments-open'><p>Own text</p></article></div>", "Own text"),
    ("<div class='has-sidebar widget'><div class='content'><p>Own text of the page</p></div></div><div class='sidebar'>Side</div>", "Own text of the page"),
    ("<form id='whole'><div class='content'><p>Own text of the page</p></div></form>", "Own text of the page"),
    ("<article><p>Own text</p><div class='comments'><article class='comment'><p>Said</p></article></div></article>", "Own text"),
    ("<html><head><title>T</title><meta name='a'><body><p>Own text</p></body></html>", "Own text"),
    ("<html><head><title>T</title><meta name='a'><p>Own text</p></html>", "Own text"),
    ("<p>Own text</p><button>x<p>More text</p>", "Own text\nx\nMore text"),
    ("<article><ul><li><a href='/a'>All of it links</a></li></ul></article>", "All of it links"),
])
def test_names_and_open_ends_drop_no_article(spark, page, want):
    assert main_of(spark, page) == [want]


def test_training_reads_every_token(spark, monkeypatch):
    monkeypatch.setattr(lm, "LEAST_TOKENS", 0)
    texts = [f"a{i} b{i % 7} c" for i in range(1600)] + ["long word " * 9000, "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    counts = lm.gathered(lm.word_counts(df))
    assert counts.tokens == sum(len((t or "").split()) + 1 for t in texts)
    index = {w: i for i, w in enumerate(counts.head[:lm.SYMBOLS - 1])}
    rows = df.select("text").mapInArrow(lm._round(lm.Network.initial(counts), index, 1), "part int, tokens long, weights binary").collect()
    assert sum(r["tokens"] for r in rows) == counts.tokens
    summed = lm._summed(__import__("pandas").DataFrame([r.asDict() for r in rows]))
    assert np.frombuffer(summed["weights"][0]) == pytest.approx(sum(np.frombuffer(r["weights"]) for r in rows))
    before = lm.Network.initial(counts).packed()
    assert lm.fit(df, counts).packed() not in (before, lm.fit(df.where("doc_id < 1500"), counts).packed())


def test_all_notices_of_one_line():
    ready = [licenses.Wording(*w) for w in licenses.WORDINGS]
    short = [(n, t) for n, t in licenses.WORDINGS if len(t.split()) < 16]
    line = " and a part of the whole ".join(t for _, t in short)
    assert [n[0] for n in licenses.notices(line, ready)] == [n for n, _ in short]
    legal = "the license software permission work copies terms notice rights granted under public any use version".split()
    rng = np.random.default_rng(3)
    for notice, name in (("Released under the MIT License.", "MIT"), ("Licensed under CC0 1.0.", "CC0-1.0")):
        for _ in range(20):
            around = [" ".join(rng.choice(legal, 80)) for _ in range(2)]
            assert [n[0] for n in licenses.notices(f"{around[0]} {notice} {around[1]}", ready)] == [name]
