"""Secrets, near copies, leaks, toxicity and mixing against brute force on small tables."""

import hashlib
import re

import pytest
import xxhash

from larder.llm import decontamination, mixing, secrets, simhash, toxicity
from larder.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, key string, fp string"

ODD = [
    (1, None, "en", None, 0), (2, "", "en", "b", 0), (3, " \t\n", "en", "b", 3), (4, "one", "en", "a", 3),
    (4, "one", "en", "a", 3), (5, "password=hunter22 x" * 3000, "en", "a", 9), (None, "token: 'abcdefg'", "en", "a", 9),
    (6, "Ünï ccode AKIA" + "Q" * 16 + " tail", "en", "c", 9), (7, "secret=token : abcdefgh", "en", "c", 1),
]


def frame(spark, rows=ODD):
    return spark.createDataFrame([(*r, 1, "k", "f") for r in rows], SCHEMA)


def base_spans(text):
    text = text or ""
    out = []
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out += [(m.start(), 0, "assign", m.end()) for m in assign.finditer(text) if len(m.group(2)) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 24]
    return sorted(out)


def text_of(spans):
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in spans)


def shown(df):
    return df.select("doc_id", secrets.joined(df["spans"], ["assign", "access", "hex"]).alias("spans"))


def test_secrets_by_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op4_secrets"](spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        want = base_spans(docs[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(text_of(want).encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == x[2] for x in want) for k in ("assign", "access", "hex")]
        assert set(text_of(want).split(",")) <= set(r["spans"].split(","))


def test_a_ledger_told_twice_and_one_that_died(spark, tmp_path):
    docs, path = frame(spark), str(tmp_path / "ledger")
    want = sorted((str(r[0]), text_of(base_spans(r[1]))) for r in ODD)
    # A first write that died leaves a folder without rows.
    (tmp_path / "ledger" / "_temporary" / "0").mkdir(parents=True)
    assert sorted((str(r["doc_id"]), r["spans"]) for r in shown(secrets.scan(docs, path)).collect()) == want
    # Another writer that saw no ledger, and an append that was run again.
    for _ in range(2):
        secrets.new_findings(docs.select("doc_id", "text"), None).write.mode("append").parquet(path)
    assert sorted((str(r["doc_id"]), r["spans"]) for r in shown(secrets.scan(docs, path)).collect()) == want
    assert secrets.findings(spark, path).count() == len({r[1] or "" for r in ODD})


def test_secrets_of_odd_rows(spark, tmp_path):
    got = shown(secrets.scan(frame(spark), str(tmp_path / "ledger"))).collect()
    want = sorted((str(r[0]), text_of(base_spans(r[1]))) for r in ODD)
    assert sorted((str(r["doc_id"]), r["spans"]) for r in got) == want


def test_ledger_scans_only_what_is_new(spark, tmp_path):
    path = str(tmp_path / "ledger")
    secrets.scan(frame(spark), path)
    assert secrets.new_findings(frame(spark), spark.read.parquet(path)).count() == 0
    assert secrets.new_findings(frame(spark), spark.read.parquet(path), rules_version="2").count() == 7
    more = frame(spark, ODD + [(9, "api_key = 12345678", "en", "a", 1)])
    assert secrets.new_findings(more, spark.read.parquet(path)).count() == 1
    assert secrets.scan(more, path).count() == len(ODD) + 1


def test_redaction(spark):
    text = "a token = \"0123456789abcdef0123456789abcdef\" b password=hunter22"
    df = secrets.new_findings(spark.createDataFrame([(text,)], "text string"), None)
    out = df.select(secrets.redacted(__import__("pyspark").sql.functions.lit(text), df["spans"])).first()[0]
    assert out == 'a [secret]" b [secret]'


def test_no_rows(spark, tmp_path):
    none = frame(spark, [])
    assert secrets.scan(none, str(tmp_path / "l")).count() == 0
    assert mixing.mix(none).count() == 0
    assert simhash.clustered(none).count() == 0
    assert decontamination.leaks(none, spark.createDataFrame([], "item_id long, text string")).count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.graded(none, toxicity.fit(none, labels)).count() == 0
    assert toxicity.graded(frame(spark), toxicity.fit(frame(spark), labels)).where("toxic").count() == 0


def simhash_of(text):
    w = WORDS.findall((text or "").translate(LOWER))
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i:i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum((2 * sum(h >> b & 1 for h in hs) > len(hs)) << b for b in range(64))


def brute_components(rows):
    fps = [(d, simhash_of(t)) for d, t in rows]
    label = list(range(len(fps)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 4 or fps[i][0] == fps[j][0]:
                label[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(fps):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, f"{fp:016x}", least[root(i)]) for i, (d, fp) in enumerate(fps))


def test_simhash_by_brute_force(spark, rows):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op8_simhash"](spark, SF).collect())) == brute_components(docs)


def test_simhash_of_close_fingerprints(spark, monkeypatch):
    """Chains, dense groups and large anchors, on fingerprints themselves."""
    import random

    import numpy as np

    random.seed(5)
    fps = [random.getrandbits(64) for _ in range(300)]
    for base in fps[:30]:
        near = base
        for _ in range(8):
            for bit in random.sample(range(64), random.randint(1, 5)):
                near ^= 1 << bit
            fps.append(near)
    fps += [fps[0] ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(a)]
    fps = sorted(set(fps))
    want = set()
    label = list(range(len(fps)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                label[max(root(i), root(j))] = min(root(i), root(j))
    want = {i: root(i) for i in range(len(fps)) if any(root(k) == root(i) for k in range(len(fps)) if k != i)}
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame(list(zip(signed, range(len(fps)))), "fp long, id long")
    from larder.llm.components import components
    for part in (simhash.PART, 16):
        monkeypatch.setattr(simhash, "PART", part)
        found = components(simhash.links(df))
        assert {r["node"]: r["component"] for r in found.collect()} == want


def test_simhash_of_odd_rows(spark):
    rows = [r for r in ODD if r[0] is not None]
    got = sorted((r["doc_id"], f"{r['fp'] & (1 << 64) - 1:016x}", r["component_id"]) for r in simhash.clustered(frame(spark)).where("doc_id is not null").collect())
    assert got == brute_components([(r[0], r[1]) for r in rows])
    kept = simhash.deduplicated(frame(spark))
    assert kept.columns == frame(spark).columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "4", "5", "6", "7", "None"]


def test_leaks_are_the_whole_items(spark):
    docs = [(r["doc_id"], " " + " ".join(WORDS.findall(r["text"].translate(LOWER))) + " ") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], " " + " ".join(WORDS.findall(r["text"].translate(LOWER))) + " ") for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {(d, i) for d, t in docs for i, x in items if x in t}
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op7_decontamination"](spark, SF).collect()}
    assert want and got == want


def test_leaks_in_shards_and_odd_rows(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta. Eta theta iota kappa lambda."), (2, None), (3, ""), (4, "mu nu xi")], "item_id long, text string")
    filler = "w%d " * 200 % tuple(range(200))
    docs = frame(spark, ODD + [
        (20, filler + "Alpha beta gamma delta epsilon zeta. eta theta iota kappa lambda. " + filler, "en", "a", 1),
        (21, "beta gamma delta " + filler, "en", "a", 1), (22, "x mu nu xi y", "en", "a", 1), (23, "mu xi nu", "en", "a", 1)])
    for most in (decontamination.INDEX_BYTES, 8):
        assert sorted((r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs, bench, most).collect()) == [(20, 1), (22, 4)]
        kept = decontamination.decontaminated(docs, bench, most)
        assert kept.columns == docs.columns and kept.count() == docs.count() - 2


def test_index_scores_like_plain_bm25():
    index = decontamination.Index([(i, " ".join(f"t{(i * 7 + j * j) % 40}" for j in range(12))) for i in range(40)])
    text = [f"t{i % 40}".encode() for i in range(30)]
    got = {i for _, i, *_ in index.search([text])}
    for i, (item_id, part, question, answer) in enumerate(index.items):
        score = sum(index.impact[i].get(index.terms.get(t, -1), 0) for t in set(text))
        flat = b" " + b" ".join(text) + b" "
        held = sum(b" " + s + b" " in flat for s in question)
        assert (item_id in got) == (score >= decontamination.THRESHOLD and held >= 0.8 * len(question))


def test_toxicity_finds_the_labelled(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r["toxic"] for r in QUERIES["op9_toxicity"](spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    # Some cues occur in one or two labelled documents of these small tables only.
    assert sum(got[r["doc_id"]] for r in labels if r["toxic"]) >= 0.7 * sum(r["toxic"] for r in labels)
    assert sum(got[r["doc_id"]] for r in labels if not r["toxic"]) <= 0.01 * len(labels)


def test_toxicity_on_rows_it_has_not_seen(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    known = labels.where("doc_id % 4 > 0")
    held = {r["doc_id"]: r["toxic"] for r in labels.where("doc_id % 4 = 0").collect()}
    got = {r["doc_id"]: r for r in toxicity.graded(docs, toxicity.fit(docs, known)).where("doc_id % 4 = 0").collect()}
    assert sum(got[d]["toxic"] for d, t in held.items() if t) >= 0.85 * sum(held.values())
    assert sum(got[d]["toxic"] for d, t in held.items() if not t) <= 0.01 * len(held)
    assert all(0 <= r["severity"] <= toxicity.TOXIC_GRADES for r in got.values())


def test_thresholds_rise_and_weights_are_shared():
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [np.flatnonzero(rng.random(5) < 0.5) for _ in range(600)]
    true = np.array([2.0, 1.0, 0.0, -1.0, 0.5])
    total = np.array([true[r].sum() for r in rows]) + rng.logistic(size=600) * 0.3
    grades = np.digitize(total, [0.5, 1.5, 2.5])
    w, cuts = toxicity.fit_link(rows, grades, 5, 4)
    assert (np.diff(cuts) > 0).all() and np.corrcoef(w, true)[0, 1] > 0.97


def brute_mix(rows):
    size = lambda t: len(WORDS.findall(t or ""))
    totals = {}
    for _, t, s in rows:
        totals[s] = totals.get(s, 0) + size(t)
    order = sorted((s for s in totals if s is not None)) + [None] * (None in totals)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    goal, free, left = {s: 0.0 for s in order}, set(order), 1.5 * sum(totals.values())
    while free and left > 1e-9:
        w = sum(weight[s] for s in free)
        share = {s: left * weight[s] / w for s in free}
        left = 0.0
        for s, x in share.items():
            goal[s] += x
        for s in list(free):
            if goal[s] > 2 * totals[s]:
                left += goal[s] - 2 * totals[s]
                goal[s] = 2.0 * totals[s]
                free.discard(s)
    out = []
    for s in order:
        mine = sorted((hashlib.md5(str(d).encode() if d is not None else b"").hexdigest(), d if d is not None else -1, size(t), d) for d, t, x in rows if x == s)
        at = 0
        for _, _, n, d in mine:
            took = sum(min(max(int(goal[s] + 1e-9) - at - again, 0), n) for again in (0, totals[s]))
            out.append((d, n, totals[s], round(goal[s], 6), took))
            at += n
    return sorted(out, key=str)


@pytest.mark.parametrize("odd", [False, True])
def test_mixing_by_brute_force(spark, odd):
    docs = frame(spark) if odd else spark.read.parquet(f"{SF}/documents.parquet")
    got = mixing.mix(docs).collect()
    want = brute_mix([(r["doc_id"], r["text"], r["source"]) for r in docs.collect()])
    assert sorted(((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in got), key=str) == want
    at = [r["position"] for r in got if r["position"] is not None]
    assert at == sorted(at) and all(0 <= x <= 1 for x in at)
    assert all((r["position"] is None) == (r["taken"] == 0) and r["taken"] <= 2 * r["size"] for r in got)


def test_positions_invert_the_schedule(spark):
    from pyspark.sql import functions as F

    df = spark.range(101).select((F.col("id") / 100).alias("u"), *[mixing.position(F.col("id") / 100, F.lit(s)).alias(f"t{i}") for i, s in enumerate(mixing.SLOPES)])
    for r in df.collect():
        for i, s in enumerate(mixing.SLOPES):
            t = r[f"t{i}"]
            assert abs((1 - s) * t + s * t * t - r["u"]) < 1e-12


def test_pipeline_by_brute_force(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    toxic = {r["doc_id"] for r in QUERIES["op9_toxicity"](spark, sf).collect() if r["toxic"]}
    left = {d: r["text"] for d, r in rows.items() if d not in toxic}
    one = {d for d, _, c in brute_components(sorted(left.items())) if d == c}
    flat = lambda t: " " + " ".join(WORDS.findall(t.translate(LOWER))) + " "
    items = [[decontamination.shingles(p) for p in decontamination.question_and_answer(r["text"])] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]

    def leaked(t, q, a):
        n, m = (sum(f" {s.decode()} " in t for s in part) for part in (q, a))
        return n >= 0.8 * len(q) and m >= 0.8 * len(a) or n + m >= 0.8 * (len(q) + len(a))

    kept = [d for d in one if not any(leaked(flat(left[d]), q, a) for q, a in items)]
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in got} == set(kept)
    blank = spark.createDataFrame([(d, left[d], "en", "s", 0) for d in kept], "doc_id long, text string, lang string, source string, n_chars long")
    for r in corpus_pipeline.blanked_secrets(spark, blank, sf).collect():
        want, at, end = "", 0, -1
        for s, _, _, e in base_spans(left[r["doc_id"]]):
            if s > end or end < 0:
                want += left[r["doc_id"]][at:s] + "[secret]"
            at = end = max(end, e)
        assert r["text"] == want + left[r["doc_id"]][at:]


def test_secrets_are_matched_whole_and_prose_is_not(spark):
    key = "\n".join("MIIEpAIBAAKCAQEA%044d" % i for i in range(20)) + "\nab12=="
    begin, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    prose = "\nplain prose, well-known and long"
    cases = [
        (f"{begin}\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0123\n\n{key}\n{end}", prose),
        (f"{begin}\n{key}", prose),
        (f"{begin}\nProc-Type: 4,ENCRYPTED\n\n{key}", prose + f"\n{begin.replace('PRIVATE', 'PUBLIC')}"),
        ("https://bob:github_pat_" + "a" * 82 + "@", "host"),
        ("redis://:pass@", "host"),
    ]
    df = spark.createDataFrame([("x " + a + b,) for a, b in cases], "text string")
    found = secrets.new_findings(df, None).join(df.withColumn("blob", secrets.blob_of(df["text"])), "blob")
    got = {r[0]: r[1] for r in found.select("text", secrets.redacted(found["text"], found["spans"])).collect()}
    assert [got["x " + a + b] for a, b in cases] == ["x [secret]" + b for _, b in cases]


def test_long_items_are_confirmed_as_a_whole(spark):
    item = [f"w{i}" for i in range(1100)]
    for n in (decontamination.LONGEST + 1, 1100):
        bench = spark.createDataFrame([(1, " ".join(item[:n]))], "item_id long, text string")
        whole = "before " * 700 + " ".join(item[:n]) + " after" * 700
        docs = spark.createDataFrame([(1, f"x {item[n - 1]} y"), (2, " ".join(item[:n // 2])), (3, whole)], "doc_id long, text string")
        assert [r["doc_id"] for r in decontamination.leaks(docs, bench).collect()] == [3]
        assert sorted(r["doc_id"] for r in decontamination.decontaminated(docs, bench).collect()) == [1, 2]
