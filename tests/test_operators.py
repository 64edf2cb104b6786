import json
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from larder.operators import activity, evaluation, payloads, preferences, quality, ranking, stock, training
from larder.operators.payloads import receipt_items
from larder.plans import jobs
from larder.operators.requests import histogram_rows, latency_histogram
from larder.sources import changes, readers, writers

AS_OF = datetime(2024, 1, 31, 12)


def history(spark, scores):
    rows = [(i, 1, s, False, datetime(2024, 1, 30, 0, i)) for i, s in enumerate(scores)]
    return spark.createDataFrame(rows, "id long, user_id long, feedback_score int, is_cooked boolean, created_at timestamp_ntz")


def test_stock_value_and_alerts(spark, rows):
    inv = spark.createDataFrame(
        [("rice", 0.5, "kg", 10.0, 600.0, date(2024, 1, 1)), ("oil", 2.0, "L", 1.0, 0.5, None)],
        "item_name string, quantity double, unit string, unit_cost double, reorder_threshold double, expiry_date date")
    done = stock.transform_inventory(inv)
    assert [r.stock_value for r in done.collect()] == [5000.0, 2000.0]
    assert rows(stock.all_alerts(done, date(2024, 1, 1)).select("item_name", "issue_type")) == [("rice", "LOW_STOCK")]
    assert rows(stock.all_alerts(done, date(2024, 1, 2)).select("issue_type")) == [("EXPIRED",), ("LOW_STOCK",)]
    assert stock.all_alerts(done.limit(0), date(2024, 1, 2)).columns == stock.ALERT_COLUMNS


def test_deductions_do_not_depend_on_order(spark, rows):
    inv = spark.createDataFrame([(1, 1, 5.0), (1, 2, 1.0), (2, 1, -3.0)], "user_id int, item_id int, quantity double")
    ded = [(1, 1, 2.0), (1, 1, 4.0), (1, 2, 0.25)]
    for d in (ded, ded[::-1]):
        out = stock.deduct(inv, spark.createDataFrame(d, "user_id int, item_id int, amount double"))
        assert rows(out) == [(1, 1, 0.0), (1, 2, 0.75), (2, 1, -3.0)]


@pytest.mark.parametrize("scores,status,rate", [
    ([], "SKIPPED", None), ([2] * 9, "SKIPPED", 1.0), ([2] * 7 + [1] * 3, "ALERT", 0.7), ([2] * 8 + [1] * 2, "OK", 0.8)])
def test_monitor(spark, scores, status, rate):
    got = activity.monitor_status(activity.approval_rate(history(spark, scores), AS_OF)).first()
    assert (got.status, got.approval_rate) == (status, rate)


@pytest.mark.parametrize("scores,want", [([1] * 4, False), ([1] * 5, True), ([1, 1, 2, 1, 1], False), ([2] + [1] * 5, True), ([1] * 5 + [0, None], True)])
def test_streaks(spark, scores, want):
    h = history(spark, scores)
    assert activity.global_streak(h).first().streak is want
    assert (activity.user_streaks(h).count() == 1) is want


def test_empty_history(spark):
    got = activity.recipe_metrics(history(spark, []), AS_OF).first()
    assert (got.total, got.feedback_rate, got.like_rate) == (0, 0.0, 0.0)
    assert [r.n for r in activity.daily_counts(history(spark, []), AS_OF).collect()] == [0] * 7


def test_seventh_generation(spark, rows):
    h = history(spark, [0] * 15)
    assert rows(activity.comparison_events(h).select("id", "generation_number")) == [(13, 14), (6, 7)]


def prefs(spark, data):
    return spark.createDataFrame(data, "id int, user_id int, chosen_variant string, skipped boolean, exported_for_training boolean, created_at timestamp_ntz")


def test_null_skipped_and_threshold(spark):
    t = datetime(2024, 1, 1)
    p = prefs(spark, [(i, 1, "A", None if i % 2 else False, None, t) for i in range(50)] + [(99, 1, "B", True, True, t), (98, 1, None, None, None, t)])
    assert preferences.users_ready(p).first().n == 50
    assert preferences.users_ready(p, null_skipped="drop").count() == 0
    assert [r.id for r in preferences.threshold_events(p).collect()] == [49]
    assert preferences.untrained_pairs(p).count() == 50


def test_blank_pairs_are_counted(spark, rows):
    pairs = spark.createDataFrame([(" p ", "c", "r"), ("p", "  ", "r"), (None, "c", "r"), ("p", "c", "")], "prompt string, chosen string, rejected string")
    seen = Observation()
    assert rows(preferences.drop_blank_pairs(pairs, seen)) == [("p", "c", "r")]
    assert seen.get == {"dropped": 3, "seen": 4}


def test_choice_goes_to_history(spark):
    p = spark.createDataFrame(
        [(1, 5, "make soup", None, "A-json", "B-json", None, None, None, None), (2, 5, "", "q", "A2", "B2", None, None, None, None)],
        "id int, user_id int, prompt string, user_query string, variant_a string, variant_b string, chosen_variant string, "
        "rejected_variant string, chosen_at timestamp_ntz, chosen_recipe_history_id int")
    choices = spark.createDataFrame([(1, 5, "a", 2), (2, 6, "B", 2), (2, 5, "x", 2)], "id int, user_id int, choice string, servings int")
    updated, rows = preferences.apply_choices(p, choices, AS_OF)
    got = {r.id: (r.chosen_variant, r.rejected_variant, r.chosen_recipe_history_id) for r in updated.collect()}
    assert got == {1: ("A", "B", 1), 2: (None, None, None)}
    assert [(r.recipe_json, r.user_query, r.servings) for r in rows.collect()] == [("A-json", "make soup", 2)]
    again = spark.createDataFrame([(2, 5, "a", 1, 1), (2, 5, "b", 3, 2)], "id int, user_id int, choice string, servings int, no int")
    updated, rows = preferences.apply_choices(p, again, AS_OF, order="no")
    assert [r.chosen_variant for r in updated.orderBy("id").collect()] == [None, "B"]
    assert sorted((r.recipe_json, r.user_query, r.servings) for r in rows.collect()) == [("A2", "q", 1), ("B2", "q", 3)]


@pytest.mark.parametrize("winners,winner,confidence,rate", [
    (["dpo", "dpo", "sft"], "dpo", "medium", 2 / 3), (["sft", "dpo", "unknown"], "tie", "low", 0.5), (["sft"] * 3, "sft", "high", 1.0),
    (["unknown"] * 3, "unknown", "none", 0.0), (["dpo", "tie", "tie"], "dpo", "medium", 1 / 3)])
def test_consensus(spark, winners, winner, confidence, rate):
    v = spark.createDataFrame([("p", 1, f"e{i}", w) for i, w in enumerate(winners)], "persona string, test_case_id int, evaluator string, winner string")
    got = evaluation.consensus(v).first()
    assert (got.winner, got.confidence, got.agreement_rate) == (winner, confidence, pytest.approx(rate))


def test_agreement_takes_the_first_of_equals(spark):
    v = spark.createDataFrame([("p", 1, "e1", "tie"), ("p", 1, "e2", "sft"), ("p", 1, "e3", "sft"), ("p", 1, "e4", "dpo"), ("p", 1, "e5", "dpo"), ("p", 2, "e1", "sft")],
                              "persona string, test_case_id int, evaluator string, winner string")
    got = {r.test_case_id: (r.majority_winner, r.agreement) for r in evaluation.agreement(v).collect()}
    assert got == {1: ("sft", "ok"), 2: (None, "insufficient_data")}


def test_checks(spark):
    df = spark.createDataFrame([("a", 0.1, "kg", "2025-1-5"), (None, 0.05, "lb", "20250105"), ("b", None, None, None)],
                               "item_id string, quantity double, unit string, day string")
    checks = [quality.expect_not_null("item_id"), quality.expect_between("quantity", 0.1), quality.expect_in_set("unit", quality.UNITS),
              quality.expect_date_format("day"), quality.expect_row_count(1, 2)]
    assert [r.unexpected for r in quality.run_checks(df, checks).orderBy("check_no").collect()] == [1, 1, 1, 1, 1]
    assert quality.run_suite(df, "d", "s", checks, "now").first().result == "FAIL"
    assert quality.run_suite(df, "d", "s", [quality.expect_row_count(3, 3)], "now").first().result == "PASS"
    with pytest.raises(ValueError):
        quality.run_suite(df, "d", "s", checks, "now", fail_fast=True)


def test_profile_and_slices(spark):
    df = spark.createDataFrame([("x", 1.0, 1), ("x", 3.0, 2), (None, None, 3), ("y", 2.0, 4)], "c string, v double, n int")
    got = {r.column: r for r in quality.profile(df).collect()}
    assert (got["c"].n, got["c"].unique, got["c"].top, got["c"].freq) == (3, 2, "x", 2)
    assert (got["v"].n, got["v"].mean, got["v"].q50, got["n"].q75) == (3, 2.0, 2.0, 3.25)
    under = {(r.slice, r.value): r.n for r in quality.under_represented(df, ["c"], floor=2).collect()}
    assert under == {("c", None): 1, ("c", "y"): 1}
    assert {r.c for r in quality.describe_by(df, "c", "v").collect()} == {"x", "y"}


def test_slice_counts_sum_to_the_table(spark):
    df = spark.range(100).withColumn("a", F.col("id") % 7).withColumn("b", F.when(F.col("id") % 3 > 0, F.col("id") % 3))
    sums = quality.slice_counts(df, ["a", "b"]).groupBy("slice").agg(F.sum("n").alias("n")).collect()
    assert {r.n for r in sums} == {100}


def test_cleaning_without_meatless_samples(spark):
    s = spark.createDataFrame([("t", []), ("u", None)], "text string, dietary_tags array<string>")
    got = training.cleaning_stats(s).first()
    assert (got.total, got.removed, got.removed_pct, got.reduction_pct) == (2, 0, None, 0.0)


def test_receipts(spark, rows):
    payloads = ['[{"item": "milk", "quantity": "2 L"}, 5]', '{"items": [{"name": "egg"}]}', '"[{\\"item_name\\": \\"beef\\", \\"qty\\": 3}]"', "broken", '{"item": null}']
    df = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "id int, p string")
    assert rows(receipt_items(df, "p").select("id", "item_name", "quantity", "unit", "category")) == [
        (0, "milk", 2.0, "L", "dairy"), (1, "egg", 1.0, "pcs", "dairy"), (2, "beef", 3.0, "pcs", "meat"), (4, "None", 1.0, "pcs", "pantry")]


def test_histogram_is_cumulative(spark):
    df = spark.createDataFrame([("GET", "/u/1", 200, 0.05), ("GET", "/u/2", 200, 0.3), ("GET", "/u/3", 200, 99.0)], "method string, path string, status int, duration_s double")
    got = {r.le: r.n for r in histogram_rows(latency_histogram(df)).collect()}
    assert got == {0.05: 1, 0.1: 1, 0.2: 1, 0.5: 2, 1.0: 2, 2.0: 2, 5.0: 2, 10.0: 2}


def test_changes(spark, rows):
    inv = spark.createDataFrame([(1, 1, "a", 1.0, "kg", "dairy"), (2, 1, "b", 2.0, "g", None)],
                                "item_id int, user_id int, item_name string, quantity double, unit string, category string")
    added = changes.insert_items(inv, spark.createDataFrame([(3, 1, "milk")], "item_id int, user_id int, item_name string"))
    assert (3, 1, "milk", 1.0, "pcs", "pantry") in rows(added)
    detected = changes.insert_items(inv, spark.createDataFrame([(3, 1, "milk")], "item_id int, user_id int, item_name string"), detect=True)
    assert (3, 1, "milk", 1.0, "pcs", "dairy") in rows(detected)
    other = spark.createDataFrame([(1, 2, 9.0)], "item_id int, user_id int, quantity double")
    assert rows(changes.update_items(inv, other)) == rows(inv)
    assert changes.delete_items(inv, other.select("item_id", "user_id")).count() == 2
    mine = spark.createDataFrame([(1, 1, 9.0)], "item_id int, user_id int, quantity double")
    assert changes.update_items(inv, mine).filter("item_id = 1").first().quantity == 9.0
    assert changes.delete_items(inv, mine.select("item_id", "user_id")).count() == 1
    twice = spark.createDataFrame([(1, 1, 9.0, None, 1), (1, 1, None, "g", 2), (1, 1, 8.0, None, 3)],
                                  "item_id int, user_id int, quantity double, unit string, no int")
    got = changes.update_items(inv, twice, order="no").filter("item_id = 1").first()
    assert (got.quantity, got.unit) == (8.0, "g")
    assert changes.upsert(inv, inv.withColumn("quantity", F.lit(7.0)).limit(1), "item_id").count() == 2
    # A repeated key gives one row, with an order the last one, without the greatest.
    again = spark.createDataFrame([(5, 1, "x", 3.0, "g", "c", 1), (5, 1, "x", 2.0, "g", "c", 2)],
                                  "item_id int, user_id int, item_name string, quantity double, unit string, category string, no int")
    assert [changes.upsert(inv, again, "item_id", o).filter("item_id = 5").collect()[0].quantity for o in (None, "no")] == [3.0, 2.0]
    assert changes.upsert(inv, again, "item_id").count() == 3
    assert changes.update_items(inv, again.drop("no").withColumn("item_id", F.lit(1))).count() == 2


def test_parts_of_a_stock_list_are_bounded(spark):
    """Ids with a common factor spread over the parts all the same."""
    inv = spark.range(4000).select((F.col("id") * 8).alias("item_id"), F.lit(1).alias("user_id"), F.lit("n").alias("item_name"), F.lit(1.0).alias("quantity"), F.lit("g").alias("unit"))
    sizes = [r.n for r in stock.in_stock_by_user(inv, 500).select(F.size("items").alias("n")).collect()]
    assert len(sizes) == 8 and sum(sizes) == 4000 and max(sizes) < 650


def test_csv_keeps_breaks_and_empty_texts(spark, tmp_path):
    (tmp_path / "x.csv").write_text('a,b,c\n1,"two\nlines ""quoted""",\n2,"",x\n')
    got = readers.read_csv(spark, str(tmp_path / "x.csv"), "a int, b string, c string").orderBy("a").collect()
    assert [tuple(r) for r in got] == [(1, 'two\nlines "quoted"', None), (2, "", "x")]


def test_ids_in_file_names_are_decoded(spark, tmp_path):
    (tmp_path / "new comer_variants.jsonl").write_text('{"x": 1}\n')
    assert readers.read_entity_files(spark, str(tmp_path / "*.jsonl"), "_variants.jsonl", "x int").first().persona == "new comer"
    rows = spark.createDataFrame([("a:b", 1), ("c+d 50%", 2)], "persona string, x int")
    rows.write.partitionBy("persona").json(str(tmp_path / "by"))
    read = readers.read_entity_files(spark, str(tmp_path / "by" / "*" / "*.json"), None, "x int", pattern=r"/persona=([^/]+)/[^/]+$")
    assert {(r.persona, r.x) for r in read.collect()} == {("a:b", 1), ("c+d 50%", 2)}


def test_any_client_of_an_access_log(spark):
    lines = spark.createDataFrame([('INFO:     ::1:53122 - "GET /x HTTP/1.1" 200 OK',), ("INFO:     Started",)], "value string")
    assert [(r.client_ip, r.client_port) for r in readers.parse_access_log(lines).collect()] == [("::1", 53122)]
    assert tuple(readers.access_line_counts(lines).first()) == (1, 1)


def test_readers(spark, tmp_path, rows):
    log = tmp_path / "app.log"
    log.write_text('INFO:     127.0.0.1:57947 - "GET / HTTP/1.1" 200 OK\nINFO:     Started\nINFO:     1.2.3.4:5 - "POST /auth/x HTTP/1.1" 404 Not Found\n')
    assert rows(readers.read_access_log(spark, str(log))) == [
        ("INFO", "1.2.3.4", 5, "POST", "/auth/x", 404, "Not Found"), ("INFO", "127.0.0.1", 57947, "GET", "/", 200, "OK")]
    (tmp_path / "a_variants.jsonl").write_text('{"x": 1}\n\n{"x": 2}\n')
    (tmp_path / "b_variants.jsonl").write_text('{"x": 3}\n')
    got = readers.read_entity_files(spark, str(tmp_path / "*_variants.jsonl"), "_variants.jsonl", "x int")
    assert rows(got) == [(1, "a"), (2, "a"), (3, "b")]
    (tmp_path / "arr.json").write_text('[{"x": 1},\n {"x": null}]')
    assert rows(readers.read_json_array(spark, str(tmp_path / "arr.json"), "x int")) == [(1,), (None,)]


def test_routed_sinks_keep_every_row(spark, tmp_path):
    df = spark.range(100).select(F.col("id"), F.when(F.col("id") % 3 == 0, "accepted").otherwise("rejected").alias("route"),
                                 F.when(F.col("id") % 3 > 0, "bad").alias("reason"))
    writers.write_routed(df, str(tmp_path / "ok"), str(tmp_path / "no"))
    ok, no = (spark.read.json(str(tmp_path / p)) for p in ("ok", "no"))
    assert ok.count() == 34 and no.count() == 66 and "reason" not in ok.columns and set(no.columns) == {"id", "reason"}


def test_user_lists_are_whole(spark):
    inv = spark.range(500).select(F.lit(1).alias("user_id"), F.col("id").alias("item_id"), F.lit("x").alias("item_name"),
                                  F.lit(1.0).alias("quantity"), F.lit("kg").alias("unit"))
    got = stock.in_stock_by_user(inv, part_size=50).select("part", F.size("items").alias("n")).collect()
    assert sum(r.n for r in got) == 500 and len(got) == 10


class Recorder:
    """Stands in for a session's reader and keeps the options it is given."""

    def __init__(self):
        self.seen = {}
        self.read = self

    def format(self, name):
        self.seen["format"] = name
        return self

    def option(self, key, value):
        self.seen[key] = value
        return self

    def options(self, **more):
        self.seen.update(more)
        return self

    def load(self):
        return self.seen


def test_table_scan_is_partitioned_only_with_a_column():
    plain = readers.read_table(Recorder(), "jdbc:x", "inventory")
    assert plain == {"format": "jdbc", "url": "jdbc:x", "dbtable": "inventory"}
    ranged = readers.read_table(Recorder(), "jdbc:x", "inventory", "id", (1, 900), 12, {"user": "u"})
    assert ranged["partitionColumn"] == "id" and ranged["upperBound"] == 900 and ranged["numPartitions"] == 12


def test_configuration_tables(spark, rows):
    cases = readers.load_cases(spark, [("p1", "a01", ["rice"], "Make rice", "basic_alignment")])
    personas = readers.load_personas(spark, [("p1", "One", ["x"], [], "quick", [], ["ham"], [])])
    got = readers.attach_persona(cases.select("persona", "category"), personas)
    assert rows(got.select("category", "persona_name", "persona_forbidden_keywords")) == [("basic_alignment", "One", ["ham"])]


def test_dashboard(spark):
    h = history(spark, [2, 1, 0, None, 2])
    users = spark.createDataFrame([(1, "ann", datetime(2024, 1, 29)), (2, "bob", datetime(2023, 1, 1))], "id long, username string, created_at timestamp_ntz")
    inv = spark.createDataFrame([(1, 0.05, "dairy"), (1, 3.0, None)], "user_id long, quantity double, category string")
    p = spark.createDataFrame([("A", None), (None, True)], "chosen_variant string, skipped boolean")
    got = {k: [tuple(r) for r in df.collect()] for k, df in jobs.dashboard(users, h, inv, p, AS_OF).items()}
    assert got["users"] == [(2, 1)] and got["active_share"] == [(2, 1, 50)] and got["inventory"] == [(2, 1)]
    assert got["recipes"] == [(5, 5, 3, 2, 1, 0, 60.0, 0.0, 66.7)] and got["comparisons"] == [(2, 1, 1, 50.0)]
    assert got["categories"] == [("Uncategorized", 1), ("dairy", 1)] and got["top_users"] == [(1, "ann", 5)]
    assert len(got["growth"]) == len(got["recipes_by_day"]) == 7


def test_coverage_counts_items_that_are_words_or_parts_of_words(spark):
    rows = [
        (["rice", "egg"], "fried rice"), (["rice", "rice", "egg", "egg"], "fried rice"), (["ric"], "rice"), ([], "rice"), (None, "rice"),
        (["rice", None], "rice"), (["two words", "words two"], "two words here"), ([""], "x"), (["zz", "zz", None, None], "rice"),
        ([f"w{i}" for i in range(3000)], " ".join(f"w{i}" for i in range(1500, 6000))),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, inventory array<string>, text string")
    got = [r[1] for r in sorted(df.select("i", evaluation.coverage(F.col("inventory"), F.col("text"))).collect())]
    want = [None if not inv else sum(x is not None and x in text for x in inv) / len(inv) for inv, text in rows]
    assert got == want


def test_cooking_from_stored_recipes(spark, tmp_path, rows):
    recipes = [
        (1, 1, '{"recipe": {"main_ingredients": ["1 kg rice", {"name": "2 lb chicken breast"}, "", 7]}}', 2, False),
        (2, 1, '{"main_ingredients": ["1 kg rice"]}', None, False), (3, 1, "no JSON", 1, False), (4, 1, None, 1, True), (5, 2, '{"main_ingredients": "rice"}', 1, None),
    ]
    history = spark.createDataFrame(recipes, "id int, user_id int, recipe_json string, servings int, is_cooked boolean")
    inventory = spark.createDataFrame(
        [(1, 1, "Chicken Breast", 5.0, "lb"), (1, 2, "Rice", 3.5, "kg"), (2, 1, "Rice", 9.0, "kg")],
        "user_id int, item_id int, item_name string, quantity double, unit string")
    done = jobs.cook_job(history, inventory, spark.createDataFrame([(1,), (1,), (3,), (5,), (99,)], "id int"), str(tmp_path))
    assert rows(done["inventory"].select("user_id", "item_id", "quantity")) == [(1, 1, 1.0), (1, 2, 1.5), (2, 1, 9.0)]
    assert rows(done["history"].select("id", "is_cooked")) == [(1, True), (2, False), (3, True), (4, True), (5, True)]


def test_pairs_of_users_who_have_enough(spark, tmp_path, rows):
    data = [
        (1, 7, "p1", '{"a": 1}', '{"b": 1}', "A", "B", False), (2, 7, "p2", '{"a": 2}', '{"b": 2}', "B", "A", False), (3, 7, "p3", "", '{"b": 3}', "A", "B", False),
        (4, 7, "p4", "x", "y", "A", "B", None), (5, 8, "p5", "x", "y", "A", "B", False), (6, 9, "p6", "x", "y", "A", "B", False), (7, 8, "p7", "x", "y", None, None, False),
    ]
    prefs = spark.createDataFrame(
        [(*r, AS_OF) for r in data],
        "id int, user_id long, prompt string, variant_a_raw string, variant_b_raw string, chosen_variant string, rejected_variant string, skipped boolean, created_at timestamp_ntz")
    users = spark.createDataFrame([(7, "ann"), (8, "bo")], "id long, username string")
    done = jobs.export_user_pairs_job(prefs, users, str(tmp_path), min_n=3)
    assert rows(done["status"]) == [(7, "ann", 3, 2, "pending"), (8, "bo", 1, 1, "collecting")]
    assert rows(done["pairs"].select("user_id", "prompt", "chosen", "rejected")) == [(7, "p1", '{"a": 1}', '{"b": 1}'), (7, "p2", '{"b": 2}', '{"a": 2}')]


def test_answers_with_several_candidates(spark, rows):
    answers = [(1, '[{"name": "a"}, "text", 3, null]'), (2, '{"name": "a"}'), (3, "[ broken"), (4, None), (5, "[]")]
    got = payloads.answer_recipes(spark.createDataFrame(answers, "request_id int, answer string"))
    assert rows(got) == [(1, 1, '{"name":"a"}'), (1, 2, '"text"'), (1, 3, "3"), (1, 4, "null")]
    scored = spark.createDataFrame([(1, 1, 0.5), (1, 2, None), (1, 3, 0.9), (1, 4, 0.5)], "request_id int, place int, score double")
    assert rows(ranking.ordered_by_score(scored).select("place", "position")) == [(1, 2), (2, 4), (3, 1), (4, 3)]


def test_a_user_has_one_file_of_pairs(spark, tmp_path):
    """Rows of a user come from many tasks; the files hold them in order, one for every user with few pairs, several for a hot one."""
    schema = "id long, user_id long, created_at timestamp_ntz, prompt string, variant_a_raw string, variant_b_raw string, chosen_variant string, rejected_variant string, skipped boolean"
    start = datetime(2024, 1, 1)
    owners = [1 if i % 2 else i % 9 for i in range(400)]
    prefs = spark.createDataFrame(
        [(i, u, start + timedelta(minutes=i * 37 % 400), f"{i * 37 % 400:03d}", "a", "b", "A", "B", False) for i, u in enumerate(owners)], schema).repartition(8)
    users = spark.createDataFrame([(u, f"u{u}") for u in range(9)], "id long, username string")
    for name, how, most in (("whole", {}, 400), ("split", {"most": 100}, 100)):
        done = jobs.export_user_pairs_job(prefs, users, f"{tmp_path}/{name}", min_n=3, **how)
        assert sorted((r.user_id, r.prompt) for r in done["pairs"].collect()) == sorted((u, f"{i * 37 % 400:03d}") for i, u in enumerate(owners))
        for u in set(owners):
            files = list((tmp_path / name / "pairs" / f"user_id={u}").glob("*.json"))
            own = [[json.loads(line)["prompt"] for line in f.read_text().splitlines()] for f in files]
            assert len(files) == 1 if owners.count(u) <= most else len(files) > 1
            assert all(rows == sorted(rows) and len(rows) <= most for rows in own)
