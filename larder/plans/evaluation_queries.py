"""Model outputs, slices, votes, chat rows, diet rules and ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions.diet import CLEANER_MEAT, RULES, first_keyword
from larder.functions.json_recovery import error_recipe, recover_json
from larder.functions.prompts import CUISINE_REQUESTS, INGREDIENT_REQUESTS, PLAIN_REQUESTS, PREFERENCE_REQUESTS
from larder.functions.text import WHITESPACE, split_steps, token_count
from larder.operators import evaluation as ev
from larder.operators import margin, payloads, quality, ranking, training
from larder.plans.bindings import choose, sql_choose, table
from larder.plans.registry import query, rounded

# --- raw model outputs: every document becomes the steps of a recipe, wrapped in seven ways ---

def model_outputs(spark, d):
    docs = table(spark, d, "documents")
    form = F.col("doc_id") % 7
    steps = F.when(form == 4, F.concat("text", F.lit(" mix } and stir"))).otherwise(F.col("text"))
    body = F.to_json(F.struct(
        F.lit("ok").alias("status"),
        F.struct(
            F.col("source").alias("cuisine"), F.col("lang").alias("culinary_preference"),
            F.array(F.lit("rice"), F.col("source")).alias("main_ingredients"), steps.alias("steps"),
        ).alias("recipe"),
    ))
    output = (
        F.when(form == 0, body)
        .when(form == 1, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```\nEnjoy {it}")))
        .when(form == 2, F.concat(F.lit("Here is "), body, F.lit(" bon appetit")))
        .when(form == 3, F.substring(body, F.lit(1), F.length(body) - 1))
        .when(form == 4, body)
        .when(form == 5, F.concat(body, F.lit(' and {"x": 1}')))
        .otherwise(F.col("text"))
    )
    all_words = F.array_distinct(F.split(F.lower("text"), " "))
    return docs.select(
        F.col("doc_id").alias("example_id"), output.alias("output"),
        F.when(F.col("doc_id") % 2 == 0, "base").otherwise("lora").alias("model"),
        F.when(F.col("doc_id") % 3 == 0, F.upper("lang")).when(F.col("doc_id") % 3 == 1, "vegan").otherwise("").alias("preference"),
        F.when(F.col("doc_id") % 4 == 0, F.col("source")).when(F.col("doc_id") % 4 == 1, "other").alias("cuisine"),
        F.when(F.col("doc_id") % 5 == 0, F.array().cast("array<string>"))
        .otherwise(F.concat(F.array(F.lit("RICE"), F.lit("zzqqzz")), all_words)).alias("user_inventory"),
    )


# Which wrapping each policy can read.
VALID = {"service": "0, 1, 2, 4, 5", "eval": "0, 1, 2, 5", "greedy": "0, 2, 4", "judge": "0, 2, 4"}
OUTPUTS = """outputs AS (SELECT doc_id AS example_id, doc_id % 7 AS form, CASE WHEN doc_id % 2 = 0 THEN 'base' ELSE 'lora' END AS model,
  CASE doc_id % 3 WHEN 0 THEN upper(lang) WHEN 1 THEN 'vegan' ELSE '' END AS preference,
  CASE doc_id % 4 WHEN 0 THEN source WHEN 1 THEN 'other' END AS cuisine, source, lang,
  lower('rice ' || source || ' ' || text || CASE WHEN doc_id % 7 = 4 THEN ' mix } and stir' ELSE '' END) AS said,
  CASE WHEN doc_id % 5 = 0 THEN [] ELSE list_concat(['rice', 'zzqqzz'], list_distinct(string_split(lower(text), ' '))) END AS inv
  FROM documents),
examples AS (SELECT *, form IN (0, 1, 2, 5) AS json_valid,
  CASE WHEN form IN (0, 1, 2, 5) AND preference <> '' THEN lower(lang) = lower(preference) END AS diet_match,
  CASE WHEN form IN (0, 1, 2, 5) AND cuisine <> '' THEN lower(source) = lower(cuisine) END AS cuisine_match,
  CASE WHEN form IN (0, 1, 2, 5) AND len(inv) > 0 THEN len(list_filter(inv, lambda i: contains(said, i))) / len(inv) END
    AS inventory_coverage FROM outputs)"""


def _recovered_sql(policy: str) -> str:
    return f"""SELECT doc_id AS example_id, doc_id % 7 IN ({VALID[policy]}) AS valid,
  CASE WHEN doc_id % 7 IN ({VALID[policy]}) THEN source END AS cuisine,
  CASE WHEN doc_id % 7 IN ({VALID[policy]}) THEN md5(text || CASE WHEN doc_id % 7 = 4 THEN ' mix }} and stir' ELSE '' END) END AS steps_md5
FROM documents"""


def _recovered(spark, d, policy):
    read = model_outputs(spark, d).select("example_id", recover_json(F.col("output"), policy).alias("_r"))
    value = F.try_parse_json("_r.json")
    return read.select(
        "example_id", F.col("_r.valid").alias("valid"),
        F.try_variant_get(value, "$.recipe.cuisine", "string").alias("cuisine"),
        F.md5(F.try_variant_get(value, "$.recipe.steps", "string")).alias("steps_md5"),
    )


@query("recovered_json_service", _recovered_sql("service"))
def recovered_json_service(spark, d):
    return _recovered(spark, d, "service")


@query("recovered_json_eval", _recovered_sql("eval"))
def recovered_json_eval(spark, d):
    return _recovered(spark, d, "eval")


@query("recovered_json_greedy", _recovered_sql("greedy"))
def recovered_json_greedy(spark, d):
    return _recovered(spark, d, "greedy")


@query("unreadable_recipes", f"""
SELECT doc_id AS example_id, 'error' AS status, 'Error' AS name, true AS opens, length('Failed to parse recipe. Raw output:' || chr(10)) AS added
FROM documents WHERE doc_id % 7 NOT IN ({VALID['greedy']})""")
def unreadable_recipes(spark, d):
    read = model_outputs(spark, d).withColumn("_r", recover_json(F.col("output"), "greedy")).filter("NOT _r.valid")
    rows = read.withColumn("e", error_recipe(F.col("output")))
    return rows.select(
        "example_id", "e.status", "e.name", F.startswith("e.steps", F.lit("Failed to parse recipe. Raw output:\n")).alias("opens"),
        (F.length("e.steps") - F.length("output")).cast("long").alias("added"),
    )


@query("example_metrics", f"""WITH {OUTPUTS}
SELECT example_id, json_valid, diet_match, cuisine_match, round(inventory_coverage, 6) AS inventory_coverage FROM examples""")
def example_metrics(spark, d):
    scored = ev.example_metrics(model_outputs(spark, d))
    return rounded(scored.select("example_id", "json_valid", "diet_match", "cuisine_match", "inventory_coverage"), "inventory_coverage")


RATES = """count(*) AS n, round(avg(json_valid::INT), 6) AS json_valid_rate, round(avg(diet_match::INT), 6) AS diet_match_rate,
  round(1 - avg(diet_match::INT), 6) AS constraint_violation_rate, round(avg(cuisine_match::INT), 6) AS cuisine_match_rate,
  round(avg(inventory_coverage), 6) AS inventory_coverage_mean"""


@query("metrics_by_model", f"WITH {OUTPUTS} SELECT model, {RATES} FROM examples GROUP BY model")
def metrics_by_model(spark, d):
    return rounded(ev.aggregate_metrics(ev.example_metrics(model_outputs(spark, d)), ["model"]), *ev.METRICS)


SLICED = f"""sliced AS (SELECT model, coalesce(nullif(preference, ''), 'none') AS preference,
  coalesce(nullif(cuisine, ''), 'none') AS cuisine, {RATES.replace('round(', '(').replace(', 6)', ')')} FROM examples GROUP BY ALL)"""


@query("slice_metrics", f"""WITH {OUTPUTS}, {SLICED} SELECT model, preference, cuisine, n,
  {', '.join(f'round({m}, 6) AS {m}' for m in ev.METRICS)} FROM sliced""")
def slice_metrics(spark, d):
    return rounded(ev.slice_metrics(ev.example_metrics(model_outputs(spark, d))), *ev.METRICS)


SHOWN = [m for m in ev.METRICS if m != "cuisine_match_rate"]


def _summary_sql(mean: str) -> str:
    cols = ", ".join(f"round({mean.format(m=m)}, 6) AS {m}" for m in SHOWN)
    return f"""WITH {OUTPUTS}, {SLICED}
SELECT model, 'preference' AS slice, preference AS value, {cols}, round(avg(n), 6) AS n_mean FROM sliced GROUP BY ALL UNION ALL
SELECT model, 'cuisine', cuisine, {cols}, round(avg(n), 6) FROM sliced GROUP BY ALL"""


@query("slice_summary", _summary_sql("avg({m})"))
def slice_summary(spark, d):
    slices = ev.slice_metrics(ev.example_metrics(model_outputs(spark, d)))
    return rounded(ev.summarize_slices(slices), *SHOWN, "n_mean")


@query("slice_summary_weighted", _summary_sql("sum({m} * n) / sum(n) FILTER ({m} IS NOT NULL)"))
def slice_summary_weighted(spark, d):
    slices = ev.slice_metrics(ev.example_metrics(model_outputs(spark, d)))
    return rounded(ev.summarize_slices(slices, weighted=True), *SHOWN, "n_mean")


# Runs: the quality labels per source as if each source were a run of a model.
RUNS = """runs AS (SELECT lang AS model, CASE WHEN source < 'source_1' THEN 0.7 ELSE 1.0 END AS temperature, source,
  avg(quality) AS json_valid_rate, avg(toxic) AS diet_match_rate FROM documents JOIN labels USING (doc_id) GROUP BY ALL)"""


def _runs(spark, d, low: float, name: str):
    joined = ev.attach_examples(
        table(spark, d, "documents").withColumnRenamed("doc_id", "example_id"),
        table(spark, d, "labels").withColumnRenamed("doc_id", "example_id"),
    )
    return joined.groupBy(
        F.col("lang").alias("model"), F.when(F.col("source") < name, low).otherwise(1.0).alias("temperature"), "source"
    ).agg(F.avg("quality").alias("json_valid_rate"), F.avg("toxic").alias("diet_match_rate"))


EVAL_RATES = "round(avg(json_valid_rate), 6) AS json_valid_rate, round(avg(diet_match_rate), 6) AS diet_match_rate"


@query("eval_summary", f"""WITH {RUNS.replace("'source_1'", "'m'")}
SELECT model, {EVAL_RATES} FROM runs WHERE temperature = 0.7 OR NOT (SELECT bool_or(temperature = 0.7) FROM runs) GROUP BY model""")
def eval_summary(spark, d):
    return rounded(ev.summarize_eval(_runs(spark, d, 0.7, "m")), "json_valid_rate", "diet_match_rate")


@query("eval_summary_fallback", f"WITH {RUNS.replace('0.7', '0.9')} SELECT model, {EVAL_RATES} FROM runs GROUP BY model")
def eval_summary_fallback(spark, d):
    return rounded(ev.summarize_eval(_runs(spark, d, 0.9, "source_1")), "json_valid_rate", "diet_match_rate")


@query("metric_gate", f"""WITH {OUTPUTS}, m AS (SELECT model, {RATES} FROM examples GROUP BY model)
SELECT model, metric, value, threshold, coalesce(value >= threshold, false) AS passed FROM (
  SELECT model, 'json_valid_rate' AS metric, json_valid_rate AS value, 0.85::DOUBLE AS threshold FROM m UNION ALL
  SELECT model, 'diet_match_rate', diet_match_rate, 0.95 FROM m UNION ALL SELECT model, 'cuisine_match_rate', cuisine_match_rate, 0.90 FROM m)""")
def metric_gate(spark, d):
    metrics = rounded(ev.aggregate_metrics(ev.example_metrics(model_outputs(spark, d)), ["model"]), *ev.METRICS)
    return quality.gate(metrics, ["model"])


@query("quality_flags", r"""
SELECT doc_id, doc_id % 4 <> 0 AS complete, doc_id % 3 <> 2 AS from_inventory, n >= 3 AS enough_steps,
  len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) < 2048 AS fits
FROM (SELECT *, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS n FROM documents)""")
def quality_flags(spark, d):
    name = F.when(F.col("doc_id") % 4 != 0, F.col("lang")).otherwise("  ")
    used = F.array(F.when(F.col("doc_id") % 3 == 2, "unknown").otherwise(F.upper("source")), F.col("lang"))
    steps = split_steps(F.concat(F.lit("- "), F.regexp_replace("text", r"\n+", "\n- ")))
    flags = quality.quality_flags(name, used, steps, F.array("lang", "source"), token_count(F.col("text")))
    return table(spark, d, "documents").select("doc_id", flags.alias("f")).select("doc_id", "f.*")


@query("model_latency", """
SELECT lang AS model, count(*) AS n, round(avg(n_chars / 100), 6) AS mean_latency, max(n_chars / 100) AS max_latency, quantile_disc(n_chars / 100, 0.5) AS median_latency,
       round(avg(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))), 6) AS mean_tokens FROM documents GROUP BY lang""")
def model_latency(spark, d):
    runs = table(spark, d, "documents").select(
        F.col("lang").alias("model"), (F.col("n_chars") / 100).alias("latency_sec"), token_count(F.col("text")).alias("token_count")
    )
    return rounded(ev.model_latency(runs), "mean_latency", "mean_tokens")


# --- judge votes: three evaluators per embedding row ---

WINNERS = ["dpo", "dpo", "dpo", "sft", "sft", "tie", "unknown"]
EVALUATORS = ["e1", "e2", "e3"]
CATEGORIES = ["basic_alignment", "constraint_stress", "edge_case", "cross_persona"]
VOTES = f"""votes AS (SELECT 'p' || label % 6 AS persona, vec_id AS test_case_id, {sql_choose(CATEGORIES, 'vec_id % 4')} AS category,
  'e' || e AS evaluator, {sql_choose(WINNERS, '(vec_id * (2 * e + 1) + label + e) % 7')} AS winner
  FROM embeddings, (SELECT unnest([1, 2, 3]) AS e))"""
AGREED = f"""{VOTES}, c AS (SELECT persona, test_case_id, category, count(*) FILTER (winner = 'sft') AS sft_votes,
  count(*) FILTER (winner = 'dpo') AS dpo_votes, count(*) FILTER (winner = 'tie') AS tie_votes,
  count(*) FILTER (winner <> 'unknown') AS n_votes FROM votes GROUP BY ALL),
agreed AS (SELECT *, CASE WHEN n_votes = 0 THEN 'unknown' WHEN sft_votes > dpo_votes THEN 'sft' WHEN dpo_votes > sft_votes THEN 'dpo' ELSE 'tie' END AS winner,
  CASE WHEN n_votes = 0 THEN 'none' WHEN sft_votes = dpo_votes THEN 'low' WHEN greatest(sft_votes, dpo_votes) = n_votes THEN 'high' ELSE 'medium' END AS confidence,
  CASE WHEN n_votes = 0 THEN 0 ELSE greatest(sft_votes, dpo_votes) / n_votes END AS agreement_rate FROM c)"""


def votes(spark, d):
    e = F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])).alias("e")
    rows = table(spark, d, "embeddings").select("vec_id", "label", e)
    i = (F.col("vec_id") * (2 * F.col("e") + 1) + F.col("label") + F.col("e")) % 7
    return rows.select(
        F.concat(F.lit("p"), (F.col("label") % 6).cast("string")).alias("persona"), F.col("vec_id").alias("test_case_id"),
        choose(CATEGORIES, (F.col("vec_id") % 4).cast("int")).alias("category"),
        F.concat(F.lit("e"), F.col("e").cast("string")).alias("evaluator"), choose(WINNERS, i.cast("int")).alias("winner"),
    )


KEYS = ["persona", "test_case_id", "category"]


@query("vote_consensus", f"""WITH {AGREED}
SELECT persona, test_case_id, category, sft_votes, dpo_votes, tie_votes, n_votes, winner, confidence, round(agreement_rate, 6) AS agreement_rate FROM agreed""")
def vote_consensus(spark, d):
    return rounded(ev.consensus(votes(spark, d), KEYS), "agreement_rate")


@query("aligned_votes", f"""WITH {VOTES} SELECT persona, test_case_id, max(winner) FILTER (evaluator = 'e1') AS e1,
  max(winner) FILTER (evaluator = 'e2') AS e2, max(winner) FILTER (evaluator = 'e3') AS e3 FROM votes GROUP BY ALL""")
def aligned_votes(spark, d):
    return ev.align_votes(votes(spark, d), EVALUATORS)


@query("vote_agreement", f"""WITH {VOTES}, k AS (SELECT * FROM votes WHERE winner <> 'unknown'),
w AS (SELECT persona, test_case_id, winner, count(*) AS n, min(evaluator) AS ev FROM k GROUP BY ALL),
a AS (SELECT persona, test_case_id, sum(n)::BIGINT AS total, count(*) = 1 AS all_agree, arg_min(winner, (-n, ev)) AS mw, max(n) AS mc FROM w GROUP BY ALL)
SELECT DISTINCT v.persona, v.test_case_id, coalesce(total, 0) AS total_evaluators, CASE WHEN total >= 2 THEN all_agree END AS all_agree,
  CASE WHEN total >= 2 THEN mw END AS majority_winner, CASE WHEN total >= 2 THEN mc END AS majority_count,
  CASE WHEN total >= 2 THEN round(mc / total, 6) END AS agreement_rate, CASE WHEN total >= 2 THEN 'ok' ELSE 'insufficient_data' END AS agreement
FROM votes v LEFT JOIN a ON v.persona = a.persona AND v.test_case_id = a.test_case_id""")
def vote_agreement(spark, d):
    return rounded(ev.agreement(votes(spark, d)), "agreement_rate")


WINS = """count(*) AS total_tests, count(*) FILTER (winner = 'dpo') AS dpo_wins, count(*) FILTER (winner = 'sft') AS sft_wins,
  count(*) FILTER (winner = 'tie') AS ties, round(count(*) FILTER (winner = 'dpo') / count(*), 6) AS dpo_win_rate,
  round(count(*) FILTER (winner = 'sft') / count(*), 6) AS sft_win_rate, round(count(*) FILTER (winner = 'tie') / count(*), 6) AS tie_rate,
  round(avg(agreement_rate), 6) AS avg_agreement_rate"""
WIN_RATES = ["dpo_win_rate", "sft_win_rate", "tie_rate", "avg_agreement_rate"]


@query("win_summary", f"""WITH {AGREED} SELECT persona, {WINS} FROM agreed GROUP BY persona
UNION ALL SELECT 'ALL', {WINS} FROM agreed""")
def win_summary(spark, d):
    return rounded(ev.win_summary(ev.consensus(votes(spark, d), KEYS)), *WIN_RATES)


@query("wins_by_category", f"WITH {AGREED} SELECT category, {WINS} FROM agreed GROUP BY category")
def wins_by_category(spark, d):
    return rounded(ev.wins_by_category(ev.consensus(votes(spark, d), KEYS)), *WIN_RATES)


@query("wins_by_evaluator", f"""WITH {VOTES} SELECT persona, evaluator, count(*) FILTER (winner = 'dpo') AS dpo_wins,
  count(*) FILTER (winner = 'sft') AS sft_wins, count(*) FILTER (winner = 'tie') AS ties FROM votes GROUP BY ALL""")
def wins_by_evaluator(spark, d):
    return ev.wins_by_evaluator(votes(spark, d))


@query("parsed_judgements", """
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'unknown' WHEN quality = 1 THEN 'sft' WHEN toxic = 1 THEN 'dpo' ELSE 'unknown' END AS winner,
  CASE WHEN doc_id % 5 = 0 THEN 0 ELSE round_even((doc_id % 10 + 8) / 2, 2) END AS sft_score, CASE WHEN doc_id % 5 IN (0, 1) THEN 0 ELSE 7.25::DOUBLE END AS dpo_score,
  CASE WHEN doc_id % 5 = 0 THEN 'none' WHEN doc_id % 5 = 2 THEN 'unknown' ELSE 'high' END AS confidence,
  CASE WHEN doc_id % 5 IN (0, 2) THEN '' ELSE 'meat|egg' END AS violations_a, CASE WHEN doc_id % 5 = 0 THEN 'Failed to parse response' ELSE '' END AS reasoning
FROM labels""")
def parsed_judgements(spark, d):
    form, score = F.col("doc_id") % 5, (F.col("doc_id") % 10).cast("string")
    letter = F.when(F.col("quality") == 1, "a").when(F.col("toxic") == 1, "B").otherwise("neither")
    b = F.when(form == 1, "{}").otherwise('{"x": 7, "y": 7.5}')
    more = F.when(form == 2, "").otherwise(', "confidence": "high", "violations_found": {"recipe_a": ["meat", "egg"], "recipe_b": []}')
    body = F.concat(F.lit('Verdict: {"recipe_a_scores": {"taste": '), score, F.lit(', "diet": 8}, "recipe_b_scores": '), b,
                    F.lit(', "winner": "'), letter, F.lit('"'), more, F.lit("} end"))
    answer = F.when(form == 0, F.replace(body, F.lit('"winner":'), F.lit("winner:"))).otherwise(body)
    read = table(spark, d, "labels").select("doc_id", ev.parse_judge(answer).alias("j"))
    return read.select(
        "doc_id", "j.winner", "j.sft_score", "j.dpo_score", "j.confidence",
        F.array_join("j.violations.recipe_a", "|").alias("violations_a"), "j.reasoning",
    )


# --- diet rules: every line of a document is a selected ingredient, one known item is added ---

EXTRA = ["graham cracker", "eggplant", "peanut butter", "chicken breast", "tofu", "cheddar", "hot dog", "whey powder", "plain rice"]
TAGS = [["vegetarian"], ["vegan", "dairy-free"], ["dairy-free"], []]


def diet_samples(spark, d):
    doc = F.col("doc_id")
    tags = F.array(*[F.array(*[F.lit(t) for t in group]).cast("array<string>") for group in TAGS])
    extra = choose(EXTRA, (doc % 9).cast("int"))
    opened = F.when(doc % 5 != 4, "Selected ingredients from your pantry:").otherwise("My picks:")
    text = F.concat(
        F.lit("<|user|>\nDinner, please<|end|>\n<|assistant|>\nA recipe\n"), opened, F.lit("\n- "),
        F.replace("text", F.lit("\n"), F.lit("\n- ")), F.lit("\n- "), F.upper(extra),
        F.lit("\nSuggested additions:\n- bacon and milk\nInstructions:\n- fry the ham<|end|>\n- pork"),
    )
    return table(spark, d, "documents").select(
        "doc_id", text.alias("text"), F.get(tags, (doc % 4).cast("int")).alias("dietary_tags"), F.col("source").alias("recipe_title")
    )


def _literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


SPACE = "'" + WHITESPACE + "'"
SAMPLES = f"""samples AS (SELECT doc_id, text, ({TAGS})[doc_id % 4 + 1] AS tags, doc_id % 5 <> 4 AS opened,
  list_concat(list_transform(string_split(text, chr(10)), lambda s: lower(trim(s, {SPACE}))), [{sql_choose(EXTRA, 'doc_id % 9')}]) AS raw FROM documents),
sel AS (SELECT *, CASE WHEN opened THEN list_filter(raw, lambda s: s <> '') ELSE [] END AS items, CASE WHEN opened THEN raw ELSE [] END AS kept FROM samples)"""


def _rule_sql(rules: str) -> str:
    parts = []
    for constraint, wanted, why, keywords in RULES[rules]:
        head, _, tail = why.partition("{}")
        word = f"list_filter({keywords}, lambda k: contains(i, k))[1]"
        said = f"{_literal(head)} || w.w || {_literal(tail)}" if "{}" in why else _literal(why)
        parts.append(f"""CASE WHEN list_has_any(tags, {wanted}) THEN list_transform(list_filter(list_transform(items, lambda i:
  {{'i': i, 'w': {word}}}), lambda w: w.w IS NOT NULL), lambda w: '{constraint}: ' || w.i || ' (' || {said} || ')') ELSE [] END""")
    joined = parts[0]
    for p in parts[1:]:
        joined = f"list_concat({joined}, {p})"
    return joined


@query("diet_violations", f"""WITH {SAMPLES}, v AS (SELECT *, {_rule_sql('code')} AS violations FROM sel)
SELECT doc_id, len(items) > 0 AS extracted, len(violations) = 0 AS is_valid, array_to_string(violations, '|') AS messages FROM v""")
def diet_violations(spark, d):
    return training.validate_samples(diet_samples(spark, d)).select(
        "doc_id", "extracted", "is_valid", F.array_join("violations", "|").alias("messages")
    )


@query("diet_violations_documented", f"""WITH {SAMPLES}, v AS (SELECT *, {_rule_sql('documented')} AS violations FROM sel)
SELECT doc_id, array_to_string(violations, '|') AS messages FROM v""")
def diet_violations_documented(spark, d):
    checked = training.validate_samples(diet_samples(spark, d), rules="documented")
    return checked.select("doc_id", F.array_join("violations", "|").alias("messages"))


@query("validation_stats", f"""WITH {SAMPLES}, v AS (SELECT *, {_rule_sql('code')} AS violations FROM sel)
SELECT count(*) AS total, count(*) FILTER (len(violations) = 0) AS valid, count(*) FILTER (len(violations) > 0) AS invalid,
       count(*) FILTER (len(items) > 0) AS extracted FROM v""")
def validation_stats(spark, d):
    return training.validation_stats(training.validate_samples(diet_samples(spark, d)))


@query("violation_stats", f"""WITH {SAMPLES}, v AS (SELECT doc_id, unnest({_rule_sql('code')}) AS m FROM sel)
SELECT split_part(m, ':', 1) AS "constraint", count(*) AS n_messages, count(DISTINCT doc_id) AS n_samples FROM v GROUP BY ALL""")
def violation_stats(spark, d):
    return training.violation_stats(training.validate_samples(diet_samples(spark, d)))


MEATY = f"""m AS (SELECT *, list_has_any(tags, ['vegetarian', 'vegan']) AS veg, list_filter({CLEANER_MEAT},
  lambda k: contains(array_to_string(kept, ' '), k))[1] AS word FROM sel)"""


@query("kept_samples", f"WITH {SAMPLES}, {MEATY} SELECT doc_id FROM m WHERE NOT (veg AND word IS NOT NULL)")
def kept_samples(spark, d):
    return training.drop_diet_violators(diet_samples(spark, d)).select("doc_id")


@query("cleaning_stats", f"""WITH {SAMPLES}, {MEATY}, c AS (SELECT count(*) AS total, count(*) FILTER (veg) AS vegetarian_total,
  count(*) FILTER (veg AND word IS NOT NULL) AS removed FROM m)
SELECT total, vegetarian_total, removed, vegetarian_total - removed AS kept, total - removed AS final_size,
       round_even(removed / vegetarian_total * 100, 1) AS removed_pct, round_even((vegetarian_total - removed) / vegetarian_total * 100, 1) AS kept_pct,
       round_even(removed / total * 100, 1) AS reduction_pct FROM c""")
def cleaning_stats(spark, d):
    return training.cleaning_stats(diet_samples(spark, d))


@query("first_keywords", f"SELECT doc_id, list_filter({['egg', 'ham', 'eth', 'ion', 'ou']}, lambda k: contains(text, k))[1] AS keyword FROM documents")
def first_keywords(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", first_keyword(F.col("text"), ["egg", "ham", "eth", "ion", "ou"]).alias("keyword")
    )


# --- chat rows ---

def recipe_rows(spark, d):
    doc = F.col("doc_id")
    stock = F.slice(F.array(F.lit("rice"), F.col("source"), F.col("lang"), F.lit("egg")), F.lit(1), (doc % 5).cast("int"))
    diets = list(PREFERENCE_REQUESTS) + ["halal", ""]
    return table(spark, d, "documents").select(
        "doc_id", stock.alias("user_inventory"),
        F.when(doc % 3 == 0, F.array(F.col("lang"), F.col("source"))).alias("requested_ingredients"),
        choose(diets, (doc % len(diets)).cast("int")).alias("preference"),
        F.when(doc % 4 > 0, F.col("source")).otherwise("").alias("cuisine"),
        F.when(doc % 8 < 7, F.concat(F.lit("scenario_"), (doc % 8 + 1).cast("string"))).alias("scenario"),
        F.col("text").alias("output"),
    )


def _templates(texts) -> str:
    return "[" + ", ".join(_literal(t) for t in texts) + "]"


def _pick_sql(texts, salt: str) -> str:
    return f"({_templates(texts)})[('0x' || substr(md5(doc_id::VARCHAR || '{salt}'), 1, 8))::BIGINT % {len(texts)} + 1]"


DIET_NAMES = list(PREFERENCE_REQUESTS) + ["halal", ""]
DIET_MAP = "MAP {" + ", ".join(f"{_literal(k)}: {_templates(v)}" for k, v in PREFERENCE_REQUESTS.items()) + "}"
OXFORD = """CASE len({l}) WHEN 0 THEN '' WHEN 1 THEN {l}[1] WHEN 2 THEN {l}[1] || ' and ' || {l}[2]
  ELSE array_to_string({l}[1:len({l}) - 1], ', ') || ', and ' || {l}[len({l})] END"""
REQUESTS = f"""rows AS (SELECT doc_id, text, ['rice', source, lang, 'egg'][1:doc_id % 5] AS inv, [lang, source] AS req, doc_id % 3 = 0 AS has_req,
  ({DIET_MAP})[{sql_choose(DIET_NAMES, f'doc_id % {len(DIET_NAMES)}')}] AS diet, CASE WHEN doc_id % 4 > 0 THEN source END AS cuisine,
  doc_id % 8 + 1 AS sc FROM documents),
parts AS (SELECT *, 'I have ' || {OXFORD.format(l='inv')} || '.' AS have, {_pick_sql(PLAIN_REQUESTS, 'plain')} AS plain,
  diet[('0x' || substr(md5(doc_id::VARCHAR || 'preference'), 1, 8))::BIGINT % 5 + 1] AS by_diet,
  replace({_pick_sql(CUISINE_REQUESTS, 'cuisine')}, '{{}}', cuisine) AS by_cuisine, cuisine || ' style.' AS style,
  CASE WHEN has_req THEN replace({_pick_sql(INGREDIENT_REQUESTS, 'requested')}, '{{}}', {OXFORD.format(l='req')}) END AS by_items FROM rows),
asked AS (SELECT doc_id, text AS output, CASE WHEN sc < 8 THEN 'scenario_' || sc ELSE 'unknown' END AS scenario,
  CASE WHEN sc = 1 THEN concat_ws(' ', have, plain) WHEN sc = 2 THEN concat_ws(' ', have, by_diet) WHEN sc = 3 THEN concat_ws(' ', have, by_cuisine)
       WHEN sc = 4 THEN concat_ws(' ', have, by_diet, style) WHEN sc IN (5, 6) THEN concat_ws(' ', have, by_items, by_diet, style) ELSE have END AS user_message
  FROM parts)"""
CHAT = """'<|im_start|>system' || chr(10) || 'You are a recipe generation AI that creates recipes based on user inventory and preferences.<|im_end|>' || chr(10)
  || '<|im_start|>user' || chr(10) || {u} || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || {a} || '<|im_end|>'"""


@query("chat_rows", f"WITH {REQUESTS} SELECT doc_id, {CHAT.format(u='user_message', a='output')} AS text, scenario, user_message FROM asked")
def chat_rows(spark, d):
    return training.to_chat_rows(recipe_rows(spark, d), "doc_id")


@query("scenario_counts", f"""WITH {REQUESTS}, s AS (SELECT CASE WHEN doc_id % 10 < 8 THEN 'train' ELSE 'validation' END AS dataset, scenario FROM asked)
SELECT dataset, scenario, count(*) AS n FROM s GROUP BY ALL UNION ALL SELECT 'ALL', scenario, count(*) FROM s GROUP BY scenario""")
def scenario_counts(spark, d):
    rows = recipe_rows(spark, d).withColumn("dataset", F.when(F.col("doc_id") % 10 < 8, "train").otherwise("validation"))
    return training.scenario_counts(rows)


@query("rendered_turns", """
SELECT conv_id, turn, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' AS block FROM conversations""")
def rendered_turns(spark, d):
    return training.render_turns(table(spark, d, "conversations"))


@query("chat_exchanges", f"""
SELECT u.conv_id, u.turn, {CHAT.format(u='u.text', a='a.text')} AS text FROM conversations u JOIN conversations a
  ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'""")
def chat_exchanges(spark, d):
    return training.exchanges(table(spark, d, "conversations"))


# --- ranking ---

WEIGHTS = [((i * 7) % 11 - 5) / 10 for i in range(64)]
SCORE = "list_sum(list_transform(list_zip({v}, " + str(WEIGHTS) + "::DOUBLE[]), lambda z: z[1]::DOUBLE * z[2]))"
EMB_PAIRS = """pairs AS (SELECT a.vec_id // 2 AS pair_id, CASE WHEN a.label >= b.label THEN a.embedding ELSE b.embedding END AS chosen,
  CASE WHEN a.label >= b.label THEN b.embedding ELSE a.embedding END AS rejected
  FROM embeddings a JOIN embeddings b ON a.vec_id + 1 = b.vec_id AND a.vec_id % 2 = 0)"""


def embedding_pairs(spark, d):
    e = table(spark, d, "embeddings")
    even = e.filter("vec_id % 2 = 0").select(F.col("vec_id").alias("k"), F.col("embedding").alias("a"), F.col("label").alias("la"))
    odd = e.filter("vec_id % 2 = 1").select((F.col("vec_id") - 1).alias("k"), F.col("embedding").alias("b"), F.col("label").alias("lb"))
    first = F.col("la") >= F.col("lb")
    return even.join(odd, "k").select(
        F.expr("k div 2").alias("pair_id"), F.when(first, F.col("a")).otherwise(F.col("b")).alias("chosen"),
        F.when(first, F.col("b")).otherwise(F.col("a")).alias("rejected"),
    )


@query("scored_pairs", f"""WITH {EMB_PAIRS} SELECT pair_id, round({SCORE.format(v='chosen')}, 6) AS score_chosen,
  round({SCORE.format(v='rejected')}, 6) AS score_rejected FROM pairs""")
def scored_pairs(spark, d):
    scored = ranking.score_pairs(embedding_pairs(spark, d), WEIGHTS)
    return rounded(scored.select("pair_id", "score_chosen", "score_rejected"), "score_chosen", "score_rejected")


@query("pair_accuracy", f"""WITH {EMB_PAIRS} SELECT count(*) AS n_pairs,
  round(avg(({SCORE.format(v='chosen')} > {SCORE.format(v='rejected')})::INT), 6) AS accuracy FROM pairs""")
def pair_accuracy(spark, d):
    return rounded(ranking.pair_accuracy(ranking.score_pairs(embedding_pairs(spark, d), WEIGHTS)), "accuracy")


@query("best_candidates", f"""SELECT label AS request_id, arg_min(vec_id, (-s, vec_id)) AS candidate_id, round(max(s), 6) AS score
FROM (SELECT *, {SCORE.format(v='embedding')} AS s FROM embeddings) GROUP BY label""")
def best_candidates(spark, d):
    rows = table(spark, d, "embeddings").select(
        F.col("label").alias("request_id"), F.col("vec_id").alias("candidate_id"), F.col("embedding").alias("features"))
    return rounded(ranking.score_and_pick(rows, WEIGHTS), "score")


@query("ranked_candidates", f"""SELECT label AS request_id, vec_id AS candidate_id, rank() OVER (PARTITION BY label ORDER BY s DESC) AS rank
FROM (SELECT *, round({SCORE.format(v='embedding')}, 6) AS s FROM embeddings)""")
def ranked_candidates(spark, d):
    scored = table(spark, d, "embeddings").select(
        F.col("label").alias("request_id"), F.col("vec_id").alias("candidate_id"),
        F.round(ranking.dot(F.col("embedding"), WEIGHTS), 6).alias("score"),
    )
    return ranking.rank_candidates(scored).drop("score")


@query("fitted_ranker")
def fitted_ranker(spark, d):
    """Accuracy of a ranker fitted on the same pairs."""
    pairs = embedding_pairs(spark, d)
    weights = ranking.fit_pair_ranker(pairs).coefficients
    return ranking.pair_accuracy(ranking.score_pairs(pairs, weights))


@query("fitted_ranker_floor", f"WITH {EMB_PAIRS} SELECT count(*) AS n_pairs, true AS better FROM pairs")
def fitted_ranker_floor(spark, d):
    """Whether the fitted ranker orders more than half of its pairs rightly."""
    return fitted_ranker(spark, d).select("n_pairs", (F.col("accuracy") > 0.5).alias("better"))


@query("margin_ranker_floor", f"WITH {EMB_PAIRS} SELECT count(*) AS n_pairs, true AS better FROM pairs")
def margin_ranker_floor(spark, d):
    """Whether the ranker with a margin orders more than half of its pairs rightly."""
    pairs = embedding_pairs(spark, d)
    network, _ = margin.fit_margin_ranker(pairs, steps=8)
    return ranking.pair_accuracy(margin.score_with(pairs, network)).select("n_pairs", (F.col("accuracy") > 0.5).alias("better"))


@query("ranked_answers", """WITH a AS (SELECT doc_id, n_chars, source, lang FROM documents WHERE doc_id % 4 <> 3),
c AS (SELECT doc_id, unnest([1, 2, 3]) AS place, unnest([n_chars % 7, n_chars % 5, n_chars % 7]) AS score, unnest([source, lang, 'plain']) AS recipe_name FROM a)
SELECT doc_id AS request_id, place, recipe_name, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, place)::INT AS position FROM c""")
def ranked_answers(spark, d):
    """Answers that are a JSON array of three candidates, scored and put in order; every fourth answer is no array."""
    def candidate(name, score):
        return F.struct(name.alias("name"), score.alias("score"))

    n = F.col("n_chars")
    listed = F.to_json(F.array(candidate(F.col("source"), n % 7), candidate(F.col("lang"), n % 5), candidate(F.lit("plain"), n % 7)))
    odd = F.when(F.col("doc_id") % 8 == 3, F.lit('{"name": "single"}')).otherwise(F.lit("[ no JSON"))
    answers = table(spark, d, "documents").select(
        F.col("doc_id").alias("request_id"), F.when(F.col("doc_id") % 4 == 3, odd).otherwise(listed).alias("answer"))
    rows = payloads.answer_recipes(answers)
    value = F.parse_json("recipe")
    scored = rows.withColumns({"recipe_name": F.variant_get(value, "$.name", "string"), "score": F.variant_get(value, "$.score", "long")})
    return ranking.ordered_by_score(scored).select("request_id", "place", "recipe_name", "position")
