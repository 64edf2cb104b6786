"""Units, ingredient texts, categories, receipts and small text operators."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from larder.functions import categories, text, units
from larder.functions.prompts import (
    custom_preferences, detailed_request, eval_prompt, header_prompt, persona_prompt, persona_request, persona_system,
    scoring_text, serving_prompt,
)
from larder.operators import payloads
from larder.plans.bindings import SPELLINGS, UNITS, choose, ingredient_texts, sql_choose, table
from larder.plans.registry import query

# The same spellings and factors for the oracle, from the unit tables.
ALIASES = "MAP {" + ", ".join(f"'{s}': '{u}'" for u, group in units.UNIT_SPELLINGS.items() for s in group) + "}"
GRAMS = "MAP {" + ", ".join(f"'{k}': {v}::DOUBLE" for k, v in units.GRAMS.items()) + "}"
MILLILITRES = "MAP {" + ", ".join(f"'{k}': {v}::DOUBLE" for k, v in units.MILLILITRES.items()) + "}"
NORM = "coalesce(({m})[lower({c})], lower({c}))"
SPELLED = f"""spelled AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, p_name,
  {sql_choose(SPELLINGS, 'l_orderkey % 10')} AS spelling, ((l_orderkey + l_linenumber) % 5)::INT AS form,
  {sql_choose(UNITS, 'l_linenumber % 5')} AS wanted FROM lineitem JOIN part ON l_partkey = p_partkey),
named AS (SELECT *, {NORM.format(m=ALIASES, c='spelling')} AS unit, {NORM.format(m=ALIASES, c='wanted')} AS target FROM spelled)"""


@query("normalized_units", f"WITH {SPELLED} SELECT l_orderkey, l_linenumber, spelling, unit FROM named")
def normalized_units(spark, d):
    padded = F.concat(F.lit(" "), F.upper("spelling"), F.lit("\t"))
    return ingredient_texts(spark, d).select("l_orderkey", "l_linenumber", "spelling", units.normalize_unit(padded).alias("unit"))


@query("parsed_ingredients", f"""WITH {SPELLED}
SELECT l_orderkey, l_linenumber, CASE form WHEN 4 THEN 1.0 WHEN 3 THEN l_quantity / 4 ELSE l_quantity END AS qty,
       CASE form WHEN 4 THEN 'pcs' ELSE unit END AS unit,
       CASE form WHEN 2 THEN p_name || ' ' || l_quantity::INT || ' ' || spelling || ' cut' ELSE p_name END AS name FROM named""")
def parsed_ingredients(spark, d):
    parsed = ingredient_texts(spark, d).withColumn("_p", units.parse_ingredient(F.col("text")))
    return parsed.select("l_orderkey", "l_linenumber", "_p.*")


@query("converted_units", f"""WITH {SPELLED}, g AS (SELECT {GRAMS} AS g, {MILLILITRES} AS v)
SELECT l_orderkey, l_linenumber, unit, wanted, CASE WHEN unit = target THEN l_quantity
  ELSE coalesce(l_quantity * g[unit] / g[target], l_quantity * v[unit] / v[target]) END AS converted FROM named, g""")
def converted_units(spark, d):
    wanted = choose(UNITS, F.col("l_linenumber") % 5)
    return ingredient_texts(spark, d).select(
        "l_orderkey", "l_linenumber", units.normalize_unit(F.col("spelling")).alias("unit"), wanted.alias("wanted"),
        units.convert_unit(F.col("l_quantity"), F.col("spelling"), wanted).alias("converted"),
    )


NORM_SQL = r"trim(regexp_replace(lower({c}), '[^a-z0-9\s]', ' ', 'g'), ' ' || chr(9) || chr(10) || chr(13))"


@query("normalized_names", f"""
SELECT p_partkey, {NORM_SQL.format(c="p_name || ' (' || p_brand || ')'")} AS server_name,
       regexp_replace({NORM_SQL.format(c="p_name || ' (' || p_brand || ')'")}, '\\s+', ' ', 'g') AS client_name FROM part""")
def normalized_names(spark, d):
    label = F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))
    return table(spark, d, "part").select(
        "p_partkey", text.norm_text(label).alias("server_name"), text.norm_text(label, collapse=True).alias("client_name")
    )


# Food words behind the part names, so that every class and both exceptions occur.
FOODS = ["rice", "ice cream cola", "tomatoes", "ripe tomato", "frozen pea", "orange juice", "egg", "beef steak", "oat milk",
         "iced tea", "hammer", "canned corn"]


def _category_sql(name: str) -> str:
    def hit(words):
        return f"regexp_matches({name}, '{categories.word_pattern(words)}')"

    return f"""CASE WHEN {hit(categories.FROZEN)} THEN 'frozen' WHEN contains({name}, 'ice cream') THEN 'dairy'
  WHEN {hit(categories.BEVERAGES)} THEN 'beverages' WHEN {hit(categories.DAIRY)} THEN 'dairy'
  WHEN {hit(categories.MEAT)} THEN 'meat' WHEN {hit(categories.PRODUCE)} THEN 'produce' ELSE 'pantry' END"""


FOOD_SQL = f"lower(p_name || ' ' || {sql_choose(FOODS, 'p_partkey % 12')})"


@query("detected_categories", f"SELECT p_partkey, {_category_sql(FOOD_SQL)} AS category FROM part")
def detected_categories(spark, d):
    name = F.concat("p_name", F.lit(" "), choose(FOODS, (F.col("p_partkey") % 12).cast("int")))
    return table(spark, d, "part").select("p_partkey", categories.detect_category(F.upper(name)).alias("category"))


# --- receipts ---

def _receipts(spark, d):
    """One payload per part in six shapes."""
    name, n = F.col("p_name"), F.col("p_size").cast("string")
    form = F.col("p_partkey") % 6
    item = F.concat(F.lit('{"item":"'), name, F.lit('","quantity":"'), n, F.lit(' lbs"}'))
    quoted = F.concat(F.lit('"['), F.replace(item, F.lit('"'), F.lit('\\"')), F.lit(']"'))
    payload = (
        F.when(form == 0, F.concat(F.lit("["), item, F.lit("]")))
        .when(form == 1, F.concat(F.lit('{"items":[{"name":"'), name, F.lit('","qty":"'), n, F.lit('lbs"}]}')))
        .when(form == 2, F.concat(F.lit('{"detected_items":[{"item_name":"'), name, F.lit('","quantity":'), n, F.lit("}]}")))
        .when(form == 3, F.concat(F.lit('{"item":"'), name, F.lit('","quantity":null}')))
        .when(form == 4, quoted)
        .otherwise(F.concat(F.lit('[{"qty":"2.5 kg"},"loose",'), item, F.lit("]")))
    )
    return table(spark, d, "part").select("p_partkey", payload.alias("payload"))


@query("receipt_items", f"""
SELECT p_partkey, p_name AS item_name, CASE p_partkey % 6 WHEN 3 THEN 1.0 ELSE p_size::DOUBLE END AS quantity,
       CASE WHEN p_partkey % 6 IN (2, 3) THEN 'pcs' ELSE 'lbs' END AS unit, {_category_sql('lower(p_name)')} AS category FROM part
UNION ALL SELECT p_partkey, 'Unknown Item', 2.5, 'kg', 'pantry' FROM part WHERE p_partkey % 6 = 5""")
def receipt_items(spark, d):
    return payloads.receipt_items(_receipts(spark, d), "payload")


@query("exploded_items", "SELECT p_partkey, CASE WHEN p_partkey % 6 = 5 THEN 2 ELSE 1 END::BIGINT AS n FROM part")
def exploded_items(spark, d):
    return payloads.explode_items(_receipts(spark, d), "payload").groupBy("p_partkey").agg(F.count(F.lit(1)).alias("n"))


@query("stamped_receipts", """
SELECT p_partkey, p_name AS item, p_size::VARCHAR || ' pcs' AS quantity, DATE '2024-01-31' AS purchase_date FROM part""")
def stamped_receipts(spark, d):
    body = F.concat(F.lit('[{"item":"'), "p_name", F.lit('","quantity":"'), F.col("p_size").cast("string"), F.lit(' pcs"}]'))
    answer = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    answers = table(spark, d, "part").select("p_partkey", answer.alias("answer"))
    return payloads.stamp_receipt_items(answers, "answer", date(2024, 1, 31))


# --- small text operators ---

def _unused_recipes(spark, d):
    """A recipe per part with text, object, number and unused ingredients."""
    body = F.concat(
        F.lit('{"main_ingredients":["'), "p_name", F.lit('","salt (NOT USED)",{"name":"'), "p_brand",
        F.lit('"},{"ingredient":"oil, ignore"},7]}'),
    )
    nested = F.concat(F.lit('{"recipe":'), body, F.lit("}"))
    return table(spark, d, "part").select(
        "p_partkey", F.try_parse_json(F.when(F.col("p_partkey") % 2 == 0, body).otherwise(nested)).alias("recipe_json")
    )


@query("kept_ingredients", """
SELECT p_partkey, '"' || p_name || '"|{"name":"' || p_brand || '"}|7' AS kept FROM part""")
def kept_ingredients(spark, d):
    kept = payloads.drop_unused_ingredients(_unused_recipes(spark, d))
    return kept.select(
        "p_partkey", F.array_join(F.transform("main_ingredients", lambda e: F.to_json(e)), "|").alias("kept")
    )


@query("ingredient_texts", """
SELECT p_partkey, p_name || '|salt (NOT USED)|' || p_brand || '|oil, ignore' AS texts FROM part""")
def texts_of_ingredients(spark, d):
    rows = payloads.with_ingredient_texts(_unused_recipes(spark, d))
    return rows.select("p_partkey", F.array_join("main_ingredients", "|").alias("texts"))


@query("token_counts", r"""
SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))::INT AS n_tokens FROM documents""")
def token_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", text.token_count(F.col("text")).alias("n_tokens"))


@query("token_overlap", """
SELECT l_orderkey, l_linenumber, len(list_intersect(string_split(lower(p_name), ' '), string_split(lower(p_type), ' '))) > 0
  OR l_orderkey % 2 = 0 AS overlap FROM lineitem JOIN part ON l_partkey = p_partkey""")
def token_overlap(spark, d):
    li, part = table(spark, d, "lineitem"), table(spark, d, "part")
    other = F.when(F.col("l_orderkey") % 2 == 0, F.concat("p_type", F.lit(", "), F.upper("p_name"))).otherwise(F.col("p_type"))
    return li.join(part, li.l_partkey == part.p_partkey).select(
        "l_orderkey", "l_linenumber", text.token_overlap(F.col("p_name"), other).alias("overlap")
    )


@query("meal_types", """
SELECT o_orderkey, CASE WHEN o_custkey % 10 = 0 THEN 'meal' WHEN h BETWEEN 5 AND 10 THEN 'breakfast' WHEN h BETWEEN 11 AND 14 THEN 'lunch'
  WHEN h BETWEEN 15 AND 16 THEN 'snack' WHEN h BETWEEN 17 AND 21 THEN 'dinner' ELSE 'late night snack' END AS meal
FROM (SELECT *, o_orderkey % 24 AS h FROM orders)""")
def meal_types(spark, d):
    hour = F.when(F.col("o_custkey") % 10 == 0, "noon").otherwise(F.format_string("%02d:30", F.col("o_orderkey") % 24))
    return table(spark, d, "orders").select("o_orderkey", text.meal_type(hour).alias("meal"))


@query("comma_lists", """
SELECT p_partkey, array_to_string(string_split(p_name, ' '), '|') || '|' || p_brand AS items FROM part""")
def comma_lists(spark, d):
    raw = F.concat(F.lit(" "), F.replace("p_name", F.lit(" "), F.lit(" ,\t")), F.lit(", ,"), "p_brand", F.lit(" ,"))
    return table(spark, d, "part").select("p_partkey", F.array_join(text.comma_list(raw), "|").alias("items"))


@query("run_names", """
SELECT s_suppkey, CASE WHEN s_nationkey % 2 = 0 THEN 'base' ELSE 'lora' END AS model, s_nationkey / 10 AS temperature FROM supplier""")
def run_names(spark, d):
    name = F.concat(F.when(F.col("s_nationkey") % 2 == 0, "base").otherwise("lora"), F.lit("_t"),
                    (F.col("s_nationkey") / 10).cast("string"))
    return table(spark, d, "supplier").select("s_suppkey", text.split_run_name(name).alias("r")).select("s_suppkey", "r.*")


@query("normalized_paths", r"""
SELECT page_id, regexp_replace(url, '/\d+', '/:id', 'g') AS path FROM pages""")
def normalized_paths(spark, d):
    return table(spark, d, "pages").select("page_id", text.normalize_path(F.col("url")).alias("path"))


# A document is one exchange in two prompt styles; its text is kept whole.
@query("prompt_parts", r"""
SELECT doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS user_text,
       CASE doc_id % 3 WHEN 0 THEN '{"lang": "' || lang || '"}' WHEN 1 THEN '{"n": ' || n_chars || '}' ELSE source END AS answer,
       CASE WHEN doc_id % 2 = 0 THEN '{' || lang || '}' ELSE lang END AS variant FROM documents""")
def prompt_parts(spark, d):
    prompt = F.concat(F.lit("<|im_start|>system\nS<|im_end|>\n<|im_start|>user\n"), "text", F.lit("<|im_end|>\n<|im_start|>assistant\n"))
    answer = (
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('Here:\n```json\n{"lang": "'), "lang", F.lit('"}\n```\nBye')))
        .when(F.col("doc_id") % 3 == 1, F.concat(F.lit('It is {"n": '), F.col("n_chars").cast("string"), F.lit("} I think")))
        .otherwise(F.concat(F.lit(" "), "source", F.lit(" ")))
    )
    output = F.concat(F.lit("<|start_header_id|>user<|end_header_id|>x<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n"),
                      answer, F.lit("<|eot_id|>tail"))
    variant = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" {"), "lang", F.lit("}<|eot_id|>x}<|"))).otherwise(F.concat("lang", F.lit("\n")))
    return table(spark, d, "documents").select(
        "doc_id", text.user_part(prompt).alias("user_text"), text.assistant_part(output).alias("answer"),
        text.clean_variant(variant).alias("variant"),
    )


# Sentences without a look-behind: a line break behind every end mark, then the split by lines.
WS = "' ' || chr(9) || chr(10) || chr(13)"
PARTS = "list_filter(list_transform(string_split({c}, chr(10)), lambda x: trim(x, " + WS + ")), lambda x: x <> '')"
PLAIN = f"trim(replace(text, chr(13), ''), {WS})"
SENTENCES = PARTS.format(c=rf"regexp_replace({PLAIN}, '([.!?])\s+', '\1' || chr(10), 'g')")
BULLETS = PARTS.format(c=rf"regexp_replace({PLAIN}, '(?m)^[ \t]*[-*][ \t]+', '', 'g')")
FREE = rf"CASE WHEN regexp_matches({PLAIN}, '(?m)^\s*[-*]\s+') THEN {BULLETS} ELSE {SENTENCES} END"


@query("step_counts", f"""
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 3 WHEN 1 THEN len({PARTS.format(c='text')})::INT + 1 ELSE len({FREE})::INT END AS n_steps,
       CASE doc_id % 3 WHEN 0 THEN 'Chop.' WHEN 1 THEN 'start' ELSE ({FREE})[1] END AS first_step FROM documents""")
def step_counts(spark, d):
    form = F.col("doc_id") % 3
    steps = (
        F.when(form == 0, F.concat(F.lit("Intro Step 1. Chop. STEP 2: "), "text", F.lit(" step 3- Serve")))
        .when(form == 1, F.concat(F.lit("- start\n* "), F.regexp_replace("text", r"\n+", "\n- ")))
        .otherwise(F.col("text"))
    )
    parts = table(spark, d, "documents").select("doc_id", text.split_steps(steps).alias("_s"))
    return parts.select("doc_id", F.size("_s").alias("n_steps"), F.get("_s", F.lit(0)).alias("first_step"))


@query("listed_steps", f"""
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN len(s) + 1 ELSE coalesce(len({FREE}), 0) END::INT AS n_steps,
       CASE WHEN doc_id % 2 = 0 THEN 'Chop.' ELSE ({FREE})[1] END AS first_step, CASE WHEN doc_id % 2 = 0 THEN s[1] ELSE ({FREE})[2] END AS next_step
FROM (SELECT *, list_filter([trim(text, {WS})], lambda x: x <> '') AS s FROM documents)""")
def listed_steps(spark, d):
    """Steps as a JSON list that also holds other things, or as one JSON text."""
    array = F.to_json(F.array("text"))
    alone = F.substring(array, F.lit(2), F.length(array) - 2)
    given = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('[" Chop. ", 7, null, {"a": "b"}, "  ", '), alone, F.lit("]"))).otherwise(alone)
    parts = table(spark, d, "documents").select("doc_id", text.steps_of_json(given).alias("_s"))
    return parts.select(
        "doc_id", F.size("_s").alias("n_steps"), F.get("_s", F.lit(0)).alias("first_step"), F.get("_s", F.lit(1)).alias("next_step"))


@query("error_recipes", """
SELECT doc_id, doc_id % 6 IN (0, 1, 2, 3) AS is_error,
       CASE doc_id % 6 WHEN 1 THEN 'Unknown' WHEN 2 THEN lang WHEN 0 THEN lang WHEN 3 THEN lang WHEN 4 THEN lang ELSE source END AS title
FROM documents""")
def error_recipes(spark, d):
    k = F.col("doc_id") % 6
    name = F.when(k == 1, "Unknown").when(k != 5, F.col("lang")).otherwise("")
    raw = F.when(k == 0, F.concat("text", F.lit(" We are UNABLE TO cook")))
    steps = F.when(k == 2, F.array(F.lit("raw output: x"), F.lit("It Failed"))).when(
        k == 3, F.array(F.col("text"), F.lit("Not possible"))
    ).otherwise(F.array(F.col("text"), F.lit("An error is fine once")))
    nested = F.when(k == 5, F.col("source"))
    shown = F.when(k == 5, nested).otherwise(name)
    return table(spark, d, "documents").select(
        "doc_id", text.is_error_recipe(raw, shown, steps).alias("is_error"),
        text.recipe_title(name, nested, F.col("lang")).alias("title"),
    )


# --- prompts ---

DIETS = "[['Vegan'], ['vegetarian', 'Gluten-Free'], [], ['keto']]"
ALLERGIES = "[['peanut', 'soy'], [], ['milk']]"


def _profiles(spark, d):
    diets = F.array(F.array(F.lit("Vegan")), F.array(F.lit("vegetarian"), F.lit("Gluten-Free")),
                    F.array().cast("array<string>"), F.array(F.lit("keto")))
    allergies = F.array(F.array(F.lit("peanut"), F.lit("soy")), F.array().cast("array<string>"), F.array(F.lit("milk")))
    n = F.col("c_custkey")
    return table(spark, d, "customer").select(
        n.alias("user_id"), "c_name", F.get(diets, (n % 4).cast("int")).alias("diets"),
        F.get(allergies, (n % 3).cast("int")).alias("allergies"),
        F.when(n % 2 == 0, F.array(F.col("c_mktsegment"))).otherwise(F.array().cast("array<string>")).alias("cuisines"),
        F.when(n % 5 == 0, "").otherwise(F.concat(F.lit("cook "), "c_mktsegment")).alias("request"),
    )


PROFILES = f"""profiles AS (SELECT c_custkey AS user_id, c_name, ({DIETS})[c_custkey % 4 + 1] AS diets,
  ({ALLERGIES})[c_custkey % 3 + 1] AS allergies, CASE WHEN c_custkey % 2 = 0 THEN [c_mktsegment] ELSE [] END AS cuisines,
  CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'cook ' || c_mktsegment END AS request FROM customer)"""


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _restriction_sql() -> str:
    from larder.functions import prompts as p

    return f"""CASE WHEN len(diets) + len(allergies) = 0 THEN '' ELSE {_quoted(p.RESTRICTION_HEAD)} || array_to_string(list_filter([
  CASE WHEN len(diets) > 0 THEN '• CRITICAL DIETARY RESTRICTIONS: ' || array_to_string(diets, ', ') END,
  CASE WHEN list_has_any(diets, ['Vegan', 'vegetarian']) THEN '• ' || {_quoted(p.NO_MEAT)} END,
  CASE WHEN list_contains(diets, 'Vegan') THEN '• ' || {_quoted(p.NO_ANIMAL)} END,
  CASE WHEN list_contains(diets, 'Gluten-Free') THEN '• ' || {_quoted(p.NO_GLUTEN)} END,
  CASE WHEN len(allergies) > 0 THEN '• SEVERE ALLERGIES - LIFE THREATENING: ' || array_to_string(allergies, ', ') END,
  CASE WHEN len(allergies) > 0 THEN '• NEVER use these allergens: ' || array_to_string(allergies, ', ') END
], lambda x: x IS NOT NULL), chr(10)) || {_quoted(p.RESTRICTION_TAIL)} END"""


@query("restriction_texts", f"""WITH {PROFILES}, r AS (SELECT *, {_restriction_sql()} AS rt FROM profiles)
SELECT user_id, rt || CASE WHEN len(cuisines) > 0 THEN ' Preferred cuisines: ' || cuisines[1] || '.' ELSE '' END AS custom,
       starts_with(request || rt, request) AS opens_with_request, length(rt) > 0 AS restricted FROM r""")
def restriction_texts(spark, d):
    p = _profiles(spark, d)
    custom = custom_preferences(F.col("diets"), F.col("allergies"), F.col("cuisines"))
    asked = detailed_request(F.col("request"), F.col("diets"), F.col("allergies"))
    return p.select(
        "user_id", custom.alias("custom"), F.startswith(asked, F.col("request")).alias("opens_with_request"),
        F.contains(asked, F.lit("MANDATORY")).alias("restricted"),
    )


@query("serving_prompts", f"""WITH {PROFILES}
SELECT user_id, '<|im_start|>system' || chr(10) || 'You are a recipe generation AI that creates recipes based on user inventory and preferences.<|im_end|>'
  || chr(10) || '<|im_start|>user' || chr(10) || CASE WHEN request = '' THEN '' ELSE request || chr(10) || chr(10) END
  || 'I have ' || c_name || ', rice.' || CASE WHEN len(diets) > 0 THEN ' I want a ' || lower(diets[1]) || ' recipe.' ELSE '' END
  || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS prompt FROM profiles""")
def serving_prompts(spark, d):
    names = F.array(F.col("c_name"), F.lit("rice"))
    return _profiles(spark, d).select("user_id", serving_prompt(names, F.col("diets"), F.col("request")).alias("prompt"))


@query("eval_prompts", f"""WITH {PROFILES}
SELECT user_id, '<|im_start|>system' || chr(10) || 'Answer in JSON.' || chr(10) || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10)
  || CASE WHEN len(cuisines) > 0 THEN 'Inventory: ' || c_name || ', ' || cuisines[1] || '. ' ELSE '' END
  || CASE WHEN len(diets) > 0 THEN 'Dietary preference: ' || diets[1] || '. ' ELSE '' END
  || CASE WHEN len(cuisines) > 0 THEN 'Cuisine: ' || cuisines[1] || '. ' ELSE '' END || 'Request: '
  || CASE WHEN request = '' THEN 'Create a single recipe using my inventory.' ELSE request END
  || chr(10) || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS prompt FROM profiles""")
def eval_prompts(spark, d):
    stock = F.when(F.size("cuisines") > 0, F.array(F.col("c_name"), F.get("cuisines", F.lit(0)))).otherwise(
        F.array().cast("array<string>"))
    return _profiles(spark, d).select("user_id", eval_prompt(
        F.lit("Answer in JSON."), stock, F.get("diets", F.lit(0)), F.get("cuisines", F.lit(0)), F.col("request")
    ).alias("prompt"))


@query("header_prompts", f"""WITH {PROFILES}
SELECT user_id, '<|begin_of_text|><|start_header_id|>system<|end_header_id|>' || chr(10) || chr(10)
  || CASE WHEN len(cuisines) > 0 THEN 'You are a recipe generation AI specializing in ' || cuisines[1] || ' cuisine.' || chr(10)
       || 'You prefer spicy flavors and any cooking style.' || chr(10) || 'Try to incorporate ingredients like: ' || c_name || '.' || chr(10)
       || 'Generate recipes in valid JSON format matching the exact structure you were trained on.'
     ELSE 'You are a helpful recipe generation AI. Generate recipes in valid JSON format based on the user''s available ingredients and preferences.' END
  || '<|eot_id|><|start_header_id|>user<|end_header_id|>' || chr(10) || chr(10) || 'Generate a recipe using these available ingredients: rice, '
  || c_name || chr(10) || chr(10) || 'User request: ' || request || chr(10) || chr(10) || 'Generate a complete recipe in JSON format.'
  || '<|eot_id|><|start_header_id|>assistant<|end_header_id|>' || chr(10) || chr(10) AS prompt FROM profiles""")
def header_prompts(spark, d):
    system = F.when(F.size("cuisines") > 0, persona_system(
        F.col("cuisines"), F.array(F.lit("spicy")), F.lit(None).cast("string"), F.array(F.col("c_name"))
    ))
    return _profiles(spark, d).select("user_id", header_prompt(
        system, F.array(F.lit("rice"), F.col("c_name")), F.col("request")
    ).alias("prompt"))


@query("persona_prompts", f"""WITH {PROFILES}, m AS (SELECT *, ('0x' || substr(md5(user_id::VARCHAR || 'phrase'), 1, 8))::BIGINT % 3 AS ph,
  ('0x' || substr(md5(user_id::VARCHAR || 'restriction'), 1, 8))::BIGINT % greatest(len(diets), 1) AS ri FROM profiles),
w AS (SELECT *, diets[ri + 1] AS dr FROM m),
q AS (SELECT *, 'I have ' || c_name || ', rice.' || CASE WHEN len(cuisines) > 0 THEN ' I want a ' || cuisines[1] || ' recipe.' ELSE '' END
  || CASE WHEN len(diets) = 0 THEN '' WHEN ph = 0 THEN ' I want a ' || dr || ' recipe.' WHEN ph = 1 THEN ' I''m ' || dr || ', what can I cook?'
     ELSE ' ' || upper(dr[1]) || dr[2:] || ' recipe please.' END AS request_text FROM w)
SELECT user_id, '<|im_start|>system' || chr(10) || 'You are a recipe generation AI that creates recipes based on user inventory and preferences.'
  || CASE WHEN len(cuisines) > 0 THEN ' You specialize in ' || cuisines[1] || ' cuisine.' ELSE '' END
  || ' You prefer mild flavors. Try to incorporate ingredients like: a, b, c, d, e.'
  || CASE WHEN len(diets) > 0 THEN ' The user is ' || array_to_string(diets, ', ') || '.' ELSE '' END
  || CASE WHEN len(allergies) > 0 THEN ' Do NOT use these ingredients: ' || array_to_string(allergies, ', ') || '.' ELSE '' END
  || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || request_text || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS strong,
  '<|im_start|>system' || chr(10) || 'You are a recipe generation AI that creates recipes based on user inventory and preferences.<|im_end|>'
  || chr(10) || '<|im_start|>user' || chr(10) || request_text || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS weak FROM q""")
def persona_prompts(spark, d):
    asked = persona_request(F.array(F.col("c_name"), F.lit("rice")), F.col("cuisines"), F.col("diets"), F.col("user_id"))
    liked = F.array(*[F.lit(x) for x in "abcdef"])
    p = _profiles(spark, d).withColumn("_q", asked)
    args = (F.col("_q"), F.col("cuisines"), F.array(F.lit("mild")), liked, F.col("diets"), F.col("allergies"))
    return p.select("user_id", persona_prompt(*args).alias("strong"), persona_prompt(*args, strong=False).alias("weak"))


@query("scoring_texts", """
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'Request: Inventory: ' || p_brand || ': ' || p_size || ' Dietary: '
  || CASE WHEN p_partkey % 4 = 0 THEN 'vegan' ELSE 'any' END || '. Recipe: Name: ' ELSE 'Request: Inventory:  Dietary: any. Recipe: Name: ' END
  || p_name || ' Cuisine: ' || p_type || ' Ingredients: ' || replace(p_name, ' ', ', ') || ' Steps: .' AS scored FROM part""")
def scoring_texts(spark, d):
    recipe = F.struct(F.col("p_name").alias("name"), F.col("p_type").alias("cuisine"),
                      F.split("p_name", " ").alias("ingredients"), F.lit(None).cast("string").alias("steps"))
    one = F.array(F.struct(F.col("p_brand").alias("item"), F.col("p_size").alias("qty")))
    stock = F.when(F.col("p_partkey") % 2 == 0, one).otherwise(F.filter(one, lambda x: F.lit(False)))
    diet = F.when(F.col("p_partkey") % 4 == 0, "vegan")
    return table(spark, d, "part").select("p_partkey", scoring_text(recipe, stock, diet).alias("scored"))
