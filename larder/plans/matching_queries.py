"""Ingredients against stock, keyword rules, and what cooked recipes use up."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions import similarity as sim
from larder.operators import matching
from larder.plans import jobs
from larder.plans.bindings import (
    OWNED, RECIPE_INGREDIENTS, choose, owned_items, recipe_ingredients, sql_choose, table,
)
from larder.plans.registry import query, rounded
from larder.plans.text_queries import NORM_SQL
from larder.session import scratch_path, settled

BOTH = f"WITH {OWNED}, {RECIPE_INGREDIENTS}"
# The longest block that x and y share, the earliest in x and then in y of equals, as one number:
# its length, 999 less its place in x, 999 less its place in y, three digits each; names are short.
LONGEST = """list_max(flatten(list_transform(range(1, len(x) + 1), lambda i: list_transform(range(1, len(y) + 1), lambda j:
  1000000 * len(list_filter(range(1, least(len(x) - i, len(y) - j) + 2), lambda k: x[i:i + k - 1] = y[j:j + k - 1])) + (999 - i) * 1000 + 999 - j))))"""
# Similarity of the pairs (a, b): what remains before and behind the longest block is compared likewise.
SCORES = f"""blocks AS (
  SELECT a, b, x, y, {LONGEST} AS m FROM (SELECT a, b, a AS x, b AS y FROM pairs WHERE a <> '' AND b <> '')
  UNION ALL SELECT a, b, x, y, {LONGEST} AS m FROM (
    SELECT a, b, p.x AS x, p.y AS y FROM (
      SELECT a, b, unnest([{{'x': x[1:i - 1], 'y': y[1:j - 1]}}, {{'x': x[i + n:], 'y': y[j + n:]}}]) AS p FROM (
        SELECT *, m // 1000000 AS n, 999 - m // 1000 % 1000 AS i, 999 - m % 1000 AS j FROM blocks WHERE m >= 1000000)))
  WHERE x <> '' AND y <> ''),
scores AS (SELECT a, b, 2.0::DOUBLE * sum(m // 1000000) / (len(a) + len(b)) AS score FROM blocks GROUP BY a, b)"""
WORDS = "list_filter(string_split_regex({c}, '\\s+'), lambda w: w <> '')"
# All pairs of a user's ingredient and item names; the operator compares lists and leaves out what a bound excludes.
NAME_PAIRS = f"""{BOTH.replace('WITH', 'WITH RECURSIVE', 1)}, i AS (SELECT DISTINCT user_id, ingredient, {NORM_SQL.format(c='ingredient')} AS b FROM ingredients),
o AS (SELECT user_id, {NORM_SQL.format(c='item_name')} AS a, min(item_id) AS item_id FROM owned GROUP BY ALL),
pairs AS (SELECT DISTINCT a, b FROM i JOIN o USING (user_id) WHERE a <> '' AND b <> ''), {SCORES}"""
CLIENT = "regexp_replace(" + NORM_SQL + r", '\s+', ' ', 'g')"
# The oracle compares all pairs; the operator joins substrings.
FIRST_ITEM = f"""i AS (SELECT DISTINCT user_id, ingredient, {CLIENT.format(c='ingredient')} AS nm FROM ingredients),
o AS (SELECT user_id, item_id, quantity, {CLIENT.format(c='item_name')} AS om FROM owned),
f AS (SELECT i.user_id, ingredient, min(item_id) AS item_id FROM i JOIN o ON i.user_id = o.user_id
  AND nm <> '' AND om <> '' AND (contains(om, nm) OR contains(nm, om)) GROUP BY ALL),
a AS (SELECT n.user_id, recipe_id, n.ingredient, f.item_id, f.item_id IS NULL AS missing, coalesce(o.quantity <= 0.1, false) AS low
  FROM ingredients n LEFT JOIN f ON n.user_id = f.user_id AND n.ingredient = f.ingredient
  LEFT JOIN o ON o.user_id = f.user_id AND o.item_id = f.item_id)"""


@query("containing_items", f"{BOTH}, {FIRST_ITEM} SELECT user_id, ingredient, item_id FROM f")
def containing_items(spark, d):
    return matching.containing_item(recipe_ingredients(spark, d), owned_items(spark, d))


@query("ingredient_availability", f"{BOTH}, {FIRST_ITEM} SELECT * FROM a")
def ingredient_availability(spark, d):
    return matching.ingredient_availability(recipe_ingredients(spark, d), owned_items(spark, d))


@query("recipes_missing_items", f"""{BOTH}, {FIRST_ITEM}
SELECT user_id, recipe_id, bool_or(missing) AS has_missing, count(*) FILTER (missing) AS n_missing FROM a GROUP BY ALL""")
def recipes_missing_items(spark, d):
    return matching.recipes_missing_items(recipe_ingredients(spark, d), owned_items(spark, d))


@query("best_item_match", f"""{NAME_PAIRS}
SELECT user_id, ingredient, item_id, round(score, 6) AS score FROM i JOIN o USING (user_id) JOIN scores USING (a, b) WHERE score >= 0.45
QUALIFY row_number() OVER (PARTITION BY user_id, ingredient ORDER BY scores.score DESC, item_id) = 1""")
def best_item_match(spark, d):
    return rounded(matching.best_item_match(recipe_ingredients(spark, d), owned_items(spark, d)), "score")


# Without the similarity half, a shared word is a match; the oracle checks that no such match is missed.
@query("word_matches", f"""{BOTH}, i AS (SELECT DISTINCT user_id, ingredient,
  list_filter(string_split({CLIENT.format(c='ingredient')}, ' '), lambda w: w <> '') AS ws FROM ingredients),
o AS (SELECT DISTINCT user_id, {CLIENT.format(c='item_name')} AS om FROM owned)
SELECT i.user_id, ingredient, count(o.om) FILTER (list_has_any(ws, string_split(om, ' '))) AS n_matches
FROM i LEFT JOIN o ON i.user_id = o.user_id GROUP BY ALL""")
def word_matches(spark, d):
    # No score reaches 2, so only shared words count.
    found = matching.matching_items(recipe_ingredients(spark, d), owned_items(spark, d), min_score=2.0)
    return found.select("user_id", "ingredient", "n_matches")


@query("matching_items", f"""{NAME_PAIRS}
SELECT user_id, ingredient, n_matches, n_matches > 0 AS matched FROM (
  SELECT i.user_id, ingredient, count(*) FILTER (score >= 0.45 OR list_has_any({WORDS.format(c='a')}, {WORDS.format(c='b')})) AS n_matches
  FROM (SELECT * FROM i WHERE b <> '') i LEFT JOIN (SELECT * FROM o WHERE a <> '') o USING (user_id) LEFT JOIN scores USING (a, b) GROUP BY i.user_id, ingredient)""")
def matching_items(spark, d):
    return matching.matching_items(recipe_ingredients(spark, d), owned_items(spark, d))


@query("name_similarity", f"""WITH RECURSIVE named AS (SELECT DISTINCT p_name, p_type, {NORM_SQL.format(c='p_name')} AS a, {NORM_SQL.format(c='p_type')} AS b
  FROM lineitem JOIN part ON l_partkey = p_partkey), pairs AS (SELECT DISTINCT a, b FROM named), {SCORES}
SELECT p_name, p_type, round(coalesce(score, 0.0), 6) AS score,
  coalesce(score, 0.0) >= 0.45 OR list_has_any({WORDS.format(c='a')}, {WORDS.format(c='b')}) AS matched
FROM named LEFT JOIN scores USING (a, b)""")
def name_similarity(spark, d):
    part = table(spark, d, "part")
    pairs = table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select("p_name", "p_type").distinct()
    scored = pairs.withColumns({
        "score": sim.similarity(F.col("p_name"), F.col("p_type")), "matched": sim.is_match(F.col("p_name"), F.col("p_type"))
    })
    return rounded(scored, "score")


@query("missing_requested", """
SELECT p_partkey, array_to_string(list_filter([p_name, p_brand, p_type, p_brand], lambda r: NOT list_contains(
  CASE p_size % 3 WHEN 0 THEN [p_brand] WHEN 1 THEN [p_type, 'x'] ELSE [] END, r)), '|') AS missing FROM part""")
def missing_requested(spark, d):
    has = F.when(F.col("p_size") % 3 == 0, F.array("p_brand")).when(
        F.col("p_size") % 3 == 1, F.array(F.col("p_type"), F.lit("x")))
    rows = table(spark, d, "part").select(
        "p_partkey", F.array("p_name", "p_brand", "p_type", "p_brand").alias("requested_ingredients"), has.alias("user_inventory")
    )
    return matching.missing_requested(rows).select("p_partkey", F.array_join("missing_ingredients", "|").alias("missing"))


# Rules from a table: the words of the benchmark texts, in two classes, against the words of the documents' names.
RULES = """rules AS (SELECT DISTINCT CASE WHEN length(w) % 2 = 0 THEN 'even' ELSE 'odd' END AS class, w AS keyword,
  length(w) * 1000000 + ascii(w) * 1000 + ascii(w[2:]) AS ord
  FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS w FROM part) WHERE length(w) > 0)"""


def _rules(spark, d):
    words = table(spark, d, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("keyword")).filter(
        F.length("keyword") > 0).distinct()
    second = F.when(F.length("keyword") > 1, F.ascii(F.substring("keyword", 2, 1))).otherwise(0)
    return words.select(
        F.when(F.length("keyword") % 2 == 0, "even").otherwise("odd").alias("class"), "keyword",
        (F.length("keyword") * 1000000 + F.ascii("keyword") * 1000 + second).alias("ord"),
    )


@query("rule_hits", f"""WITH {RULES}, lines AS (
  SELECT l_orderkey, l_linenumber, lower('x' || p_type || p_name || 'y') AS ingredient FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT l_orderkey, l_linenumber, class, arg_min(keyword, ord) AS keyword FROM (
  SELECT DISTINCT l_orderkey, l_linenumber, ingredient, class, keyword, ord FROM lines JOIN rules ON contains(ingredient, keyword))
GROUP BY l_orderkey, l_linenumber, ingredient, class""")
def rule_hits(spark, d):
    part = table(spark, d, "part")
    lines = table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        "l_orderkey", "l_linenumber", F.lower(F.concat(F.lit("x"), "p_type", "p_name", F.lit("y"))).alias("ingredient")
    ).distinct()
    return matching.rule_hits(lines, _rules(spark, d)).select("l_orderkey", "l_linenumber", "class", "keyword")


PERSONAS = [("no_red", ["RED", "ring"]), ("no_blue", ["blue"]), ("anything", []), ("no_gear", ["gear", "bolt", "green"])]


@query("compatible_items", "SELECT p_partkey, persona FROM part, (VALUES " + ", ".join(
    f"('{p}', {[w.lower() for w in words]}::VARCHAR[])" for p, words in PERSONAS
) + """) AS t(persona, bad)
WHERE len(list_filter(bad, lambda w: contains(lower(p_name), w))) = 0""")
def compatible_items(spark, d):
    items = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("item_name"))
    return matching.compatible_items(items, PERSONAS).select("p_partkey", "persona")


# --- cooking ---

COOK_UNITS = ["kg", "g", "cups", "pieces"]


def cooked_recipes(spark, d, reworded: bool = False):
    """Every order line cooks what it bought; ingredients carry the part names, with ``reworded`` half of them word by word backwards."""
    li, part, orders = (table(spark, d, t) for t in ("lineitem", "part", "orders"))
    qty = (F.col("l_quantity") % 7 + 1).cast("int").cast("string")
    name = F.col("p_name")
    if reworded:
        name = F.when(F.col("l_orderkey") % 2 == 1, F.array_join(F.reverse(F.split("p_name", " ")), " ")).otherwise(name)
    line = F.concat(qty, F.lit(" "), choose(COOK_UNITS, F.col("l_linenumber") % 4), F.lit(" "), F.upper(name))
    lines = li.join(part, li.l_partkey == part.p_partkey).join(orders, li.l_orderkey == orders.o_orderkey)
    return lines.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity").alias("id"), F.col("o_custkey").alias("user_id"),
        F.array(line).alias("main_ingredients"), (F.col("l_orderkey") % 3).cast("int").alias("servings"),
    )


def _cooked_sql(name: str, firsts: str) -> str:
    """Cooked lines with their ingredient's name, and per (user, item) what they use up; ``firsts`` gives (user_id, item_name, item_id)."""
    return f"""cooked AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_quantity, o_custkey AS user_id, l_quantity % 7 + 1 AS qty,
  {sql_choose(COOK_UNITS, 'l_linenumber % 4')} AS cu, {name} AS nm, CASE WHEN l_orderkey % 3 = 0 THEN 1 ELSE l_orderkey % 3 END AS times
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey),
{firsts},
used AS (SELECT f.user_id, f.item_id, sum(times * CASE
    WHEN cu = o.unit OR (cu = 'pieces' AND o.unit = 'pcs') THEN qty WHEN cu = 'kg' AND o.unit = 'g' THEN qty * 1000.0 / 1
    WHEN cu = 'g' AND o.unit = 'kg' THEN qty * 1 / 1000.0
    WHEN cu = 'cups' AND o.unit = 'L' THEN qty * 236.588::DOUBLE / 1000.0 WHEN cu = 'cups' AND o.unit = 'ml' THEN qty * 236.588::DOUBLE
    ELSE 1 END) AS amount
  FROM cooked c JOIN firsts f ON c.user_id = f.user_id AND c.nm = f.item_name
  JOIN owned o ON o.user_id = f.user_id AND o.item_id = f.item_id GROUP BY ALL)"""


COOKED = _cooked_sql("p_name", "firsts AS (SELECT user_id, item_name, min(item_id) AS item_id FROM owned GROUP BY ALL)")
REWORDED = _cooked_sql(
    "CASE WHEN l_orderkey % 2 = 1 THEN array_to_string(list_reverse(string_split(p_name, ' ')), ' ') ELSE p_name END",
    f"""i AS (SELECT DISTINCT user_id, nm AS b FROM cooked), o AS (SELECT user_id, item_name AS a, min(item_id) AS item_id FROM owned GROUP BY ALL),
pairs AS (SELECT DISTINCT a, b FROM i JOIN o USING (user_id)), {SCORES},
firsts AS (SELECT user_id, b AS item_name, item_id FROM i JOIN o USING (user_id) JOIN scores USING (a, b) WHERE score >= 0.45
  QUALIFY row_number() OVER (PARTITION BY user_id, b ORDER BY score DESC, item_id) = 1)""")
LEFT_OVER = """SELECT user_id, item_id, round(CASE WHEN amount IS NULL THEN quantity ELSE greatest(0, quantity - amount) END, 6) AS quantity
FROM owned LEFT JOIN used USING (user_id, item_id)"""


@query("cooked_stock", f"WITH {OWNED}, {COOKED} {LEFT_OVER}")
def cooked_stock(spark, d):
    left = matching.apply_cooked(cooked_recipes(spark, d), owned_items(spark, d))
    return rounded(left.select("user_id", "item_id", "quantity"), "quantity")


@query("cooked_stock_reworded", f"WITH RECURSIVE {OWNED}, {REWORDED} {LEFT_OVER}")
def cooked_stock_reworded(spark, d):
    """Half of the ingredients have no equal name in stock and are matched by similarity."""
    left = matching.apply_cooked(cooked_recipes(spark, d, reworded=True), owned_items(spark, d))
    return rounded(left.select("user_id", "item_id", "quantity"), "quantity")


@query("cooked_from_history", f"WITH {OWNED}, {COOKED} {LEFT_OVER}")
def cooked_from_history(spark, d):
    """The same from stored recipes as JSON, every other one below a key of its own, their ingredients texts or objects."""
    rows = cooked_recipes(spark, d)
    text = F.get("main_ingredients", F.lit(0))
    objects = F.to_json(F.struct(F.array(F.struct(text.alias("name"), F.lit(1).alias("n"))).alias("main_ingredients")))
    nested = F.to_json(F.struct(F.struct(F.array(text, F.lit("")).alias("main_ingredients")).alias("recipe")))
    history = rows.select("id", "user_id", "servings", F.lit(False).alias("is_cooked"), F.when(
        F.col("servings") == 1, nested).otherwise(objects).alias("recipe_json"))
    done = jobs.cook_job(lambda: settled(history, "history"), owned_items(spark, d), lambda h: h.select("id"), scratch_path(spark, "cook"))
    return rounded(done["inventory"].select("user_id", "item_id", "quantity"), "quantity")
