"""Ingredient names against a user's items: by containment, by similarity, and what a cooked recipe uses up.

No operator here turns all (ingredient, item) pairs of a user into rows.
Containment is resolved on the two vocabularies by sorted suffixes. Similarity compares packed lists of names and returns one result
per ingredient and list, so a hot user becomes many independent rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.similarity import best_in_block, match_counts_in_block
from larder.functions.text import array_missing, has_name, norm_text
from larder.functions.units import parse_ingredient
from larder.operators.containment import contained, keyword_hits
from larder.operators.stock import deduct, deduction_amount
from larder.session import passing, settled, task_count

BLOCK = 512
# The similarity of equal names is 1 below this length; beyond it frequent letters are ignored.
EXACT_LENGTH = 200


def _names(df: DataFrame, col: str, collapse: bool = False) -> DataFrame:
    """Rows with a normalised name; the test on the raw text spares the filter the normalisation."""
    return df.filter(has_name(F.col(col))).withColumn("_name", norm_text(F.col(col), collapse))


def _lowest(keep=()) -> Column:
    """Aggregate: the lowest item id as ``_item``, with what is kept of its row; null where all ids are."""
    return F.min(F.when(F.col("item_id").isNotNull(), F.struct("item_id", *keep))).alias("_item")


def _item_names(inventory: DataFrame, collapse: bool = False, keep=()) -> DataFrame:
    """One row per (user, normalised name) with the lowest item id and the ``keep`` columns of that item."""
    return (
        _names(inventory.select("user_id", "item_id", "item_name", *keep), "item_name", collapse)
        .groupBy("user_id", "_name").agg(_lowest(keep)).select("user_id", "_name", "_item.*")
    )


def _block_numbers(names: DataFrame, size: int) -> DataFrame:
    """The number of lists of the users that need more than one: few users, by definition."""
    return names.groupBy("user_id").agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).alias("_blocks")).filter(F.col("_blocks") > 1)


def _blocks(names: DataFrame, packed: Column, size: int) -> DataFrame:
    """Names packed into sorted lists of about ``size`` per user; a user with few names gets one list."""
    return (
        names.join(_block_numbers(names, size), "user_id", "left")
        .withColumn("_block", F.pmod(F.xxhash64("_name"), F.coalesce("_blocks", F.lit(1))))
        .groupBy("user_id", "_block")
        .agg(F.array_sort(F.collect_list(packed)).alias("_packed"))
    )


def _block_pairs(left: DataFrame, items: DataFrame, size: int, keep=()) -> DataFrame:
    """Lists of ingredient names beside lists of items of the same user.

    Rows are lists, not names. Every ingredient list is addressed to each item
    list of its user by number, so the join key of a hot user is many keys.
    """
    # Comparing costs far more than the bytes suggest: with a fixed number the partitions are not merged.
    n = task_count(left.sparkSession)
    spread = ("user_id", "_right")
    names = (
        _blocks(left, F.col("_name"), size)
        .join(_block_numbers(items, size), "user_id", "left")
        .select("user_id", F.col("_packed").alias("names"), F.explode(
            F.sequence(F.lit(0).cast("long"), F.coalesce("_blocks", F.lit(1)) - 1)).alias("_right"))
    )
    # Items sorted by id: the first of equal scores is the lowest id.
    lists = _blocks(items, F.struct("item_id", "_name", *keep), size).select(
        "user_id", F.col("_block").alias("_right"), F.col("_packed").alias("items")
    )
    return names.repartition(n, *spread).join(lists.repartition(n, *spread), list(spread))


def _closest(names: DataFrame, items: DataFrame, min_score: float, block: int, keep=()) -> DataFrame:
    """Per (user, name) the item of the highest similarity from ``min_score`` on, with the ``keep`` columns of ``items``; of equals the lowest id."""
    found = best_in_block(F.col("names"), F.transform("items", lambda i: i["_name"]), min_score)
    scored = (
        _block_pairs(names, items, block, keep)
        .withColumn("best", found)
        .withColumn("_found", F.explode(F.arrays_zip("names", "best")))
        .filter(F.col("_found.best").isNotNull())
        .select("user_id", F.col("_found.names").alias("_name"), F.col("_found.best.score").alias("score"),
                F.get("items", F.col("_found.best.at")).alias("_item"))
    )
    best = scored.groupBy("user_id", "_name").agg(
        F.min(F.struct((-F.col("score")).alias("_neg"), *[F.col(f"_item.{c}").alias(c) for c in ("item_id", *keep)])).alias("_best"))
    return best.select("user_id", "_name", *[F.col(f"_best.{c}").alias(c) for c in ("item_id", *keep)], (-F.col("_best._neg")).alias("score"))


def _equal_items(items: DataFrame) -> DataFrame:
    """Items whose equal name needs no comparison, marked as ``_equal``."""
    return items.filter(F.length("_name") < EXACT_LENGTH).withColumn("_equal", F.lit(True))


def best_item_match(
    ingredients: DataFrame, inventory: DataFrame, min_score: float = 0.45, block: int = BLOCK
) -> DataFrame:
    """The one item of the user with the highest similarity per ingredient name.

    Ties go to the lowest item id; names without a match of ``min_score`` give
    no row. Equal names are joined directly, the rest is compared in lists; which
    names are equal is written once for both.
    """
    wanted = settled(_names(ingredients.select("user_id", "ingredient").distinct(), "ingredient"), "wanted")
    items = settled(_item_names(inventory), "items")
    names = settled(wanted.select("user_id", "_name").distinct().join(_equal_items(items), ["user_id", "_name"], "left"), "names")
    equal = names.filter("_equal").select("user_id", "_name", "item_id", F.lit(1.0).alias("score"))
    best = _closest(names.filter(F.col("_equal").isNull()).select("user_id", "_name"), items, min_score, block)
    return (
        wanted.join(equal.unionByName(best), ["user_id", "_name"])
        .select("user_id", "ingredient", "item_id", "score")
    )


def matching_items(
    ingredients: DataFrame, inventory: DataFrame, min_score: float = 0.45, block: int = BLOCK
) -> DataFrame:
    """Per ingredient name how many item names of the user match it (shared word or similarity)."""
    wanted = settled(_names(ingredients.select("user_id", "ingredient").distinct(), "ingredient"), "wanted")
    names = settled(wanted.select("user_id", "_name").distinct(), "names")
    items = settled(_item_names(inventory), "items")
    counts = match_counts_in_block(F.col("names"), F.transform("items", lambda i: i["_name"]), min_score)
    found = (
        _block_pairs(names, items, block)
        .withColumn("n", counts)
        .withColumn("_found", F.explode(F.arrays_zip("names", "n")))
        .groupBy("user_id", F.col("_found.names").alias("_name"))
        .agg(F.sum("_found.n").alias("n_matches"))
    )
    return (
        wanted.join(found, ["user_id", "_name"], "left")
        .select("user_id", "ingredient", F.coalesce("n_matches", F.lit(0)).alias("n_matches"))
        .withColumn("matched", F.col("n_matches") > 0)
    )


def _contained(containers: DataFrame, parts: DataFrame) -> DataFrame:
    """Which names of one table each distinct name of another contains, as (_name, _part), on the two vocabularies without users.

    A name has few parts, so joining the result to users multiplies little.
    """
    return contained(containers.select("_name").distinct(), parts.select(F.col("_name").alias("_part")).distinct())


def containing_item(ingredients: DataFrame, inventory: DataFrame, keep=()) -> DataFrame:
    """The first item (lowest id) whose name contains the ingredient name or is contained in it.

    ``keep`` names columns of the item that come along. All joins are equi joins, and each direction is reduced to the lowest item
    id per (user, name) ahead of the last one.
    """
    wanted = settled(_names(ingredients.select("user_id", "ingredient").distinct(), "ingredient", collapse=True), "wanted")
    names = settled(wanted.select("user_id", "_name").distinct(), "names")
    items = settled(_item_names(inventory, collapse=True, keep=keep), "items")
    inside_item = (
        items.join(_contained(items, names), "_name")
        .groupBy("user_id", F.col("_part").alias("_name")).agg(_lowest(keep))
        .join(names, ["user_id", "_name"])
    )
    holds_item = (
        names.join(_contained(names, items), "_name")
        .join(items.withColumnRenamed("_name", "_part"), ["user_id", "_part"])
        .groupBy("user_id", "_name").agg(_lowest(keep))
    )
    first = (
        inside_item.select("user_id", "_name", "_item").unionByName(holds_item)
        .groupBy("user_id", "_name").agg(F.min("_item").alias("_item"))
    )
    return wanted.join(first, ["user_id", "_name"]).select("user_id", "ingredient", "_item.*")


def ingredient_availability(ingredients: DataFrame, inventory: DataFrame, low: float = 0.1) -> DataFrame:
    """Per (user, recipe, ingredient) the item it is taken from, and whether it is missing or low."""
    rows = settled(ingredients.select("user_id", "recipe_id", "ingredient"), "ingredients")
    first = containing_item(rows, inventory, keep=("quantity",))
    return (
        rows.join(first, ["user_id", "ingredient"], "left")
        .select(
            "user_id", "recipe_id", "ingredient", "item_id",
            F.col("item_id").isNull().alias("missing"),
            F.coalesce(F.col("quantity") <= low, F.lit(False)).alias("low"),
        )
    )


def asked_ingredients(requests: DataFrame, words=("chicken",)) -> DataFrame:
    """Ingredient rows (user_id, recipe_id, ingredient) for the words that a request text names."""
    named = F.array_compact(F.array(*[
        F.when(F.contains(F.lower("request"), F.lit(w)), F.lit(w)) for w in words
    ]))
    return requests.select("user_id", "recipe_id", F.explode(named).alias("ingredient"))


def recipes_missing_items(ingredients: DataFrame, inventory: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """Whether any ingredient of a recipe has no item; a protein that the request names counts as an ingredient."""
    rows = ingredients.select("user_id", "recipe_id", "ingredient")
    if requests is not None:
        rows = rows.unionByName(asked_ingredients(requests))
    return ingredient_availability(rows, inventory).groupBy("user_id", "recipe_id").agg(
        F.bool_or("missing").alias("has_missing"), F.count_if("missing").alias("n_missing")
    )


def missing_requested(requests: DataFrame) -> DataFrame:
    """Requested ingredients that are not among the user's, as a list."""
    return requests.withColumn(
        "missing_ingredients", array_missing(F.col("requested_ingredients"), F.col("user_inventory"))
    )


def rule_hits(ingredients: DataFrame, rules: DataFrame) -> DataFrame:
    """First keyword (lowest ``ord``) per (ingredient row, rule class) that the ingredient contains.

    ``rules`` has columns class, keyword, ord and may be large; every distinct
    ingredient is read once per shard of the rules.
    """
    texts = ingredients.select(F.col("ingredient").alias("text")).where(F.length("text") > 0).distinct()
    first = keyword_hits(texts, rules).withColumnRenamed("text", "ingredient")
    return ingredients.join(first, "ingredient").select(*ingredients.columns, "class", "keyword")


def compatible_items(items: DataFrame, personas: list) -> DataFrame:
    """Items per persona without any of its forbidden keywords.

    ``personas`` is the small fixed configuration (id, forbidden words); items
    are multiplied in place, without a join.
    """
    low = F.lower(F.col("item_name"))
    allowed = []
    for persona_id, forbidden in personas:
        bad = F.lit(False)
        for word in forbidden:
            bad = bad | F.contains(low, F.lit(word.lower()))
        allowed.append(F.when(~bad, F.lit(persona_id)))
    return items.withColumn("persona", F.explode(F.array_compact(F.array(*allowed))))


def parsed_ingredients(recipes: DataFrame, items: str = "main_ingredients") -> DataFrame:
    """One row per ingredient text of a recipe, parsed; empty texts are left out."""
    # A filter of the list, not of the rows: Spark would repeat what the list is made of in filters ahead of the explode.
    rows = recipes.select(
        *[c for c in recipes.columns if c != items],
        F.explode(F.filter(items, lambda t: F.length(t) > 0)).alias("ingredient_text"),
    )
    return rows.withColumn("_p", parse_ingredient(F.col("ingredient_text"))).select(
        *rows.columns, F.col("_p.qty").alias("qty"), F.col("_p.unit").alias("unit"),
        F.col("_p.name").alias("ingredient"),
    )


def cook_deductions(cooked: DataFrame, inventory: DataFrame, min_score: float = 0.45, keep=("ingredient_text",)) -> DataFrame:
    """What cooked recipes take from which item: (user_id, item_id, amount) per ingredient, with the ``keep`` columns of its row.

    ``inventory`` has one row per (user, item). An ingredient meets the item of its name in one join, which is all that
    most of them need; only names that no item has are gathered and compared in lists, as in ``best_item_match``.
    """
    taken = ("user_id", "item_id", *keep, deduction_amount(F.col("qty"), F.col("unit"), F.col("item_unit"), F.col("servings")).alias("amount"))
    asked = ("_name", "qty", "unit", "servings")
    # No filter on the name ahead of the join: it would parse the texts once more.
    used = parsed_ingredients(cooked).withColumn("_name", norm_text(F.col("ingredient"))).select("user_id", *asked, *keep)
    with passing(cooked.sparkSession):
        items = settled(_item_names(inventory, keep=("unit",)).withColumnRenamed("unit", "item_unit"), "items")
        rows = used.join(_equal_items(items), ["user_id", "_name"], "left")
        # What is settled for a row is its amount, for the others what they ask for.
        met = settled(rows.select(*taken, "_equal", *[F.when(F.col("_equal").isNull(), F.col(c)).alias(c) for c in asked]), "met", lasting=True)
        rest = met.filter(F.col("_equal").isNull() & (F.length("_name") > 0)).select("user_id", *asked, *keep)
        names = settled(rest.select("user_id", "_name").distinct(), "names")
        # Only the items of users who have such a name.
        near = items.join(names.select("user_id").distinct(), "user_id", "left_semi")
        best = settled(_closest(names, near, min_score, BLOCK, keep=("item_unit",)), "best", lasting=True)
    equal = met.filter("_equal").select("user_id", "item_id", *keep, "amount")
    return equal.unionByName(rest.join(best, ["user_id", "_name"]).select(*taken))


def _once(rows: DataFrame, key: str) -> DataFrame:
    """One row per key; only rows that share the hash of their key with another row are moved, the others stay where they are."""
    marked = rows.withColumn("_hash", F.xxhash64(key))
    several = settled(marked.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_hash"), "several")
    alone = marked.join(several, "_hash", "left_anti")
    shared = marked.join(several, "_hash", "left_semi").dropDuplicates([key])
    return alone.unionByName(shared).select(*rows.columns)


def apply_cooked(cooked: DataFrame, inventory: DataFrame, event_id: str = "id", min_score: float = 0.45) -> DataFrame:
    """The inventory after a set of cook events, each event counted once; the inventory is written once for all that read it."""
    inventory = settled(inventory, "inventory")
    return deduct(inventory, cook_deductions(_once(cooked, event_id), inventory, min_score, keep=()))
