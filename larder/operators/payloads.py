"""Recipe and receipt payloads of changing shape, read as Variant."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.categories import detect_category
from larder.functions.text import is_filled, strip, unused_ingredient
from larder.functions.units import parse_qty_text


def _text(v: Column, path: str = "$") -> Column:
    return F.try_variant_get(v, path, "string")


def _node(v: Column, path: str) -> Column:
    """A sub-value; null where the key is absent, a variant null where its value is null."""
    return F.try_variant_get(v, path, "variant")


def recipe_node(recipe: Column) -> Column:
    """The inner ``recipe`` object where there is one, else the object itself."""
    return F.coalesce(_node(recipe, "$.recipe"), recipe)


def ingredient_elements(recipe: Column) -> Column:
    """Main ingredients as array<variant>: texts, objects or anything else."""
    return F.try_variant_get(recipe_node(recipe), "$.main_ingredients", "array<variant>")


def _is_object(v: Column) -> Column:
    return F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))


def _is_text(v: Column) -> Column:
    return F.schema_of_variant(v) == "STRING"


def ingredient_text(element: Column) -> Column:
    """Text of a list element: itself, or the name (else the ingredient) of an object; null for anything else."""
    def some(c: Column) -> Column:
        return F.when(is_filled(c), c)

    named = F.coalesce(some(_text(element, "$.name")), some(_text(element, "$.ingredient")), F.lit(""))
    return F.when(_is_text(element), _text(element)).when(_is_object(element), named)


def drop_unused_ingredients(recipes: DataFrame, col: str = "recipe_json") -> DataFrame:
    """Main ingredients (array<variant>) without those that call themselves unused; elements without text stay."""
    kept = F.filter(
        ingredient_elements(F.col(col)),
        lambda e: ~F.coalesce(unused_ingredient(ingredient_text(e)), F.lit(False)),
    )
    return recipes.withColumn("main_ingredients", kept)


def with_ingredient_texts(recipes: DataFrame, col: str = "recipe_json") -> DataFrame:
    """Main ingredients as plain texts, elements without text left out."""
    texts = F.transform(ingredient_elements(F.col(col)), ingredient_text)
    return recipes.withColumn("main_ingredients", F.filter(texts, lambda t: F.length(t) > 0))


def payload_elements(payload: Column) -> Column:
    """List elements of a payload text: a list, an object that holds one, one object, or any of these as a JSON string."""
    outer = F.try_parse_json(payload)
    value = F.when(_is_text(outer), F.try_parse_json(_text(outer))).otherwise(outer)
    as_list = "array<variant>"
    held = F.coalesce(_node(value, "$.items"), _node(value, "$.detected_items"))
    return (
        F.when(F.startswith(F.schema_of_variant(value), F.lit("ARRAY")), F.try_variant_get(value, "$", as_list))
        .when(_is_object(value) & held.isNotNull(), F.try_variant_get(held, "$", as_list))
        .when(_is_object(value), F.array(value))
    )


def explode_items(df: DataFrame, payload_col: str, name: str = "element") -> DataFrame:
    """One row per object in the payload's list."""
    exploded = df.withColumn(name, F.explode(payload_elements(F.col(payload_col))))
    return exploded.filter(_is_object(F.col(name)))


def _first_key(element: Column, keys, default: str) -> Column:
    """The value of the first key that is present; a null value reads as the word None."""
    found = F.coalesce(*[_node(element, f"$.{k}") for k in keys])
    return (
        F.when(found.isNull(), F.lit(default))
        .when(F.is_variant_null(found), F.lit("None"))
        .otherwise(_text(found))
    )


def receipt_items(df: DataFrame, payload_col: str) -> DataFrame:
    """(item_name, quantity, unit, category) per item of a receipt payload."""
    rows = explode_items(df, payload_col)
    element = F.col("element")
    return (
        rows.withColumn("_q", parse_qty_text(_first_key(element, ["quantity", "qty"], "1 pcs")))
        .withColumn("item_name", _first_key(element, ["item", "name", "item_name"], "Unknown Item"))
        .withColumns({"quantity": F.col("_q.qty"), "unit": F.col("_q.unit")})
        .withColumn("category", detect_category(F.col("item_name")))
        .drop("element", "_q", payload_col)
    )


def stamp_receipt_items(df: DataFrame, text_col: str, as_of: date) -> DataFrame:
    """(item, quantity, purchase_date) per item of a model answer that may be fenced."""
    text = strip(F.col(text_col))
    bare = strip(F.regexp_replace(text, r"```json|```", ""))
    payload = F.when(F.startswith(text, F.lit("```json")), bare).otherwise(text)
    rows = df.withColumn("_payload", payload)
    return explode_items(rows, "_payload").select(
        *[c for c in df.columns if c != text_col],
        _text(F.col("element"), "$.item").alias("item"), _text(F.col("element"), "$.quantity").alias("quantity"),
        F.lit(as_of).alias("purchase_date"),
    )


def variant_json(prefs: DataFrame) -> DataFrame:
    """Both variants of a comparison as JSON text, texts kept as they are."""
    def as_text(c: str) -> Column:
        return F.coalesce(F.col(f"{c}_raw"), F.to_json(F.col(c)))

    return prefs.withColumns({"variant_a_raw": as_text("variant_a"), "variant_b_raw": as_text("variant_b")})


def answer_recipes(answers: DataFrame, text_col: str = "answer") -> DataFrame:
    """One row per candidate of a model answer that is a JSON array: its place, from 1, and its JSON text as ``recipe``.

    Any other answer, an unreadable one among them, has no candidates.
    """
    value = F.try_parse_json(F.col(text_col))
    listed = F.when(F.startswith(F.schema_of_variant(value), F.lit("ARRAY")), F.try_variant_get(value, "$", "array<variant>"))
    others = [c for c in answers.columns if c != text_col]
    rows = answers.select(*others, F.posexplode(F.transform(listed, lambda e: F.to_json(e))).alias("_at", "recipe"))
    return rows.select(*others, (F.col("_at") + 1).alias("place"), "recipe")
