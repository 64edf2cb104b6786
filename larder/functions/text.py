"""Text normalisation, splitting and small classifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space when a text is stripped.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Fixed value: the same characters inside a character class (the plain class knows ASCII only).
SPACE = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

# Phrases that mark a failed recipe.
ERROR_PHRASES = [
    "no suitable recipe", "cannot be made", "no recipe found", "failed to parse", "unable to",
    "not possible", "cannot generate", "no sweet dessert", "no dessert can be made",
    "ingredients provided",
]
# Names and step words that mark a failed recipe.
ERROR_NAMES = ["error", "unknown", ""]
ERROR_STEP_WORDS = ["error", "failed", "no suitable", "raw output"]


def once(c: Column, fn) -> Column:
    """``fn`` applied to a value that is computed once, however often ``fn`` names it."""
    return F.get(F.transform(F.array(c), fn), F.lit(0))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def hash_bucket(key: Column, buckets, salt: str = "") -> Column:
    """Bucket 0..n-1 by the md5 of the key: the same on every run and partitioning."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(salt)))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(buckets))


def is_filled(c: Column) -> Column:
    """True for a text that is neither null nor empty; never null."""
    return F.coalesce(F.length(c) > 0, F.lit(False))


def is_blank(c: Column) -> Column:
    """True for null, empty and white-space-only text."""
    return ~is_filled(strip(c))


def default_if_empty(c: Column, value) -> Column:
    """``value`` where the text is null or empty (``coalesce`` would keep the empty text)."""
    return F.when(is_filled(c), c).otherwise(F.lit(value))


def norm_text(c: Column, collapse: bool = False) -> Column:
    """Lower case with every non-alphanumeric as a space; ``collapse`` also folds runs of spaces."""
    low = F.lower(c)
    spaced = F.regexp_replace(low, f"[^a-z0-9{SPACE}]", " ")
    if collapse:
        spaced = F.regexp_replace(spaced, f"[{SPACE}]+", " ")
    # Most names are plain words with single spaces; one cheap test spares them the replacements.
    return F.when(F.rlike(low, F.lit(r"^[a-z0-9]+( [a-z0-9]+)*\z")), low).otherwise(strip(spaced))


def has_name(c: Column) -> Column:
    """Whether anything is left of a text once it is normalised."""
    return F.rlike(F.lower(c), F.lit("[a-z0-9]"))


def words(c: Column) -> Column:
    return F.filter(F.split(c, f"[{SPACE}]+"), lambda w: F.length(w) > 0)


def token_count(c: Column) -> Column:
    return F.size(words(c))


def token_overlap(a: Column, b: Column) -> Column:
    """Whether two texts share a normalised word."""
    return F.coalesce(F.arrays_overlap(words(norm_text(a)), words(norm_text(b))), F.lit(False))


def comma_list(c: Column) -> Column:
    """"a, b,,c" -> [a, b, c]; null stays null."""
    return F.filter(F.transform(F.split(c, ","), strip), lambda x: F.length(x) > 0)


def oxford_list(items: Column) -> Column:
    """"a", "a and b", "a, b, and c"; empty for no items."""
    n = F.size(items)
    head = F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(0))), ", ")
    last = F.try_element_at(items, F.lit(-1))
    return (
        F.when(items.isNull() | (n <= 0), F.lit(""))
        .when(n == 1, F.get(items, F.lit(0)))
        .when(n == 2, F.concat(head, F.lit(" and "), last))
        .otherwise(F.concat(head, F.lit(", and "), last))
    )


def array_missing(requested: Column, available: Column) -> Column:
    """Requested names that are not available, in request order, repeats kept."""
    return F.filter(
        F.coalesce(requested, F.array().cast("array<string>")),
        lambda r: ~F.array_contains(F.coalesce(available, F.array().cast("array<string>")), r),
    )


def meal_type(c: Column) -> Column:
    """Meal by the hour of "HH:MM"; "meal" where the hour is no number."""
    hour = strip(F.split_part(c, F.lit(":"), F.lit(1))).try_cast("int")
    return (
        F.when(hour.isNull(), "meal")
        .when(hour.between(5, 10), "breakfast")
        .when(hour.between(11, 14), "lunch")
        .when(hour.between(15, 16), "snack")
        .when(hour.between(17, 21), "dinner")
        .otherwise("late night snack")
    )


def normalize_path(c: Column) -> Column:
    """Numeric path segments become ``/:id``, so that labels stay few."""
    return F.regexp_replace(c, r"/\d+", "/:id")


def split_run_name(c: Column) -> Column:
    """"model_t0.7" -> struct(model, temperature)."""
    return F.struct(
        F.split_part(c, F.lit("_t"), F.lit(1)).alias("model"),
        F.split_part(c, F.lit("_t"), F.lit(2)).try_cast("double").alias("temperature"),
    )


def clean_variant(c: Column) -> Column:
    """Cut a model text behind the first ``}`` that a special token follows."""
    cut = F.when(F.contains(c, F.lit("}<|")), F.concat(F.substring_index(c, "}<|", 1), F.lit("}"))).otherwise(c)
    return strip(cut)


def after_first(c: Column, marker: str) -> Column:
    """The part between the first and the second marker; null without a marker."""
    return F.get(F.split(c, f"\\Q{marker}\\E", 3), F.lit(1))


def before(c: Column, marker: str) -> Column:
    return F.substring_index(c, marker, 1)


def user_part(c: Column) -> Column:
    """User message of a ChatML prompt."""
    return strip(before(after_first(c, "<|im_start|>user"), "<|im_end|>"))


def assistant_part(c: Column) -> Column:
    """Assistant answer of a header-style output, cut down to its JSON where it has some."""
    answer = strip(before(after_first(c, "<|start_header_id|>assistant<|end_header_id|>"), "<|eot_id|>"))
    fence = "```json"
    behind = F.substring(answer, F.instr(answer, fence) + len(fence), F.length(answer))
    closed = F.instr(behind, "```") > 1
    fenced = F.when(closed, strip(before(behind, "```"))).otherwise(answer)
    # From the first opening to the last closing brace; nothing where they are out of order.
    first = F.instr(answer, "{")
    last = F.length(answer) - F.instr(F.reverse(answer), "}") + 1
    braces = F.substring(answer, first, F.greatest(last - first + 1, F.lit(0)))
    picked = (
        F.when(F.contains(answer, F.lit(fence)), fenced)
        .when(F.contains(answer, F.lit("{")) & F.contains(answer, F.lit("}")), braces)
        .otherwise(answer)
    )
    return F.when(answer.isNull(), strip(c)).otherwise(picked)


def split_steps(c: Column) -> Column:
    """Cooking steps: by "Step n" markers, else by bullets, else by lines that open with a marker, else by sentences."""
    text = strip(F.regexp_replace(c, "\r", ""))

    def kept(parts: Column) -> Column:
        return F.filter(F.transform(parts, strip), lambda s: F.length(s) > 0)

    marker = r"(?i)step\s*\d+[.:-]?\s*"
    # Text ahead of the first marker is no step.
    pieces = F.split(text, marker)
    by_marker = kept(F.slice(pieces, 2, F.greatest(F.size(pieces), F.lit(1))))
    lines = F.split(text, r"\n+")
    by_bullet = kept(F.transform(lines, lambda s: F.regexp_replace(s, r"^\s*[-*]\s+", "")))
    opening = r"(?i)(?:^|\n)\s*step\s*\d+[.:\-\s]*"
    by_opening = kept(F.split(text, opening))
    by_sentence = kept(F.flatten(F.transform(lines, lambda s: F.split(s, r"(?<=[.!?])\s+"))))
    return (
        F.when(~is_filled(text), F.array().cast("array<string>"))
        .when(F.size(by_marker) > 0, by_marker)
        .when(F.rlike(text, F.lit(r"(?m)^\s*[-*]\s+")), by_bullet)
        .when(F.rlike(text, F.lit(opening)), by_opening)
        .otherwise(by_sentence)
    )


def steps_of_json(c: Column) -> Column:
    """Cooking steps of a JSON text: of a list the texts in it, stripped and without empty ones; a text is split; nothing for anything else."""
    value = F.try_parse_json(c)
    kind = F.schema_of_variant(value)

    def said(e: Column) -> Column:
        return F.when(F.schema_of_variant(e) == "STRING", strip(F.try_variant_get(e, "$", "string")))

    listed = F.filter(F.transform(F.try_variant_get(value, "$", "array<variant>"), said), lambda s: F.length(s) > 0)
    return (
        F.when(F.startswith(kind, F.lit("ARRAY")), listed)
        .when(kind == "STRING", split_steps(F.try_variant_get(value, "$", "string")))
        .otherwise(F.array().cast("array<string>"))
    )


def contains_any(c: Column, phrases) -> Column:
    """Whether the text holds one of a fixed list of phrases."""
    hit = F.lit(False)
    for p in phrases:
        hit = hit | F.contains(c, F.lit(p))
    return hit


def is_error_recipe(raw_text: Column, name: Column, steps: Column) -> Column:
    """Whether a recipe is really an error answer."""
    raw = F.lower(F.coalesce(raw_text, F.lit("")))
    title = F.lower(F.coalesce(name, F.lit("")))
    low = F.transform(F.coalesce(steps, F.array().cast("array<string>")), F.lower)
    phrase = (
        contains_any(raw, ERROR_PHRASES)
        | contains_any(title, ERROR_PHRASES)
        | F.exists(low, lambda s: contains_any(s, ERROR_PHRASES))
    )
    bad_steps = (F.size(low) > 0) & F.forall(low, lambda s: contains_any(s, ERROR_STEP_WORDS))
    return phrase | title.isin(ERROR_NAMES) | bad_steps


def recipe_title(name: Column, nested_name: Column, user_query: Column) -> Column:
    def some(c):
        return F.when(is_filled(c), c)

    return F.coalesce(some(name), some(nested_name), some(user_query), F.lit("Untitled Recipe"))


def unused_ingredient(c: Column) -> Column:
    """Whether an ingredient text marks itself as unused."""
    return contains_any(F.lower(c), ["not used", "ignore"])
