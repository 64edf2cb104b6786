"""Diet rules on the ingredient lines of a chat text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.functions.categories import UNICODE, word_pattern
from larder.functions.text import after_first, before, once, strip

# Keywords of the validator.
MEAT = [
    "chicken", "beef", "pork", "fish", "turkey", "lamb", "bacon", "sausage", "ham", "steak", "meat",
    "salmon", "tuna", "shrimp", "chorizo", "crawfish", "crab",
]
DAIRY = [
    "milk", "cheese", "butter", "cream", "yogurt", "cheddar", "mozzarella", "parmesan",
    "cottage cheese", "whey", "casein",
]
EGG = ["egg", "eggs"]
# Keywords of the cleaner.
CLEANER_MEAT = [
    "chicken", "beef", "pork", "fish", "turkey", "lamb", "bacon", "sausage", "ham", "steak", "meat",
    "salmon", "tuna", "shrimp", "frankfurts", "hot dog", "pepperoni", "prosciutto", "duck", "veal",
    "venison", "crab", "lobster", "anchovy",
]
# The rules as documented, wider than the ones in use.
DOCUMENTED_ANIMAL = ["chicken", "beef", "pork", "fish", "seafood"]
DOCUMENTED_MEAT = ["chicken", "beef", "pork", "lamb", "fish", "seafood", "gelatin"]
DOCUMENTED_DAIRY = ["milk", "butter", "cheese", "cream", "yogurt"]
DOCUMENTED_GLUTEN = ["flour", "bread", "pasta", "barley", "rye", "soy sauce", "couscous", "bulgur"]
# Rule sets; (constraint, tags that ask for it, message, keywords), in message order.
RULES = {
    "code": [
        ("VEGETARIAN", ["vegetarian", "vegan"], "contains: {}", MEAT),
        ("DAIRY-FREE", ["dairy-free"], "contains: {}", DAIRY),
        ("VEGAN", ["vegan"], "meat: {}", MEAT),
        ("VEGAN", ["vegan"], "dairy: {}", DAIRY),
        ("VEGAN", ["vegan"], "egg", EGG),
    ],
    "documented": [
        ("VEGETARIAN", ["vegetarian"], "contains: {}", DOCUMENTED_MEAT),
        ("GLUTEN-FREE", ["gluten-free"], "contains: {}", DOCUMENTED_GLUTEN),
        ("DAIRY-FREE", ["dairy-free"], "contains: {}", DOCUMENTED_DAIRY + ["whey", "casein"]),
        ("VEGAN", ["vegan"], "meat: {}", DOCUMENTED_ANIMAL),
        ("VEGAN", ["vegan"], "dairy: {}", DOCUMENTED_DAIRY),
        ("VEGAN", ["vegan"], "egg", ["egg"]),
        ("VEGAN", ["vegan"], "contains: {}", ["honey", "gelatin"]),
    ],
}
# Markers of the chat text.
ASSISTANT, END = "<|assistant|>", "<|end|>"
SELECTED = "Selected ingredients from your pantry:"


def _no_items() -> Column:
    return F.array().cast("array<string>")


def _dashed(lines: Column) -> Column:
    """Lower-case text behind the dash of every "- item" line."""
    dashed = F.filter(F.transform(lines, strip), lambda s: F.startswith(s, F.lit("-")))
    return F.transform(dashed, lambda s: F.lower(strip(F.substring(s, F.lit(2), F.length(s)))))


def _validator_items(answer: Column) -> Column:
    section = after_first(answer, SELECTED)
    cut = once(section, lambda s: (
        F.when(F.contains(s, F.lit("Suggested additions")), before(s, "Suggested additions"))
        .when(F.contains(s, F.lit("Instructions:")), before(s, "Instructions:"))
        .otherwise(s)
    ))
    return F.filter(_dashed(F.split(strip(cut), "\n")), lambda s: F.length(s) > 0)


# Fixed value: the start of a line that ends the section, unless the line opens one.
STOP_LINE = r"(?U)(?:^|\n)\s*(?:Suggested|Instructions)(?![^\n]*\Q" + SELECTED + r"\E)"


def _cleaner_items(answer: Column) -> Column:
    # What follows the line with the opening words.
    behind = F.get(F.split(answer, r"\Q" + SELECTED + r"\E[^\n]*\n", 2), F.lit(1))
    lines = F.split(F.get(F.split(behind, STOP_LINE, 2), F.lit(0)), "\n")
    return _dashed(F.filter(lines, lambda s: ~F.contains(s, F.lit(SELECTED))))


def selected_items(c: Column, policy: str = "validator") -> Column:
    """Selected ingredients of a chat text; empty where it has no such section.

    ``validator`` ends the section at "Suggested additions", else at
    "Instructions:"; ``cleaner`` ends it at a line that starts with
    "Suggested" or "Instructions".
    """
    read = {"validator": _validator_items, "cleaner": _cleaner_items}
    if policy not in read:
        raise ValueError(f"policy must be 'validator' or 'cleaner', not {policy!r}")
    return F.coalesce(read[policy](before(after_first(c, ASSISTANT), END)), _no_items())


def _holds(text: Column, keyword: str, match: str) -> Column:
    if match == "word":
        return F.rlike(text, F.lit(UNICODE + word_pattern([keyword])))
    return F.contains(text, F.lit(keyword))


def first_keyword(text: Column, keywords, match: str = "substring") -> Column:
    """First keyword in list order that the text holds, else null."""
    return F.coalesce(*[F.when(_holds(text, k, match), F.lit(k)) for k in keywords], F.lit(None).cast("string"))


def first_meat_word(items: Column, keywords=None, match: str = "substring") -> Column:
    """First meat word in the joined selection."""
    return once(F.array_join(items, " "), lambda joined: first_keyword(joined, keywords or CLEANER_MEAT, match))


def asks_for(tags: Column, wanted) -> Column:
    return F.coalesce(F.arrays_overlap(tags, F.array(*[F.lit(t) for t in wanted])), F.lit(False))


def _messages(items: Column, constraint: str, why: str, keywords, match: str) -> Column:
    """One message per item that holds a keyword."""
    head, named, tail = why.partition("{}")

    def message(item: Column) -> Column:
        word = first_keyword(item, keywords, match)
        # Both forms are null without a keyword, and so is the message.
        reason = F.concat(F.lit(head), word, F.lit(tail)) if named else F.when(word.isNotNull(), F.lit(why))
        return F.concat(F.lit(f"{constraint}: "), item, F.lit(" ("), reason, F.lit(")"))

    return F.array_compact(F.transform(items, message))


def diet_violations(tags: Column, items: Column, rules: str = "code", match: str = "substring") -> Column:
    """Messages "CONSTRAINT: item (why)" for every item that breaks a tag of the sample."""
    return F.concat(*[
        F.when(asks_for(tags, wanted), _messages(items, constraint, why, keywords, match)).otherwise(_no_items())
        for constraint, wanted, why, keywords in RULES[rules]
    ])
