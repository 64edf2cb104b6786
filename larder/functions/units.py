"""Units, ingredient texts and quantities."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.functions.text import is_filled, once, strip

# Canonical unit -> the spellings that mean it.
UNIT_SPELLINGS = {
    "lb": ["lb", "lbs", "pound", "pounds"],
    "oz": ["oz", "ounce", "ounces"],
    "kg": ["kg", "kilogram", "kilograms"],
    "g": ["g", "gram", "grams"],
    "cup": ["cup", "cups"],
    "tbsp": ["tbsp", "tablespoon", "tablespoons"],
    "tsp": ["tsp", "teaspoon", "teaspoons"],
    "ml": ["ml", "milliliter", "milliliters"],
    "l": ["l", "liter", "liters"],
    "fl oz": ["fl oz", "fluid ounce"],
    "pcs": ["pc", "pcs", "piece", "pieces", "unit", "units"],
    "can": ["can", "cans"],
    "bunch": ["bunch", "bunches"],
    "head": ["head", "heads"],
    "clove": ["clove", "cloves"],
}
# Grams per weight unit and millilitres per volume unit.
GRAMS = {"g": 1.0, "kg": 1000.0, "lb": 453.592, "oz": 28.3495}
MILLILITRES = {"ml": 1.0, "l": 1000.0, "cup": 236.588, "tbsp": 14.7868, "tsp": 4.92892, "fl oz": 29.5735}

# The three forms of an ingredient text, tried in this order.
LEADING = r"^\s*([\d./]+)\s*([a-zA-Z]+)?\s+([^\n]*)"
IN_PARENTHESES = r"^([^()]+)\(\s*([\d./]+)\s*([a-zA-Z]+)"
INLINE = r"([\d./]+)\s*([a-zA-Z]+)"
RECEIPT_QUANTITY = r"^([\d.]+)\s*([^\n]*)"


def lookup(table: dict, key: Column) -> Column:
    entries = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in table.items()))
    return F.try_element_at(entries, key)


ALIASES = {spelling: unit for unit, group in UNIT_SPELLINGS.items() for spelling in group}


def normalize_unit(c: Column) -> Column:
    """Canonical unit of a spelling; unknown spellings stay, empty text is null."""
    return F.when(is_filled(c), once(strip(F.lower(c)), lambda s: F.coalesce(lookup(ALIASES, s), s)))


def _unit_or_pieces(c: Column) -> Column:
    return once(normalize_unit(c), lambda unit: F.when(is_filled(unit), unit).otherwise("pcs"))


def _number(c: Column) -> Column:
    """"2", "1.5" or "1/2" as a number, 1.0 where it is none (or divides by zero)."""
    def ratio(parts: Column) -> Column:
        return F.when(F.size(parts) == 2, F.try_divide(
            F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double")
        ))

    value = F.when(F.contains(c, F.lit("/")), once(F.split(c, "/"), ratio)).otherwise(c.try_cast("double"))
    return F.coalesce(value, F.lit(1.0))


def parse_ingredient(c: Column) -> Column:
    """Ingredient text -> struct(qty, unit, name); the forms are tried in order, each pattern once."""
    def parsed(qty, unit, name) -> Column:
        return F.struct(qty.alias("qty"), unit.alias("unit"), strip(name).alias("name"))

    def read(text: Column, pattern: str, groups, then, otherwise) -> Column:
        """``then(groups)`` where the pattern occurs: its first listed group is never empty in a match."""
        found = F.array(*[F.regexp_extract(text, pattern, g) for g in groups])
        return once(found, lambda g: F.when(g[0] != "", then(g)).otherwise(otherwise))

    def form(text: Column) -> Column:
        plain = parsed(F.lit(1.0), F.lit("pcs"), text)
        inline = read(text, INLINE, [1, 2], lambda g: parsed(_number(g[0]), _unit_or_pieces(g[1]), text), plain)
        paren = read(
            text, IN_PARENTHESES, [2, 3, 1], lambda g: parsed(_number(g[0]), _unit_or_pieces(g[1]), g[2]), inline
        )
        return read(text, LEADING, [1, 2, 3], lambda g: parsed(_number(g[0]), _unit_or_pieces(g[1]), g[2]), paren)

    return F.when(c.isNotNull(), once(strip(c), form))


def convert_unit(qty: Column, src: Column, dst: Column) -> Column:
    """Quantity in another unit of the same kind; null where the kinds differ."""
    def converted(a: Column, b: Column) -> Column:
        return (
            F.when(~is_filled(a) | ~is_filled(b), F.lit(None))
            .when(a == b, qty)
            .otherwise(F.coalesce(
                qty * lookup(GRAMS, a) / lookup(GRAMS, b), qty * lookup(MILLILITRES, a) / lookup(MILLILITRES, b)
            ))
        )

    units = F.struct(normalize_unit(src).alias("a"), normalize_unit(dst).alias("b"))
    return once(units, lambda u: converted(u["a"], u["b"]))


def canonical_qty(qty: Column, unit: Column) -> Column:
    """kg and L become g and ml; the unit is matched with its case."""
    return F.when(unit.isin("kg", "L"), qty * 1000.0).otherwise(qty)


def canonical_unit(unit: Column) -> Column:
    return F.when(unit == "kg", "g").when(unit == "L", "ml").otherwise(unit)


def to_canonical(qty: Column, unit: Column) -> Column:
    return F.struct(canonical_qty(qty, unit).alias("qty"), canonical_unit(unit).alias("unit"))


def parse_qty_text(c: Column) -> Column:
    """Receipt quantity "2.5 kg" -> struct(qty, unit); 1 pcs without a leading number."""
    text = F.coalesce(c, F.lit("1 pcs"))
    number = F.regexp_extract(text, RECEIPT_QUANTITY, 1)
    unit = strip(F.regexp_extract(text, RECEIPT_QUANTITY, 2))
    return F.struct(
        F.when(number == "", F.lit(1.0)).otherwise(number.try_cast("double")).alias("qty"),
        F.when(is_filled(unit), unit).otherwise("pcs").alias("unit"),
    )


def price_per_unit(price: Column, qty: Column, zero: str = "one") -> Column:
    """Price by quantity; a zero quantity counts as 1 (``one``) or gives null (``null``)."""
    if zero == "one":
        return price / F.when(qty == 0, 1.0).otherwise(qty)
    if zero == "null":
        return F.try_divide(price, F.nullif(qty, F.lit(0.0)))
    raise ValueError(f"zero must be 'one' or 'null', not {zero!r}")
