import pytest
from pyspark.sql import functions as F

from larder.functions import units
from larder.functions.categories import detect_category


def one(spark, df_rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(df_rows, schema).select(*cols).collect()]


def test_spellings(spark):
    cases = {
        "lbs": "lb", "pounds": "lb", "kilograms": "kg", "ounces": "oz", "cups": "cup", "tablespoon": "tbsp",
        "teaspoons": "tsp", "liters": "l", "piece": "pcs", "pieces": "pcs", "unit": "pcs", "unknown_unit": "unknown_unit",
        "  LBS\t": "lb", "Fluid Ounce": "fl oz", "": None, "  ": "",
    }
    got = one(spark, [(k,) for k in cases], "u string", "u", units.normalize_unit(F.col("u")))
    assert dict(got) == cases
    assert one(spark, [(None,)], "u string", units.normalize_unit(F.col("u"))) == [(None,)]


INGREDIENTS = {
    "2 lbs chicken breast": (2.0, "lb", "chicken breast"),
    "1.5 kg rice": (1.5, "kg", "rice"),
    "1/2 cup sugar": (0.5, "cup", "sugar"),
    "Chicken Breast (4 oz, sliced)": (4.0, "oz", "Chicken Breast"),
    "Chicken Breast 4 oz cut": (4.0, "oz", "Chicken Breast 4 oz cut"),
    "Salt": (1.0, "pcs", "Salt"),
    "2 eggs": (2.0, "pcs", "eggs"),
    "1 large onion": (1.0, "large", "onion"),
    "1/0 cup milk": (1.0, "cup", "milk"),
    "1..2 cup milk": (1.0, "cup", "milk"),
    "1/2/3 cup milk": (1.0, "cup", "milk"),
    ". cup milk": (1.0, "cup", "milk"),
    "2eggs": (2.0, "eggs", "2eggs"),
    "10 lb": (10.0, "pcs", "lb"),
    "  3 cups   flour ": (3.0, "cup", "flour"),
    "": (1.0, "pcs", ""),
}


def test_ingredient_texts(spark):
    parsed = units.parse_ingredient(F.col("t"))
    got = one(spark, [(k,) for k in INGREDIENTS], "t string", "t", parsed["qty"], parsed["unit"], parsed["name"])
    assert {r[0]: r[1:] for r in got} == INGREDIENTS
    assert one(spark, [(None,)], "t string", parsed) == [(None,)]


@pytest.mark.parametrize("qty,src,dst,want", [
    (1.0, "lb", "oz", 16.0), (1.0, "kg", "g", 1000.0), (1.0, "lb", "kg", 0.4536), (1.0, "cup", "ml", 236.588),
    (1.0, "l", "ml", 1000.0), (5.0, "kg", "kg", 5.0), (1.0, "kg", "cup", None), (1.0, "pcs", "lb", None),
    (2.0, "Pounds", "LB", 2.0), (2.0, "", "lb", None), (2.0, "bag", "bag", 2.0),
])
def test_conversion(spark, qty, src, dst, want):
    got = one(spark, [(qty, src, dst)], "q double, a string, b string", units.convert_unit(F.col("q"), F.col("a"), F.col("b")))
    assert got[0][0] == (want if want is None else pytest.approx(want, rel=0.01))


def test_canonical(spark):
    cases = [(1.0, "kg"), (2.0, "L"), (5.0, "pcs"), (2.0, "oz"), (1.0, "KG"), (3.0, None)]
    c = units.to_canonical(F.col("q"), F.col("u"))
    assert one(spark, cases, "q double, u string", c["qty"], c["unit"]) == [
        (1000.0, "g"), (2000.0, "ml"), (5.0, "pcs"), (2.0, "oz"), (1.0, "KG"), (3.0, None)]


def test_receipt_quantities(spark):
    q = units.parse_qty_text(F.col("t"))
    got = one(spark, [("2.5 kg",), ("3",), ("a few",), (None,), ("4pcs",)], "t string", q["qty"], q["unit"])
    assert got == [(2.5, "kg"), (3.0, "pcs"), (1.0, "pcs"), (1.0, "pcs"), (4.0, "pcs")]


def test_unit_price(spark):
    for zero, want in (("one", [10.0, 2.5, None]), ("null", [None, 2.5, None])):
        c = units.price_per_unit(F.col("p"), F.col("q"), zero)
        got = one(spark, [(10.0, 0.0), (10.0, 4.0), (10.0, None)], "p double, q double", c)
        assert [r[0] for r in got] == want
    with pytest.raises(ValueError):
        units.price_per_unit(F.col("p"), F.col("q"), "half")


def test_categories(spark):
    cases = {
        "Ice Cream Soda": "dairy", "frozen ice cream": "frozen", "orange juice": "beverages", "rice": "pantry",
        "tomatoes": "pantry", "tomato": "produce", "Chicken Breast": "meat", "hammer": "pantry", "Sour Cream": "dairy",
        "éham": "pantry",
    }
    got = one(spark, [(k,) for k in cases], "t string", "t", detect_category(F.col("t")))
    assert dict(got) == cases
