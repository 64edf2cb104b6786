"""Food category by whole words of the item name."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.functions.text import strip

# Category words.
PRODUCE = [
    "apple", "banana", "orange", "lemon", "lime", "grape", "berry", "strawberry", "blueberry",
    "raspberry", "mango", "pineapple", "watermelon", "melon", "peach", "pear", "plum", "cherry",
    "kiwi", "avocado", "tomato", "potato", "onion", "garlic", "ginger", "carrot", "celery",
    "broccoli", "cauliflower", "spinach", "lettuce", "cabbage", "kale", "cucumber", "pepper",
    "zucchini", "squash", "eggplant", "corn", "bean", "pea", "mushroom", "asparagus", "artichoke",
    "beet", "radish", "turnip", "parsley", "cilantro", "basil", "mint", "herb", "salad", "greens",
    "vegetable", "fruit", "produce", "fresh",
]
DAIRY = [
    "milk", "cream", "cheese", "butter", "yogurt", "yoghurt", "cottage", "ricotta", "mozzarella",
    "cheddar", "parmesan", "feta", "brie", "gouda", "swiss", "sour cream", "half and half",
    "creamer", "whipping", "ice cream", "gelato", "egg", "eggs", "dairy",
]
MEAT = [
    "chicken", "beef", "pork", "lamb", "turkey", "duck", "bacon", "sausage", "ham", "steak",
    "ground beef", "ground turkey", "meat", "poultry", "fish", "salmon", "tuna", "shrimp", "prawn",
    "lobster", "crab", "seafood", "tilapia", "cod", "halibut", "trout", "oyster", "mussel", "clam",
    "scallop", "ribs", "roast", "chop", "filet", "tenderloin", "wing", "thigh", "breast", "deli",
    "cold cut", "salami", "pepperoni", "prosciutto",
]
FROZEN = ["frozen", "freezer", "frost", "tv dinner", "popsicle"]
BEVERAGES = [
    "water", "juice", "soda", "cola", "sprite", "coke", "pepsi", "coffee", "tea", "beer", "wine",
    "alcohol", "drink", "beverage", "smoothie", "lemonade", "iced tea", "energy drink", "gatorade",
    "sparkling", "mineral",
]
# The order in which the classes are tried.
CLASS_ORDER = [
    ("frozen", FROZEN), ("beverages", BEVERAGES), ("dairy", DAIRY), ("meat", MEAT), ("produce", PRODUCE),
]


# Word borders between letters of any alphabet, whatever the Java version takes as its default.
UNICODE = "(?U)"


def word_pattern(keywords) -> str:
    """Any of the keywords as a whole word."""
    return r"\b(" + "|".join(re.escape(k).replace(r"\ ", " ") for k in keywords) + r")\b"


def detect_category(c: Column, classes=None) -> Column:
    """First class with a whole word in the name; "ice cream" is dairy before any drink; else pantry."""
    name = strip(F.lower(c))
    result = None
    for label, keywords in classes or CLASS_ORDER:
        hit = F.rlike(name, F.lit(UNICODE + word_pattern(keywords)))
        result = F.when(hit, label) if result is None else result.when(hit, label)
        if label == "frozen":
            result = result.when(F.contains(name, F.lit("ice cream")), "dairy")
    return F.when(c.isNotNull(), result.otherwise("pantry"))
