"""Request texts and prompts from columns."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.functions.text import hash_bucket, is_filled, oxford_list, strip

# Request texts by scenario, preference, cuisine and requested ingredients.
PLAIN_REQUESTS = [
    "What can I cook for dinner?",
    "Suggest me a recipe.",
    "I'm hungry, make something.",
    "What should I make with these ingredients?",
    "Give me a recipe idea.",
    "Help me cook something.",
    "I want to make dinner.",
    "What can I prepare?",
    "Recommend a dish.",
    "Create a recipe for me.",
]
NON_DAIRY = [
    "I can't have dairy, what can I make?",
    "Dairy-free recipe please.",
    "I'm lactose intolerant.",
    "No dairy products.",
    "Give me a non-dairy recipe.",
]
GLUTEN_FREE = [
    "I'm gluten-free, what can I make?",
    "Gluten-free recipe please.",
    "I can't have gluten.",
    "No wheat or gluten.",
    "Give me a gluten-free dish.",
]
PREFERENCE_REQUESTS = {
    "vegan": [
        "I want a vegan recipe.",
        "Make me something vegan.",
        "I'm vegan, what can I cook?",
        "Vegan recipe please.",
        "I need a plant-based dish.",
    ],
    "vegetarian": [
        "I want a vegetarian recipe.",
        "I'm vegetarian, what can I make?",
        "Vegetarian dish please.",
        "Make me something vegetarian.",
        "I don't eat meat.",
    ],
    "non-dairy": NON_DAIRY,
    "non_dairy": NON_DAIRY,
    "pescatarian": [
        "I'm pescatarian, what can I cook?",
        "Pescatarian recipe please.",
        "I eat fish but no meat.",
        "Seafood or vegetarian dish.",
        "Make me a pescatarian meal.",
    ],
    "gluten-free": GLUTEN_FREE,
    "gluten_free": GLUTEN_FREE,
    "keto": [
        "I'm on keto, what can I cook?",
        "Keto recipe please.",
        "Low-carb dish.",
        "Make me a keto meal.",
        "I need a ketogenic recipe.",
    ],
    "paleo": [
        "I'm doing paleo, what can I make?",
        "Paleo recipe please.",
        "I follow paleo diet.",
        "Make me a paleo dish.",
        "Give me a paleo-friendly meal.",
    ],
}
CUISINE_REQUESTS = [
    "Make me {} food.",
    "I want to cook {} cuisine.",
    "Give me a {} recipe.",
    "I'm craving {} food.",
    "Can you suggest a {} dish?",
    "I want something {}.",
    "{} recipe please.",
]
INGREDIENT_REQUESTS = [
    "I'd like to use {}.",
    "I want to cook with {}.",
    "Make something with {}.",
    "Can you use {}?",
    "I want to use {}.",
]
RESTRICTION_REQUESTS = ["I want a {} recipe.", "I'm {}, what can I cook?", "{} recipe please."]

# Prompt texts.
CHAT_SYSTEM = "You are a recipe generation AI that creates recipes based on user inventory and preferences."
PLAIN_SYSTEM = (
    "You are a helpful recipe generation AI. Generate recipes in valid JSON format based on the user's "
    "available ingredients and preferences."
)
NO_MEAT = (
    "ABSOLUTELY NO meat, poultry, fish, or seafood (no chicken, beef, pork, lamb, turkey, salmon, shrimp, etc.)"
)
NO_ANIMAL = "ABSOLUTELY NO animal products (no eggs, dairy, milk, cheese, butter, cream, honey)"
NO_GLUTEN = "ABSOLUTELY NO gluten (no wheat, barley, rye, regular pasta, bread, flour)"
RESTRICTION_HEAD = "\n\n⚠️ MANDATORY RESTRICTIONS (MUST FOLLOW - NO EXCEPTIONS):\n"
RESTRICTION_TAIL = (
    "\n\nDo NOT suggest any recipe that violates these restrictions. This is non-negotiable.\n\n"
)
DETAIL_TEXT = (
    "Please provide detailed, step-by-step cooking instructions. "
    "Use the provided inventory as the primary ingredient source. "
    "Keep missing/shopping list ingredients to 3 or fewer; prefer substitutions from inventory over adding new items. "
    "Use only ingredients you list in the recipe; do not include ingredients that are unused or marked as 'ignore'. "
    "Keep the ingredient list tightly aligned to the actual steps."
)


def _pick(templates, key: Column, salt: str, value: Column | None = None) -> Column:
    """One template by the hash of the key, with ``{}`` replaced by a value."""
    at = hash_bucket(key, len(templates), salt)
    chosen = F.get(F.array(*[F.lit(t) for t in templates]), at)
    return chosen if value is None else F.replace(chosen, F.lit("{}"), value)


def _preference_request(preference: Column, key: Column) -> Column:
    """Null for a preference without templates."""
    entries = F.create_map(*chain.from_iterable(
        (F.lit(name), F.array(*[F.lit(t) for t in texts])) for name, texts in PREFERENCE_REQUESTS.items()
    ))
    texts = F.try_element_at(entries, preference)
    # All lists have the same length.
    return F.get(texts, hash_bucket(key, len(NON_DAIRY), "preference"))


def user_request_text(
    inventory: Column, requested: Column, preference: Column, cuisine: Column, scenario: Column, key: Column
) -> Column:
    """Request in natural language; the template is picked by the key."""
    some_cuisine = F.when(is_filled(cuisine), cuisine)
    by_preference = _preference_request(preference, key)
    by_cuisine = F.when(some_cuisine.isNotNull(), _pick(CUISINE_REQUESTS, key, "cuisine", some_cuisine))
    style = F.concat(some_cuisine, F.lit(" style."))
    by_items = F.when(F.size(requested) > 0, _pick(INGREDIENT_REQUESTS, key, "requested", oxford_list(requested)))
    have = F.concat(F.lit("I have "), oxford_list(inventory), F.lit("."))
    # concat_ws leaves out the parts that are null.
    return (
        F.when(scenario == "scenario_1", F.concat_ws(" ", have, _pick(PLAIN_REQUESTS, key, "plain")))
        .when(scenario == "scenario_2", F.concat_ws(" ", have, by_preference))
        .when(scenario == "scenario_3", F.concat_ws(" ", have, by_cuisine))
        .when(scenario == "scenario_4", F.concat_ws(" ", have, by_preference, style))
        .when(scenario.isin("scenario_5", "scenario_6"), F.concat_ws(" ", have, by_items, by_preference, style))
        .otherwise(have)
    )


def chat_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), text, F.lit("<|im_end|>"))


def chat_prompt(system: Column, user: Column) -> Column:
    """ChatML prompt that waits for the assistant."""
    return F.concat(
        chat_turn(F.lit("system"), system), F.lit("\n"), chat_turn(F.lit("user"), user),
        F.lit("\n<|im_start|>assistant\n"),
    )


def chat_text(system: Column, user: Column, assistant: Column) -> Column:
    """Whole ChatML conversation of one exchange."""
    return F.concat_ws(
        "\n", chat_turn(F.lit("system"), system), chat_turn(F.lit("user"), user),
        chat_turn(F.lit("assistant"), assistant),
    )


def eval_prompt(system: Column, inventory: Column, preference: Column, cuisine: Column, request: Column) -> Column:
    """Evaluation prompt; optional fields vanish with their sentence."""
    def sentence(label: str, value: Column) -> Column:
        return F.when(is_filled(value), F.concat(F.lit(f"{label}: "), value, F.lit(".")))

    user = F.concat_ws(
        " ",
        sentence("Inventory", F.array_join(inventory, ", ")),
        sentence("Dietary preference", preference),
        sentence("Cuisine", cuisine),
        F.concat(
            F.lit("Request: "),
            F.when(is_filled(request), request).otherwise("Create a single recipe using my inventory."),
        ),
    )
    return F.concat(
        F.lit("<|im_start|>system\n"), system, F.lit("\n<|im_end|>\n<|im_start|>user\n"), user,
        F.lit("\n<|im_end|>\n<|im_start|>assistant\n"),
    )


def _listed(items: Column, limit: int | None = None) -> Column:
    """"a, b"; null for an empty list."""
    shown = items if limit is None else F.slice(items, 1, limit)
    return F.when(F.size(items) > 0, F.array_join(shown, ", "))


def persona_request(inventory: Column, cuisines: Column, restrictions: Column, key: Column) -> Column:
    """Request of a persona: what is there, one of its cuisines, one of its restrictions."""
    def one(items: Column, salt: str) -> Column:
        n = F.greatest(F.size(items), F.lit(1))
        return F.when(F.size(items) > 0, F.get(items, hash_bucket(key, n, salt)))

    cuisine, restriction = one(cuisines, "cuisine"), one(restrictions, "restriction")
    phrase = _pick(RESTRICTION_REQUESTS, key, "phrase", restriction)
    # Only the phrase that opens with the restriction starts with a lower-case letter of its own.
    opened = F.concat(F.upper(F.substring(phrase, 1, 1)), F.substring(phrase, F.lit(2), F.length(phrase)))
    return F.concat_ws(
        " ",
        F.concat(F.lit("I have "), F.array_join(inventory, ", "), F.lit(".")),
        F.concat(F.lit("I want a "), cuisine, F.lit(" recipe.")),
        opened,
    )


def persona_prompt(
    request: Column, cuisines: Column, flavors: Column, liked: Column, restrictions: Column, forbidden: Column,
    strong: bool = True,
) -> Column:
    """ChatML prompt of a persona; ``strong`` spells its tastes and limits out."""
    system = F.lit(CHAT_SYSTEM)
    if strong:
        system = F.concat_ws(
            " ",
            system,
            F.concat(F.lit("You specialize in "), _listed(cuisines), F.lit(" cuisine.")),
            F.concat(F.lit("You prefer "), _listed(flavors), F.lit(" flavors.")),
            F.concat(F.lit("Try to incorporate ingredients like: "), _listed(liked, 5), F.lit(".")),
            F.concat(F.lit("The user is "), _listed(restrictions), F.lit(".")),
            F.concat(F.lit("Do NOT use these ingredients: "), _listed(forbidden, 5), F.lit(".")),
        )
    return chat_prompt(system, request)


def restriction_text(dietary: Column, allergies: Column) -> Column:
    """Bulleted restrictions of a profile; empty without any."""
    has_diet, has_allergy = F.size(dietary) > 0, F.size(allergies) > 0
    lower = F.transform(dietary, F.lower)
    meatless = F.exists(lower, lambda d: d.isin("vegetarian", "vegan"))
    vegan = F.exists(lower, lambda d: d == "vegan")
    gluten = F.exists(lower, lambda d: F.contains(d, F.lit("gluten")))
    lines = F.array_compact(F.array(
        F.when(has_diet, F.concat(F.lit("CRITICAL DIETARY RESTRICTIONS: "), F.array_join(dietary, ", "))),
        F.when(meatless, F.lit(NO_MEAT)),
        F.when(vegan, F.lit(NO_ANIMAL)),
        F.when(gluten, F.lit(NO_GLUTEN)),
        F.when(has_allergy, F.concat(F.lit("SEVERE ALLERGIES - LIFE THREATENING: "), F.array_join(allergies, ", "))),
        F.when(has_allergy, F.concat(F.lit("NEVER use these allergens: "), F.array_join(allergies, ", "))),
    ))
    bullets = F.array_join(F.transform(lines, lambda s: F.concat(F.lit("• "), s)), "\n")
    return F.when(
        F.size(lines) > 0, F.concat(F.lit(RESTRICTION_HEAD), bullets, F.lit(RESTRICTION_TAIL))
    ).otherwise("")


def custom_preferences(dietary: Column, allergies: Column, cuisines: Column) -> Column:
    """Restrictions and liked cuisines as one text."""
    liked = F.concat(F.lit(" Preferred cuisines: "), _listed(cuisines), F.lit("."))
    return F.concat(restriction_text(dietary, allergies), F.coalesce(liked, F.lit("")))


def detailed_request(request: Column, dietary: Column, allergies: Column) -> Column:
    return F.concat(request, restriction_text(dietary, allergies), F.lit(DETAIL_TEXT))


def serving_prompt(names: Column, dietary: Column, request: Column) -> Column:
    """Serving prompt from item names and the first dietary restriction."""
    have = F.concat(F.lit("I have "), F.array_join(names, ", "), F.lit("."))
    diet = F.when(F.size(dietary) > 0, F.concat(F.lit("I want a "), F.lower(F.get(dietary, F.lit(0))), F.lit(" recipe.")))
    user = F.concat(
        F.when(is_filled(request), F.concat(request, F.lit("\n\n"))).otherwise(""),
        F.concat_ws(" ", have, diet),
    )
    return chat_prompt(F.lit(CHAT_SYSTEM), user)


def persona_system(cuisines: Column, flavors: Column, style: Column, liked: Column) -> Column:
    """System message of a persona for the header-style prompt."""
    return F.concat(
        F.lit("You are a recipe generation AI specializing in "), F.array_join(cuisines, ", "),
        F.lit(" cuisine.\nYou prefer "), F.array_join(flavors, ", "), F.lit(" flavors and "),
        F.coalesce(style, F.lit("any")), F.lit(" cooking style.\nTry to incorporate ingredients like: "),
        F.array_join(liked, ", "),
        F.lit(".\nGenerate recipes in valid JSON format matching the exact structure you were trained on."),
    )


def header_prompt(system: Column, inventory: Column, request: Column) -> Column:
    """Prompt with header tokens instead of ChatML."""
    def part(role: str, text: Column) -> Column:
        return F.concat(F.lit(f"<|start_header_id|>{role}<|end_header_id|>\n\n"), text)

    user = F.concat(
        F.lit("Generate a recipe using these available ingredients: "), F.array_join(inventory, ", "),
        F.lit("\n\nUser request: "), request, F.lit("\n\nGenerate a complete recipe in JSON format."),
    )
    return F.concat(
        F.lit("<|begin_of_text|>"), part("system", F.coalesce(system, F.lit(PLAIN_SYSTEM))), F.lit("<|eot_id|>"),
        part("user", user), F.lit("<|eot_id|>"), part("assistant", F.lit("")),
    )


def scoring_text(recipe: Column, inventory: Column | None = None, diet: Column | None = None) -> Column:
    """Text of a recipe, with its request where given, for scoring.

    ``recipe`` is struct(name, cuisine, ingredients, steps) or null;
    ``inventory`` is array<struct(item, qty)>.
    """
    def text(c: Column) -> Column:
        return F.coalesce(c, F.lit(""))

    about = F.concat(
        F.lit("Recipe: Name: "), text(recipe["name"]), F.lit(" Cuisine: "), text(recipe["cuisine"]),
        F.lit(" Ingredients: "), text(F.array_join(recipe["ingredients"], ", ")),
        F.lit(" Steps: "), text(recipe["steps"]), F.lit("."),
    )
    parts = [F.when(recipe.isNotNull(), about)]
    if inventory is not None:
        stock = F.array_join(
            F.transform(inventory, lambda i: F.concat(i["item"], F.lit(": "), i["qty"].cast("string"))), ", "
        )
        wanted = F.coalesce(diet if diet is not None else F.lit(None), F.lit("any"))
        parts.insert(0, F.concat(F.lit("Request: Inventory: "), text(stock), F.lit(" Dietary: "), wanted, F.lit(". ")))
    return strip(F.concat_ws("", *parts))
