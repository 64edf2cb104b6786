"""Recipe rows to chat rows, diet cleaning and their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions.diet import asks_for, diet_violations, first_meat_word, selected_items
from larder.functions.prompts import CHAT_SYSTEM, chat_text, chat_turn, user_request_text


def to_chat_rows(recipes: DataFrame, key: str) -> DataFrame:
    """(text, scenario, user_message) per recipe row; ``output`` is the answer as source text."""
    scenario = F.coalesce(F.col("scenario"), F.lit("unknown"))
    request = user_request_text(
        F.col("user_inventory"), F.col("requested_ingredients"), F.col("preference"), F.col("cuisine"), scenario,
        F.col(key),
    )
    return recipes.withColumn("user_message", request).select(
        key, chat_text(F.lit(CHAT_SYSTEM), F.col("user_message"), F.col("output")).alias("text"),
        scenario.alias("scenario"), "user_message",
    )


def render_turns(turns: DataFrame) -> DataFrame:
    """Every turn of a conversation as a ChatML block, with its place in the conversation.

    Blocks stay rows: a writer that sorts by (conv_id, turn) has the whole text
    without any conversation being gathered in memory.
    """
    return turns.select("conv_id", "turn", chat_turn(F.col("role"), F.col("text")).alias("block"))


def exchanges(turns: DataFrame) -> DataFrame:
    """Chat text of every user turn that the assistant answers in the next turn: an equi join on (conv_id, turn)."""
    asked = turns.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("user_text"))
    answered = turns.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("assistant_text")
    )
    return asked.join(answered, ["conv_id", "turn"]).select(
        "conv_id", "turn", chat_text(F.lit(CHAT_SYSTEM), F.col("user_text"), F.col("assistant_text")).alias("text"),
    )


def scenario_counts(df: DataFrame) -> DataFrame:
    """Rows per (dataset, scenario) and per scenario over all datasets (dataset "ALL")."""
    scenario = F.coalesce(F.col("scenario"), F.lit("unknown"))
    per = df.groupBy("dataset", scenario.alias("scenario")).agg(F.count(F.lit(1)).alias("n"))
    merged = per.groupBy("scenario").agg(F.sum("n").alias("n")).withColumn("dataset", F.lit("ALL"))
    return per.unionByName(merged)


def _cleaned(samples: DataFrame) -> DataFrame:
    veg = asks_for(F.col("dietary_tags"), ["vegetarian", "vegan"])
    return samples.withColumn("_veg", veg).withColumn(
        "_meat", F.when(F.col("_veg"), first_meat_word(selected_items(F.col("text"), "cleaner")))
    )


def drop_diet_violators(samples: DataFrame) -> DataFrame:
    """Samples without those that are tagged meatless and select meat."""
    return _cleaned(samples).filter(F.col("_meat").isNull()).drop("_veg", "_meat")


def cleaning_stats(samples: DataFrame) -> DataFrame:
    """Totals, removed and kept, with percentages of the meatless samples (null without any)."""
    total, veg, removed = F.count(F.lit(1)), F.count_if("_veg"), F.count_if(F.col("_meat").isNotNull())

    def share(a, b):
        return F.bround(F.try_divide(a.cast("double"), b) * 100, 1)

    return _cleaned(samples).agg(
        total.alias("total"), veg.alias("vegetarian_total"), removed.alias("removed"), (veg - removed).alias("kept"),
        (total - removed).alias("final_size"), share(removed, veg).alias("removed_pct"),
        share(veg - removed, veg).alias("kept_pct"), share(removed, total).alias("reduction_pct"),
    )


def validate_samples(samples: DataFrame, rules: str = "code", match: str = "substring") -> DataFrame:
    """Violation messages per sample; a sample without readable ingredients is valid and not ``extracted``."""
    items = selected_items(F.col("text"), "validator")
    return (
        samples.withColumn("selected", items)
        .withColumn("extracted", F.size("selected") > 0)
        .withColumn("violations", diet_violations(F.col("dietary_tags"), F.col("selected"), rules, match))
        .withColumn("is_valid", F.size("violations") == 0)
    )


def validation_stats(validated: DataFrame) -> DataFrame:
    return validated.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("is_valid").alias("valid"),
        F.count_if(~F.col("is_valid")).alias("invalid"), F.count_if("extracted").alias("extracted"),
    )


def violation_stats(validated: DataFrame) -> DataFrame:
    """Messages and samples per constraint."""
    found = validated.select(F.col("violations")).withColumn(
        "constraints", F.transform("violations", lambda v: F.split_part(v, F.lit(":"), F.lit(1)))
    )
    return (
        found.select(F.explode(F.array_distinct("constraints")).alias("constraint"), "constraints")
        .withColumn("_n", F.size(F.filter("constraints", lambda c: c == F.col("constraint"))))
        .groupBy("constraint").agg(F.sum("_n").alias("n_messages"), F.count(F.lit(1)).alias("n_samples"))
    )
