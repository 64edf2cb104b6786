"""A/B preferences: filters, pairs, routing, thresholds and state changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from larder.functions.clock import at
from larder.functions.text import clean_variant, is_blank, is_filled, strip
from larder.operators.ordering import running_number

PAIR = ["prompt", "chosen", "rejected"]
# The judge's recommendation and the reasons of rejected pairs.
USE_PAIR = "use_pair"
NOT_READ = "evaluation_failed"
NOT_RECOMMENDED = "groq_recommendation_reject"


def untrained_pairs(prefs: DataFrame) -> DataFrame:
    """Decided pairs not yet exported; an unknown export state counts as not exported."""
    return prefs.filter(
        ~F.coalesce(F.col("exported_for_training"), F.lit(False)) & F.col("chosen_variant").isNotNull()
    )


def new_pair_status(prefs: DataFrame, pairs: int = 50) -> DataFrame:
    """How many pairs wait for training, and whether they are enough to start it."""
    return untrained_pairs(prefs).agg(F.count(F.lit(1)).alias("n_pairs")).withColumn(
        "status", F.when(F.col("n_pairs") >= pairs, "READY").otherwise("WAITING")
    )


def usable_prefs(prefs: DataFrame, null_skipped: str = "keep") -> DataFrame:
    """Decided pairs that were not skipped; ``drop`` also leaves out pairs whose skip state is unknown."""
    if null_skipped == "keep":
        unskipped = ~F.coalesce(F.col("skipped"), F.lit(False))
    elif null_skipped == "drop":
        unskipped = ~F.col("skipped")
    else:
        raise ValueError(f"null_skipped must be 'keep' or 'drop', not {null_skipped!r}")
    return prefs.filter(unskipped & F.col("chosen_variant").isNotNull())


def usable_counts(prefs: DataFrame, null_skipped: str = "keep") -> DataFrame:
    return usable_prefs(prefs, null_skipped).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


def users_ready(prefs: DataFrame, min_n: int = 50, null_skipped: str = "keep") -> DataFrame:
    return usable_counts(prefs, null_skipped).filter(F.col("n") >= min_n)


def threshold_events(prefs: DataFrame, n: int = 50, null_skipped: str = "keep") -> DataFrame:
    """The preference with which a user reaches ``n``: the batch form of the notice."""
    numbered = running_number(
        usable_prefs(prefs, null_skipped), ["user_id"], ["created_at", "id"],
        F.date_trunc("minute", "created_at"), "preference_count",
    )
    return numbered.filter(F.col("preference_count") == n)


def pick_by_letter(letter: Column, a: Column, b: Column) -> Column:
    """The first text for "A", the second for anything else."""
    return F.when(letter == "A", a).otherwise(b)


def resolve_pair(prefs: DataFrame) -> DataFrame:
    """Chosen and rejected text of a decided pair."""
    letter, a, b = F.col("chosen_variant"), F.col("variant_a_raw"), F.col("variant_b_raw")
    return prefs.withColumns({"chosen": pick_by_letter(letter, a, b), "rejected": pick_by_letter(letter, b, a)})


def drop_blank_pairs(pairs: DataFrame, observation: Observation | None = None) -> DataFrame:
    """Pairs with text in all three fields, stripped; an observation counts the others."""
    blank = F.lit(False)
    for c in PAIR:
        blank = blank | is_blank(F.col(c))
    marked = pairs.withColumn("_blank", blank)
    if observation is not None:
        marked = marked.observe(observation, F.count_if("_blank").alias("dropped"), F.count(F.lit(1)).alias("seen"))
    return marked.filter(~F.col("_blank")).drop("_blank").withColumns({c: strip(F.col(c)) for c in PAIR})


def blank_pair_counts(pairs: DataFrame) -> DataFrame:
    blank = F.lit(False)
    for c in PAIR:
        blank = blank | is_blank(F.col(c))
    return pairs.agg(F.count_if(~blank).alias("kept"), F.count_if(blank).alias("dropped"))


def prefs_in_order(prefs: DataFrame) -> DataFrame:
    """Oldest first: a range-partitioned sort, not a single task."""
    return prefs.orderBy("created_at", "id")


def route_pairs(judged: DataFrame, degenerate: bool = False) -> DataFrame:
    """``route`` and ``reason`` of a judged pair.

    ``degenerate`` also rejects pairs whose two letters are the same.
    """
    a, b = clean_variant(F.col("variant_a")), clean_variant(F.col("variant_b"))
    out = judged.withColumns({
        "chosen": F.when(F.col("chosen_variant").isNotNull(), pick_by_letter(F.col("chosen_variant"), a, b)),
        "rejected": F.when(F.col("rejected_variant").isNotNull(), pick_by_letter(F.col("rejected_variant"), a, b)),
    })
    reason = F.when(~is_filled(F.col("chosen")) | ~is_filled(F.col("rejected")), NOT_READ)
    if degenerate:
        reason = reason.when(F.col("chosen_variant") == F.col("rejected_variant"), "degenerate")
    reason = reason.when(F.coalesce(F.col("recommendation"), F.lit("")) != USE_PAIR, NOT_RECOMMENDED)
    return out.withColumn("reason", reason).withColumn(
        "route", F.when(F.col("reason").isNull(), "accepted").otherwise("rejected")
    )


def user_pairs(prefs: DataFrame, null_skipped: str = "drop") -> DataFrame:
    """(user_id, id, created_at, prompt, chosen, rejected): what every user's training reads, in the order of creation within a user.

    Pairs that lack a variant or the rejected letter are left out; variants are JSON texts.
    """
    there = is_filled(F.col("variant_a_raw")) & is_filled(F.col("variant_b_raw")) & is_filled(F.col("rejected_variant"))
    return (
        resolve_pair(usable_prefs(prefs, null_skipped).where(there & is_filled(F.col("chosen_variant"))))
        .select("user_id", "id", "created_at", *PAIR).sortWithinPartitions("user_id", "created_at", "id")
    )


def user_pair_status(prefs: DataFrame, users: DataFrame, min_n: int = 50, null_skipped: str = "drop") -> DataFrame:
    """(user_id, username, preference_count, n_pairs, status) of users with usable preferences.

    ``pending`` once the preferences reach ``min_n``, ``collecting`` before; ``n_pairs``
    is what the export holds. Preferences of unknown users are left out.
    """
    counted = usable_counts(prefs, null_skipped).withColumnRenamed("n", "preference_count")
    pairs = user_pairs(prefs, null_skipped).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_pairs"))
    return (
        counted.join(users.select(F.col("id").alias("user_id"), "username"), "user_id").join(pairs, "user_id", "left")
        .select(
            "user_id", "username", "preference_count", F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"),
            F.when(F.col("preference_count") >= min_n, "pending").otherwise("collecting").alias("status"))
    )


def label_pass_rate(routed: DataFrame) -> DataFrame:
    accepted = F.count_if(F.col("route") == "accepted")
    return routed.agg(
        F.count(F.lit(1)).alias("n"), accepted.alias("accepted"),
        F.bround(F.try_divide(accepted.cast("double"), F.count(F.lit(1))) * 100, 1).alias("pass_rate"),
    )


def rejects_by_reason(routed: DataFrame) -> DataFrame:
    return routed.filter(F.col("route") == "rejected").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def pairs_by_persona(pairs: DataFrame) -> DataFrame:
    """Pairs per persona and in total (persona "ALL")."""
    return (
        pairs.rollup("persona").agg(F.count(F.lit(1)).alias("n"), F.grouping("persona").alias("_all"))
        .select(F.when(F.col("_all") == 1, "ALL").otherwise(F.col("persona")).alias("persona"), "n")
    )


def mark_exported(prefs: DataFrame, exported_ids: DataFrame) -> DataFrame:
    """Export flag set for the given ids."""
    done = exported_ids.select("id").distinct().withColumn("_done", F.lit(True))
    return (
        prefs.join(done, "id", "left")
        .withColumn("exported_for_training", F.when(F.col("_done"), F.lit(True)).otherwise(F.col("exported_for_training")))
        .select(*prefs.columns)
    )


def apply_choices(prefs: DataFrame, choices: DataFrame, chosen_at, order: str | None = None) -> tuple:
    """Choices (id, user_id, choice, servings) recorded: (preferences, new history rows).

    Every valid choice gives a history row. A preference that is chosen several
    times keeps its last choice along the ``order`` column, without one the later
    letter. The link to the history row is the preference
    id, which makes a repeated run give the same rows.
    """
    valid = choices.withColumn("_choice", F.upper("choice")).filter(F.col("_choice").isin("A", "B"))
    last = valid.groupBy("id", "user_id").agg(F.max_by("_choice", order or "_choice").alias("_choice"))
    hit = F.col("_choice").isNotNull()

    def changed(new: Column, old: str) -> Column:
        return F.when(hit, new).otherwise(F.col(old)).alias(old)

    replaced = {
        "chosen_variant": changed(F.col("_choice"), "chosen_variant"),
        "rejected_variant": changed(F.when(F.col("_choice") == "A", "B").otherwise("A"), "rejected_variant"),
        "chosen_at": changed(at(chosen_at), "chosen_at"),
        "chosen_recipe_history_id": changed(F.col("id"), "chosen_recipe_history_id"),
    }
    updated = prefs.join(last, ["id", "user_id"], "left").select(*[replaced.get(c, F.col(c)) for c in prefs.columns])
    query = F.coalesce(F.when(is_filled(F.col("prompt")), F.col("prompt")), F.col("user_query"), F.lit(""))
    made = valid.select("id", "user_id", "_choice", F.col("servings").alias("_servings"))
    history = prefs.join(made, ["id", "user_id"]).select(
        F.col("id").alias("preference_id"), "user_id",
        pick_by_letter(F.col("_choice"), F.col("variant_a"), F.col("variant_b")).alias("recipe_json"),
        query.alias("user_query"), F.col("_servings").alias("servings"), at(chosen_at).alias("created_at"),
    )
    return updated, history


def preference_triplets(df: DataFrame) -> DataFrame:
    """(request, chosen, rejected) rows with all three present; empty objects count as absent."""
    def there(c: str) -> Column:
        return is_filled(F.col(c)) & ~strip(F.col(c)).isin("{}", "[]", "null", '""')

    return df.filter(there("user_request") & there("chosen_recipe") & there("rejected_recipe")).select(
        "user_request", "chosen_recipe", "rejected_recipe"
    )
