"""Model outputs scored per example, per slice and per run; judge votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.json_recovery import json_text, recover_json
from larder.functions.text import default_if_empty, is_filled

METRICS = [
    "json_valid_rate", "diet_match_rate", "constraint_violation_rate", "cuisine_match_rate",
    "inventory_coverage_mean",
]


def attach_examples(outputs: DataFrame, examples: DataFrame) -> DataFrame:
    """Model outputs with the test example they answer."""
    return outputs.join(examples, "example_id")


def coverage(inventory: Column, text: Column) -> Column:
    """Share of the items that the text mentions; null without items. Both in lower case.

    Items that are words of the text are found by hash; only what is left is searched for, in a text of any length.
    """
    n = F.size(inventory)
    missing = F.filter(F.array_except(inventory, F.split(text, " ")), lambda i: ~F.coalesce(F.contains(text, i), F.lit(False)))
    # Of an item that is listed several times each counts.
    listed = F.filter(inventory, lambda i: F.exists(missing, lambda m: m.eqNullSafe(i)))
    lacking = F.when(F.size(missing) == 0, 0).when(F.size(F.array_distinct(inventory)) == n, F.size(missing)).otherwise(F.size(listed))
    return F.when(n > 0, (n - lacking) / n)


def example_metrics(df: DataFrame, policy: str = "eval") -> DataFrame:
    """json_valid, diet_match, cuisine_match and inventory_coverage of every raw ``output``.

    A metric is null where the output is no object or the example does not ask for it.
    """
    read = df.withColumn("_r", recover_json(F.col("output"), policy)).withColumn(
        "_v", F.try_parse_json(F.col("_r.json"))
    )
    recipe = "$.recipe"
    usable = F.col("_r.valid") & F.startswith(F.col("_r.json"), F.lit("{"))

    # An absent field reads as an empty text, a null field as the word "none".
    def field(name: str) -> Column:
        node = F.try_variant_get("_v", f"{recipe}.{name}", "variant")
        text = F.coalesce(json_text(F.col("_v"), f"{recipe}.{name}"), F.lit(""))
        return F.lower(F.when(F.is_variant_null(node), "none").otherwise(text))

    def matches(name: str, wanted: Column) -> Column:
        return F.when(usable & is_filled(wanted), field(name) == F.lower(wanted))

    listed = F.transform(
        F.try_variant_get("_v", f"{recipe}.main_ingredients", "array<variant>"),
        lambda x: F.coalesce(F.try_variant_get(x, "$", "string"), F.to_json(x)),
    )
    steps = json_text(F.col("_v"), f"{recipe}.steps")
    text = F.concat(
        F.lower(F.coalesce(F.array_join(listed, " "), F.lit(""))), F.lit(" "),
        F.lower(F.coalesce(steps, F.lit(""))),
    )
    return read.withColumns({
        "json_valid": F.col("_r.valid"),
        "diet_match": matches("culinary_preference", F.col("preference")),
        "cuisine_match": matches("cuisine", F.col("cuisine")),
        "inventory_coverage": F.when(usable, coverage(F.transform("user_inventory", F.lower), text)),
    }).drop("_r", "_v")


def _rate(c: str) -> Column:
    return F.avg(F.col(c).cast("double"))


def aggregate_metrics(examples: DataFrame, keys=()) -> DataFrame:
    """Rates over the examples of a slice; a metric without values is null."""
    return examples.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        _rate("json_valid").alias("json_valid_rate"),
        _rate("diet_match").alias("diet_match_rate"),
        (1.0 - _rate("diet_match")).alias("constraint_violation_rate"),
        _rate("cuisine_match").alias("cuisine_match_rate"),
        F.avg("inventory_coverage").alias("inventory_coverage_mean"),
    )


def slice_metrics(examples: DataFrame, keys=("model", "preference", "cuisine")) -> DataFrame:
    """Metrics per slice; an empty preference or cuisine is the slice "none"."""
    named = examples.withColumns({
        k: default_if_empty(F.col(k), "none") for k in keys if k in ("preference", "cuisine")
    })
    return aggregate_metrics(named, keys)


def summarize_eval(runs: DataFrame, temperature: float = 0.7) -> DataFrame:
    """Mean of every metric per model at one temperature; over all where no run has it."""
    at = F.col("temperature") == temperature
    any_at = runs.agg(F.coalesce(F.bool_or(at), F.lit(False))).scalar()
    return runs.filter(at | ~any_at).groupBy("model").agg(
        *[F.avg(m).alias(m) for m in METRICS if m in runs.columns]
    )


def summarize_slices(slices: DataFrame, weighted: bool = False) -> DataFrame:
    """Means over slices per (model, preference) and per (model, cuisine), from one scan.

    Unweighted by default; ``weighted`` counts every slice with its n.
    """
    views = F.array(
        F.struct(F.lit("preference").alias("slice"), F.col("preference").alias("value")),
        F.struct(F.lit("cuisine").alias("slice"), F.col("cuisine").alias("value")),
    )
    shown = [m for m in METRICS if m in slices.columns and m != "cuisine_match_rate"]

    def mean(m: str) -> Column:
        if not weighted:
            return F.avg(m)
        # Slices without the metric do not weigh.
        return F.try_divide(F.sum(F.col(m) * F.col("n")), F.sum(F.when(F.col(m).isNotNull(), F.col("n"))))

    return (
        slices.withColumn("_view", F.explode(views))
        .groupBy("model", F.col("_view.slice").alias("slice"), F.col("_view.value").alias("value"))
        .agg(*[mean(m).alias(m) for m in shown], F.avg("n").alias("n_mean"))
    )


def model_latency(runs: DataFrame) -> DataFrame:
    """Latency and token counts per model; the median is a sketch (relative error 1/10000)."""
    return runs.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.avg("latency_sec").alias("mean_latency"),
        F.max("latency_sec").alias("max_latency"),
        F.approx_percentile("latency_sec", 0.5, 10000).alias("median_latency"),
        F.avg("token_count").alias("mean_tokens"),
    )


# --- judge votes ---

def parse_judge(c: Column) -> Column:
    """Judge answer -> struct(winner, sft_score, dpo_score, confidence, reasoning, violations)."""
    recovered = recover_json(c, "judge")
    value = F.try_parse_json(recovered["json"])
    scores = {
        side: F.try_variant_get(value, f"$.recipe_{side}_scores", "map<string,double>") for side in ("a", "b")
    }

    def mean(m: Column) -> Column:
        total = F.aggregate(F.map_values(m), F.lit(0.0), lambda s, x: s + x)
        return F.when(F.size(m) > 0, F.bround(total / F.size(m), 2)).otherwise(0.0)

    letter = F.upper(F.coalesce(json_text(value, "$.winner"), F.lit("")))
    violations = F.try_variant_get(value, "$.violations_found", "struct<recipe_a:array<string>,recipe_b:array<string>>")
    nothing = F.array().cast("array<string>")
    read = recovered["valid"]
    return F.struct(
        F.when(read & (letter == "A"), "sft").when(read & (letter == "B"), "dpo").otherwise("unknown").alias("winner"),
        F.when(read, mean(scores["a"])).otherwise(0.0).alias("sft_score"),
        F.when(read, mean(scores["b"])).otherwise(0.0).alias("dpo_score"),
        F.when(read, F.coalesce(json_text(value, "$.confidence"), F.lit("unknown"))).otherwise("none").alias("confidence"),
        F.when(read, F.coalesce(json_text(value, "$.reasoning"), F.lit("")))
        .otherwise("Failed to parse response").alias("reasoning"),
        F.struct(
            F.coalesce(violations["recipe_a"], nothing).alias("recipe_a"),
            F.coalesce(violations["recipe_b"], nothing).alias("recipe_b"),
        ).alias("violations"),
    )


def _votes() -> list:
    winner = F.col("winner")
    return [
        F.count_if(winner == "sft").alias("sft_votes"), F.count_if(winner == "dpo").alias("dpo_votes"),
        F.count_if(winner == "tie").alias("tie_votes"), F.count_if(winner != "unknown").alias("n_votes"),
    ]


def consensus(votes: DataFrame, keys=("persona", "test_case_id")) -> DataFrame:
    """Winner, confidence and agreement rate per test case; "tie" votes count in the divisor."""
    sft, dpo, n = F.col("sft_votes"), F.col("dpo_votes"), F.col("n_votes")
    top = F.greatest(sft, dpo)
    return votes.groupBy(*keys).agg(*_votes()).withColumns({
        "winner": F.when(n == 0, "unknown").when(sft > dpo, "sft").when(dpo > sft, "dpo").otherwise("tie"),
        "confidence": F.when(n == 0, "none").when(sft == dpo, "low").when(top == n, "high").otherwise("medium"),
        "agreement_rate": F.coalesce(F.try_divide(top.cast("double"), n), F.lit(0.0)),
    })


def align_votes(votes: DataFrame, evaluators) -> DataFrame:
    """One row per test case with the winner of every evaluator, by key instead of by position."""
    return votes.groupBy("persona", "test_case_id").pivot("evaluator", list(evaluators)).agg(F.max("winner"))


def agreement(votes: DataFrame, keys=("persona", "test_case_id")) -> DataFrame:
    """Whether the evaluators agree, and the majority; among equals the winner of the first evaluator."""
    kinds = ("sft", "dpo", "tie")
    first = [F.min(F.when(F.col("winner") == w, F.col("evaluator"))).alias(f"_{w}") for w in kinds]
    counts = votes.groupBy(*keys).agg(*_votes(), *first)
    n = F.col("n_votes")
    given = F.lit(0)
    for w in kinds:
        given = given + F.when(F.col(f"{w}_votes") > 0, 1).otherwise(0)
    # Most votes first, then the earliest evaluator.
    top = F.array_min(F.array(*[
        F.struct((-F.col(f"{w}_votes")).alias("neg"), F.col(f"_{w}").alias("by"), F.lit(w).alias("winner"))
        for w in kinds
    ]))
    enough = n >= 2
    return counts.withColumn("_top", top).select(
        *keys, n.alias("total_evaluators"),
        F.when(enough, given == 1).alias("all_agree"),
        F.when(enough, F.col("_top.winner")).alias("majority_winner"),
        F.when(enough, -F.col("_top.neg")).alias("majority_count"),
        F.when(enough, -F.col("_top.neg") / n).alias("agreement_rate"),
        F.when(enough, "ok").otherwise("insufficient_data").alias("agreement"),
    )


def _wins() -> list:
    total = F.count(F.lit(1))
    wins = {w: F.count_if(F.col("winner") == w) for w in ("dpo", "sft", "tie")}
    return [
        total.alias("total_tests"), wins["dpo"].alias("dpo_wins"), wins["sft"].alias("sft_wins"),
        wins["tie"].alias("ties"), (wins["dpo"] / total).alias("dpo_win_rate"),
        (wins["sft"] / total).alias("sft_win_rate"), (wins["tie"] / total).alias("tie_rate"),
        F.avg("agreement_rate").alias("avg_agreement_rate"),
    ]


def win_summary(agreed: DataFrame) -> DataFrame:
    """Wins per persona and over all (persona "ALL"), from one rollup."""
    return (
        agreed.rollup("persona").agg(*_wins(), F.grouping("persona").alias("_all"))
        .withColumn("persona", F.when(F.col("_all") == 1, "ALL").otherwise(F.col("persona")))
        .drop("_all")
    )


def wins_by_category(agreed: DataFrame) -> DataFrame:
    return agreed.groupBy("category").agg(*_wins())


def wins_by_evaluator(votes: DataFrame) -> DataFrame:
    winner = F.col("winner")
    return votes.groupBy("persona", "evaluator").agg(
        F.count_if(winner == "dpo").alias("dpo_wins"), F.count_if(winner == "sft").alias("sft_wins"),
        F.count_if(winner == "tie").alias("ties"),
    )
