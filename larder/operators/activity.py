"""User, recipe and feedback activity.

``as_of`` is always an argument. "Last 7 days" is ``as_of`` minus 168 hours for
counters and seven calendar days for charts.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.clock import at
from larder.functions.rates import pct, whole_pct
from larder.functions.text import default_if_empty
from larder.operators.ordering import first_n_per, running_number, with_share_of_max


def since(col: str, as_of: datetime, days: int) -> Column:
    return F.col(col) >= at(as_of - timedelta(days=days))


def user_metrics(users: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    return users.agg(
        F.count(F.lit(1)).alias("total_users"), F.count_if(since("created_at", as_of, days)).alias("new_users")
    )


def active_users(history: DataFrame, as_of: datetime, days: int = 7, approx: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approx else F.count_distinct
    return history.filter(since("created_at", as_of, days)).agg(count("user_id").alias("active_users"))


def recipe_metrics(history: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    """All recipe counters and rates from one scan."""
    counts = history.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(since("created_at", as_of, days)).alias("last_days"),
        F.count_if(F.col("feedback_score") > 0).alias("with_feedback"),
        F.count_if(F.col("feedback_score") == 2).alias("liked"),
        F.count_if(F.col("feedback_score") == 1).alias("disliked"),
        F.count_if(F.col("is_cooked")).alias("cooked"),
    )
    return counts.withColumns({
        "feedback_rate": pct(F.col("with_feedback"), F.col("total")),
        "cook_rate": pct(F.col("cooked"), F.col("total")),
        "like_rate": pct(F.col("liked"), F.col("with_feedback")),
    })


def daily_counts(df: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    """Rows per calendar day, zero-filled, for the last ``days`` days, oldest first."""
    last = as_of.date()
    first = last - timedelta(days=days - 1)
    counts = (
        df.filter((F.col("created_at") >= F.lit(first)) & (F.col("created_at") < F.lit(last + timedelta(days=1))))
        .groupBy(F.to_date("created_at").alias("day"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    spark = df.sparkSession
    calendar = spark.range(days).select(F.date_add(F.lit(first), F.col("id").cast("int")).alias("day"))
    return (
        calendar.join(counts, "day", "left")
        .select("day", F.date_format("day", "MMM dd").alias("label"), F.coalesce("n", F.lit(0)).alias("n"))
        .orderBy("day")
    )


def daily_signups(users: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    return daily_counts(users, as_of, days)


def category_counts(inventory: DataFrame) -> DataFrame:
    return inventory.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def top_categories(counts: DataFrame, n: int = 5) -> DataFrame:
    """The largest categories; a missing name is shown as Uncategorized after the cut."""
    return counts.orderBy(F.desc("n"), F.asc_nulls_first("category")).limit(n).withColumn(
        "category", default_if_empty(F.col("category"), "Uncategorized")
    )


def comparison_metrics(prefs: DataFrame) -> DataFrame:
    return prefs.agg(
        F.count(F.lit(1)).alias("total"),
        F.count(F.col("chosen_variant")).alias("completed"),
        F.count_if(F.col("skipped")).alias("skipped"),
    ).withColumn("completion_rate", pct(F.col("completed"), F.col("total")))


def recipe_counts(history: DataFrame) -> DataFrame:
    """Recipes per user: aggregated before any join, so the join sees one row per user."""
    return history.groupBy("user_id").agg(F.count(F.lit(1)).alias("recipe_count"))


def user_recipe_counts(users: DataFrame, history: DataFrame) -> DataFrame:
    names = users.select(F.col("id").alias("user_id"), "username")
    return names.join(recipe_counts(history), "user_id")


def top_users(counts: DataFrame, n: int = 5) -> DataFrame:
    return counts.orderBy(F.desc("recipe_count"), "user_id").limit(n)


def attach_users(counts: DataFrame, users: DataFrame) -> DataFrame:
    """User names for counted ids; ids without a user are left out."""
    return counts.join(users.select(F.col("id").alias("user_id"), "username"), "user_id")


def rated(history: DataFrame) -> DataFrame:
    return history.filter(F.col("feedback_score").isin(1, 2))


def approval_rate(history: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    """Likes, dislikes and their rate in the look-back; the rate is null without feedback."""
    counts = rated(history).filter(since("created_at", as_of, days)).agg(
        F.count_if(F.col("feedback_score") == 2).alias("likes"),
        F.count_if(F.col("feedback_score") == 1).alias("dislikes"),
    )
    return counts.withColumn(
        "approval_rate", F.try_divide(F.col("likes").cast("double"), F.col("likes") + F.col("dislikes"))
    )


def monitor_status(rates: DataFrame, min_n: int = 10, floor: float = 0.80) -> DataFrame:
    """SKIPPED below the smallest sample, ALERT below the floor, else OK."""
    n = F.col("likes") + F.col("dislikes")
    return rates.withColumn(
        "status", F.when(n < min_n, "SKIPPED").when(F.col("approval_rate") < floor, "ALERT").otherwise("OK")
    )


def newest_first() -> list:
    return [F.desc("created_at"), F.desc("id")]


def global_streak(history: DataFrame, n: int = 5) -> DataFrame:
    """Whether the last ``n`` ratings are all dislikes."""
    last = rated(history).orderBy(*newest_first()).limit(n)
    return last.agg(
        F.count(F.lit(1)).alias("n_ratings"), F.bool_and(F.col("feedback_score") == 1).alias("_all")
    ).select("n_ratings", ((F.col("n_ratings") == n) & F.coalesce("_all", F.lit(False))).alias("streak"))


def user_streaks(history: DataFrame, n: int = 5) -> DataFrame:
    """Users whose last ``n`` ratings are all dislikes."""
    last = first_n_per(rated(history).select("user_id", "id", "created_at", "feedback_score"),
                       ["user_id"], newest_first(), n)
    return (
        last.groupBy("user_id")
        .agg(F.count(F.lit(1)).alias("n_ratings"), F.bool_and(F.col("feedback_score") == 1).alias("_all"),
             F.max("created_at").alias("last_rating_at"))
        .filter((F.col("n_ratings") == n) & F.col("_all"))
        .select("user_id", "n_ratings", "last_rating_at")
    )


def with_generation_number(generations: DataFrame) -> DataFrame:
    """Running number of a generation per user, by time and id."""
    return running_number(
        generations, ["user_id"], ["created_at", "id"], F.date_trunc("minute", "created_at"), "generation_number"
    )


def comparison_events(generations: DataFrame, every: int = 7) -> DataFrame:
    """Every ``every``-th generation per user, and those that ask for a comparison."""
    numbered = with_generation_number(generations)
    asked = F.coalesce(F.col("compare"), F.lit(False)) if "compare" in generations.columns else F.lit(False)
    return numbered.filter((F.col("generation_number") % every == 0) | asked)


def history_newest_first(history: DataFrame, user_id=None) -> DataFrame:
    rows = history if user_id is None else history.filter(F.col("user_id") == user_id)
    return rows.orderBy(*newest_first())


def history_tab(history: DataFrame, tab: str) -> DataFrame:
    """One tab: liked, disliked, neutral (null counts as neutral), else all."""
    score = F.col("feedback_score")
    tests = {"liked": score == 2, "disliked": score == 1, "neutral": F.coalesce(score, F.lit(0)) == 0}
    return history.filter(tests[tab]) if tab in tests else history


def tab_counts(history: DataFrame) -> DataFrame:
    score = F.col("feedback_score")
    return history.agg(
        F.count(F.lit(1)).alias("all"), F.count_if(score == 2).alias("liked"),
        F.count_if(score == 1).alias("disliked"), F.count_if(F.coalesce(score, F.lit(0)) == 0).alias("neutral"),
    )


def active_share(users: DataFrame, history: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    """Active users as a whole percentage of all users."""
    active = active_users(history, as_of, days).scalar()
    return users.agg(F.count(F.lit(1)).alias("total_users")).withColumn("active_users", active).withColumn(
        "active_pct", whole_pct(F.col("active_users"), F.col("total_users"))
    )


def daily_bars(df: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    """Daily counts with their height relative to the largest day."""
    return with_share_of_max(daily_counts(df, as_of, days), "n")
