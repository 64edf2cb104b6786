"""Data checks, representation checks and profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.clock import parsed_date
from larder.functions.text import is_blank
from larder.operators.quantiles import described, described_columns

QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def expect_not_null(col: str) -> tuple:
    return f"{col} not null", F.count_if(F.col(col).isNull())


def expect_between(col: str, lo=None, hi=None) -> tuple:
    bad = F.lit(False)
    if lo is not None:
        bad = bad | (F.col(col) < lo)
    if hi is not None:
        bad = bad | (F.col(col) > hi)
    # Nulls pass: a null comparison counts nothing.
    return f"{col} between {lo} and {hi}", F.count_if(bad)


def expect_in_set(col: str, values) -> tuple:
    return f"{col} in set", F.count_if(~F.col(col).isin(list(values)))


def expect_date_format(col: str, pattern: str = "yyyy-M-d") -> tuple:
    unread = F.col(col).isNotNull() & parsed_date(F.col(col).cast("string"), pattern).isNull()
    return f"{col} is a date", F.count_if(unread)


def expect_row_count(lo: int, hi: int) -> tuple:
    n = F.count(F.lit(1))
    return f"row count between {lo} and {hi}", F.when(n.between(lo, hi), 0).otherwise(1).cast("long")


def run_checks(df: DataFrame, expectations) -> DataFrame:
    """One row per expectation with its number of unexpected rows, from a single scan."""
    counts = df.agg(*[c.alias(f"_{i}") for i, (_, c) in enumerate(expectations)])
    rows = F.array(*[
        F.struct(F.lit(i + 1).alias("check_no"), F.lit(name).alias("expectation"), F.col(f"_{i}").alias("unexpected"))
        for i, (name, _) in enumerate(expectations)
    ])
    return (
        counts.select(F.explode(rows).alias("r")).select("r.*")
        .withColumn("success", F.col("unexpected") == 0)
    )


def run_suite(
    df: DataFrame, dataset: str, suite: str, expectations, run_ts, fail_fast: bool = False
) -> DataFrame:
    """PASS or FAIL of a suite as one summary row; ``fail_fast`` raises on a failure."""
    failed = F.lit(0).cast("long")
    for _, c in expectations:
        failed = failed + F.when(c > 0, 1).otherwise(0)
    summary = df.agg(failed.alias("n_failed")).select(
        F.lit(run_ts).alias("run_ts"), F.lit(dataset).alias("dataset"), F.lit(suite).alias("suite"),
        F.when(F.col("n_failed") == 0, "PASS").otherwise("FAIL").alias("result"), "n_failed",
    )
    if fail_fast:
        row = summary.first()
        if row["result"] == "FAIL":
            raise ValueError(f"{suite} on {dataset}: {row['n_failed']} expectations failed")
    return summary


# The two suites.
UNITS = ["kg", "g", "L", "ml", "pcs"]


def inventory_suite() -> list:
    return [
        expect_not_null("item_id"), expect_not_null("item_name"), expect_between("quantity", 0.1),
        expect_in_set("unit", UNITS), expect_date_format("expiry_date"), expect_between("reorder_threshold", 0),
        expect_row_count(100, 5000),
    ]


def purchase_suite() -> list:
    return [
        expect_not_null("item_id"), expect_not_null("purchase_date"), expect_between("quantity_purchased", 1),
        expect_between("price_total", 0), expect_in_set("unit", UNITS),
        expect_date_format("expected_depletion_date"), expect_row_count(500, 10000),
    ]


def slice_counts(df: DataFrame, slice_cols) -> DataFrame:
    """Rows per (slice column, value), nulls counted as a value."""
    pairs = F.array(*[
        F.struct(F.lit(c).alias("slice"), F.col(c).cast("string").alias("value")) for c in slice_cols
    ])
    return df.select(F.explode(pairs).alias("p")).groupBy("p.slice", "p.value").agg(F.count(F.lit(1)).alias("n"))


def under_represented(df: DataFrame, slice_cols, floor: float = 5, share: float = 0.02) -> DataFrame:
    """Slice values with fewer than ``max(floor, share * rows)`` rows."""
    counts = slice_counts(df, slice_cols)
    # Every slice column covers all rows, so its own sum is the table's row count.
    totals = counts.groupBy("slice").agg(F.sum("n").alias("total"))
    return (
        counts.join(totals, "slice")
        .filter(F.col("n") < F.greatest(F.lit(float(floor)), F.lit(share) * F.col("total")))
        .select("slice", "value", F.lit("underrepresented").alias("issue"), "n")
    )


def describe_by(df: DataFrame, slice_col: str, value_col: str, approx: bool = False) -> DataFrame:
    """Count, mean, deviation, range and quartiles of a value per slice; null slices are left out."""
    rows = df.filter(F.col(slice_col).isNotNull()).select(slice_col, value_col)
    if not approx:
        return described(rows, [slice_col], value_col, QUARTILES)
    v = F.col(value_col)
    sketch = F.approx_percentile(v, list(QUARTILES.values()), 10000)
    return rows.groupBy(slice_col).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"),
        F.max(v).alias("max"), sketch.alias("_q"),
    ).select(
        slice_col, "n", "mean", "std", "min",
        *[F.get("_q", F.lit(i)).alias(q) for i, q in enumerate(QUARTILES)], "max",
    )


def profile(df: DataFrame, approx: bool = False) -> DataFrame:
    """Every column described: count, distinct values, most frequent one, moments and quartiles.

    Text, boolean and date columns get unique/top/freq, numeric columns get
    moments and quartiles. Columns are read one at a time, numbers three times,
    so ``df`` should be a written table. ``approx`` is one
    scan of sketches, without top/freq.
    """
    numeric = [f.name for f in df.schema if f.dataType.typeName() in NUMERIC_TYPES]
    other = [f.name for f in df.schema if f.name not in numeric]
    if approx:
        return _sketch_profile(df, numeric, other)
    parts = [_text_profile(df, c) for c in other]
    if numeric:
        parts.append(described_columns(df, numeric, QUARTILES))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return rows.select(*[
        F.col(c) if c in rows.columns else F.lit(None).cast(PROFILE_TYPES.get(c, "double")).alias(c) for c in PROFILE_COLUMNS
    ])


def _text_profile(df: DataFrame, col: str) -> DataFrame:
    """One row for a column with values: how many, how many distinct ones, the most frequent one."""
    whole = F.col(col) if df.schema[col].dataType.typeName() in PLAIN_TYPES else F.col(col).cast("string")
    counts = df.filter(whole.isNotNull()).groupBy(whole.alias("_v")).agg(F.count(F.lit(1)).alias("_n")).select(
        F.col("_v").cast("string").alias("text"), "_n"
    )
    return counts.agg(
        F.sum("_n").alias("n"), F.count(F.lit(1)).alias("unique"),
        F.min(F.struct((-F.col("_n")).alias("neg"), "text")).alias("_top"),
    ).filter(F.col("n") > 0).select(
        F.lit(col).alias("column"), "n", "unique", F.col("_top.text").alias("top"), (-F.col("_top.neg")).alias("freq")
    )


NUMERIC_TYPES = {"byte", "short", "integer", "long", "float", "double", "decimal"}
# Types of which no two values have the same text: values are counted as they are, and told as text.
PLAIN_TYPES = {"string", "boolean", "date", "timestamp_ntz"}
PROFILE_TYPES = {"unique": "long", "top": "string", "freq": "long"}
PROFILE_COLUMNS = ["column", "n", "unique", "top", "freq", "mean", "std", "min", *QUARTILES, "max"]


def _sketch_profile(df: DataFrame, numeric, other) -> DataFrame:
    none = F.lit(None)
    aggs = []
    for c in numeric:
        v = F.col(c).cast("double")
        q = F.approx_percentile(v, list(QUARTILES.values()), 10000)
        aggs.append(F.struct(
            F.lit(c).alias("column"), F.count(v).alias("n"), none.cast("long").alias("unique"),
            F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"),
            *[F.get(q, F.lit(i)).alias(name) for i, name in enumerate(QUARTILES)], F.max(v).alias("max"),
        ))
    for c in other:
        aggs.append(F.struct(
            F.lit(c).alias("column"), F.count(F.col(c)).alias("n"),
            F.approx_count_distinct(F.col(c)).alias("unique"),
            *[none.cast("double").alias(x) for x in ["mean", "std", "min", *QUARTILES, "max"]],
        ))
    return df.agg(F.array(*aggs).alias("_rows")).select(F.explode("_rows").alias("r")).select("r.*")


def quality_flags(
    name: Column, ingredients: Column, steps: Column, inventory: Column, n_tokens: Column,
    min_steps: int = 3, max_tokens: int = 2048,
) -> Column:
    """Documented recipe checks as struct(complete, from_inventory, enough_steps, fits)."""
    some_ingredients = F.coalesce(F.size(ingredients) > 0, F.lit(False))
    known = F.forall(
        F.coalesce(ingredients, F.array().cast("array<string>")),
        lambda i: F.exists(F.coalesce(inventory, F.array().cast("array<string>")), lambda v: F.lower(v) == F.lower(i)),
    )
    n_steps = F.coalesce(F.size(steps), F.lit(0))
    return F.struct(
        (~is_blank(name) & some_ingredients & (n_steps > 0)).alias("complete"),
        known.alias("from_inventory"),
        (n_steps >= min_steps).alias("enough_steps"),
        (n_tokens < max_tokens).alias("fits"),
    )


# Gate thresholds.
THRESHOLDS = {
    "json_valid_rate": 0.85, "diet_match_rate": 0.95, "cuisine_match_rate": 0.90, "min_slice_diet_match": 0.85,
}


def gate(metrics: DataFrame, keys, thresholds=None) -> DataFrame:
    """One row per metric with its threshold and whether it is reached; an undefined metric does not pass."""
    limits = thresholds or THRESHOLDS
    shown = [m for m in limits if m in metrics.columns]
    rows = F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(limits[m]).alias("threshold"))
        for m in shown
    ])
    return metrics.select(*keys, F.explode(rows).alias("g")).select(*keys, "g.*").withColumn(
        "passed", F.coalesce(F.col("value") >= F.col("threshold"), F.lit(False))
    )
