"""Inventory and purchase operators: derived columns, alerts, low stock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.text import hash_bucket
from larder.functions.units import canonical_qty, canonical_unit, convert_unit, price_per_unit
from larder.session import settled


def items_of(inventory: DataFrame, user_id) -> DataFrame:
    """The items of one user."""
    return inventory.filter(F.col("user_id") == user_id).select(
        "item_id", "item_name", "quantity", "unit", "category"
    )


def in_stock(inventory: DataFrame) -> DataFrame:
    return inventory.filter(F.col("quantity") > 0)


def in_stock_by_user(inventory: DataFrame, part_size: int = 1000) -> DataFrame:
    """Items in stock per user as lists of struct(name, quantity, unit).

    A user with more than ``part_size`` items gets several rows (``part`` 0, 1,
    ..., by the hash of the item id, whatever the ids have in common), so that no
    list grows with the hottest user; all parts together are the whole list.
    Only the users above the size are joined to their number of parts. The stock
    is written once, for the counts and for the lists.
    """
    stock = settled(in_stock(inventory).select("user_id", "item_id", "item_name", "quantity", "unit"), "stock")
    sizes = stock.groupBy("user_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > part_size).select(
        "user_id", F.ceil(F.col("_n") / F.lit(part_size)).cast("int").alias("_parts")
    )
    return (
        stock.join(sizes, "user_id", "left")
        .withColumn("part", F.when(F.col("_parts").isNull(), 0).otherwise(
            hash_bucket(F.col("item_id"), F.col("_parts"))).cast("int"))
        .groupBy("user_id", "part")
        .agg(F.array_sort(F.collect_list(
            F.struct(F.col("item_name").alias("name"), "quantity", "unit")
        )).alias("items"))
    )


def with_canonical(inventory: DataFrame) -> DataFrame:
    return inventory.withColumns({
        "qty_canonical": canonical_qty(F.col("quantity"), F.col("unit")),
        "canonical_unit": canonical_unit(F.col("unit")),
    })


def with_stock_value(inventory: DataFrame) -> DataFrame:
    """Canonical quantity times the cost of one raw unit."""
    return inventory.withColumn("stock_value", F.col("qty_canonical") * F.col("unit_cost"))


def with_low_stock_flag(inventory: DataFrame, threshold_unit: str = "canonical") -> DataFrame:
    """Canonical quantity below the reorder threshold; ``raw`` converts the threshold like the quantity."""
    threshold = F.col("reorder_threshold")
    if threshold_unit == "raw":
        threshold = canonical_qty(threshold, F.col("unit"))
    return inventory.withColumn("is_low_stock", F.col("qty_canonical") < threshold)


def transform_inventory(inventory: DataFrame, threshold_unit: str = "canonical") -> DataFrame:
    return with_low_stock_flag(with_stock_value(with_canonical(inventory)), threshold_unit)


def with_unit_price(purchases: DataFrame, zero: str = "one") -> DataFrame:
    return purchases.withColumn(
        "unit_price", price_per_unit(F.col("price_total"), F.col("quantity_purchased"), zero)
    )


ALERT_COLUMNS = ["item_name", "issue_type", "quantity", "expiry_date"]


def low_stock_alerts(inventory: DataFrame) -> DataFrame:
    return inventory.filter("is_low_stock").select(
        "item_name", F.lit("LOW_STOCK").alias("issue_type"), F.col("qty_canonical").alias("quantity"), "expiry_date"
    )


def is_expired(as_of) -> Column:
    return F.coalesce(F.col("expiry_date") < F.lit(as_of), F.lit(False))


def expired_alerts(inventory: DataFrame, as_of) -> DataFrame:
    return inventory.filter(is_expired(as_of)).select(
        "item_name", F.lit("EXPIRED").alias("issue_type"), F.col("qty_canonical").alias("quantity"), "expiry_date"
    )


def all_alerts(inventory: DataFrame, as_of) -> DataFrame:
    """Both kinds from one scan; an item that is low and expired gives two rows."""
    issues = F.array_compact(F.array(
        F.when(F.col("is_low_stock"), F.lit("LOW_STOCK")), F.when(is_expired(as_of), F.lit("EXPIRED"))
    ))
    return inventory.select(
        "item_name", F.explode(issues).alias("issue_type"), F.col("qty_canonical").alias("quantity"), "expiry_date"
    )


def app_low_stock(inventory: DataFrame, limit: float = 0.1, strict: bool = True, shown: int = 3) -> DataFrame:
    """Items running low per user: how many, the first names, and "+N more"."""
    low = F.col("quantity") < limit if strict else F.col("quantity") <= limit
    items = inventory.filter(low)
    counts = items.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_low"))
    # The constant limit keeps at most three names per user and task in the shuffle.
    w = Window.partitionBy("user_id").orderBy("item_id")
    first = (
        items.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= shown)
        .groupBy("user_id")
        .agg(F.array_sort(F.collect_list(F.struct("_rn", "item_name"))).alias("_first"))
    )
    names = F.array_join(F.transform("_first", lambda s: s["item_name"]), ", ")
    more = F.when(F.col("n_low") > shown, F.concat(F.lit(" +"), F.col("n_low") - shown, F.lit(" more"))).otherwise("")
    return counts.join(first, "user_id").select("user_id", "n_low", F.concat(names, more).alias("summary"))


def inventory_metrics(inventory: DataFrame, limit: float = 0.1) -> DataFrame:
    return inventory.agg(
        F.count(F.lit(1)).alias("total_items"), F.count_if(F.col("quantity") < limit).alias("low_stock")
    )


def deduct(inventory: DataFrame, deductions: DataFrame) -> DataFrame:
    """``max(0, quantity - sum of deductions)`` per (user, item); untouched items stay."""
    spent = deductions.groupBy("user_id", "item_id").agg(F.sum("amount").alias("_spent"))
    left = F.col("quantity") - F.coalesce(F.col("_spent"), F.lit(0.0))
    return (
        inventory.join(spent, ["user_id", "item_id"], "left")
        .withColumn("quantity", F.when(F.col("_spent").isNull(), F.col("quantity")).otherwise(F.greatest(F.lit(0.0), left)))
        .select(*inventory.columns)
    )


def deduction_amount(qty: Column, unit: Column, item_unit: Column, servings: Column) -> Column:
    """Converted quantity times servings; servings alone where the units differ in kind. 0 and null servings are 1."""
    times = F.when(F.coalesce(servings, F.lit(0)) == 0, 1).otherwise(servings)
    return F.coalesce(convert_unit(qty, unit, item_unit), F.lit(1.0)) * times


def purchase_dates(purchases: DataFrame, shelf_days: str) -> DataFrame:
    """Weekday name, start of use (next day) and expected depletion of a purchase."""
    day = F.col("purchase_date").cast("date")
    return purchases.withColumns({
        "weekday": F.date_format(day, "EEEE"),
        "consumption_start_date": F.date_add(day, 1),
        "expected_depletion_date": F.date_add(day, F.col(shelf_days).cast("int")),
    })
