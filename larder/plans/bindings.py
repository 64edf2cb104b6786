"""The driver's tables as domain tables.

Every derived column is plain arithmetic on the given columns, and the SQL
text beside it says the same for the oracle.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = datetime(2024, 1, 31)
STOCK_AS_OF = datetime(1998, 9, 2)
UNITS = ["kg", "g", "L", "ml", "pcs"]
SPELLINGS = ["lbs", "kilograms", "grams", "Liters", "pieces", "cups", "clove", "large", "oz", "tbsp"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def choose(values, index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index)


def sql_choose(values, index: str) -> str:
    return f"([{', '.join(repr(v) for v in values)}])[{index} + 1]"


def props_number(props: Column) -> Column:
    return F.regexp_extract(props, r"(\d+)", 1).cast("int")


# --- stock: line items with their part, and the owner only where it is needed ---

def purchases(spark, d) -> DataFrame:
    li, part = table(spark, d, "lineitem"), table(spark, d, "part")
    return li.join(part, li.l_partkey == part.p_partkey).select(
        F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("item_id"),
        F.col("p_name").alias("item_name"), F.col("p_type").alias("category"),
        (F.col("l_quantity") % 25).alias("quantity_purchased"), F.col("l_extendedprice").alias("price_total"),
        choose(UNITS, F.col("l_linenumber") % 5).alias("unit"),
        F.col("l_shipdate").alias("expected_depletion_date"),
    )


PURCHASES = f"""purchases AS (
  SELECT l_orderkey AS order_id, l_partkey AS item_id, p_name AS item_name, p_type AS category,
         l_quantity % 25 AS quantity_purchased, l_extendedprice AS price_total,
         {sql_choose(UNITS, 'l_linenumber % 5')} AS unit, l_shipdate AS expected_depletion_date
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def inventory(spark, d) -> DataFrame:
    li, part = table(spark, d, "lineitem"), table(spark, d, "part")
    return li.join(part, li.l_partkey == part.p_partkey).select(
        F.col("l_partkey").alias("item_id"), F.col("p_name").alias("item_name"), F.col("p_type").alias("category"),
        (F.col("l_quantity") / 10).alias("quantity"), choose(UNITS, F.col("l_linenumber") % 5).alias("unit"),
        F.col("p_retailprice").alias("unit_cost"),
        (F.col("l_quantity") * F.col("l_tax") * 1000).alias("reorder_threshold"),
        F.col("l_shipdate").cast("date").alias("expiry_date"),
    )


INVENTORY = f"""inventory AS (
  SELECT l_partkey AS item_id, p_name AS item_name, p_type AS category, l_quantity / 10 AS quantity,
         {sql_choose(UNITS, 'l_linenumber % 5')} AS unit, p_retailprice AS unit_cost,
         l_quantity * l_tax * 1000 AS reorder_threshold, l_shipdate::DATE AS expiry_date
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
CLEANED = INVENTORY + """, cleaned AS (
  SELECT *, CASE WHEN unit IN ('kg', 'L') THEN quantity * 1000 ELSE quantity END AS qty_canonical,
         CASE unit WHEN 'kg' THEN 'g' WHEN 'L' THEN 'ml' ELSE unit END AS canonical_unit FROM inventory),
flagged AS (SELECT *, qty_canonical * unit_cost AS stock_value, qty_canonical < reorder_threshold AS is_low_stock
            FROM cleaned)"""


def owned_items(spark, d) -> DataFrame:
    """One row per (user, item): the line items of a customer summed per part."""
    li, orders, part = (table(spark, d, t) for t in ("lineitem", "orders", "part"))
    sums = (
        li.join(orders, li.l_orderkey == orders.o_orderkey)
        .groupBy(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"))
        .agg(F.sum("l_quantity").alias("_q"))
    )
    return sums.join(part, F.col("item_id") == F.col("p_partkey")).select(
        "user_id", "item_id", F.col("p_name").alias("item_name"),
        (F.greatest(F.col("_q") - 3, F.lit(0.0)) / 50).alias("quantity"),
        choose(UNITS, (F.col("item_id") % 5).cast("int")).alias("unit"), F.col("p_type").alias("category"),
    )


OWNED = f"""owned AS (
  SELECT user_id, item_id, p_name AS item_name, greatest(q - 3, 0.0) / 50 AS quantity,
         {sql_choose(UNITS, 'item_id % 5')} AS unit, p_type AS category
  FROM (SELECT o_custkey AS user_id, l_partkey AS item_id, sum(l_quantity) AS q
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)
  JOIN part ON item_id = p_partkey)"""


def recipe_ingredients(spark, d) -> DataFrame:
    """Ingredient names that orders ask for: the part name, half of them with a word swapped or left out."""
    li, orders, part = (table(spark, d, t) for t in ("lineitem", "orders", "part"))
    word = F.split("p_name", " ")
    name = (
        F.when(F.col("l_orderkey") % 4 == 0, F.concat(F.get(word, F.lit(1)), F.lit(", "), F.get(word, F.lit(0))))
        .when(F.col("l_orderkey") % 4 == 1, F.upper(F.get(word, F.lit(1))))
        .otherwise(F.col("p_name"))
    )
    return (
        li.join(orders, li.l_orderkey == orders.o_orderkey).join(part, li.l_partkey == part.p_partkey)
        .select(
            # The buyer's neighbour cooks, so that some ingredients are not in stock.
            (F.col("o_custkey") + F.col("l_orderkey") % 2).alias("user_id"), F.col("l_orderkey").alias("recipe_id"),
            name.alias("ingredient"),
        ).distinct()
    )


RECIPE_INGREDIENTS = """ingredients AS (
  SELECT DISTINCT o_custkey + l_orderkey % 2 AS user_id, l_orderkey AS recipe_id,
         CASE l_orderkey % 4 WHEN 0 THEN split_part(p_name, ' ', 2) || ', ' || split_part(p_name, ' ', 1)
              WHEN 1 THEN upper(split_part(p_name, ' ', 2)) ELSE p_name END AS ingredient
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""


def ingredient_texts(spark, d) -> DataFrame:
    """Ingredient texts in the three forms and without a quantity."""
    li, part = table(spark, d, "lineitem"), table(spark, d, "part")
    qty = F.col("l_quantity").cast("int").cast("string")
    unit = choose(SPELLINGS, (F.col("l_orderkey") % 10).cast("int"))
    form = (F.col("l_orderkey") + F.col("l_linenumber")) % 5
    return li.join(part, li.l_partkey == part.p_partkey).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", unit.alias("spelling"), "p_name",
        form.cast("int").alias("form"),
        F.when(form == 0, F.concat(qty, F.lit(" "), unit, F.lit(" "), "p_name"))
        .when(form == 1, F.concat(F.col("p_name"), F.lit(" ("), qty, F.lit(" "), unit, F.lit(", sliced)")))
        .when(form == 2, F.concat(F.col("p_name"), F.lit(" "), qty, F.lit(" "), unit, F.lit(" cut")))
        .when(form == 3, F.concat(qty, F.lit("/4 "), unit, F.lit(" "), "p_name"))
        .otherwise(F.col("p_name")).alias("text"),
    )


# --- activity: events as recipe history and preferences, customers as users ---

def users(spark, d) -> DataFrame:
    c = table(spark, d, "customer")
    return c.select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("username"),
        F.expr("timestamp_ntz '2024-01-31 00:00:00' - make_dt_interval(int(c_custkey % 45))").alias("created_at"),
    )


USERS = """users AS (
  SELECT c_custkey AS id, c_name AS username,
         TIMESTAMP '2024-01-31 00:00:00' - to_days((c_custkey % 45)::INT) AS created_at FROM customer)"""


def as_history(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    return events.select(
        F.col("event_id").alias("id"), "user_id", F.col("ts").alias("created_at"),
        F.when(kind == "purchase", 2).when(kind == "error", 1).when(kind == "view", 0).alias("feedback_score"),
        (kind == "click").alias("is_cooked"), (props_number(F.col("props")) % 4).alias("servings"),
    )


def history(spark, d) -> DataFrame:
    return as_history(table(spark, d, "events"))


HISTORY = """history AS (
  SELECT event_id AS id, user_id, ts AS created_at,
         CASE event_type WHEN 'purchase' THEN 2 WHEN 'error' THEN 1 WHEN 'view' THEN 0 END AS feedback_score,
         event_type = 'click' AS is_cooked, regexp_extract(props, '([0-9]+)', 1)::INT % 4 AS servings FROM events)"""


def as_preferences(events: DataFrame) -> DataFrame:
    k, i = F.col("_k"), F.col("event_id")
    return events.withColumn("_k", props_number(F.col("props"))).select(
        i.alias("id"), "user_id", F.col("ts").alias("created_at"), F.col("event_type").alias("user_query"),
        F.when(i % 17 == 0, "  ").otherwise(F.concat(F.lit(" make "), "event_type", F.lit(" "))).alias("prompt"),
        F.when(i % 11 == 0, " \t").when(i % 13 != 0, F.concat(F.lit("A"), i.cast("string"), F.lit("}<|eot|>")))
        .alias("variant_a_raw"),
        F.concat(F.lit(" B"), i.cast("string"), F.lit(" ")).alias("variant_b_raw"),
        F.when(k % 3 == 0, "A").when(k % 3 == 1, "B").alias("chosen_variant"),
        F.when(k % 3 == 0, "B").when(k % 3 == 1, "A").alias("rejected_variant"),
        F.when(k % 4 == 0, True).when(k % 4 < 3, False).alias("skipped"),
        F.when(k % 5 == 0, True).when(k % 5 < 3, False).alias("exported_for_training"),
        k.alias("k"),
    )


def preferences(spark, d) -> DataFrame:
    return as_preferences(table(spark, d, "events"))


PREFERENCES = r"""numbered AS (SELECT *, regexp_extract(props, '([0-9]+)', 1)::INT AS k FROM events),
prefs AS (
  SELECT event_id AS id, user_id, ts AS created_at, event_type AS user_query,
         CASE WHEN event_id % 17 = 0 THEN '  ' ELSE ' make ' || event_type || ' ' END AS prompt,
         CASE WHEN event_id % 11 = 0 THEN ' ' || chr(9) WHEN event_id % 13 <> 0 THEN 'A' || event_id || '}<|eot|>' END
           AS variant_a_raw,
         ' B' || event_id || ' ' AS variant_b_raw,
         CASE k % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' END AS chosen_variant,
         CASE k % 3 WHEN 0 THEN 'B' WHEN 1 THEN 'A' END AS rejected_variant,
         CASE WHEN k % 4 = 0 THEN true WHEN k % 4 < 3 THEN false END AS skipped,
         CASE WHEN k % 5 = 0 THEN true WHEN k % 5 < 3 THEN false END AS exported_for_training, k
  FROM numbered)"""


def as_requests(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    return events.select(
        F.col("event_id").alias("request_id"), F.col("ts").alias("created_at"),
        F.when(kind.isin("signup", "purchase"), "POST").otherwise("GET").alias("method"),
        F.concat(F.lit("/users/"), F.col("user_id").cast("string"), F.lit("/"), kind).alias("path"),
        F.when(kind == "error", 500).otherwise(200).alias("status"), (F.col("value") / 50).alias("duration_s"),
    )


def requests(spark, d) -> DataFrame:
    return as_requests(table(spark, d, "events"))


REQUESTS = r"""requests AS (
  SELECT event_id AS request_id, ts AS created_at,
         CASE WHEN event_type IN ('signup', 'purchase') THEN 'POST' ELSE 'GET' END AS method,
         '/users/:id/' || event_type AS path,
         CASE event_type WHEN 'error' THEN 500 ELSE 200 END AS status, value / 50 AS duration_s FROM events)"""
