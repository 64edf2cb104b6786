"""Stock, purchases, quality checks and table changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.operators import quality, stock
from larder.operators.activity import category_counts, top_categories
from larder.operators.ordering import sorted_summary
from larder.plans.bindings import (
    CLEANED, INVENTORY, OWNED, PURCHASES, STOCK_AS_OF, inventory, owned_items, purchases, table,
)
from larder.plans.registry import query, rounded
from larder.session import scratch_path
from larder.sources import bucketed, changes

FLAGGED = "WITH " + CLEANED


def flagged(spark, d):
    return stock.transform_inventory(inventory(spark, d))


@query("stock_transform", FLAGGED + """
SELECT item_id, item_name, qty_canonical, canonical_unit, stock_value, is_low_stock FROM flagged""")
def stock_transform(spark, d):
    return flagged(spark, d).select(
        "item_id", "item_name", "qty_canonical", "canonical_unit", "stock_value", "is_low_stock"
    )


@query("low_stock_raw_threshold", FLAGGED + """
SELECT unit, count(*) AS n, count(*) FILTER (qty_canonical <
  CASE WHEN unit IN ('kg', 'L') THEN reorder_threshold * 1000 ELSE reorder_threshold END) AS n_low
FROM flagged GROUP BY unit""")
def low_stock_raw_threshold(spark, d):
    return stock.transform_inventory(inventory(spark, d), "raw").groupBy("unit").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_low_stock").alias("n_low")
    )


LOW = """SELECT item_name, 'LOW_STOCK' AS issue_type, qty_canonical AS quantity, expiry_date
FROM flagged WHERE is_low_stock"""
EXPIRED = f"""SELECT item_name, 'EXPIRED' AS issue_type, qty_canonical AS quantity, expiry_date
FROM flagged WHERE expiry_date < DATE '{STOCK_AS_OF.date()}'"""


@query("low_stock_alerts", FLAGGED + "\n" + LOW)
def low_stock_alerts(spark, d):
    return stock.low_stock_alerts(flagged(spark, d))


@query("expired_alerts", FLAGGED + "\n" + EXPIRED)
def expired_alerts(spark, d):
    return stock.expired_alerts(flagged(spark, d), STOCK_AS_OF.date())


@query("all_alerts", f"{FLAGGED}\n{LOW}\nUNION ALL\n{EXPIRED}")
def all_alerts(spark, d):
    return stock.all_alerts(flagged(spark, d), STOCK_AS_OF.date())


@query("unit_price_zero_as_one", "WITH " + PURCHASES + """
SELECT order_id, item_id, price_total / CASE WHEN quantity_purchased = 0 THEN 1 ELSE quantity_purchased END
  AS unit_price FROM purchases""")
def unit_price_zero_as_one(spark, d):
    return stock.with_unit_price(purchases(spark, d), "one").select("order_id", "item_id", "unit_price")


@query("unit_price_zero_as_null", "WITH " + PURCHASES + """
SELECT order_id, item_id, price_total / nullif(quantity_purchased, 0) AS unit_price FROM purchases""")
def unit_price_zero_as_null(spark, d):
    return stock.with_unit_price(purchases(spark, d), "null").select("order_id", "item_id", "unit_price")


def _describe_sql(slice_col: str) -> str:
    return "WITH " + PURCHASES + f"""
SELECT {slice_col}, count(p) AS n, round(avg(p), 4) AS mean, round(stddev_samp(p), 4) AS std, min(p) AS min,
       round(quantile_cont(p, 0.25), 4) AS q25, round(quantile_cont(p, 0.5), 4) AS q50,
       round(quantile_cont(p, 0.75), 4) AS q75, max(p) AS max
FROM (SELECT *, price_total / nullif(quantity_purchased, 0) AS p FROM purchases) WHERE {slice_col} IS NOT NULL
GROUP BY {slice_col}"""


def _describe(spark, d, slice_col):
    priced = stock.with_unit_price(purchases(spark, d), "null")
    out = quality.describe_by(priced, slice_col, "unit_price")
    return rounded(out, "mean", "std", "q25", "q50", "q75", digits=4)


@query("unit_price_by_category", _describe_sql("category"))
def unit_price_by_category(spark, d):
    return _describe(spark, d, "category")


@query("unit_price_by_unit", _describe_sql("unit"))
def unit_price_by_unit(spark, d):
    return _describe(spark, d, "unit")


@query("unit_price_by_category_sketch")
def unit_price_by_category_sketch(spark, d):
    priced = stock.with_unit_price(purchases(spark, d), "null")
    return quality.describe_by(priced, "category", "unit_price", approx=True)


def _near_quartiles(rows, sketch, key: str):
    """Per key the number of values, and whether each sketched quartile is within its rank error of a ten-thousandth."""
    v, n = F.col("_v"), F.count("_v")
    near = [
        ((F.count_if(v < F.col(q)) <= (p + 1e-4) * n + 1) & (F.count_if(v <= F.col(q)) >= (p - 1e-4) * n - 1)).alias(f"{q}_near")
        for q, p in quality.QUARTILES.items()
    ]
    return rows.join(sketch.select(key, *quality.QUARTILES), key).groupBy(key).agg(n.alias("n"), *near)


@query("unit_price_sketch_error", "WITH " + PURCHASES + """
SELECT category, count(price_total / nullif(quantity_purchased, 0)) AS n, true AS q25_near, true AS q50_near, true AS q75_near
FROM purchases WHERE category IS NOT NULL GROUP BY category""")
def unit_price_sketch_error(spark, d):
    rows = stock.with_unit_price(purchases(spark, d), "null").select("category", F.col("unit_price").alias("_v"))
    return _near_quartiles(rows, unit_price_by_category_sketch(spark, d), "category")


@query("under_represented", "WITH " + PURCHASES + """, c AS (
  SELECT 'category' AS slice, category AS value, count(*) AS n FROM purchases GROUP BY ALL UNION ALL
  SELECT 'unit', unit, count(*) FROM purchases GROUP BY ALL UNION ALL
  SELECT 'item_name', item_name, count(*) FROM purchases GROUP BY ALL)
SELECT slice, value, 'underrepresented' AS issue, n FROM c
WHERE n < greatest(5, 0.02 * (SELECT count(*) FROM purchases))""")
def under_represented(spark, d):
    return quality.under_represented(purchases(spark, d), ["category", "unit", "item_name"])


def _profile_sql(numeric, texts) -> str:
    parts = []
    for c in texts:
        parts.append(f"""SELECT '{c}' AS "column", sum(n)::BIGINT AS n, count(*) AS "unique",
  arg_min(v, (-n, v)) AS top, max(n) AS freq, NULL::DOUBLE AS mean, NULL::DOUBLE AS std, NULL::DOUBLE AS min,
  NULL::DOUBLE AS q25, NULL::DOUBLE AS q50, NULL::DOUBLE AS q75, NULL::DOUBLE AS max
FROM (SELECT {c}::VARCHAR AS v, count(*) AS n FROM lineitem WHERE {c} IS NOT NULL GROUP BY ALL)""")
    for c in numeric:
        x = f"{c}::DOUBLE"
        parts.append(f"""SELECT '{c}', count({c}), NULL, NULL, NULL, round(avg({x}), 4), round(stddev_samp({x}), 4),
  min({x}), round(quantile_cont({x}, 0.25), 4), round(quantile_cont({x}, 0.5), 4),
  round(quantile_cont({x}, 0.75), 4), max({x}) FROM lineitem""")
    return "\nUNION ALL\n".join(parts)


@query("profile_lineitem", _profile_sql(
    ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"],
    ["l_returnflag", "l_linestatus", "l_shipdate"],
))
def profile_lineitem(spark, d):
    return rounded(quality.profile(table(spark, d, "lineitem")), "mean", "std", "q25", "q50", "q75", digits=4)


@query("profile_lineitem_sketch")
def profile_lineitem_sketch(spark, d):
    return quality.profile(table(spark, d, "lineitem"), approx=True)


NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("profile_sketch_error", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS n, true AS q25_near, true AS q50_near, true AS q75_near FROM lineitem""" for c in NUMBERS))
def profile_sketch_error(spark, d):
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("_v")) for c in NUMBERS]))
    rows = table(spark, d, "lineitem").select(cells.alias("c")).select("c.*")
    return _near_quartiles(rows, profile_lineitem_sketch(spark, d), "column")


SUITE_ROWS = """, checks AS (
  SELECT 1 AS check_no, 'item_id not null' AS expectation, count(*) FILTER (item_id IS NULL) AS unexpected FROM {t}
  UNION ALL SELECT 2, '{second} not null', count(*) FILTER ({second} IS NULL) FROM {t}
  UNION ALL SELECT 3, '{q} between {low} and None', count(*) FILTER ({q} < {low}) FROM {t}
  UNION ALL SELECT {unit_no}, 'unit in set', count(*) FILTER (unit NOT IN ('kg', 'g', 'L', 'ml', 'pcs')) FROM {t}
  UNION ALL SELECT {date_no}, '{day} is a date', count(*) FILTER ({day} IS NOT NULL AND
    try_strptime({day}, '%Y-%m-%d') IS NULL) FROM {t}
  UNION ALL SELECT {value_no}, '{value} between 0 and None', count(*) FILTER ({value} < 0) FROM {t}
  UNION ALL SELECT 7, 'row count between {lo} and {hi}',
    CASE WHEN count(*) BETWEEN {lo} AND {hi} THEN 0 ELSE 1 END FROM {t})
"""
INVENTORY_CHECKS = "WITH " + INVENTORY + """, t AS (
  SELECT * REPLACE (CASE WHEN item_id % 50 = 0 THEN strftime(expiry_date, '%Y%m%d')
                         ELSE strftime(expiry_date, '%Y-%m-%d') END AS expiry_date) FROM inventory)""" + SUITE_ROWS.format(
    t="t", second="item_name", q="quantity", low="0.1", unit_no=4, date_no=5, day="expiry_date", value_no=6,
    value="reorder_threshold", lo=100, hi=5000,
)
PURCHASE_CHECKS = "WITH " + PURCHASES + """, t AS (
  SELECT * REPLACE (strftime(expected_depletion_date, '%Y-%m-%d') AS expected_depletion_date),
         expected_depletion_date AS purchase_date FROM purchases)""" + SUITE_ROWS.format(
    t="t", second="purchase_date", q="quantity_purchased", low="1", unit_no=5, date_no=6,
    day="expected_depletion_date", value_no=4, value="price_total", lo=500, hi=10000,
)


def _dated_inventory(spark, d):
    # Some dates in another format, as a check has to find them.
    day = F.col("expiry_date")
    text = F.when(F.col("item_id") % 50 == 0, F.date_format(day, "yyyyMMdd")).otherwise(day.cast("string"))
    return inventory(spark, d).withColumn("expiry_date", text)


def _dated_purchases(spark, d):
    day = F.col("expected_depletion_date")
    return purchases(spark, d).withColumn("purchase_date", day).withColumn(
        "expected_depletion_date", day.cast("date").cast("string")
    )


CHECK_ROWS = "SELECT check_no, expectation, unexpected, unexpected = 0 AS success FROM checks"


@query("inventory_checks", INVENTORY_CHECKS + CHECK_ROWS)
def inventory_checks(spark, d):
    return quality.run_checks(_dated_inventory(spark, d), quality.inventory_suite())


@query("purchase_checks", PURCHASE_CHECKS + CHECK_ROWS)
def purchase_checks(spark, d):
    return quality.run_checks(_dated_purchases(spark, d), quality.purchase_suite())


@query("validation_summary", PURCHASE_CHECKS + """
SELECT '2025-10-28' AS run_ts, 'purchase_history' AS dataset, 'purchase_history_suite' AS suite,
       CASE WHEN count(*) FILTER (unexpected > 0) = 0 THEN 'PASS' ELSE 'FAIL' END AS result,
       count(*) FILTER (unexpected > 0) AS n_failed FROM checks""")
def validation_summary(spark, d):
    return quality.run_suite(
        _dated_purchases(spark, d), "purchase_history", "purchase_history_suite", quality.purchase_suite(), "2025-10-28"
    )


# --- per user ---

W_OWNED = "WITH " + OWNED


@query("items_of_owner", W_OWNED + """
SELECT item_id, item_name, quantity, unit, category FROM owned WHERE user_id =
  (SELECT user_id FROM owned GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 1)""")
def items_of_owner(spark, d):
    items = owned_items(spark, d)
    largest = items.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).agg(
        F.min_by("user_id", F.struct(-F.col("n"), "user_id"))
    ).scalar()
    return stock.items_of(items, largest)


@query("in_stock_by_user", W_OWNED + """, s AS (
  SELECT *, ('0x' || substr(md5(item_id::VARCHAR), 1, 8))::BIGINT % ceil(count(*) OVER (PARTITION BY user_id) / 20)::INT AS part
  FROM owned WHERE quantity > 0)
SELECT user_id, part::INT AS part, count(*)::INT AS n_items, min(item_name) AS first_name,
       round(sum(quantity), 6) AS quantity FROM s GROUP BY user_id, part""")
def in_stock_by_user(spark, d):
    lists = stock.in_stock_by_user(owned_items(spark, d), part_size=20)
    total = F.aggregate(F.transform("items", lambda i: i["quantity"]), F.lit(0.0), lambda s, x: s + x)
    return lists.select(
        "user_id", "part", F.size("items").alias("n_items"), F.get("items", F.lit(0))["name"].alias("first_name"),
        F.round(total, 6).alias("quantity"),
    )


def _low_sql(op: str) -> str:
    return W_OWNED + f""", low AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY item_id) AS rn FROM owned WHERE quantity {op} 0.1)
SELECT user_id, count(*) AS n_low, string_agg(item_name, ', ' ORDER BY rn) FILTER (rn <= 3)
  || CASE WHEN count(*) > 3 THEN ' +' || (count(*) - 3) || ' more' ELSE '' END AS summary
FROM low GROUP BY user_id"""


@query("app_low_stock", _low_sql("<"))
def app_low_stock(spark, d):
    return stock.app_low_stock(owned_items(spark, d))


@query("client_low_stock", _low_sql("<="))
def client_low_stock(spark, d):
    return stock.app_low_stock(owned_items(spark, d), strict=False)


@query("inventory_metrics", W_OWNED + """
SELECT count(*) AS total_items, count(*) FILTER (quantity < 0.1) AS low_stock FROM owned""")
def inventory_metrics(spark, d):
    return stock.inventory_metrics(owned_items(spark, d))


MASKED = "masked AS (SELECT *, CASE p_type WHEN 'SMALL' THEN NULL WHEN 'LARGE' THEN '' ELSE p_type END AS category FROM part)"


def _masked_parts(spark, d):
    kind = F.col("p_type")
    return table(spark, d, "part").withColumn(
        "category", F.when(kind == "SMALL", None).when(kind == "LARGE", "").otherwise(kind)
    )


@query("category_counts", f"WITH {MASKED} SELECT category, count(*) AS n FROM masked GROUP BY category")
def all_category_counts(spark, d):
    return category_counts(_masked_parts(spark, d))


@query("top_categories", f"""WITH {MASKED}, c AS (SELECT category, count(*) AS n FROM masked GROUP BY category
  ORDER BY n DESC, category NULLS FIRST LIMIT 5)
SELECT coalesce(nullif(category, ''), 'Uncategorized') AS category, n FROM c""")
def largest_categories(spark, d):
    return top_categories(category_counts(_masked_parts(spark, d)))


@query("deducted_stock", W_OWNED + """, spent AS (
  SELECT o_custkey AS user_id, l_partkey AS item_id, sum(l_discount * l_quantity) / 2 AS amount
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT user_id, item_id, round(CASE WHEN amount IS NULL THEN quantity ELSE greatest(0, quantity - amount) END, 6)
  AS quantity FROM owned LEFT JOIN spent USING (user_id, item_id)""")
def deducted_stock(spark, d):
    li, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    spent = li.join(orders, li.l_orderkey == orders.o_orderkey).select(
        F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"),
        (F.col("l_discount") * F.col("l_quantity") / 2).alias("amount"),
    )
    return rounded(stock.deduct(owned_items(spark, d), spent).select("user_id", "item_id", "quantity"), "quantity")


@query("purchase_dates", """
SELECT o_orderkey AS order_id, strftime(o_orderdate, '%A') AS weekday,
       o_orderdate::DATE + 1 AS consumption_start_date,
       o_orderdate::DATE + (o_custkey % 30)::INT AS expected_depletion_date FROM orders""")
def purchase_dates(spark, d):
    rows = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").alias("purchase_date"),
        (F.col("o_custkey") % 30).alias("shelf_days"),
    )
    return stock.purchase_dates(rows, "shelf_days").drop("purchase_date", "shelf_days")


# --- table changes ---

STOCKED = """stocked AS (SELECT p_partkey AS item_id, p_size AS user_id, p_name AS item_name,
  p_retailprice / 100 AS quantity, 'pcs' AS unit, p_type AS category FROM part)"""


def _stocked(spark, d):
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("item_id"), F.col("p_size").alias("user_id"), F.col("p_name").alias("item_name"),
        (F.col("p_retailprice") / 100).alias("quantity"), F.lit("pcs").alias("unit"), F.col("p_type").alias("category"),
    )


@query("insert_items", f"""WITH {STOCKED}
SELECT item_id, user_id, item_name, quantity, unit, category FROM stocked UNION ALL
SELECT s_suppkey + 1000000000, s_nationkey, s_name, CASE WHEN s_acctbal > 0 THEN s_acctbal ELSE 1.0 END, 'pcs', 'pantry'
FROM supplier""")
def insert_items(spark, d):
    new = table(spark, d, "supplier").select(
        (F.col("s_suppkey") + 1000000000).alias("item_id"), F.col("s_nationkey").alias("user_id"),
        F.col("s_name").alias("item_name"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("quantity"),
    )
    return changes.insert_items(_stocked(spark, d), new)


@query("update_items", f"""WITH {STOCKED}, ch AS (
  SELECT l_partkey AS item_id, max(l_quantity) AS q, CASE WHEN max(l_tax) > 0.07 THEN 'kg' END AS u
  FROM lineitem GROUP BY l_partkey)
SELECT item_id, coalesce(q, quantity) AS quantity, coalesce(u, unit) AS unit, category
FROM stocked LEFT JOIN ch USING (item_id)""")
def update_items(spark, d):
    new = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("item_id")).agg(
        F.max("l_quantity").alias("quantity"), F.when(F.max("l_tax") > 0.07, "kg").alias("unit")
    )
    return changes.update_items(_stocked(spark, d), new, ["item_id"]).select("item_id", "quantity", "unit", "category")


@query("update_repeated", f"""WITH {STOCKED}, ch AS (
  SELECT l_partkey AS item_id, arg_max(l_quantity, (l_orderkey, l_linenumber, l_suppkey, l_extendedprice)) AS q,
         arg_max(CASE WHEN l_tax > 0.07 THEN l_returnflag END, CASE WHEN l_tax > 0.07 THEN (l_orderkey, l_linenumber, l_suppkey, l_extendedprice) END) AS u
  FROM lineitem GROUP BY l_partkey)
SELECT item_id, coalesce(q, quantity) AS quantity, coalesce(u, unit) AS unit, category FROM stocked LEFT JOIN ch USING (item_id)""")
def update_repeated(spark, d):
    """Every order line changes its part: the last line counts, a null keeps what was there."""
    new = table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("item_id"), F.col("l_quantity").alias("quantity"),
        F.when(F.col("l_tax") > 0.07, F.col("l_returnflag")).alias("unit"), "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice",
    )
    done = changes.update_items(_stocked(spark, d), new, ["item_id"], ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"])
    return done.select("item_id", "quantity", "unit", "category")


@query("upsert_repeated", f"""WITH {STOCKED}, src AS (
  SELECT l_partkey * 2 AS item_id, arg_max((l_linenumber, l_returnflag, l_quantity), (l_orderkey, l_linenumber, l_suppkey, l_extendedprice)) AS v FROM lineitem GROUP BY l_partkey)
SELECT item_id, v[1]::BIGINT AS user_id, v[2] AS item_name, v[3] AS quantity, 'g' AS unit, 'pantry' AS category FROM src
UNION ALL SELECT item_id, user_id::BIGINT, item_name, quantity, unit, category FROM stocked WHERE item_id NOT IN (SELECT item_id FROM src)""")
def upsert_repeated(spark, d):
    """Every order line sets a part, whose last line stays."""
    new = table(spark, d, "lineitem").select(
        (F.col("l_partkey") * 2).alias("item_id"), F.col("l_linenumber").cast("bigint").alias("user_id"), F.col("l_returnflag").alias("item_name"),
        F.col("l_quantity").alias("quantity"), F.lit("g").alias("unit"), F.lit("pantry").alias("category"), "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice",
    )
    target = _stocked(spark, d).withColumn("user_id", F.col("user_id").cast("bigint"))
    return changes.upsert(target, new, "item_id", ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"])


@query("delete_items", f"""WITH {STOCKED}
SELECT item_id, user_id FROM stocked WHERE (item_id, user_id) NOT IN
  (SELECT (l_partkey, l_linenumber) FROM lineitem)""")
def delete_items(spark, d):
    gone = table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("item_id"), F.col("l_linenumber").alias("user_id")
    )
    return changes.delete_items(_stocked(spark, d), gone).select("item_id", "user_id")


@query("upsert_items", f"""WITH {STOCKED}, src AS (
  SELECT s_suppkey * 3 AS item_id, s_nationkey AS user_id, s_name AS item_name, s_acctbal AS quantity, 'g' AS unit,
         'pantry' AS category FROM supplier)
SELECT * FROM src UNION ALL SELECT * FROM stocked WHERE item_id NOT IN (SELECT item_id FROM src)""")
def upsert_items(spark, d):
    new = table(spark, d, "supplier").select(
        (F.col("s_suppkey") * 3).alias("item_id"), F.col("s_nationkey").alias("user_id"),
        F.col("s_name").alias("item_name"), F.col("s_acctbal").alias("quantity"), F.lit("g").alias("unit"),
        F.lit("pantry").alias("category"),
    )
    return changes.upsert(_stocked(spark, d), new, "item_id")


STOCK_SCHEMA = "item_id bigint, user_id int, item_name string, quantity double, unit string, category string"


def _bucketed(spark, d, new, change, keys="item_id"):
    """The stock kept in buckets, after a change that rewrites only those it touches."""
    path = scratch_path(spark, "stock")
    stock = _stocked(spark, d).select(*[F.col(f.split()[0]).cast(f.split()[1]) for f in STOCK_SCHEMA.split(", ")])
    bucketed.write_bucketed(stock, path, keys, buckets=32)
    bucketed.change_bucketed(spark, path, STOCK_SCHEMA, keys, new, change, buckets=32)
    return bucketed.read_bucketed(spark, path, STOCK_SCHEMA)


@query("bucketed_update", f"""WITH {STOCKED}, ch AS (
  SELECT l_partkey AS item_id, max(l_quantity) AS q FROM lineitem WHERE l_partkey % 97 = 3 GROUP BY l_partkey)
SELECT item_id, coalesce(q, quantity) AS quantity, unit, category FROM stocked LEFT JOIN ch USING (item_id)""")
def bucketed_update(spark, d):
    """Order lines of a hundredth of the parts change the quantity in stock."""
    new = table(spark, d, "lineitem").where(F.col("l_partkey") % 97 == 3).groupBy(F.col("l_partkey").alias("item_id")).agg(
        F.max("l_quantity").alias("quantity"))
    done = _bucketed(spark, d, new, lambda held, given: changes.update_items(held, given, ["item_id"]))
    return done.select("item_id", "quantity", "unit", "category")


@query("bucketed_upsert", f"""WITH {STOCKED}, src AS (
  SELECT s_suppkey * 3 AS item_id, s_nationkey AS user_id, s_name AS item_name, s_acctbal AS quantity, 'g' AS unit,
         'pantry' AS category FROM supplier)
SELECT * FROM src UNION ALL SELECT * FROM stocked WHERE item_id NOT IN (SELECT item_id FROM src)""")
def bucketed_upsert(spark, d):
    new = table(spark, d, "supplier").select(
        (F.col("s_suppkey") * 3).alias("item_id"), F.col("s_nationkey").alias("user_id"),
        F.col("s_name").alias("item_name"), F.col("s_acctbal").alias("quantity"), F.lit("g").alias("unit"), F.lit("pantry").alias("category"),
    )
    return _bucketed(spark, d, new, lambda held, given: changes.upsert(held, given, "item_id"))


@query("bucketed_delete", f"""WITH {STOCKED}
SELECT item_id, user_id FROM stocked WHERE (item_id, user_id) NOT IN (SELECT (l_partkey, l_linenumber) FROM lineitem)""")
def bucketed_delete(spark, d):
    gone = table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("item_id"), F.col("l_linenumber").alias("user_id"))
    return _bucketed(spark, d, gone, changes.delete_items).select("item_id", "user_id")


@query("sorted_summary", "WITH " + PURCHASES + """
SELECT category, unit, count(*) AS n FROM purchases GROUP BY ALL ORDER BY category, unit""")
def summary_in_order(spark, d):
    counts = purchases(spark, d).groupBy("category", "unit").agg(F.count(F.lit(1)).alias("n"))
    return sorted_summary(counts, ["category", "unit"])
