"""The whole runs on the test tables, told by the row counts of what they write."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from larder.plans import jobs
from larder.plans.activity_queries import ANY_BLANK, PAIRS, RATED_WEEK, UNTRAINED, W_HISTORY, W_PREFS
from larder.plans.bindings import AS_OF, PREFERENCES, STOCK_AS_OF, history, preferences
from larder.plans.evaluation_queries import AGREED, OUTPUTS, SLICED, model_outputs, votes
from larder.plans.registry import query
from larder.plans.stock_queries import EXPIRED, INVENTORY, LOW, PURCHASES, _dated_inventory, _dated_purchases
from larder.session import scratch_path


def _sizes(tables: dict, names):
    counts = [tables[n].agg(F.lit(n).alias("table"), F.count(F.lit(1)).alias("n")) for n in names]
    return reduce(lambda a, b: a.unionByName(b), counts)


DATED = "WITH " + INVENTORY + """, cleaned AS (
  SELECT * REPLACE (CASE WHEN item_id % 50 <> 0 THEN expiry_date END AS expiry_date),
         CASE WHEN unit IN ('kg', 'L') THEN quantity * 1000 ELSE quantity END AS qty_canonical FROM inventory),
flagged AS (SELECT *, qty_canonical < reorder_threshold AS is_low_stock FROM cleaned), """ + PURCHASES


@query("stock_run", f"""{DATED}
SELECT 'inventory_cleaned' AS "table", count(*) AS n FROM cleaned UNION ALL SELECT 'purchases_cleaned', count(*) FROM purchases
UNION ALL SELECT 'alerts', (SELECT count(*) FROM ({LOW})) + (SELECT count(*) FROM ({EXPIRED}))
UNION ALL SELECT 'findings', count(*) FROM (SELECT count(*) AS n FROM purchases GROUP BY category UNION ALL
  SELECT count(*) FROM purchases GROUP BY unit) WHERE n < greatest(5, 0.02 * (SELECT count(*) FROM purchases))
UNION ALL SELECT 'inventory_profile', 8 UNION ALL SELECT 'purchase_profile', 9
UNION ALL SELECT 'unit_price_category', count(DISTINCT category) FROM purchases UNION ALL SELECT 'unit_price_unit', count(DISTINCT unit) FROM purchases""")
def stock_run(spark, d):
    tables = jobs.stock_job(
        _dated_inventory(spark, d), _dated_purchases(spark, d), scratch_path(spark, "run"), STOCK_AS_OF.date(), "2025-10-28"
    )
    return _sizes(tables, ["inventory_cleaned", "purchases_cleaned", "alerts", "findings", "inventory_profile",
                           "purchase_profile", "unit_price_category", "unit_price_unit"])


@query("export_run", f"""{W_PREFS}, {PAIRS}
SELECT exported_for_training OR id IN (SELECT id FROM pairs WHERE NOT ({ANY_BLANK})) AS exported, count(*) AS n FROM prefs GROUP BY ALL""")
def export_run(spark, d):
    tables = jobs.export_pairs_job(preferences(spark, d), scratch_path(spark, "run"))
    return tables["preferences"].groupBy(F.col("exported_for_training").alias("exported")).agg(F.count(F.lit(1)).alias("n"))


@query("evaluation_run", f"""WITH {OUTPUTS}, {SLICED}
SELECT 'examples' AS "table", count(*) AS n FROM examples UNION ALL SELECT 'summary', count(DISTINCT model) FROM examples
UNION ALL SELECT 'slices', count(*) FROM sliced UNION ALL SELECT 'gate', 3 * count(DISTINCT model) FROM examples
UNION ALL SELECT 'slice_summary', count(DISTINCT (model, preference)) + count(DISTINCT (model, cuisine)) FROM sliced""")
def evaluation_run(spark, d):
    tables = jobs.evaluation_job(model_outputs(spark, d), scratch_path(spark, "run"), "20251115")
    return _sizes(tables, ["examples", "summary", "slices", "gate", "slice_summary"])


@query("judging_run", f"""WITH {AGREED}
SELECT 'consensus' AS "table", count(*) AS n FROM agreed UNION ALL SELECT 'agreement', count(*) FROM agreed
UNION ALL SELECT 'wins', count(DISTINCT persona) + 1 FROM agreed UNION ALL SELECT 'wins_by_category', count(DISTINCT category) FROM agreed
UNION ALL SELECT 'wins_by_evaluator', count(DISTINCT (persona, evaluator)) FROM votes""")
def judging_run(spark, d):
    tables = jobs.judging_job(votes(spark, d), scratch_path(spark, "run"))
    return _sizes(tables, ["consensus", "agreement", "wins", "wins_by_category", "wins_by_evaluator"])


@query("monitor_run", f"""{W_HISTORY}, {PREFERENCES}, {RATED_WEEK},
l AS (SELECT * FROM history WHERE feedback_score IN (1, 2) ORDER BY created_at DESC, id DESC LIMIT 5)
SELECT 'approval_rate' AS kind, CASE WHEN likes + dislikes < 10 THEN 'SKIPPED' WHEN likes / (likes + dislikes) < 0.8 THEN 'ALERT' ELSE 'OK' END AS status,
  likes || ' likes, ' || dislikes || ' dislikes' AS detail FROM c UNION ALL
SELECT 'dislike_streak', CASE WHEN count(*) = 5 AND bool_and(feedback_score = 1) THEN 'ALERT' ELSE 'OK' END, count(*) || ' ratings looked at' FROM l UNION ALL
SELECT 'new_pairs', CASE WHEN count(*) >= 50 THEN 'READY' ELSE 'WAITING' END, count(*) || ' pairs' FROM prefs WHERE {UNTRAINED}""")
def monitor_run(spark, d):
    path = scratch_path(spark, "run")
    jobs.monitor_job(history(spark, d), preferences(spark, d), path, AS_OF)
    return spark.read.schema("kind string, status string, detail string").json(f"{path}/monitor")
