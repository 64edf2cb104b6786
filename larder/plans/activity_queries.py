"""Activity, feedback, preferences and requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.operators import activity, ordering, preferences as prefs_ops, requests as req
from larder.plans import jobs
from larder.plans.bindings import (
    AS_OF, HISTORY, PREFERENCES, REQUESTS, USERS, history, preferences, requests, table, users,
)
from larder.plans.registry import query, rounded
from larder.session import scratch_path
from larder.sources.readers import parse_access_log

W_USERS, W_HISTORY, W_PREFS, W_REQUESTS = ("WITH " + t for t in (USERS, HISTORY, PREFERENCES, REQUESTS))
WEEK_AGO = "TIMESTAMP '2024-01-24 00:00:00'"
CALENDAR = """cal AS (SELECT (DATE '2024-01-31' - i::INT) AS day FROM range(7) t(i))"""
PCT = "coalesce(round_even({a} / nullif({b}, 0) * 100, 1), 0)"


@query("user_metrics", f"""{W_USERS}
SELECT count(*) AS total_users, count(*) FILTER (created_at >= {WEEK_AGO}) AS new_users FROM users""")
def user_metrics(spark, d):
    return activity.user_metrics(users(spark, d), AS_OF)


@query("active_users", f"""{W_HISTORY}
SELECT count(DISTINCT user_id) AS active_users FROM history WHERE created_at >= {WEEK_AGO}""")
def active_users(spark, d):
    return activity.active_users(history(spark, d), AS_OF)


@query("active_users_sketch")
def active_users_sketch(spark, d):
    return activity.active_users(history(spark, d), AS_OF, approx=True)


@query("active_users_sketch_error", f"""{W_HISTORY}
SELECT count(DISTINCT user_id) AS active_users, true AS near FROM history WHERE created_at >= {WEEK_AGO}""")
def active_users_sketch_error(spark, d):
    """Whether the sketch lies within three of its standard errors (a twentieth each) of the exact count."""
    exact = activity.active_users(history(spark, d), AS_OF)
    sketch = activity.active_users(history(spark, d), AS_OF, approx=True).select(F.col("active_users").alias("s"))
    off = F.abs(sketch.scalar() - F.col("active_users"))
    return exact.withColumn("near", off <= 0.15 * F.col("active_users"))


@query("recipe_metrics", f"""{W_HISTORY}, c AS (
  SELECT count(*) AS total, count(*) FILTER (created_at >= {WEEK_AGO}) AS last_days,
         count(*) FILTER (feedback_score > 0) AS with_feedback, count(*) FILTER (feedback_score = 2) AS liked,
         count(*) FILTER (feedback_score = 1) AS disliked, count(*) FILTER (is_cooked) AS cooked FROM history)
SELECT *, {PCT.format(a='with_feedback', b='total')} AS feedback_rate, {PCT.format(a='cooked', b='total')} AS cook_rate,
       {PCT.format(a='liked', b='with_feedback')} AS like_rate FROM c""")
def recipe_metrics(spark, d):
    return activity.recipe_metrics(history(spark, d), AS_OF)


DAILY = """SELECT day, strftime(day, '%b %d') AS label, count(created_at) AS n
FROM cal LEFT JOIN {t} ON created_at::DATE = day GROUP BY day"""


@query("daily_recipes", f"{W_HISTORY}, {CALENDAR}\n" + DAILY.format(t="history"))
def daily_recipes(spark, d):
    return activity.daily_counts(history(spark, d), AS_OF)


@query("daily_signups", f"{W_USERS}, {CALENDAR}\n" + DAILY.format(t="users"))
def daily_signups(spark, d):
    return activity.daily_signups(users(spark, d), AS_OF)


@query("daily_bars", f"""{W_HISTORY}, {CALENDAR}, c AS ({DAILY.format(t="history")})
SELECT *, round(n / greatest((SELECT max(n) FROM c), 1) * 100, 6) AS share_of_max FROM c""")
def daily_bars(spark, d):
    return rounded(activity.daily_bars(history(spark, d), AS_OF), "share_of_max")


@query("comparison_metrics", f"""{W_PREFS}, c AS (
  SELECT count(*) AS total, count(chosen_variant) AS completed, count(*) FILTER (skipped) AS skipped FROM prefs)
SELECT *, {PCT.format(a='completed', b='total')} AS completion_rate FROM c""")
def comparison_metrics(spark, d):
    return activity.comparison_metrics(preferences(spark, d))


COUNTED = """counted AS (SELECT user_id, username, count(*) AS recipe_count
  FROM users JOIN history ON users.id = history.user_id GROUP BY ALL)"""


@query("user_recipe_counts", f"""{W_USERS}, {HISTORY}, {COUNTED}
SELECT user_id, username, recipe_count FROM counted""")
def user_recipe_counts(spark, d):
    return activity.user_recipe_counts(users(spark, d), history(spark, d))


@query("top_users", f"""{W_USERS}, {HISTORY}, {COUNTED}
SELECT user_id, username, recipe_count FROM counted ORDER BY recipe_count DESC, user_id LIMIT 5""")
def top_users(spark, d):
    return activity.top_users(activity.user_recipe_counts(users(spark, d), history(spark, d)))


@query("active_share", f"""{W_USERS}, {HISTORY}, c AS (SELECT (SELECT count(*) FROM users) AS total_users,
  (SELECT count(DISTINCT user_id) FROM history WHERE created_at >= {WEEK_AGO}) AS active_users)
SELECT *, floor(active_users / total_users * 100 + 0.5)::BIGINT AS active_pct FROM c""")
def active_share(spark, d):
    return activity.active_share(users(spark, d), history(spark, d), AS_OF)


RATED_WEEK = f"""c AS (SELECT count(*) FILTER (feedback_score = 2) AS likes, count(*) FILTER (feedback_score = 1) AS dislikes
  FROM history WHERE created_at >= {WEEK_AGO})"""


@query("approval_rate", f"{W_HISTORY}, {RATED_WEEK} SELECT *, likes / (likes + dislikes) AS approval_rate FROM c")
def approval_rate(spark, d):
    return activity.approval_rate(history(spark, d), AS_OF)


@query("monitor_status", f"""{W_HISTORY}, {RATED_WEEK}, r AS (SELECT *, likes / (likes + dislikes) AS approval_rate FROM c)
SELECT *, CASE WHEN likes + dislikes < 10 THEN 'SKIPPED' WHEN approval_rate < 0.8 THEN 'ALERT' ELSE 'OK' END AS status
FROM r""")
def monitor_status(spark, d):
    return activity.monitor_status(activity.approval_rate(history(spark, d), AS_OF))


@query("rated_history", f"{W_HISTORY} SELECT id, user_id, feedback_score FROM history WHERE feedback_score IN (1, 2)")
def rated_history(spark, d):
    return activity.rated(history(spark, d)).select("id", "user_id", "feedback_score")


@query("global_streak", f"""{W_HISTORY}, l AS (SELECT * FROM history WHERE feedback_score IN (1, 2)
  ORDER BY created_at DESC, id DESC LIMIT 5)
SELECT count(*) AS n_ratings, count(*) = 5 AND bool_and(feedback_score = 1) AS streak FROM l""")
def global_streak(spark, d):
    return activity.global_streak(history(spark, d))


def streak_sql(n: int) -> str:
    return f"""{W_HISTORY}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS rn
  FROM history WHERE feedback_score IN (1, 2))
SELECT user_id, count(*) AS n_ratings, max(created_at) AS last_rating_at FROM r WHERE rn <= {n} GROUP BY user_id
HAVING count(*) = {n} AND bool_and(feedback_score = 1)"""


@query("user_streaks", streak_sql(5))
def user_streaks(spark, d):
    return activity.user_streaks(history(spark, d))


NUMBERED = """g AS (SELECT id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY created_at, id) AS generation_number
  FROM history)"""


@query("generation_numbers", f"{W_HISTORY}, {NUMBERED} SELECT id, user_id, generation_number FROM g")
def generation_numbers(spark, d):
    return activity.with_generation_number(history(spark, d)).select("id", "user_id", "generation_number")


@query("comparison_events", f"""{W_HISTORY}, {NUMBERED}
SELECT g.id, g.user_id, generation_number FROM g JOIN history h ON g.id = h.id
WHERE generation_number % 7 = 0 OR (is_cooked AND servings = 3)""")
def comparison_events(spark, d):
    asked = history(spark, d).withColumn("compare", F.col("is_cooked") & (F.col("servings") == 3))
    return activity.comparison_events(asked).select("id", "user_id", "generation_number")


@query("history_newest_first", f"{W_HISTORY} SELECT id, user_id, created_at FROM history ORDER BY created_at DESC, id DESC")
def history_newest_first(spark, d):
    return activity.history_newest_first(history(spark, d)).select("id", "user_id", "created_at")


@query("history_neutral_tab", f"{W_HISTORY} SELECT id, feedback_score FROM history WHERE coalesce(feedback_score, 0) = 0")
def history_neutral_tab(spark, d):
    return activity.history_tab(history(spark, d), "neutral").select("id", "feedback_score")


@query("tab_counts", f"""{W_HISTORY}
SELECT count(*) AS "all", count(*) FILTER (feedback_score = 2) AS liked, count(*) FILTER (feedback_score = 1) AS disliked,
       count(*) FILTER (coalesce(feedback_score, 0) = 0) AS neutral FROM history""")
def tab_counts(spark, d):
    return activity.tab_counts(history(spark, d))


# --- preferences ---

UNTRAINED = "exported_for_training IS NOT TRUE AND chosen_variant IS NOT NULL"
USABLE = "skipped IS NOT TRUE AND chosen_variant IS NOT NULL"


@query("untrained_pairs", f"{W_PREFS} SELECT id, user_id, chosen_variant FROM prefs WHERE {UNTRAINED}")
def untrained_pairs(spark, d):
    return prefs_ops.untrained_pairs(preferences(spark, d)).select("id", "user_id", "chosen_variant")


@query("new_pair_status", f"""{W_PREFS}
SELECT count(*) AS n_pairs, CASE WHEN count(*) >= 50 THEN 'READY' ELSE 'WAITING' END AS status FROM prefs WHERE {UNTRAINED}""")
def new_pair_status(spark, d):
    return prefs_ops.new_pair_status(preferences(spark, d))


@query("usable_prefs_keep", f"{W_PREFS} SELECT id, user_id, skipped FROM prefs WHERE {USABLE}")
def usable_prefs_keep(spark, d):
    return prefs_ops.usable_prefs(preferences(spark, d)).select("id", "user_id", "skipped")


@query("usable_prefs_drop", f"""{W_PREFS}
SELECT id, user_id, skipped FROM prefs WHERE skipped = false AND chosen_variant IS NOT NULL""")
def usable_prefs_drop(spark, d):
    return prefs_ops.usable_prefs(preferences(spark, d), "drop").select("id", "user_id", "skipped")


@query("usable_counts", f"{W_PREFS} SELECT user_id, count(*) AS n FROM prefs WHERE {USABLE} GROUP BY user_id")
def usable_counts(spark, d):
    return prefs_ops.usable_counts(preferences(spark, d))


@query("users_ready", f"""{W_USERS}, {PREFERENCES}, r AS (
  SELECT user_id, count(*) AS n FROM prefs WHERE {USABLE} GROUP BY user_id HAVING count(*) >= 30)
SELECT user_id, n, username FROM r JOIN users ON users.id = r.user_id""")
def users_ready(spark, d):
    ready = prefs_ops.users_ready(preferences(spark, d), min_n=30)
    return activity.attach_users(ready, users(spark, d))


WHOLE_PAIR = "coalesce(variant_a_raw, '') <> '' AND coalesce(variant_b_raw, '') <> '' AND coalesce(rejected_variant, '') <> '' AND chosen_variant <> ''"


@query("user_pair_status", f"""{W_USERS}, {PREFERENCES}, c AS (
  SELECT user_id, count(*) AS preference_count, count(*) FILTER ({WHOLE_PAIR}) AS n_pairs FROM prefs
  WHERE skipped = false AND chosen_variant IS NOT NULL GROUP BY user_id)
SELECT user_id, username, preference_count, n_pairs, CASE WHEN preference_count >= 15 THEN 'pending' ELSE 'collecting' END AS status
FROM c JOIN users ON users.id = c.user_id""")
def user_pair_status(spark, d):
    return prefs_ops.user_pair_status(preferences(spark, d), users(spark, d), 15)


@query("user_pairs_run", f"""{W_USERS}, {PREFERENCES}, r AS (
  SELECT user_id FROM prefs WHERE skipped = false AND chosen_variant IS NOT NULL GROUP BY user_id HAVING count(*) >= 15)
SELECT user_id, prompt, CASE chosen_variant WHEN 'A' THEN variant_a_raw ELSE variant_b_raw END AS chosen,
  CASE chosen_variant WHEN 'A' THEN variant_b_raw ELSE variant_a_raw END AS rejected
FROM prefs WHERE skipped = false AND chosen_variant IS NOT NULL AND {WHOLE_PAIR}
  AND user_id IN (SELECT user_id FROM r JOIN users ON users.id = r.user_id)""")
def user_pairs_run(spark, d):
    """The pairs that the export of every ready user holds, read back from its files."""
    tables = jobs.export_user_pairs_job(preferences(spark, d), users(spark, d), scratch_path(spark, "run"), 15)
    return tables["pairs"].select("user_id", "prompt", "chosen", "rejected")


@query("threshold_events", f"""{W_PREFS}, r AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at, id) AS preference_count FROM prefs WHERE {USABLE})
SELECT id, user_id, preference_count FROM r WHERE preference_count = 30""")
def threshold_events(spark, d):
    return prefs_ops.threshold_events(preferences(spark, d), 30).select("id", "user_id", "preference_count")


PAIRS = f"""pairs AS (SELECT id, prompt,
  CASE chosen_variant WHEN 'A' THEN variant_a_raw ELSE variant_b_raw END AS chosen,
  CASE chosen_variant WHEN 'A' THEN variant_b_raw ELSE variant_a_raw END AS rejected FROM prefs WHERE {UNTRAINED})"""
BLANK = "(trim(coalesce({c}, ''), ' ' || chr(9)) = '')"
ANY_BLANK = " OR ".join(BLANK.format(c=c) for c in ("prompt", "chosen", "rejected"))


def _pairs(spark, d):
    return prefs_ops.resolve_pair(prefs_ops.untrained_pairs(preferences(spark, d))).select(
        "id", "prompt", "chosen", "rejected"
    )


@query("resolved_pairs", f"{W_PREFS}, {PAIRS} SELECT * FROM pairs")
def resolved_pairs(spark, d):
    return _pairs(spark, d)


@query("training_pairs", f"""{W_PREFS}, {PAIRS}
SELECT id, trim(prompt) AS prompt, trim(chosen) AS chosen, trim(rejected) AS rejected FROM pairs WHERE NOT ({ANY_BLANK})""")
def training_pairs(spark, d):
    return prefs_ops.drop_blank_pairs(_pairs(spark, d))


@query("blank_pair_counts", f"""{W_PREFS}, {PAIRS}
SELECT count(*) FILTER (NOT ({ANY_BLANK})) AS kept, count(*) FILTER ({ANY_BLANK}) AS dropped FROM pairs""")
def blank_pair_counts(spark, d):
    return prefs_ops.blank_pair_counts(_pairs(spark, d))


@query("prefs_in_order", f"{W_PREFS} SELECT id, created_at FROM prefs WHERE {USABLE} ORDER BY created_at, id")
def prefs_in_order(spark, d):
    return prefs_ops.prefs_in_order(prefs_ops.usable_prefs(preferences(spark, d))).select("id", "created_at")


@query("mark_exported", f"""{W_PREFS}
SELECT id, CASE WHEN {UNTRAINED} THEN true ELSE exported_for_training END AS exported_for_training FROM prefs""")
def mark_exported(spark, d):
    prefs = preferences(spark, d)
    done = prefs_ops.untrained_pairs(prefs).select("id")
    return prefs_ops.mark_exported(prefs, done).select("id", "exported_for_training")


# The rater of an event chooses "a" or "b" by its number; other letters are no choice.
CHOICES = """choices AS (SELECT event_id AS id, user_id, ([ 'a', 'B', 'c' ])[event_id % 3 + 1] AS choice FROM events)"""


def _choices(spark, d):
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"), "user_id",
        F.get(F.array(F.lit("a"), F.lit("B"), F.lit("c")), F.col("event_id") % 3).alias("choice"),
        F.lit(2).alias("servings"),
    )


def _apply(spark, d):
    prefs = preferences(spark, d).withColumns({
        "variant_a": F.col("variant_a_raw"), "variant_b": F.col("variant_b_raw"),
        "chosen_at": F.lit(None).cast("timestamp_ntz"), "chosen_recipe_history_id": F.lit(None).cast("bigint"),
    })
    return prefs_ops.apply_choices(prefs, _choices(spark, d), AS_OF)


@query("applied_choices", f"""{W_PREFS}, {CHOICES}, v AS (SELECT id, upper(choice) AS c FROM choices WHERE upper(choice) IN ('A', 'B'))
SELECT p.id, coalesce(c, chosen_variant) AS chosen_variant,
       CASE c WHEN 'A' THEN 'B' WHEN 'B' THEN 'A' ELSE rejected_variant END AS rejected_variant,
       CASE WHEN c IS NOT NULL THEN TIMESTAMP '2024-01-31 00:00:00' END AS chosen_at,
       CASE WHEN c IS NOT NULL THEN p.id END AS chosen_recipe_history_id
FROM prefs p LEFT JOIN v ON p.id = v.id""")
def applied_choices(spark, d):
    return _apply(spark, d)[0].select(
        "id", "chosen_variant", "rejected_variant", "chosen_at", "chosen_recipe_history_id"
    )


@query("choice_history", f"""{W_PREFS}, {CHOICES}
SELECT p.id AS preference_id, p.user_id, CASE upper(choice) WHEN 'A' THEN variant_a_raw ELSE variant_b_raw END AS recipe_json,
       prompt AS user_query, 2 AS servings, TIMESTAMP '2024-01-31 00:00:00' AS created_at
FROM prefs p JOIN choices c ON p.id = c.id WHERE upper(choice) IN ('A', 'B')""")
def choice_history(spark, d):
    return _apply(spark, d)[1]


@query("choices_repeated", f"""{W_PREFS}, c AS (
  SELECT e.event_id - i AS id, e.event_id AS pos, e.user_id, ([ 'a', 'B', 'c' ])[e.event_id % 3 + 1] AS choice FROM events e, range(3) t(i)),
v AS (SELECT id, user_id, arg_max(upper(choice), pos) AS c FROM c WHERE upper(choice) IN ('A', 'B') GROUP BY id, user_id)
SELECT p.id, coalesce(c, chosen_variant) AS chosen_variant,
       CASE c WHEN 'A' THEN 'B' WHEN 'B' THEN 'A' ELSE rejected_variant END AS rejected_variant
FROM prefs p LEFT JOIN v ON p.id = v.id AND p.user_id = v.user_id""")
def choices_repeated(spark, d):
    """Every event chooses for itself and the two before it: a preference keeps the last choice of its user."""
    letters = F.array(F.lit("a"), F.lit("B"), F.lit("c"))
    several = table(spark, d, "events").select(
        F.explode(F.sequence(F.col("event_id") - 2, F.col("event_id"))).alias("id"), F.col("event_id").alias("at"), "user_id",
        F.get(letters, F.col("event_id") % 3).alias("choice"), F.lit(2).alias("servings"))
    prefs = preferences(spark, d).withColumns({
        "variant_a": F.col("variant_a_raw"), "variant_b": F.col("variant_b_raw"),
        "chosen_at": F.lit(None).cast("timestamp_ntz"), "chosen_recipe_history_id": F.lit(None).cast("bigint"),
    })
    return prefs_ops.apply_choices(prefs, several, AS_OF, order="at")[0].select("id", "chosen_variant", "rejected_variant")


CLEAN_A = "CASE WHEN contains(variant_a_raw, '}<|') THEN split_part(variant_a_raw, '}<|', 1) || '}' ELSE variant_a_raw END"
JUDGED = f"""judged AS (SELECT id, trim(({CLEAN_A}), ' ' || chr(9)) AS a, trim(variant_b_raw) AS b, chosen_variant AS c,
    CASE WHEN k % 10 = 1 THEN chosen_variant ELSE rejected_variant END AS r,
    CASE WHEN k % 6 = 0 THEN 'discard' ELSE 'use_pair' END AS rec FROM prefs),
routed AS (SELECT id, CASE c WHEN 'A' THEN a WHEN 'B' THEN b END AS chosen, CASE r WHEN 'A' THEN a WHEN 'B' THEN b END AS rejected,
    c, r, rec FROM judged),
reasoned AS (SELECT *, CASE WHEN coalesce(chosen, '') = '' OR coalesce(rejected, '') = '' THEN 'evaluation_failed'
    WHEN c = r THEN 'degenerate' WHEN rec <> 'use_pair' THEN 'groq_recommendation_reject' END AS reason FROM routed)"""


def judged(spark, d):
    k = F.col("k")
    return preferences(spark, d).select(
        "id", "user_id", F.col("variant_a_raw").alias("variant_a"), F.col("variant_b_raw").alias("variant_b"),
        "chosen_variant",
        F.when(k % 10 == 1, F.col("chosen_variant")).otherwise(F.col("rejected_variant")).alias("rejected_variant"),
        F.when(k % 6 == 0, "discard").otherwise("use_pair").alias("recommendation"),
    )


@query("routed_pairs", f"""{W_PREFS}, {JUDGED}
SELECT id, chosen, rejected, reason, CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END AS route FROM reasoned""")
def routed_pairs(spark, d):
    return prefs_ops.route_pairs(judged(spark, d), degenerate=True).select("id", "chosen", "rejected", "reason", "route")


@query("label_pass_rate", f"""{W_PREFS}, {JUDGED}
SELECT count(*) AS n, count(*) FILTER (reason IS NULL) AS accepted,
       round_even(count(*) FILTER (reason IS NULL) / count(*) * 100, 1) AS pass_rate FROM reasoned""")
def label_pass_rate(spark, d):
    return prefs_ops.label_pass_rate(prefs_ops.route_pairs(judged(spark, d), degenerate=True))


@query("rejects_by_reason", f"""{W_PREFS}, {JUDGED}
SELECT reason, count(*) AS n FROM reasoned WHERE reason IS NOT NULL GROUP BY reason""")
def rejects_by_reason(spark, d):
    return prefs_ops.rejects_by_reason(prefs_ops.route_pairs(judged(spark, d), degenerate=True))


# --- requests ---

@query("request_counts", f"{W_REQUESTS} SELECT method, path, status, count(*) AS n FROM requests GROUP BY ALL")
def request_counts(spark, d):
    return req.request_counts(requests(spark, d))


@query("latency_histogram", f"""{W_REQUESTS}, b AS (SELECT unnest([0.05, 0.1, 0.2, 0.5, 1, 2, 5, 10])::DOUBLE AS le),
l AS (SELECT DISTINCT method, path, status FROM requests)
SELECT l.method, l.path, l.status, le, (SELECT count(*) FROM requests r WHERE r.method = l.method AND r.path = l.path
  AND r.status = l.status AND r.duration_s <= le) AS n FROM l, b""")
def latency_histogram(spark, d):
    return req.histogram_rows(req.latency_histogram(requests(spark, d)))


@query("latency_totals", f"""{W_REQUESTS}
SELECT method, path, status, round(sum(duration_s), 4) AS sum_s, count(*) AS n FROM requests GROUP BY ALL""")
def latency_totals(spark, d):
    return rounded(req.latency_histogram(requests(spark, d)).select("method", "path", "status", "sum_s", "n"), "sum_s", digits=4)


@query("access_log", """
SELECT event_id AS id, 'INFO' AS level, '10.0.0.' || user_id % 250 AS client_ip, (event_id % 60000)::INT AS client_port,
       'GET' AS method, '/users/' || user_id AS path, CASE event_type WHEN 'error' THEN 500 ELSE 200 END AS status,
       CASE event_type WHEN 'error' THEN 'Internal Server Error' ELSE 'OK' END AS reason
FROM events WHERE event_type <> 'signup'""")
def access_log(spark, d):
    kind, user = F.col("event_type"), F.col("user_id")
    line = F.format_string(
        'INFO:     10.0.0.%s:%s - "GET /users/%s HTTP/1.1" %s', user % 250, F.col("event_id") % 60000, user,
        F.when(kind == "error", "500 Internal Server Error").otherwise("200 OK"),
    )
    lines = table(spark, d, "events").select(
        F.col("event_id").alias("id"), F.when(kind == "signup", "INFO:     Application startup").otherwise(line).alias("value")
    )
    return parse_access_log(lines)


# --- order and sampling ---

@query("first_events_per_user", """
SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)
WHERE rn <= 3""")
def first_events_per_user(spark, d):
    events = table(spark, d, "events")
    return ordering.first_n_per(events, ["user_id"], ["ts", "event_id"], 3).select("user_id", "event_id")


@query("largest_event_per_user", """
SELECT user_id, event_id, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM events) WHERE rn = 1""")
def largest_event_per_user(spark, d):
    events = table(spark, d, "events").select("user_id", "event_id", "value")
    return ordering.arg_max_first(events, ["user_id"], "value", ["event_id"])


BUCKET = "('0x' || substr(md5({k}::VARCHAR || '{s}'), 1, 8))::BIGINT % {n}"


@query("hash_split", f"""
SELECT doc_id, CASE WHEN {BUCKET.format(k='doc_id', s='v1', n=100)} < 80 THEN 'train'
  WHEN {BUCKET.format(k='doc_id', s='v1', n=100)} < 90 THEN 'validation' ELSE 'test' END AS split FROM documents""")
def hash_split(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    return ordering.hash_split(docs, "doc_id", {"train": 80, "validation": 10, "test": 10}, "v1")


@query("quota_sample", """
SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY md5(event_id::VARCHAR), event_id) AS rn
  FROM events) WHERE rn <= CASE event_type WHEN 'view' THEN 300 WHEN 'click' THEN 240 WHEN 'purchase' THEN 180 ELSE 0 END""")
def quota_sample(spark, d):
    quotas = {"view": 300, "click": 240, "purchase": 180}
    return ordering.quota_sample(table(spark, d, "events"), "event_type", quotas, "event_id").select("event_type", "event_id")


@query("latest_run", """
SELECT event_id, user_id FROM events WHERE ts::DATE = (SELECT max(ts)::DATE FROM events)""")
def latest_run(spark, d):
    runs = table(spark, d, "events").withColumn("run_ts", F.to_date("ts"))
    return ordering.latest_run(runs).select("event_id", "user_id")
