"""Streams over the events table, run to their end; the oracle is the batch meaning of each."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.operators.requests import BOUNDS
from larder.plans.activity_queries import USABLE, W_HISTORY, W_PREFS, W_REQUESTS
from larder.plans.bindings import HISTORY, as_history, as_preferences, as_requests, table
from larder.plans.registry import query, rounded
from larder.schemas import EVENTS
from larder.session import scratch_path
from larder.streaming import sinks, streams


def events_stream(spark, d):
    return streams.read_stream(spark, f"{d}/events.parq*", EVENTS)


def _updates(spark, stream, keys):
    """The final state of a stream of updates."""
    base = scratch_path(spark, "stream")
    sinks.finish(sinks.write_updates(stream, f"{base}/rows", f"{base}/checkpoint"))
    return sinks.latest_updates(spark, f"{base}/rows", keys)


def _counted(spark, stream, part, whole):
    """The result of a stream that writes parts per batch."""
    base = scratch_path(spark, "stream")
    sinks.finish(sinks.write_parts(stream, part, f"{base}/parts", f"{base}/checkpoint"))
    return whole(sinks.all_parts(spark, f"{base}/parts"))


def arrivals(spark, d, number, loads=5):
    """Events that arrive load by load, as a folder of files each; ``number`` tells the load of an event.

    Yields the same stream after every arrival: run to its end from its checkpoint, it
    reads the load as one batch, into however many files a large load is written.
    """
    path = scratch_path(spark, "files")
    table(spark, d, "events").withColumn("load", number).write.partitionBy("load").parquet(f"{path}/all")
    for k in range(loads):
        spark.read.parquet(f"{path}/all").where(F.col("load") == k).drop("load").write.parquet(f"{path}/one/{k}")
        yield streams.read_stream(spark, f"{path}/one/*", EVENTS, files_per_batch=1 << 30)


def scattered(spark, d):
    """Events dealt to files by their number, so that every file but the first is late in every day; every file is a batch."""
    path = scratch_path(spark, "files")
    for k in range(5):
        table(spark, d, "events").where(F.col("event_id") % 5 == k).write.parquet(f"{path}/one/{k}")
    return streams.read_stream(spark, f"{path}/one/*", EVENTS, files_per_batch=1)


DAILY = "SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY ALL"


@query("stream_daily_counts", DAILY)
def stream_daily_counts(spark, d):
    return _counted(spark, as_history(events_stream(spark, d)), streams.daily_parts, streams.daily_counts)


@query("stream_daily_counts_files", DAILY)
def stream_daily_counts_files(spark, d):
    return _counted(spark, as_history(scattered(spark, d)), streams.daily_parts, streams.daily_counts)


APPROVAL = f"""{W_HISTORY}, w AS (SELECT date_trunc('day', created_at)::TIMESTAMP - to_days(i::INT) AS window_start, feedback_score
  FROM history, range(7) t(i) WHERE feedback_score IN (1, 2)), c AS (SELECT window_start, count(*) FILTER (feedback_score = 2) AS likes,
  count(*) FILTER (feedback_score = 1) AS dislikes FROM w GROUP BY ALL)
SELECT *, round(likes / (likes + dislikes), 6) AS approval_rate FROM c"""


@query("stream_approval", APPROVAL)
def stream_approval(spark, d):
    return rounded(_counted(spark, as_history(events_stream(spark, d)), streams.approval_parts, streams.approval), "approval_rate")


@query("stream_approval_files", APPROVAL)
def stream_approval_files(spark, d):
    return rounded(_counted(spark, as_history(scattered(spark, d)), streams.approval_parts, streams.approval), "approval_rate")


LE = ", ".join(f"count(*) FILTER (duration_s <= {b}) AS le_{str(b).replace('.', '_')}" for b in BOUNDS)
STATS = f"""{W_REQUESTS}
SELECT time_bucket(INTERVAL '6 hours', created_at) AS window_start, method, path, status, count(*) AS n, round(sum(duration_s), 4) AS sum_s, {LE}
FROM requests GROUP BY ALL"""


def _request_stats(spark, stream):
    stats = _counted(spark, as_requests(stream), lambda batch: streams.request_parts(batch, "6 hours"), streams.request_stats)
    return rounded(stats, "sum_s", digits=4)


@query("stream_request_stats", STATS)
def stream_request_stats(spark, d):
    return _request_stats(spark, events_stream(spark, d))


@query("stream_request_stats_files", STATS)
def stream_request_stats_files(spark, d):
    return _request_stats(spark, scattered(spark, d))


@query("stream_user_streaks", f"""WITH {HISTORY}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS rn
  FROM history WHERE feedback_score IN (1, 2))
SELECT user_id, count(*)::INT AS n_ratings, count(*) = 3 AND bool_and(feedback_score = 1) AS streak, max(created_at) AS last_rating_at
FROM r WHERE rn <= 3 GROUP BY user_id""")
def stream_user_streaks(spark, d):
    return _updates(spark, streams.stream_user_streaks(as_history(events_stream(spark, d)), 3), ["user_id"])


@query("stream_threshold", f"""{W_PREFS}
SELECT user_id, count(*) AS preference_count FROM prefs WHERE {USABLE} GROUP BY user_id HAVING count(*) >= 30""")
def stream_threshold(spark, d):
    return _updates(spark, streams.stream_threshold(as_preferences(events_stream(spark, d)), 30), ["user_id"])


@query("stream_append", "SELECT event_id, user_id, event_type, value FROM events")
def stream_append(spark, d):
    base = scratch_path(spark, "stream")
    rows = events_stream(spark, d).select("event_id", "user_id", "event_type", "value")
    sinks.finish(sinks.stream_append(rows, f"{base}/rows", f"{base}/checkpoint"))
    return spark.read.parquet(f"{base}/rows")


ALERTS = f"""WITH {HISTORY}, r AS (SELECT *, count(*) OVER last3 AS k, bool_and(feedback_score = 1) OVER last3 AS streak
  FROM history WHERE feedback_score IN (1, 2)
  WINDOW last3 AS (PARTITION BY user_id ORDER BY created_at, id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
SELECT 'dislike_streak' AS kind, user_id, id, 'User ' || user_id || ': the last 3 recipes were disliked' AS message
FROM r WHERE k = 3 AND streak"""


def _alerts(spark, runs, **how):
    """The alerts of a stream that is run once per element of ``runs``, always from the same checkpoint."""
    base = scratch_path(spark, "stream")
    text = F.format_string("User %s: the last %s recipes were disliked", "user_id", "n_ratings")
    for stream in runs:
        streaks = streams.stream_streak_alerts(as_history(stream), 3, **how)
        sinks.finish(
            streaks.writeStream.foreachBatch(sinks.write_alerts(f"{base}/alerts", "dislike_streak", text)).outputMode("update")
            .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
        )
    rows = spark.read.schema("kind string, user_id bigint, id bigint, message string").json(f"{base}/alerts/*/*/")
    return rows.select("kind", "user_id", "id", "message")


@query("stream_alerts", ALERTS)
def stream_alerts(spark, d):
    """An alert for every dislike that completes or goes on with a streak."""
    return _alerts(spark, [events_stream(spark, d)])


def in_time_order(spark, d):
    """The events as loads in the order of time, cut at fifths of the time that they span."""
    ends = table(spark, d, "events").agg(F.min("ts").alias("low"), F.max("ts").alias("high")).first()
    low, high = F.unix_micros(F.lit(ends["low"]).cast("timestamp")), F.unix_micros(F.lit(ends["high"]).cast("timestamp"))
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return arrivals(spark, d, F.least(F.floor(5 * (at - low) / (high - low + 1)), F.lit(4)))


@query("stream_alerts_files", ALERTS)
def stream_alerts_files(spark, d):
    """The same from loads in the order of time."""
    return _alerts(spark, in_time_order(spark, d))


@query("stream_alerts_expiring", ALERTS.replace("SELECT *, count(*) OVER last3", """SELECT *, created_at - lag(created_at, 1) OVER own <= INTERVAL '2 days'
  AND lag(created_at, 1) OVER own - lag(created_at, 2) OVER own <= INTERVAL '2 days' AS near, count(*) OVER last3""").replace(
    "  WINDOW last3", "  WINDOW own AS (PARTITION BY user_id ORDER BY created_at, id), last3") + " AND near")
def stream_alerts_expiring(spark, d):
    """Ratings more than two days apart belong to no common streak; the state of users silent for as long is dropped."""
    return _alerts(spark, in_time_order(spark, d), retention="2 days", lateness="0 seconds")


CUT = "(SELECT min(created_at) + (max(created_at) - min(created_at)) / 2 FROM history)"


@query("stream_alerts_seeded", f"{ALERTS} AND created_at >= {CUT}")
def stream_alerts_seeded(spark, d):
    """A stream of the later half of the events that begins with what the earlier half left."""
    history, path = as_history(table(spark, d, "events")), scratch_path(spark, "seed")
    cut = history.agg(F.expr("min(created_at) + (max(created_at) - min(created_at)) / 2")).first()[0]
    seed = streams.last_ratings(history.where(F.col("created_at") < F.lit(cut)), 3)
    seed.coalesce(1).write.parquet(path)
    later = events_stream(spark, d).where(F.col("ts") >= F.lit(cut))
    return _alerts(spark, [later], seed=streams.read_stream(spark, path, seed.schema))


@query("stream_compacted_counts", DAILY)
def stream_compacted_counts(spark, d):
    """Parts of the batches that the stream has committed, merged twice: half of them first, then base and rest."""
    base = scratch_path(spark, "stream")
    sinks.finish(sinks.write_parts(as_history(scattered(spark, d)), streams.daily_parts, f"{base}/parts", f"{base}/checkpoint"))
    last = sinks.committed(spark, f"{base}/checkpoint")
    for upto in (last // 2, last):
        sinks.compact(spark, f"{base}/parts", upto, streams.daily_counts)
    return streams.daily_counts(sinks.all_parts(spark, f"{base}/parts"))
