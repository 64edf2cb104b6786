"""Streaming forms of the activity, alert and request operators.

Counts per day, window and label are summed per batch and written; reading sums
the parts of all batches. So no watermark is needed, a late row counts in its
place, and the result doesn't depend on how many files a batch holds. The
per-user operators keep a small state per user; where the order allows, every
task reduces its rows ahead of the shuffle (to the last ``n`` per user, or to a
count), so a hot user sends a few rows per task.
"""

from __future__ import annotations

from bisect import bisect

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from larder.operators.activity import rated
from larder.operators.preferences import usable_prefs
from larder.operators.requests import LABELS, bucket_counts, labelled

def read_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(path)


def _window_start(col: str, width: str) -> Column:
    return F.window(F.col(col).cast("timestamp"), width)["start"].cast("timestamp_ntz")


def daily_parts(events: DataFrame) -> DataFrame:
    """Rows per calendar day of one batch."""
    return events.groupBy(F.to_date("created_at").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def daily_counts(parts: DataFrame) -> DataFrame:
    """Rows per calendar day, from the parts of all batches."""
    return parts.groupBy("day").agg(F.sum("n").alias("n"))


def approval_parts(events: DataFrame, slide: str = "1 day") -> DataFrame:
    """Likes and dislikes of one batch per slide of the window."""
    score = F.col("feedback_score")
    return rated(events).groupBy(_window_start("created_at", slide).alias("slide_start")).agg(
        F.count_if(score == 2).alias("likes"), F.count_if(score == 1).alias("dislikes"))


def approval(parts: DataFrame, slides: int = 7, slide: str = "1 day") -> DataFrame:
    """Likes, dislikes and approval rate per sliding window of ``slides`` slides, from the parts of all batches."""
    summed = parts.groupBy("slide_start").agg(F.sum("likes").alias("likes"), F.sum("dislikes").alias("dislikes"))
    back = F.transform(F.sequence(F.lit(0), F.lit(slides - 1)), lambda i: F.col("slide_start") - i * F.expr(f"INTERVAL '{slide}'"))
    counts = summed.withColumn("window_start", F.explode(back)).groupBy("window_start").agg(
        F.sum("likes").alias("likes"), F.sum("dislikes").alias("dislikes"))
    return counts.withColumn("approval_rate", F.col("likes") / (F.col("likes") + F.col("dislikes")))


def request_parts(requests: DataFrame, window: str = "1 minute", time_col: str = "created_at") -> DataFrame:
    """Request count, latency sum and cumulative buckets of one batch per window and label set."""
    d = F.col("duration_s")
    return labelled(requests).groupBy(_window_start(time_col, window).alias("window_start"), *LABELS).agg(
        F.count(F.lit(1)).alias("n"), F.sum(d).alias("sum_s"), *bucket_counts(d))


def request_stats(parts: DataFrame) -> DataFrame:
    """Request count, latency sum and cumulative buckets per window and label set, from the parts of all batches."""
    keys = ["window_start", *LABELS]
    return parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in parts.columns if c not in keys])


RATING = "user_id bigint, ts timestamp, at bigint, id bigint, score int"
KEPT = "at array<bigint>, id array<bigint>, score array<int>"


def _newest(rows: list, n: int) -> list:
    """The last ``n`` (time, id, score) rows, newest first."""
    return sorted(rows, reverse=True)[:n]


def _ratings(events: DataFrame) -> DataFrame:
    at = F.col("created_at").cast("timestamp")
    return rated(events).select(
        F.col("user_id").cast("bigint").alias("user_id"), at.alias("ts"), F.unix_micros(at).alias("at"), F.col("id").cast("bigint").alias("id"),
        F.col("feedback_score").cast("int").alias("score"),
    )


def last_ratings(history: DataFrame, n: int = 5) -> DataFrame:
    """The last ``n`` ratings of every user of a table: what a stream of later ratings starts from, as ``seed``."""
    newest = Window.partitionBy("user_id").orderBy(F.desc("at"), F.desc("id"))
    return _ratings(history).withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= n).drop("_rank")


def _micros(interval: str) -> int:
    return round(pd.Timedelta(interval).total_seconds() * 1_000_000)


def _per_user(ratings: DataFrame, update, out: str, retention: str | None, lateness: str) -> DataFrame:
    """``update`` per user; with a retention the state of a user ends when the stream's time has passed the last rating by as much."""
    timeout = GroupStateTimeout.NoTimeout
    if retention is not None:
        ratings, timeout = ratings.withWatermark("ts", lateness), GroupStateTimeout.EventTimeTimeout
    return ratings.groupBy("user_id").applyInPandasWithState(update, out, KEPT, "update", timeout)


def _keep(state: GroupState, kept: list, span: int | None) -> None:
    """Store the ratings; with a retention, until it has passed since the last of them.

    A batch may hold ratings as far behind the stream's time that it has passed already: no rating still to come is near enough.
    """
    end = None if span is None else (max(kept)[0] + span) // 1000 + 1
    if end is not None and end <= state.getCurrentWatermarkMs():
        if state.exists:
            state.remove()
        return
    state.update(tuple(list(c) for c in zip(*kept)))
    if end is not None:
        state.setTimeoutTimestamp(end)


def stream_user_streaks(
    events: DataFrame, n: int = 5, retention: str | None = None, lateness: str = "1 hour", seed: DataFrame | None = None,
) -> DataFrame:
    """Per user and batch with ratings: whether the last ``n`` ratings are all dislikes by the end of the batch.

    The state is the last ``n`` ratings by time, so a late rating takes its
    place among them, and one older than all of them changes nothing. For
    ``retention``, ``lateness`` and ``seed`` see ``stream_streak_alerts``.
    """
    span = None if retention is None else _micros(retention)

    def shrink(batches):
        for pdf in batches:
            yield pdf.sort_values(["at", "id"], ascending=False).groupby("user_id", sort=False).head(n)

    def update(key, chunks, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        kept = list(zip(*state.get)) if state.exists else []
        for pdf in chunks:
            new = zip(pdf["at"].tolist(), pdf["id"].tolist(), pdf["score"].tolist())
            kept = _newest([*kept, *new], n)
        _keep(state, kept, span)
        streak = len(kept) == n and all(score == 1 for _, _, score in kept) and _unbroken([a for a, _, _ in reversed(kept)], span)
        yield pd.DataFrame({
            "user_id": [key[0]], "n_ratings": [len(kept)], "streak": [streak], "last_at": [kept[0][0]],
        })

    ratings = _ratings(events)
    ratings = ratings if seed is None else ratings.unionByName(seed.select(ratings.columns))
    return _per_user(
        ratings.mapInPandas(shrink, RATING), update, "user_id bigint, n_ratings int, streak boolean, last_at bigint", retention, lateness,
    ).withColumn("last_rating_at", F.timestamp_micros("last_at").cast("timestamp_ntz")).drop("last_at")


def _unbroken(times: list, span: int | None) -> bool:
    """Whether times in order lie no further apart than the retention."""
    return span is None or all(b - a <= span for a, b in zip(times, times[1:]))


def stream_streak_alerts(
    events: DataFrame, n: int = 5, retention: str | None = None, lateness: str = "1 hour", seed: DataFrame | None = None,
) -> DataFrame:
    """One row per dislike whose last ``n`` ratings of its user are all dislikes: user_id, id, n_ratings, rated_at.

    The rows are the same for any number of files per batch as long as later
    files hold later ratings. A rating that comes behind others of its user takes
    its place among the last ``n`` and is judged there; ratings that were judged
    before are not judged again, and one older than all of them says nothing.
    A user's ratings of a batch are ordered in one task, ``n`` are kept as state.

    With ``retention``, ratings further apart than it belong to no common streak,
    so the state of a user who has been silent for as long is dropped and nothing
    is lost by it; a rating more than ``lateness`` behind the newest one read
    before is left out. ``seed``, a stream of ``last_ratings`` of an earlier table
    that arrives with the first batch, is what users begin with; its ratings are
    not judged.
    """
    span = None if retention is None else _micros(retention)

    def update(key, chunks, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        kept = sorted(zip(*state.get)) if state.exists else []
        new = sorted(r for pdf in chunks for r in zip(pdf["at"].tolist(), pdf["id"].tolist(), pdf["score"].tolist(), pdf["seeded"].tolist()))
        found = []
        for *rating, seeded in new:
            rating = tuple(rating)
            if len(kept) == n and rating < kept[0]:
                continue
            at = bisect(kept, rating)
            kept.insert(at, rating)
            last = kept[max(0, at + 1 - n):at + 1]
            if not seeded and len(last) == n and all(score == 1 for _, _, score in last) and _unbroken([a for a, _, _ in last], span):
                found.append((key[0], rating[1], n, rating[0]))
            del kept[:-n]
        _keep(state, kept, span)
        yield pd.DataFrame(found, columns=["user_id", "id", "n_ratings", "at"])

    ratings = _ratings(events).withColumn("seeded", F.lit(False))
    if seed is not None:
        ratings = ratings.unionByName(seed.withColumn("seeded", F.lit(True)).select(ratings.columns))
    return _per_user(
        ratings, update, "user_id bigint, id bigint, n_ratings int, at bigint", retention, lateness,
    ).withColumn("rated_at", F.timestamp_micros("at").cast("timestamp_ntz")).drop("at")


def stream_threshold(prefs: DataFrame, n: int = 50, null_skipped: str = "keep") -> DataFrame:
    """One row per user when the usable preferences reach ``n``, also where a bulk load jumps over it."""
    users = usable_prefs(prefs, null_skipped).select("user_id")

    def count(batches):
        for pdf in batches:
            yield pdf.groupby("user_id", sort=False).size().reset_index(name="n")

    def update(key, chunks, state: GroupState):
        before = state.get[0] if state.exists else 0
        total = before + sum(int(pdf["n"].sum()) for pdf in chunks)
        state.update((total,))
        if before < n <= total:
            yield pd.DataFrame({"user_id": [key[0]], "preference_count": [total]})

    counts = users.mapInPandas(count, "user_id bigint, n bigint")
    return counts.groupBy("user_id").applyInPandasWithState(
        update, "user_id bigint, preference_count bigint", "n bigint", "update", GroupStateTimeout.NoTimeout,
    )
