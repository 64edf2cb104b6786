"""Streams over several files give what the batch operators give on the same events."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from larder.operators.activity import user_streaks
from larder.operators.preferences import usable_counts
from larder.plans import stream_queries
from larder.plans.bindings import as_history
from larder.sources.readers import read_request_log
from larder.session import scratch_path, shared_folder
from larder.streaming import sinks, streams

SCHEMA = "id bigint, user_id bigint, feedback_score int, created_at timestamp_ntz, chosen_variant string, skipped boolean"
START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def events(spark):
    rows = []
    for i in range(900):
        user = 0 if i % 3 == 0 else i % 17
        late = timedelta(hours=-30) if i % 50 == 0 else timedelta()
        rows.append((i, user, 1 if (i * 7919) % 10 < 8 else 2, START + timedelta(minutes=10 * i) + late, "A", None if i % 2 else False))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def stream(spark, events):
    """The events as files that arrive one after the other, late rows in a later file than their time says."""
    path = scratch_path(spark, "events")
    for n in range(5):
        events.filter(f"id >= {180 * n} AND id < {180 * (n + 1)}").coalesce(1).write.parquet(f"{path}/{n}")
    return streams.read_stream(spark, f"{path}/*", events.schema, files_per_batch=1)


def final(spark, stream, keys):
    base = scratch_path(spark, "run")
    query = sinks.finish(sinks.write_updates(stream, f"{base}/rows", f"{base}/checkpoint"))
    return sinks.latest_updates(spark, f"{base}/rows", keys), query


def test_streaks(spark, events, stream, rows):
    got, _ = final(spark, streams.stream_user_streaks(stream), ["user_id"])
    assert rows(got.filter("streak").select("user_id", "last_rating_at")) == rows(user_streaks(events).select("user_id", "last_rating_at"))


def test_threshold_fires_once(spark, events, stream):
    base = scratch_path(spark, "run")
    sinks.finish(sinks.write_updates(streams.stream_threshold(stream, 30), f"{base}/rows", f"{base}/checkpoint"))
    fired = [r.user_id for r in spark.read.parquet(f"{base}/rows").collect()]
    ready = [r.user_id for r in usable_counts(events).filter("n >= 30").collect()]
    assert sorted(fired) == sorted(ready) and len(fired) > 1


def counted(spark, stream, part, whole):
    base = scratch_path(spark, "run")
    sinks.finish(sinks.write_parts(stream, part, f"{base}/parts", f"{base}/checkpoint"), timeout=300)
    return whole(sinks.all_parts(spark, f"{base}/parts"))


def test_daily_counts_hold_late_rows(spark, events, stream, rows):
    got = counted(spark, stream, streams.daily_parts, streams.daily_counts)
    assert rows(got) == rows(events.groupBy(F.to_date("created_at")).count())


def brute_alerts(events, n):
    """Every dislike whose last n ratings, by time, are dislikes."""
    users = {}
    for r in sorted(events.filter("feedback_score IN (1, 2)").collect(), key=lambda r: (r.created_at, r.id)):
        users.setdefault(r.user_id, []).append((r.feedback_score, r.id))
    return sorted((u, x[1]) for u, own in users.items() for i, x in enumerate(own) if i + 1 >= n and all(s == 1 for s, _ in own[i + 1 - n:i + 1]))


def test_alerts_for_any_number_of_files(spark, events):
    few = events.filter("id < 60").withColumn("created_at", F.expr("timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, 0, id)"))
    want = brute_alerts(few, 3)
    assert len(want) > 3
    for size in (60, 7):
        path = scratch_path(spark, "events")
        for n in range(0, 60, size):
            few.filter(f"id >= {n} AND id < {n + size}").coalesce(1).write.parquet(f"{path}/{n}")
        stream = streams.stream_streak_alerts(streams.read_stream(spark, f"{path}/*", few.schema, files_per_batch=1), 3)
        base = scratch_path(spark, "run")
        sinks.finish(sinks.write_updates(stream, f"{base}/rows", f"{base}/checkpoint"))
        assert sorted((r.user_id, r.id) for r in spark.read.parquet(f"{base}/rows").collect()) == want


def test_a_stopped_stream_goes_on_where_it_was(spark, events, rows):
    path, base = scratch_path(spark, "events"), scratch_path(spark, "run")
    for half in ("id < 450", "id >= 450"):
        events.filter(half).coalesce(1).write.mode("append").parquet(path)
        stream = streams.stream_user_streaks(streams.read_stream(spark, path, events.schema))
        sinks.finish(sinks.write_updates(stream, f"{base}/rows", f"{base}/checkpoint"))
    got = sinks.latest_updates(spark, f"{base}/rows", ["user_id"])
    assert rows(got.filter("streak").select("user_id", "last_rating_at")) == rows(user_streaks(events).select("user_id", "last_rating_at"))


def test_sliding_approval(spark, events, stream):
    got = counted(spark, stream, streams.approval_parts, lambda parts: streams.approval(parts, slides=2))
    likes, dislikes = got.agg(F.sum("likes"), F.sum("dislikes")).first()
    # Every row is in two windows.
    assert likes + dislikes == 2 * events.count()
    for r in got.collect():
        assert r.approval_rate == r.likes / (r.likes + r.dislikes)


def test_request_log_stream(spark, tmp_path, rows):
    lines = ['{"ts": "2024-01-01T00:00:%02dZ", "method": "GET", "path": "/u/%d", "status": 200, "duration_ms": %d}' % (i, i, 40 * i) for i in range(10)]
    for n in range(2):
        (tmp_path / f"{n}.json").write_text("\n".join(lines[5 * n:5 * n + 5]))
    log = read_request_log(spark, str(tmp_path), streaming=True)
    got = counted(spark, log, lambda batch: streams.request_parts(batch, time_col="ts"), streams.request_stats)
    assert rows(got.select("path", "n", "le_0_05", "le_0_1", "le_10", F.round("sum_s", 6))) == [("/u/:id", 10, 2, 3, 10, 1.8)]


def sums(spark, path):
    return sorted(tuple(r) for r in sinks.all_parts(spark, path).groupBy("k").agg(F.sum("n")).collect())


def folders(path):
    return sorted(p.name for p in path.iterdir() if not p.name.startswith((".", "_aside")))


def test_compaction_keeps_what_is_read(spark, tmp_path):
    path = str(tmp_path)
    for b in range(12):
        spark.createDataFrame([(k, b + k) for k in range(3)], "k int, n long").write.parquet(f"{path}/batch={b}")
    before = sums(spark, path)

    def merge(rows):
        return rows.groupBy("k").agg(F.sum("n").alias("n"))

    def broken(rows):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        sinks.compact(spark, path, 7, broken)
    assert sums(spark, path) == before and len(folders(tmp_path)) == 12
    assert sinks.compact(spark, path, 7, merge) == 7
    assert sums(spark, path) == before and folders(tmp_path) == sorted(["_bases", *(f"batch={b}" for b in range(8, 12))])
    # Broken off between the rename and the removal: what the base holds lies there again.
    spark.createDataFrame([(0, 99)], "k int, n long").write.parquet(f"{path}/batch=3")
    assert sums(spark, path) == before
    assert sinks.compact(spark, path, 7, merge) == 7 and "batch=3" not in folders(tmp_path)
    assert sinks.compact(spark, path, 100, merge) == 11
    assert sums(spark, path) == before and folders(tmp_path) == ["_bases"] and folders(tmp_path / "_bases") == ["upto=11"]
    spark.createDataFrame([(0, 5)], "k int, n long").write.parquet(f"{path}/batch=12")
    assert sums(spark, path) == [(0, before[0][1] + 5), *before[1:]]


def test_compacted_updates(spark, tmp_path):
    path = str(tmp_path)
    for b in range(4):
        spark.createDataFrame([(k, f"{b}") for k in range(b, 6)], "k int, v string").write.parquet(f"{path}/batch={b}")

    def read():
        return sorted(tuple(r) for r in sinks.latest_updates(spark, path, ["k"]).collect())

    before = read()
    sinks.compact(spark, path, 2, lambda rows: sinks.newest_rows(rows, ["k"]))
    assert read() == before == [(0, "0"), (1, "1"), (2, "2"), (3, "3"), (4, "3"), (5, "3")]
    sinks.compact(spark, path, 3, lambda rows: sinks.newest_rows(rows, ["k"]))
    assert read() == before


def test_committed_batches(spark, events, tmp_path):
    assert sinks.committed(spark, str(tmp_path / "none")) is None
    path = scratch_path(spark, "events")
    events.repartition(3).write.parquet(path)
    stream = streams.read_stream(spark, path, events.schema, files_per_batch=1)
    sinks.finish(sinks.write_parts(stream, streams.daily_parts, str(tmp_path / "parts"), str(tmp_path / "check")))
    assert sinks.committed(spark, str(tmp_path / "check")) == 2


def gap_alerts(rows, n, span):
    users = {}
    for r in sorted(rows, key=lambda r: (r.created_at, r.id)):
        users.setdefault(r.user_id, []).append(r)
    out = []
    for user, own in users.items():
        for i in range(n - 1, len(own)):
            last = own[i + 1 - n:i + 1]
            near = all(b.created_at - a.created_at <= span for a, b in zip(last, last[1:]))
            if near and all(r.feedback_score == 1 for r in last):
                out.append((user, own[i].id))
    return sorted(out)


def test_state_of_silent_users_is_dropped(spark):
    # Fifty users rate for a day each, one after the other, and the first comes back at the end.
    rows = [(1000 * u + i, u, 1, START + timedelta(days=u, hours=i), "A", False) for u in range(50) for i in range(4)]
    rows += [(90_000 + i, 0, 1, START + timedelta(days=50, hours=i), "A", False) for i in range(3)]
    path = scratch_path(spark, "events")
    for n in range(10):
        spark.createDataFrame([r for r in rows if (r[3] - START).days // 5 == n or n == 9 and (r[3] - START).days >= 50], SCHEMA).coalesce(1).write.parquet(f"{path}/{n}")
    stream = streams.read_stream(spark, f"{path}/*", SCHEMA, files_per_batch=1)
    base = scratch_path(spark, "run")
    alerts = streams.stream_streak_alerts(stream, 3, retention="2 days", lateness="0 seconds")
    query = sinks.finish(sinks.write_updates(alerts, f"{base}/rows", f"{base}/checkpoint"))
    events = spark.createDataFrame(rows, SCHEMA).collect()
    got = sorted((r.user_id, r.id) for r in spark.read.parquet(f"{base}/rows").collect())
    assert got == gap_alerts(events, 3, timedelta(days=2)) and (0, 90_002) in got and (0, 90_000) not in got
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(held) <= 15


def test_ratings_behind_a_retention_that_has_passed(spark):
    """The second file's ratings are not late for Spark, which asks the time before the batch, but their retention has passed."""
    days = [(0, 0), (1, 12), (0, 1), (0, 1), (0, 1), (2, 13), (2, 13), (2, 13), (2, 14)]
    files = [days[:2], days[2:5], days[5:]]
    rows = [(10 * n + i, user, 1, START + timedelta(days=day, minutes=i), "A", False) for n, f in enumerate(files) for i, (user, day) in enumerate(f)]
    path, base = scratch_path(spark, "events"), scratch_path(spark, "run")
    for n in range(3):
        spark.createDataFrame([r for r in rows if r[0] // 10 == n], SCHEMA).coalesce(1).write.parquet(f"{path}/{n}")
    alerts = streams.stream_streak_alerts(
        streams.read_stream(spark, f"{path}/*", SCHEMA, files_per_batch=1), 3, retention="2 days", lateness="0 seconds")
    sinks.finish(sinks.write_updates(alerts, f"{base}/rows", f"{base}/checkpoint"))
    got = sorted((r.user_id, r.id) for r in spark.read.parquet(f"{base}/rows").collect())
    assert got == gap_alerts(spark.createDataFrame(rows, SCHEMA).collect(), 3, timedelta(days=2)) and (0, 11) in got and (2, 23) in got


def test_alerts_of_loads_in_many_files(spark, tmp_path):
    """A table in many files makes loads of many files, each of which spans the whole time of its load."""
    at = F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, int(id * 7 % 4000) * 10)")
    events = spark.range(0, 4000, 1, 16).select(
        F.col("id").alias("event_id"), at.alias("ts"), F.pmod(F.xxhash64("id"), F.lit(50)).alias("user_id"),
        F.when(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(4)) == 0, "purchase").otherwise("error").alias("event_type"),
        F.lit(1.0).alias("value"), F.lit('{"k": 1}').alias("props"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    rated = as_history(spark.read.parquet(f"{tmp_path}/events.parquet")).collect()
    got = sorted((r.user_id, r.id) for r in stream_queries.stream_alerts_expiring(spark, str(tmp_path)).collect())
    want = gap_alerts(rated, 3, timedelta(days=2))
    assert got == want and len(want) < len(gap_alerts(rated, 3, timedelta(days=99)))


def test_a_stream_begins_with_what_a_table_left(spark, events):
    rated = [r for r in events.collect() if r.feedback_score in (1, 2)]
    cut = START + timedelta(days=3)
    path, seeds, base = (scratch_path(spark, x) for x in ("events", "seed", "run"))
    later = events.where(F.col("created_at") >= F.lit(cut))
    later.coalesce(1).write.parquet(path)
    seed = streams.last_ratings(events.where(F.col("created_at") < F.lit(cut)), 3)
    seed.coalesce(1).write.parquet(seeds)
    alerts = streams.stream_streak_alerts(
        streams.read_stream(spark, path, events.schema), 3, seed=streams.read_stream(spark, seeds, seed.schema))
    sinks.finish(sinks.write_updates(alerts, f"{base}/rows", f"{base}/checkpoint"))
    whole = gap_alerts(rated, 3, timedelta(days=99))
    ids = {r.id for r in rated if r.created_at >= cut}
    want = [x for x in whole if x[1] in ids]
    assert sorted((r.user_id, r.id) for r in spark.read.parquet(f"{base}/rows").collect()) == want and 0 < len(want) < len(whole)


def test_alert_rows_are_written_once_per_batch(spark, tmp_path):
    write = sinks.write_alerts(str(tmp_path), "streak", F.concat(F.lit("u"), F.col("user_id").cast("string")))
    batch = spark.createDataFrame([(1,), (2,)], "user_id bigint")
    write(batch, 4)
    write(batch, 4)
    assert sorted(r.message for r in spark.read.json(str(tmp_path / "*/*/")).collect()) == ["u1", "u2"]


def test_shared_folder_comes_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_folder(spark) == (named or shared_folder(spark)).rstrip("/")
    assert scratch_path(spark, "x").startswith(shared_folder(spark))
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
