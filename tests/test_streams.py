"""Streams: sinks that repeat without effect, closed windows, jobs with very many events, empty input."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from boardlake.operators.lineage import ALLOWED_TRANSITIONS, TERMINAL
from boardlake.streaming import events as st
from boardlake.streaming.replay import replay
from boardlake.streaming.sinks import KeyedState, append_new_keys, split_batch

START = dt.datetime(2026, 1, 1)
HOUR = 3_600_000


def test_a_repeated_micro_batch_adds_nothing(spark, tmp_path):
    folder = str(tmp_path / "outbox")
    batches = [[("a", 1), ("b", 2), ("a", 3)], [("b", 4), ("c", 5)], [("a", 6), ("d", 7), ("c", 8)]]
    frames = [spark.createDataFrame(b, "key string, n int") for b in batches]
    for i in (0, 1, 1, 2, 1, 2):
        append_new_keys(frames[i], i, folder, "key")
    got = sorted((r["key"], r["batch_id"]) for r in spark.read.parquet(folder).collect())
    assert got == [("a", 0), ("b", 0), ("c", 1), ("d", 2)]


def test_routes_have_tables_of_their_own(spark, tmp_path):
    rows = spark.createDataFrame([(1, "accepted"), (2, "stale"), (3, None)], "id int, route string")
    for _ in range(2):
        st.route_sink(rows, 0, str(tmp_path))
    assert [r["id"] for r in spark.read.parquet(str(tmp_path / "accepted")).collect()] == [1]
    assert [r["id"] for r in spark.read.parquet(str(tmp_path / "stale")).collect()] == [2]
    split_batch(rows.limit(0), 1, str(tmp_path), {"stale": F.col("route") == "stale"})
    assert spark.read.parquet(str(tmp_path / "stale")).count() == 1


def test_state_keeps_its_last_versions(spark, tmp_path):
    state = KeyedState(str(tmp_path / "s"), "k int, v int")
    assert state.load(spark, 0).count() == 0
    for i in range(4):
        state.store(spark.createDataFrame([(1, i)], "k int, v int"), i)
    assert state.load(spark, 4).collect() == [(1, 3)] and state.load(spark, 3).collect() == [(1, 2)]
    assert sorted(p.name for p in (tmp_path / "s").iterdir()) == ["version=2", "version=3"]


@pytest.fixture(scope="module")
def jobs(spark):
    """One job with a third of all events, many with few."""
    rng = random.Random(6)
    rows = []
    for i in range(900):
        user = 0 if i % 3 == 0 else rng.randrange(1, 40)
        at = START + dt.timedelta(minutes=rng.randrange(6 * 24 * 60))
        rows.append((i, user, at, rng.choice([*ALLOWED_TRANSITIONS, *TERMINAL])))
    return rows, spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, status string").repartition(5)


def timed(e):
    return e.select("user_id", "event_id", F.unix_millis("ts").alias("at"), "status")


@pytest.mark.parametrize("hot_rows", [1_000_000, 50])
def test_transitions_of_a_long_job(spark, jobs, hot_rows):
    rows, frame = jobs
    got = {r["event_id"]: r["issue"] for r in replay(frame, timed, "t", sink=st.transition_sink(8 * HOUR, hot_rows)).collect()}
    want, last = {}, {}
    for i, user, at, status in sorted(rows, key=lambda r: (r[2], r[0])):
        p_at, p = last.get(user, (None, None))
        if p is not None and at - p_at > dt.timedelta(hours=8):
            p = None
        want[i] = "ok" if p is None else "after-terminal" if p in TERMINAL else "ok" if status in ALLOWED_TRANSITIONS.get(p, []) else "illegal-transition"
        last[user] = (at, status)
    assert got == want


@pytest.mark.parametrize("hot_rows", [1_000_000, 50])
def test_orphans_of_a_long_job(spark, jobs, hot_rows):
    rows, frame = jobs
    found = replay(frame, timed, "o", sink=st.orphan_sink(3 * HOUR, HOUR, hot_rows), close_after="1 DAY")
    want, by_user = set(), {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        by_user.setdefault(r[1], []).append(r)
    for events in by_user.values():
        for a, b in zip(events, [*events[1:], None]):
            if a[3] not in TERMINAL and (b is None or b[2] - a[2] >= dt.timedelta(hours=3)):
                want.add(a[0])
    got = [r["event_id"] for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_open_windows_and_sessions_close(spark, jobs):
    rows, frame = jobs
    totals = replay(frame.withColumn("result", F.lit("PASS")), lambda e: st.windowed_kpis(e, "ts", "1 hour", "1 day"), "w", close_after="3 DAYS")
    assert totals.agg(F.sum("total")).first()[0] == len(rows)
    sessions = replay(frame, lambda e: st.activity_sessions(e, "user_id", "ts", "2 hours", "1 hour"), "s", close_after="3 DAYS")
    assert sessions.agg(F.sum("event_count")).first()[0] == len(rows)


def test_no_events_give_no_rows(spark, jobs):
    none = jobs[1].limit(0)
    assert replay(none, lambda e: st.activity_sessions(e, "user_id", "ts", "2 hours", "1 hour"), "n").columns == ["user_id", "session_start", "session_end", "event_count", "batch_id"]
    assert replay(none, timed, "n").count() == 0
