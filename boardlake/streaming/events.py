"""Streaming forms of the event-log rules.

Functions take and return streaming (or batch) DataFrames, sinks take micro-batches. State is bounded
by a watermark in the state store, or is a table of one row per key that expires.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import audit, scoring
from ..operators.lineage import ALLOWED_TRANSITIONS, TERMINAL
from ..operators.ordered import HOT_KEY_ROWS, ordered
from .sinks import KeyedState, append_new_keys, save_batch, split_batch


def audit_records(requests: DataFrame, method: Column, path: Column, status: Column) -> DataFrame:
    """Audited requests with action, resource and outcome; stateless."""
    kind, key = audit.resource_parts(path)
    return requests.select(
        "*", audit.action(method).alias("action"), kind.alias("resource_type"), key.alias("resource_id"),
        audit.outcome(status).alias("outcome"),
    ).where(F.col("action").isNotNull())


def once_per_key(events: DataFrame, key: str, time: str, lateness: str) -> DataFrame:
    """First event of a key within the lateness; later repeats are for the sink to find."""
    return events.withWatermark(time, lateness).dropDuplicatesWithinWatermark([key])


def outbox_sink(key: str):
    """Sink that stores one event per key, ever: recent repeats end in the stream's state, older ones here."""
    return lambda batch, batch_id, folder: append_new_keys(batch, batch_id, folder, key)


def freshness_route(events: DataFrame, arrival: Column, observed: Column, tolerance: float) -> DataFrame:
    """Route by age: outside [0, tolerance] goes to the side output."""
    age = scoring.age_seconds(arrival, observed)
    return events.withColumn("route", F.when(scoring.is_stale(age, tolerance), "stale").otherwise("accepted"))


def route_sink(batch: DataFrame, batch_id: int, folder: str) -> None:
    """Accepted rows into one table, stale ones into another."""
    split_batch(batch, batch_id, folder, {r: F.col("route") == r for r in ("accepted", "stale")})


def windowed_kpis(events: DataFrame, time: str, lateness: str, size: str, slide: str | None = None) -> DataFrame:
    """Counts and yield per tumbling or sliding window."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return (
        events.withWatermark(time, lateness).groupBy(w.alias("w"))
        .agg(
            F.count(F.lit(1)).alias("total"), F.count_if(F.col("result") == "PASS").alias("pass_count"),
            F.count_if(F.col("result") == "FAIL").alias("fail_count"),
        )
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "total", "pass_count", "fail_count")
    )


def activity_sessions(events: DataFrame, key: str, time: str, gap: str, lateness: str) -> DataFrame:
    return (
        events.withWatermark(time, lateness).groupBy(key, F.session_window(time, gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("event_count"))
        .select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "event_count")
    )


def latest_alias(events: DataFrame) -> DataFrame:
    return events.groupBy("model_id", "alias").agg(F.max_by("next_version", "id").alias("version"))


def enriched(events: DataFrame, users: DataFrame, key: str) -> DataFrame:
    """Stream joined to a static table."""
    return events.join(users, key)


def _transition(previous: Column, status: Column) -> Column:
    """The verdict on a status after the one before it (null: none)."""
    allowed = F.lit(False)
    for source, targets in ALLOWED_TRANSITIONS.items():
        allowed = allowed | ((previous == source) & status.isin(*targets))
    return F.when(previous.isNull(), "ok").when(previous.isin(*TERMINAL), "after-terminal").when(allowed, "ok").otherwise("illegal-transition")


def transition_sink(ttl_ms: int, hot_rows: int = HOT_KEY_ROWS):
    """Sink for events (``user_id, event_id, at, status``) that stores each one's verdict.

    A job's last status is the state; it counts for ``ttl_ms`` of event time, and is dropped when the events are
    past that. Rows of a job are put in order by Spark, so a job may bring any number of them
    in a micro-batch.
    """

    def sink(batch: DataFrame, batch_id: int, folder: str) -> None:
        spark = batch.sparkSession
        state = KeyedState(f"{folder}-state", "user_id bigint, event_id bigint, at bigint, status string")
        events = batch.select("user_id", "event_id", "at", "status").persist()
        try:
            rows = events.withColumn("new", F.lit(True)).unionByName(state.load(spark, batch_id).withColumn("new", F.lit(False)))
            told = ordered(rows, ["user_id"], ["at", "event_id"], previous={"p_status": "status", "p_at": "at"}, hot_rows=hot_rows)
            previous = F.when(F.col("at") - F.col("p_at") <= ttl_ms, F.col("p_status"))
            verdict = told.where("new").select("event_id", "user_id", "status", _transition(previous, F.col("status")).alias("issue"))
            save_batch(verdict, batch_id, folder)
            last = rows.groupBy("user_id").agg(F.max_by(F.struct("event_id", "at", "status"), F.struct("at", "event_id")).alias("l")).select("user_id", "l.*")
            state.store(last.where(F.col("at") >= _latest(events, state, spark, batch_id) - ttl_ms), batch_id)
        finally:
            events.unpersist()

    return sink


def orphan_sink(timeout_ms: int, lateness_ms: int, hot_rows: int = HOT_KEY_ROWS):
    """Sink for events (``user_id, event_id, at, status``) that stores the events after which a job timed out.

    A job times out when its last event is not terminal and nothing follows for ``timeout_ms`` of event time: seen when the
    next event comes, or when the watermark (latest event less the lateness) is past it. Only jobs that may still
    time out are kept as state.
    """

    def sink(batch: DataFrame, batch_id: int, folder: str) -> None:
        spark = batch.sparkSession
        state = KeyedState(f"{folder}-state", "user_id bigint, event_id bigint, at bigint, status string")
        events = batch.select("user_id", "event_id", "at", "status").persist()
        try:
            rows = events.unionByName(state.load(spark, batch_id))
            active = ~F.col("status").isin(*TERMINAL)
            told = ordered(rows.withColumn("active", active), ["user_id"], ["at", "event_id"], previous={"p_event": "event_id", "p_at": "at", "p_active": "active"}, hot_rows=hot_rows)
            late = told.where(F.col("p_active") & (F.col("at") - F.col("p_at") >= timeout_ms)).select(F.col("p_event").alias("event_id"), "user_id")
            last = rows.groupBy("user_id").agg(F.max_by(F.struct("event_id", "at", "status"), F.struct("at", "event_id")).alias("l")).select("user_id", "l.*").where(active)
            over = F.col("at") + timeout_ms <= _latest(events, state, spark, batch_id) - lateness_ms
            found = late.unionByName(last.where(over).select("event_id", "user_id"))
            save_batch(found.withColumn("recovered_status", F.lit("failed")), batch_id, folder)
            state.store(last.where(~over), batch_id)
        finally:
            events.unpersist()

    return sink


def _latest(events: DataFrame, state: KeyedState, spark, batch_id: int) -> int:
    """Time of the latest event up to this micro-batch."""
    found = events.agg(F.max("at")).first()[0]
    return found if found is not None else (state.load(spark, batch_id).agg(F.max("at")).first()[0] or 0)
