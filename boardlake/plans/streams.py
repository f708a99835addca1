"""Streams over the stored events, run to completion and compared with batch results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import events as st
from ..operators import lineage as op
from ..sources.storage import fresh_path
from ..streaming.replay import latest_state, replay, replayed
from ..streaming.sinks import append_new_keys
from .catalog import query
from .lineage import ALIAS_SQL, METHOD_CASE, PAIRS, STATE_CASE

LATENESS, LATENESS_MS, HOUR_MS = "1 hour", 3_600_000, 3_600_000
TTL_MS = 36 * HOUR_MS


@query("m01_audit_stream", f"""
SELECT event_id, CASE method WHEN 'POST' THEN 'create' WHEN 'DELETE' THEN 'delete' ELSE 'update' END AS action, event_type AS resource_type,
  cast(user_id AS varchar) AS resource_id, CASE WHEN 200 + floor(value) < 400 THEN 'success' ELSE 'failure' END AS outcome
FROM (SELECT *, {METHOD_CASE} AS method FROM events) WHERE method <> 'GET'
""")
def audit_stream(t):
    path = F.concat(F.lit("/api/"), "event_type", F.lit("/"), F.col("user_id").cast("string"))
    records = replay(
        t.events, lambda e: st.audit_records(e, F.expr(METHOD_CASE), path, 200 + F.floor("value")), "audit"
    )
    return records.select("event_id", "action", "resource_type", "resource_id", "outcome")


@query("m02_once_per_key", "SELECT DISTINCT user_id || ':' || event_type || ':' || props AS idempotency_key FROM events")
def once_per_key(t):
    key = F.concat_ws(":", F.col("user_id").cast("string"), "event_type", "props").alias("idempotency_key")
    first = replay(
        t.events, lambda e: st.once_per_key(e.select("ts", key), "idempotency_key", "ts", LATENESS), "once",
        sink=st.outbox_sink("idempotency_key"),
    )
    return first.select("idempotency_key")


@query("m03_freshness_gate", """
SELECT event_id, CASE WHEN value - 5 < 0 OR value - 5 > 60 THEN 'stale' ELSE 'accepted' END AS route FROM events
""")
def freshness_gate(t):
    """Both tables read back; the route is the name of the table."""
    observed = F.expr("timestamp_micros(unix_micros(ts) - cast(round((value - 5) * 1000000) AS bigint))")
    folder = replayed(
        t.events, lambda e: st.freshness_route(e, F.col("ts"), observed, 60.0).select("event_id", "route"), "freshness", sink=st.route_sink
    )
    tables = [t.spark.read.parquet(f"{folder}/{r}").select("event_id", F.lit(r).alias("route")) for r in ("accepted", "stale")]
    return tables[0].unionByName(tables[1])


@query("a08_outbox_sink", f"""
SELECT id || ':' || channel || ':inspection-completed:v1' AS idempotency_key, result_id, channel FROM (
 SELECT id, result_id, 'plc' AS channel FROM v_run WHERE status = 'completed' AND plc_enabled
 UNION ALL SELECT id, result_id, 'mes' FROM v_run WHERE status = 'completed' AND mes_enabled)
""")
def outbox_sink(t):
    """Three deliveries of runs that overlap, the second one twice, appended to the outbox."""
    folder = fresh_path(t.spark, "outbox")
    third = F.pmod(F.xxhash64("result_id"), F.lit(3))
    for batch_id, part in ((0, third <= 1), (1, third >= 1), (1, third >= 1), (2, third != 1)):
        append_new_keys(op.outbox_events(t.v_run.where(part)), batch_id, folder, "idempotency_key")
    return t.spark.read.parquet(folder).select("idempotency_key", "result_id", "channel")


def kpis(t, *window):
    result = F.when(F.col("value") < 20, "PASS").otherwise("FAIL")
    closed = replay(
        t.events, lambda e: st.windowed_kpis(e.withColumn("result", result), "ts", LATENESS, *window), "kpis", slices=2, close_after="3 DAYS"
    )
    return closed.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "total", "pass_count", "fail_count")


@query("m04_tumbling_kpis", """
SELECT cast(time_bucket(INTERVAL 1 DAY, ts) AS timestamp) AS window_start, count(*) AS total, count(*) FILTER (WHERE value < 20) AS pass_count,
  count(*) FILTER (WHERE value >= 20) AS fail_count FROM events GROUP BY 1
""")
def tumbling_kpis(t):
    return kpis(t, "1 day")


@query("m04_sliding_kpis", """
WITH e AS (SELECT value, time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR * o.range AS w FROM events CROSS JOIN range(2) o)
SELECT cast(w AS timestamp) AS window_start, count(*) AS total, count(*) FILTER (WHERE value < 20) AS pass_count, count(*) FILTER (WHERE value >= 20) AS fail_count FROM e GROUP BY 1
""")
def sliding_kpis(t):
    return kpis(t, "1 day", "12 hours")


@query("m05_activity_sessions", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS starts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 s AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS event_count FROM s GROUP BY user_id, n
""")
def activity_sessions(t):
    closed = replay(t.events, lambda e: st.activity_sessions(e, "user_id", "ts", "6 hours", LATENESS), "sessions", close_after="3 DAYS")
    return closed.select(
        "user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"),
        F.col("session_end").cast("timestamp_ntz").alias("session_end"), "event_count",
    )


def job_events(e):
    return e.select("user_id", "event_id", F.unix_millis("ts").alias("at"), F.expr(STATE_CASE).alias("status"))


@query("m06_transition_stream", f"""
SELECT event_id, user_id, status, CASE WHEN p IS NULL OR t_ms - p_ms > {TTL_MS} THEN 'ok' WHEN p IN ('completed', 'failed', 'cancelled') THEN 'after-terminal'
  WHEN p || '>' || status IN ({PAIRS}) THEN 'ok' ELSE 'illegal-transition' END AS issue
FROM (SELECT event_id, user_id, {STATE_CASE} AS status, epoch_ms(ts) AS t_ms, lag({STATE_CASE}) OVER w AS p, lag(epoch_ms(ts)) OVER w AS p_ms FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id))
""")
def transition_stream(t):
    issues = replay(t.events, job_events, "transitions", sink=st.transition_sink(TTL_MS))
    return issues.select("event_id", "user_id", "status", "issue")


@query("m07_orphan_timeout", f"""
WITH n AS (SELECT event_id, user_id, {STATE_CASE} AS status, epoch_ms(ts) AS t_ms, lead(epoch_ms(ts)) OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS nxt FROM events)
SELECT event_id, user_id, 'failed' AS recovered_status FROM n WHERE status NOT IN ('completed', 'failed', 'cancelled')
  AND coalesce(nxt - t_ms >= {12 * 3_600_000}, TRUE)
""")
def orphan_timeout(t):
    orphans = replay(t.events, job_events, "orphans", sink=st.orphan_sink(12 * HOUR_MS, LATENESS_MS), close_after="3 DAYS")
    return orphans.select("event_id", "user_id", "recovered_status")


@query("m08_stream_static_join", "SELECT event_id, full_name FROM events JOIN v_user ON v_user.id = events.user_id")
def stream_static_join(t):
    users = t.v_user.select(F.col("id").alias("user_id"), "full_name")
    return replay(t.events, lambda e: st.enriched(e, users, "user_id"), "enriched").select("event_id", "full_name")


@query("m09_latest_alias_stream", ALIAS_SQL)
def latest_alias_stream(t):
    columns = [
        F.col("event_id").alias("id"), (F.col("user_id") % 20).alias("model_id"),
        F.when(F.col("event_type").isin("view", "click"), "candidate").otherwise("champion").alias("alias"),
        (F.col("event_id") % 7 + 1).alias("next_version"),
    ]
    updates = replay(t.events, lambda e: st.latest_alias(e.select(*columns)), "aliases", "update")
    return latest_state(updates, ["model_id", "alias"])
