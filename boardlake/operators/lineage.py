"""Runs, model versions, settings documents and their event logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.digests import tree_digest
from .ordered import HOT_KEY_ROWS, ordered
from .quantiles import exact_quantiles

# Job states, allowed transitions and stage order.
ALLOWED_TRANSITIONS = {
    "queued": ["preparing-dataset", "cancelled", "failed"],
    "preparing-dataset": ["validating", "cancelling", "failed"],
    "validating": ["training", "cancelling", "failed"],
    "training": ["evaluating", "cancelling", "failed"],
    "evaluating": ["persisting-artifacts", "cancelling", "failed"],
    "persisting-artifacts": ["completed", "cancelling", "failed"],
    "cancelling": ["cancelled", "failed"],
}
TERMINAL = ["completed", "failed", "cancelled"]
STAGES = ["queued", "preparing-dataset", "validating", "training", "evaluating", "persisting-artifacts", "cancelling"]
CHANNELS = ["plc", "mes"]


def outbox_events(runs: DataFrame, stored_keys: DataFrame | None = None) -> DataFrame:
    """One event per completed run and enabled channel, only for keys not yet stored."""
    channels = F.array_compact(F.array(*[F.when(F.col(f"{c}_enabled"), F.lit(c)) for c in CHANNELS]))
    events = runs.where("status = 'completed'").select("id", "result_id", F.explode(channels).alias("channel")).select(
        F.concat_ws(":", "id", "channel", F.lit("inspection-completed"), F.lit("v1")).alias("idempotency_key"),
        "result_id", "channel",
    )
    if stored_keys is None:
        return events
    return events.join(stored_keys.select("idempotency_key"), "idempotency_key", "left_anti")


def null_safe_lookup(requests: DataFrame, documents: DataFrame, identity: list[str]) -> DataFrame:
    """Left join on an identity whose parts may be null."""
    right = documents.select(*[F.col(c).alias(f"_r_{c}") if c in identity else F.col(c) for c in documents.columns])
    same = reduce(lambda a, b: a & b, [requests[c].eqNullSafe(right[f"_r_{c}"]) for c in identity])
    return requests.join(right, same, "left").drop(*[f"_r_{c}" for c in identity])


def version_integrity(versions: DataFrame, artifacts: DataFrame, runs: DataFrame) -> DataFrame:
    """First integrity problem of each model version, or ``ok``."""
    a = artifacts.select("artifact_id", F.col("run_id").alias("artifact_run"))
    r = runs.select("run_id", "run_completed")
    joined = versions.join(a, "artifact_id", "left").join(r, "run_id", "left")
    issue = (
        F.when(F.col("artifact_run").isNull(), "artifact-missing")
        .when(F.col("artifact_run") != F.col("run_id"), "artifact-of-other-run")
        .when(F.col("run_completed").isNull(), "run-missing")
        .when(~F.col("run_completed"), "run-not-completed")
        .when(~F.col("evidence_passed"), "evidence-not-passed")
        .otherwise("ok")
    )
    return joined.withColumn("issue", issue)


def alias_table(events: DataFrame) -> DataFrame:
    """Current version per model and alias, from the latest event."""
    return events.groupBy("model_id", "alias").agg(F.max_by("next_version", "id").alias("version"))


def rollback_targets(events: DataFrame) -> DataFrame:
    """Previous version of the latest event that has one, per model and alias."""
    usable = events.where(F.col("previous_version").isNotNull())
    return usable.groupBy("model_id", "alias").agg(
        F.max("id").alias("source_event"), F.max_by("previous_version", "id").alias("target_version")
    )


def resolve_aliases(aliases: DataFrame, versions: DataFrame) -> DataFrame:
    """Alias to version to artifact digest; unresolved aliases keep a null id."""
    v = versions.select("model_id", "version", F.col("id").alias("version_id"))
    return aliases.join(v, ["model_id", "version"], "left").withColumn("is_resolved", F.col("version_id").isNotNull())


def valid_calibration(runs: DataFrame, calibrations: DataFrame) -> DataFrame:
    """Calibration that covers each run: same station, valid at the run's time.

    A valid one exists exactly when the station's latest expiry lies after the run, so one
    row per station is joined and no run/calibration pairs arise.
    """
    latest = calibrations.groupBy("station_id").agg(
        F.max(F.struct("valid_until", "id")).alias("c")
    ).select("station_id", F.col("c.id").alias("calibration_id"), F.col("c.valid_until").alias("valid_until"))
    covered = F.col("valid_until") > F.col("created_at")
    return runs.join(latest, "station_id", "left").select(
        "id", "station_id", F.when(covered, F.col("calibration_id")).alias("calibration_id"),
        F.coalesce(covered, F.lit(False)).alias("is_calibrated"),
    )


def with_both_versions(events: DataFrame, versions: DataFrame, actors: DataFrame) -> DataFrame:
    """Events with the version rows on both ends and the actor's name."""
    def end(name: str) -> DataFrame:
        return versions.select("model_id", F.col("version").alias(f"{name}_version"), F.col("id").alias(f"{name}_id"))

    return (
        events.join(end("next"), ["model_id", "next_version"], "left")
        .join(end("previous"), ["model_id", "previous_version"], "left")
        .join(actors, "actor_id", "left")
    )


def version_numbers(rows: DataFrame, keys: list[str], order: list[str], hot_rows: int = HOT_KEY_ROWS):
    """Next version number per key for a bulk load, in creation order."""
    return ordered(rows, keys, order, number="version", hot_rows=hot_rows)


def activation_chain(events: DataFrame, key: str, order: list[str], profile: str, hot_rows: int = HOT_KEY_ROWS):
    """Profile active before each activation; null for the first and when unchanged."""
    seen = ordered(events, [key], order, previous={"_before": profile}, hot_rows=hot_rows)
    return seen.withColumn("previous_profile", F.nullif(F.col("_before"), F.col(profile))).drop("_before")


def revision_gaps(versions: DataFrame, key: str, revision: str, order: list[str], hot_rows: int = HOT_KEY_ROWS):
    """Revisions that do not follow their predecessor by one."""
    seen = ordered(versions, [key], order, previous={"previous_revision": revision}, hot_rows=hot_rows)
    expected = F.coalesce(F.col("previous_revision"), F.lit(0)) + 1
    return seen.withColumn("expected_revision", expected).where(F.col(revision) != expected)


def transition_issue(previous: Column, status: Column) -> Column:
    pairs = [f"{a}>{b}" for a, nexts in ALLOWED_TRANSITIONS.items() for b in nexts]
    return (
        F.when(previous.isNull(), "ok")
        .when(previous.isin(TERMINAL), "after-terminal")
        .when(F.concat_ws(">", previous, status).isin(pairs), "ok")
        .otherwise("illegal-transition")
    )


def check_transitions(events: DataFrame, key: str, status: str, order: list[str], hot_rows: int = HOT_KEY_ROWS):
    """Previous status and verdict for each event of a job log."""
    seen = ordered(events, [key], order, previous={"previous_status": status}, hot_rows=hot_rows)
    return seen.withColumn("issue", transition_issue(F.col("previous_status"), F.col(status)))


def check_progress(events: DataFrame, key: str, stage: str, units: str, order: list[str], hot_rows: int = HOT_KEY_ROWS):
    """Stage must not go back; units must grow within a stage."""
    rank = F.array_position(F.array(*[F.lit(s) for s in STAGES]), F.col(stage)).cast("int")
    seen = ordered(
        events.withColumn("_rank", rank), [key], order,
        previous={"_last_rank": "_rank", "_last_units": units}, hot_rows=hot_rows,
    )
    issue = (
        F.when(F.col("_rank") == 0, "unsupported-stage")
        .when(F.col("_rank") < F.col("_last_rank"), "stage-regressed")
        .when((F.col("_rank") == F.col("_last_rank")) & (F.col(units) <= F.col("_last_units")), "units-not-growing")
        .otherwise("ok")
    )
    return seen.withColumn("issue", issue).drop("_rank", "_last_rank", "_last_units")


def evidence_digests(node_runs: DataFrame, key: str, order: list[str], item: Column) -> DataFrame:
    return tree_digest(node_runs, [key], order, item)


def replay_comparison(stored: DataFrame, recomputed: DataFrame, key: str) -> DataFrame:
    s = stored.select(key, F.col("digest").alias("stored_digest"))
    return recomputed.join(s, key, "full_outer").select(
        key, "digest", F.coalesce(F.col("digest") == F.col("stored_digest"), F.lit(False)).alias("replay_matches")
    )


def idempotent_outcomes(requests: DataFrame, keys: list[str], order: str, payload: str) -> DataFrame:
    """First request per key is new; later ones replay it or conflict with it."""
    first = requests.groupBy(*keys).agg(
        F.min(order).alias("first_id"), F.min_by(payload, order).alias("_payload")
    )
    state = (
        F.when(F.col(order) == F.col("first_id"), "created")
        .when(F.col(payload).eqNullSafe(F.col("_payload")), "replayed")
        .otherwise("conflict")
    )
    return requests.join(first, keys).withColumn("outcome", state).drop("_payload")


def review_state(results: DataFrame, reviews: DataFrame) -> DataFrame:
    """Current decision per result from append-only review events."""
    folded = reviews.groupBy("result_id").agg(
        F.max_by("decision", F.struct("created_at", "id")).alias("current_decision"),
        F.count(F.lit(1)).alias("review_count"),
    )
    return results.join(folded, results["id"] == folded["result_id"], "left").drop("result_id")


def copy_forward(versions: DataFrame, key: str, target: Column) -> DataFrame:
    """New revision per document that repeats the target revision's row."""
    latest = versions.groupBy(key).agg(
        (F.max("revision") + 1).alias("new_revision"),
        F.min_by(F.struct("id", "revision", "created_by"), F.when(target, F.struct("revision", "id"))).alias("t"),
    )
    return latest.where("t IS NOT NULL").select(
        key, "new_revision", F.col("t.id").alias("source_id"), F.col("t.revision").alias("source_revision"),
        F.col("t.created_by").alias("created_by"),
    )


def export_issues(declared: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Versions missing from an export, added to it, or with another checksum."""
    d = declared.select(key, F.col("checksum").alias("_d"))
    a = actual.select(key, F.col("checksum").alias("_a"))
    issue = F.when(F.col("_a").isNull(), "missing").when(F.col("_d").isNull(), "undeclared").when(
        F.col("_d") != F.col("_a"), "checksum-mismatch"
    )
    return d.join(a, key, "full_outer").select(key, issue.alias("issue")).where("issue IS NOT NULL")


def node_summary(node_runs: DataFrame, algorithm: str, duration: str, faulted: Column) -> DataFrame:
    """Count, faults and duration quantiles per algorithm."""
    counts = node_runs.groupBy(algorithm).agg(
        F.count(F.lit(1)).alias("run_count"), F.count_if(faulted).alias("faulted_count")
    )
    spread = exact_quantiles(node_runs, [algorithm], duration, {"p50": 0.5, "p95": 0.95})
    return counts.join(spread, algorithm)


def recovered_status(status: Column) -> tuple[Column, Column]:
    """Status and error code of a run found unfinished after a restart."""
    moving = status.isin("moving", "capturing", "executing")
    waiting = status.isin("queued", "precheck")
    return (
        F.when(moving, "faulted").when(waiting, "cancelled").otherwise(status),
        F.when(moving, "restart-during-physical-operation").when(waiting, "restart-before-execution"),
    )


def retention_verdict(rows: DataFrame, limits: DataFrame, age_seconds: Column, hold: Column, kind: str) -> DataFrame:
    """Delete only what has a limit, is older than it and is not on hold."""
    joined = rows.join(limits, kind, "left")
    keep = hold | F.col("max_age_seconds").isNull() | (age_seconds <= F.col("max_age_seconds"))
    return joined.withColumn("verdict", F.when(keep, "preserve").otherwise("delete"))


def calibration_status(c: DataFrame, now: Column) -> DataFrame:
    """Validity of calibration records by the acceptance limits."""
    valid = (
        (F.col("image_count") >= 10) & (F.col("coverage_percent") >= 70)
        & (F.col("reprojection_error_pixels") <= 1) & (F.col("valid_until") > now)
    )
    return c.withColumn("status", F.when(valid, "valid").otherwise("failed"))


def station_readiness(profiles: DataFrame, calibrations: DataFrame, now: Column) -> DataFrame:
    """Stations with the reasons that keep them from production."""
    c = calibrations.select(F.col("id").alias("calibration_id"), "valid_until")
    checked = F.col("deployment_mode").isin("hardware-pilot", "production")
    reasons = F.array_compact(F.array(
        F.when(F.col("deployment_mode").isNull(), "no-active-commissioning-profile"),
        F.when(checked & F.col("valid_until").isNull(), "missing-calibration"),
        F.when(checked & (F.col("valid_until") <= now), "expired-calibration"),
    ))
    return profiles.join(c, "calibration_id", "left").select(
        "station_id", (F.size(reasons) == 0).alias("ready"), F.array_join(reasons, ",").alias("reasons")
    )


def column_completeness(tables: dict[str, DataFrame]) -> DataFrame:
    """Catalog of columns with type, row count and null count, one row per column."""
    frames = []
    for name, df in tables.items():
        counts = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
        entries = [
            F.struct(
                F.lit(name).alias("table_name"), F.lit(c).alias("column_name"), F.lit(i).alias("ordinal"),
                F.lit(dict(df.dtypes)[c]).alias("data_type"), F.col("_rows").alias("row_count"), F.col(c).alias("null_count"),
            )
            for i, c in enumerate(df.columns, 1)
        ]
        frames.append(counts.select(F.inline(F.array(*entries))))
    return reduce(lambda a, b: a.unionByName(b), frames)
