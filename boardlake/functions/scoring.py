"""Scalar score, decision and rule expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def bounded_score(score: Column) -> Column:
    """Clamp to [0, 1]; not-a-number counts as 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.nanvl(score, F.lit(0.0))))


def switch_case(value: Column, cases: Sequence[tuple[object, str]]) -> Column:
    """Branch of the first equal case, ``default`` otherwise."""
    branch = None
    for case, name in cases:
        if not name.strip():
            raise ValueError("Each switch case requires a non-empty branch.")
        hit = value == F.lit(case)
        branch = F.when(hit, name) if branch is None else branch.when(hit, name)
    return F.lit("default") if branch is None else branch.otherwise("default")


def age_seconds(later: Column, earlier: Column) -> Column:
    """Age in seconds to the microsecond; works for both timestamp types."""
    at, since = later.cast("timestamp"), earlier.cast("timestamp")
    return (F.unix_micros(at) - F.unix_micros(since)) / F.lit(1e6)


def is_stale(age: Column, tolerance: float) -> Column:
    return (age < 0) | (age > tolerance)


def precheck_code(
    byte_length: Column, sha: Column, observed_sha: Column, blurred: Column, registered: Column,
    in_position: Column, age: Column, tolerance: float,
) -> Column:
    """First failing safety rule; null when all hold."""
    return (
        F.when(byte_length <= 0, "corrupt")
        .when((F.length(sha) != 64) | (sha != observed_sha), "checksum-invalid")
        .when(blurred, "blurred")
        .when(~registered, "unregistered")
        .when(~in_position, "motion-not-in-position")
        .when(is_stale(age, tolerance), "stale-pose")
    )


def digest_score(sha: Column) -> Column:
    """Deterministic score of a digest: one minus the mean of its bytes over 255."""
    total = F.aggregate(
        F.sequence(F.lit(0), F.lit(31)), F.lit(0).cast("bigint"),
        lambda a, i: a + F.conv(sha.substr(i * 2 + 1, F.lit(2)), 16, 10).cast("bigint"),
    )
    return 1.0 - total / F.lit(32.0 * 255.0)


def pass_at_most(score: Column, threshold: float) -> Column:
    return F.when(score <= threshold, "PASS").otherwise("FAIL")


def fail_at_least(score: Column, threshold: float, decision: Column | None = None) -> Column:
    """Decision given, or FAIL from the threshold upwards; a missing score counts as 0."""
    fallback = F.when(F.coalesce(score, F.lit(0.0)) >= threshold, "FAIL").otherwise("PASS")
    return fallback if decision is None else F.coalesce(decision, fallback)


def three_way(score: Column, accept: float, reject: float, violated: Column) -> Column:
    return F.when(violated | (score >= reject), "NG").when(score >= accept, "REVIEW").otherwise("OK")


def within(a: Sequence[Column], b: Sequence[Column], tolerance: float) -> Column:
    hit = F.lit(True)
    for x, y in zip(a, b, strict=True):
        hit = hit & (F.abs(x - y) <= tolerance)
    return hit


def min_max(score: Column, low: float, high: float) -> Column:
    if high <= low:
        raise ValueError("The maximum must exceed the minimum.")
    return bounded_score((score - low) / (high - low))


def robust_z(score: Column, median: Column, mad: Column, epsilon: float = 1e-6) -> Column:
    return (score - median) / (1.4826 * mad + epsilon)


def compatible_entries(entries: Column, allowed: Sequence[str]) -> Column:
    """Allow-listed, non-empty entries of a string map."""
    return F.map_filter(entries, lambda k, v: k.isin(list(allowed)) & v.isNotNull() & (v != ""))
