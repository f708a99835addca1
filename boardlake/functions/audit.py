"""Audit fields derived from requests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Audited methods and their action.
ACTION_BY_METHOD = {"POST": "create", "PUT": "update", "PATCH": "update", "DELETE": "delete"}


def resource_parts(path: Column) -> tuple[Column, Column]:
    """Resource type and id; a leading ``api`` part is dropped."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    rest = F.when(F.get(parts, F.lit(0)) == "api", F.slice(parts, 2, 2**30)).otherwise(parts)
    return F.coalesce(F.get(rest, F.lit(0)), F.lit("application")), F.get(rest, F.lit(1))


def action(method: Column) -> Column:
    lookup = F.create_map(*[F.lit(x) for pair in ACTION_BY_METHOD.items() for x in pair])
    return lookup[method]


def outcome(status_code: Column) -> Column:
    return F.when(status_code < 400, "success").otherwise("failure")
