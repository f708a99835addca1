"""Registry of named queries."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .views import Tables, duckdb_prefix


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(Tables(spark, sf_dir))


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a query; views named in ``sql`` are put in front as common table expressions."""

    def register(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"Query {name} is registered twice.")
        QUERIES[name] = Query(name, build, with_views(sql) if sql else None)
        return build

    return register


def with_views(sql: str) -> str:
    prefix = duckdb_prefix(sql)
    if not prefix:
        return sql.strip()
    body = sql.strip()
    recursive = re.match(r"with\s+recursive\s+", body, re.I)
    plain = re.match(r"with\s+", body, re.I)
    if recursive:
        return f"WITH RECURSIVE {prefix},\n{body[recursive.end():]}"
    if plain:
        return f"WITH {prefix},\n{body[plain.end():]}"
    return f"WITH {prefix}\n{body}"
