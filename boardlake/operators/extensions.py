"""User-defined operators: a named registry, declared parameters, verified side inputs."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.digests import tree_digest
from ..sources.storage import fresh_path

Transform = Callable[..., DataFrame]


@dataclass(frozen=True)
class Parameter:
    """Kind and bounds of a parameter."""

    kind: type | tuple[type, ...]
    default: object = None
    minimum: float | None = None
    maximum: float | None = None
    options: tuple = ()

    def check(self, name: str, value: object) -> None:
        kinds = self.kind if isinstance(self.kind, tuple) else (self.kind,)
        if isinstance(value, bool) and bool not in kinds or not isinstance(value, kinds):
            raise ValueError(f"Parameter {name} has the wrong type.")
        if self.minimum is not None and value < self.minimum or self.maximum is not None and value > self.maximum:
            raise ValueError(f"Parameter {name} is outside its range.")
        if self.options and value not in self.options:
            raise ValueError(f"Parameter {name} must be one of {self.options}.")


@dataclass(frozen=True)
class Operator:
    name: str
    apply: Transform
    inputs: tuple[str, ...]
    outputs: tuple[str, ...]
    parameters: Mapping[str, Parameter] = field(default_factory=dict)

    def __call__(self, df: DataFrame, **values) -> DataFrame:
        missing = [c for c in self.inputs if c not in df.columns]
        if missing:
            raise ValueError(f"Operator {self.name} lacks input columns {missing}.")
        out = self.apply(df, **resolve(self.parameters, values))
        absent = [c for c in self.outputs if c not in out.columns]
        if absent:
            raise ValueError(f"Operator {self.name} did not produce {absent}.")
        return out


def resolve(declared: Mapping[str, Parameter], values: Mapping[str, object]) -> dict[str, object]:
    """Fill defaults and check every value before a plan is built."""
    unknown = set(values) - set(declared)
    if unknown:
        raise ValueError(f"Unknown parameters {sorted(unknown)}.")
    resolved = {n: values.get(n, p.default) for n, p in declared.items()}
    for name, value in resolved.items():
        declared[name].check(name, value)
    return resolved


class Registry:
    def __init__(self) -> None:
        self._operators: dict[str, Operator] = {}

    def register(self, operator: Operator) -> None:
        if operator.name in self._operators:
            raise ValueError(f"Operator {operator.name} is registered twice.")
        self._operators[operator.name] = operator

    def run(self, name: str, df: DataFrame, **values) -> DataFrame:
        if name not in self._operators:
            raise KeyError(f"Operator {name} is not registered.")
        return df.transform(self._operators[name], **values)


# ---------------------------------------------------------------- verified side inputs

def store_artifact(df: DataFrame, name: str, key: str) -> tuple[str, str, int]:
    """Write a side table; returns its path, digest and row count."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    digest, count = _digest(df.sparkSession.read.parquet(path), key)
    return path, digest, count


def load_artifact(spark, path: str, key: str, digest: str, count: int) -> DataFrame:
    """Read a side table after checking digest and row count once."""
    df = spark.read.parquet(path)
    found = _digest(df, key)
    if found != (digest, count):
        raise ValueError("Artifact is missing or fails its integrity check.")
    return df


def _digest(df: DataFrame, key: str) -> tuple[str, int]:
    line = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    row = tree_digest(df, [], [key], line).first()
    return (row["digest"], row["item_count"]) if row else ("", 0)


def per_image(scanlines: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Whole-image user function; a group is one image, bounded by the image size."""
    return scanlines.groupBy("image_id").applyInPandas(function, schema)
