"""Small helpers the operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import SETTINGS, ship_package
from ..sources.storage import checkpoint, fresh_path

#: Rows of an Arrow batch; texts may be long.
BATCH_ROWS = 512
SPACE = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

__all__ = ["SPACE", "SPACE_RUN", "UPPER", "checkpoint", "count_rows", "fresh_path", "let", "lower_ascii", "packed", "prepare", "saved", "text_of", "words"]


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings the operators rely on; all can be changed at run time."""
    for key, value in {**SETTINGS, "spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS)}.items():
        spark.conf.set(key, value)
    ship_package()
    return spark


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over one evaluation of ``value``, as a single lazy expression."""
    return F.transform(F.array(value), body)[0]


def text_of(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def lower_ascii(value: Column) -> Column:
    """A-Z lower-cased, all other letters as they are."""
    return F.when(F.length(value) == F.octet_length(value), F.lower(value)).otherwise(
        F.translate(value, UPPER, UPPER.lower())
    )


def words(value: Column) -> Column:
    """Runs of characters other than the six ASCII spaces."""
    return let(
        F.trim(value, F.lit(SPACE)),
        lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE_RUN)),
    )


def packed(df: DataFrame, *extra: Column) -> DataFrame:
    """The row as one struct ``_row`` besides ``extra``, so that no column name can clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), *extra)


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back, with its lineage cut."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def count_rows(df: DataFrame) -> int:
    return df.select(F.lit(1)).count()
