"""Sinks for exported records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXPORT_COLUMNS = ["id", "board_serial", "recipe_name", "result", "defect_count", "score", "inspected_at"]


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def quoted_line(columns: list[str]) -> Column:
    """One fully quoted CSV line; quotes are doubled and nulls are empty text."""
    quoted = [F.concat(F.lit('"'), F.replace(_text(c), F.lit('"'), F.lit('""')), F.lit('"')) for c in columns]
    return F.concat_ws(",", *quoted)


def export_records(df: DataFrame, path: str) -> None:
    """Write the record export as quoted CSV, in parallel part files."""
    rows = df.select(*[_text(c).alias(c) for c in EXPORT_COLUMNS])
    rows.write.option("header", True).option("quoteAll", True).option("escape", '"').option(
        "emptyValue", ""
    ).csv(path)
