"""Exact quantiles that never hold a large group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import HOT_KEY_ROWS, chunks_needed, ordered


def exact_quantiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    probs: dict[str, float],
    *,
    interpolate: bool = True,
    hot_rows: int = HOT_KEY_ROWS,
) -> DataFrame:
    """One row per key with a column per requested probability.

    ``interpolate=False`` gives the smallest value whose cumulative share reaches the
    probability (the lower median for 0.5). While no group has more than ``hot_rows`` rows,
    the built-in aggregate does. Otherwise equal values are counted, the counts are summed
    along the value order in chunks, and the value at the wanted rank is taken.
    """
    if not chunks_needed(df, keys, hot_rows):
        return _built_in(df, keys, value, probs, interpolate)
    return _by_rank(df, keys, value, probs, interpolate, hot_rows)


def _built_in(df, keys, value, probs, interpolate):
    def pick(p: float) -> Column:
        if interpolate:
            return F.percentile(value, F.lit(float(p)))
        return F.expr(f"percentile_disc({float(p)}D) WITHIN GROUP (ORDER BY `{value}`)")

    return df.groupBy(*keys).agg(*[pick(p).alias(name) for name, p in probs.items()])


def _by_rank(df, keys, value, probs, interpolate, hot_rows):
    # A null value counts for nothing, but keeps a group that has no other.
    counts = df.groupBy(*keys, value).agg(F.count(value).alias("_c"))
    ranked = ordered(
        counts, keys, [value],
        running={"_cum": F.col("_c")}, total={"_n": F.col("_c")}, hot_rows=hot_rows,
    )
    picks, columns = [], []
    for name, p in probs.items():
        if interpolate:
            at = F.lit(float(p)) * (F.col("_n") - 1)
            low, high = F.floor(at), F.ceil(at)
            picks += [
                F.min(F.when(F.col("_cum") > low, F.col(value))).alias(f"_lo_{name}"),
                F.min(F.when(F.col("_cum") > high, F.col(value))).alias(f"_hi_{name}"),
                F.max(at - low).alias(f"_fr_{name}"),
            ]
            columns.append(
                (F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * F.col(f"_fr_{name}"))
                .alias(name)
            )
        else:
            rank = F.greatest(F.ceil(F.lit(float(p)) * F.col("_n")), F.lit(1))
            picks.append(F.min(F.when(F.col("_cum") >= rank, F.col(value))).alias(f"_lo_{name}"))
            columns.append(F.col(f"_lo_{name}").alias(name))
    return ranked.groupBy(*keys).agg(*picks).select(*keys, *columns)
