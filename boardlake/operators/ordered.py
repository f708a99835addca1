"""Ordered computations per key that survive a key holding a large share of all rows.

A plain window puts all rows of one key into one task. Before planning, the rows per key
are counted (pre-aggregated per task; one row reaches the driver). When no key is above the
row limit the plan is one plain window. Otherwise the rows are range-partitioned once by key
and the full order, so chunks are cut by rank: far values, ties and bursts do not matter.
The window runs per (key, chunk), and what earlier chunks contribute is added from a table
with one row per chunk of the keys that lie in several chunks. Each border between two
chunks cuts one key at most, so that table has fewer than ``2 * chunks`` rows, whatever the
number of keys. It is broadcast.

The number of chunks follows the number of rows up to MAX_CHUNKS, the most partitions asked
of Spark; beyond that chunks grow with the input, for all keys alike.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import written

HOT_KEY_ROWS = 1_000_000
MAX_CHUNKS = 8192


def _null_safe(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[n].eqNullSafe(right[f"_r_{n}"]) for n in names], F.lit(True))


def _renamed(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[F.col(c).alias(f"_r_{c}") if c in names else F.col(c) for c in df.columns])


def chunks_needed(df: DataFrame, keys: list[str], hot_rows: int = HOT_KEY_ROWS) -> int:
    """Chunks to cut the rows into, or 0 when no key is above the row limit."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    most, rows = sizes.agg(F.max("_n"), F.sum("_n")).first()
    return min(-(-rows // hot_rows), MAX_CHUNKS) if (most or 0) > hot_rows else 0


def with_chunks(df: DataFrame, keys: list[str], order: list[str], chunks: int) -> DataFrame:
    """Add ``_chunk``, the number of the row's range of (key, order). Stored, so that a repeated
    task cannot place a row differently; rows in order pack well, so in packed files."""
    placed = df.repartitionByRange(chunks, *keys, *order).withColumn("_chunk", F.spark_partition_id())
    return written(placed, "ordered-chunks", compression="zstd")


def ordered(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    *,
    number: str | None = None,
    previous: dict[str, str] | None = None,
    running: dict[str, Column] | None = None,
    total: dict[str, Column] | None = None,
    hot_rows: int = HOT_KEY_ROWS,
) -> DataFrame:
    """Row numbers, previous-row values, running sums and key totals in one pass.

    ``order`` lists ascending columns that order the rows of a key totally. ``previous`` maps
    a new column to the column whose value on the row before is wanted. Finding large keys
    runs one job over the keys when this is called.
    """
    previous, running, total = previous or {}, running or {}, total or {}
    chunks = chunks_needed(df, keys, hot_rows)
    if not chunks:
        return _one_window(df, keys, order, number, previous, running, total)
    return _chunked(with_chunks(df, keys, order, chunks), df.columns, keys, order, number, previous, running, total)


def _one_window(df, keys, order, number, previous, running, total):
    whole = Window.partitionBy(*(keys or [F.lit(1)]))
    line = whole.orderBy(*order)
    upto = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    extra = [F.row_number().over(line).cast("bigint").alias(number)] if number else []
    extra += [F.lag(source).over(line).alias(name) for name, source in previous.items()]
    extra += [F.sum(expr).over(upto).alias(name) for name, expr in running.items()]
    extra += [F.sum(expr).over(whole).alias(name) for name, expr in total.items()]
    return df.select("*", *extra)


def _chunked(tagged, columns, keys, order, number, previous, running, total):
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*keys, "_chunk")
    last = F.struct(*[F.col(source).alias(name) for name, source in previous.items()]) if previous else None

    rows = tagged
    if number:
        rows = rows.withColumn("_rn", F.row_number().over(inside).cast("bigint"))
    if previous:
        rows = rows.withColumn("_prev", F.lag(last).over(inside))
    for name, expr in running.items():
        rows = rows.withColumn(f"_run_{name}", F.sum(expr).over(upto))
    for name, expr in total.items():
        rows = rows.withColumn(f"_tot_{name}", F.sum(expr).over(whole))

    parts = [F.count(F.lit(1)).alias("_cn")]
    if previous:
        parts.append(F.max_by(last, F.struct(*order)).alias("_clast"))
    parts += [F.sum(e).alias(f"_crun_{n}") for n, e in running.items()]
    parts += [F.sum(e).alias(f"_ctot_{n}") for n, e in total.items()]
    chunks = tagged.groupBy(*keys, "_chunk").agg(*parts)
    by_key = Window.partitionBy(*(keys or [F.lit(1)]))
    before = by_key.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = [F.sum("_cn").over(before).alias("_base_n"), F.count(F.lit(1)).over(by_key).alias("_parts")]
    if previous:
        carry.append(F.last("_clast", ignorenulls=True).over(before).alias("_base_last"))
    carry += [F.sum(f"_crun_{n}").over(before).alias(f"_base_run_{n}") for n in running]
    carry += [F.sum(f"_ctot_{n}").over(by_key).alias(f"_base_tot_{n}") for n in total]
    join_keys = [*keys, "_chunk"]
    right = _renamed(chunks.select(*join_keys, *carry).where("_parts > 1").drop("_parts"), join_keys)
    out = rows.join(F.broadcast(right), _null_safe(rows, right, join_keys), "left")

    result = [F.col(c) for c in columns]
    if number:
        result.append((F.col("_rn") + F.coalesce("_base_n", F.lit(0))).cast("bigint").alias(number))
    for name in previous:
        result.append(F.coalesce(F.col("_prev"), F.col("_base_last"))[name].alias(name))
    for name in running:
        earlier, own = F.col(f"_base_run_{name}"), F.col(f"_run_{name}")
        result.append(
            F.when(earlier.isNull(), own).when(own.isNull(), earlier).otherwise(own + earlier).alias(name)
        )
    for name in total:
        result.append(F.coalesce(f"_base_tot_{name}", f"_tot_{name}").alias(name))
    return out.select(*result)


def top_rows(df: DataFrame, keys: list[str], order: list[Column], k: int, number: str = "rank") -> DataFrame:
    """First ``k`` rows per key. Spark keeps at most ``k`` rows per key and task before
    the shuffle (window group limit), so a large key ships only ``k`` rows per task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(number, F.row_number().over(w)).where(F.col(number) <= k)
