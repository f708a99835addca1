"""Content digests: single values, canonical JSON text and ordered collections."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordered import HOT_KEY_ROWS, ordered

FANOUT = 10_000
LEVELS = 3


def sha256(column: Column | str) -> Column:
    return F.sha2(F.col(column).cast("binary") if isinstance(column, str) else column.cast("binary"), 256)


def canonical_flat_json(values: Column) -> Column:
    """Canonical JSON of a flat map: keys sorted, no spaces, nulls kept."""
    in_order = F.map_from_entries(F.array_sort(F.map_entries(values)))
    return F.to_json(in_order, {"ignoreNullFields": "false"})


def _canonical(text: str | None, ascii_only: bool) -> str | None:
    if text is None:
        return None
    return json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=ascii_only)


@F.pandas_udf(T.StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """Canonical JSON of nested documents: sorted keys at every depth, no spaces, ASCII only."""
    return text.map(lambda t: _canonical(t, ascii_only=True))


@F.pandas_udf(T.StringType())
def canonical_settings_json(text: pd.Series) -> pd.Series:
    """The same with letters beyond ASCII as they are, the form of settings checksums."""
    return text.map(lambda t: _canonical(t, ascii_only=False))


def tree_digest(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    item: Column,
    *,
    fanout: int = FANOUT,
    levels: int = LEVELS,
    hot_rows: int = HOT_KEY_ROWS,
    hashed_already: bool = False,
) -> DataFrame:
    """Digest of each key's rows in order, without gathering a key in one place.

    Rows are hashed, runs of ``fanout`` consecutive hashes are joined and hashed again, and
    so on for ``levels`` levels. The top level joins all that is left of a key, which is one
    run up to ``fanout ** levels`` rows (10^12) and a hash per 10^8 rows beyond, so every key
    has one digest. ``hashed_already`` says that ``item`` is a row's hash.
    """
    hashed = ordered(
        df.select(*keys, *[c for c in order if c not in keys], (item if hashed_already else F.sha2(item, 256)).alias("_h")),
        keys, order, number="_seq", hot_rows=hot_rows,
    ).select(*keys, "_seq", "_h", F.lit(1).cast("bigint").alias("_n"))
    for level in range(levels):
        block = F.floor((F.col("_seq") - 1) / F.lit(fanout)) if level + 1 < levels else F.lit(0)
        hashed = (
            hashed.withColumn("_block", block.cast("bigint"))
            .groupBy(*keys, "_block")
            .agg(F.array_sort(F.collect_list(F.struct("_seq", "_h"))).alias("_list"), F.sum("_n").alias("_n"))
            .select(
                *keys, (F.col("_block") + 1).alias("_seq"),
                F.sha2(F.array_join(F.transform("_list", lambda x: x["_h"]), ""), 256).alias("_h"), "_n",
            )
        )
    return hashed.select(*keys, F.col("_h").alias("digest"), F.col("_n").alias("item_count"))


def tree_digest_sql(source: str, keys: list[str], order: str, item: str, fanout: int = FANOUT, levels: int = LEVELS) -> str:
    """SQL twin of :func:`tree_digest`."""
    by = "".join(f"{k}, " for k in keys)
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    sql = (
        f"SELECT {by}row_number() OVER ({part}ORDER BY {order}) AS seq, sha256({item}) AS h,"
        f" cast(1 AS bigint) AS n FROM {source}"
    )
    for level in range(levels):
        block = f"(seq - 1) // {fanout} + 1" if level + 1 < levels else "1"
        sql = (
            f"SELECT {by}block AS seq, sha256(string_agg(h, '' ORDER BY seq)) AS h, cast(sum(n) AS bigint) AS n"
            f" FROM (SELECT *, {block} AS block FROM ({sql})) GROUP BY {by}block"
        )
    return f"SELECT {by}h AS digest, n AS item_count FROM ({sql})"
