"""Importance resampling of documents toward a target distribution.

Features are runs of one to ``longest`` consecutive words. Separators are collapsed to single
spaces; a scan with overlapping matches and lookarounds at word borders then gives the span of
every run, and the CRC-32 of its bytes names its bucket. Bucket counts over all documents and
over all target texts give each bucket's gain, a smoothed log ratio; a document's weight is the
sum of gains over its features. Adding Gumbel noise hashed from the doc_id turns the largest
scores into a draw without replacement in proportion to the exponential of the weights.

A document's buckets are kept as pairs (bucket, count) in a table, so texts are scanned once.
The gains are one number per bucket, a bound that does not grow with the input; nothing else
reaches the driver but counts. Ranks come from rows range-partitioned by score.

Defined cases: null and empty texts have no features and weight 0. A null doc_id takes the
noise of the empty name and comes before all others in ties. Rows are drawn one by one: repeated rows
get equal scores and ranks of their own. Ties go to the smaller doc_id. Documents with fewer than
``least_words`` words are scored, never drawn. An empty documents table gives an empty result, an
empty target counts nothing. Only doc_id and text are read; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import ordered
from .common import saved

BUCKETS = 10_000
LONGEST = 1
LEAST_WORDS = 20
DRAWN_PERCENT = 10
SEED = 2024
#: Rows of a range while ranking.
RANK_ROWS = 20_000
_SEPARATORS = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def run_pattern(size: int):
    """Runs of ``size`` words in a text with single spaces, from word border to word border."""
    return regex.compile(rb"(?<![^ ])[^ ]+(?: [^ ]+){%d}(?![^ ])" % (size - 1))


def scan(text: str | None, patterns: list, buckets: int) -> list[np.ndarray]:
    """The buckets of all runs, one array per pattern."""
    line = _SEPARATORS.sub(b" ", (text or "").encode("utf-8", "surrogatepass").lower()).strip(b" ")
    crc = zlib.crc32
    return [
        np.fromiter((crc(line[m.start() : m.end()]) for m in p.finditer(line, overlapped=True)), np.int64) % buckets
        for p in patterns
    ]


def features(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """doc_id, n_words, n_features, and the distinct buckets of every whole text with their counts."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        patterns = [run_pattern(k) for k in range(1, longest + 1)]
        for batch in batches:
            words, sizes, keys, counts = [], [], [], []
            for text in batch["text"]:
                found = scan(text, patterns, buckets)
                key, count = np.unique(np.concatenate(found), return_counts=True)
                words.append(len(found[0]))
                sizes.append(int(count.sum()))
                keys.append(key.astype(np.int32))
                counts.append(count.astype(np.int32))
            frame = {"doc_id": batch["doc_id"], "n_words": words, "n_features": sizes}
            yield pd.DataFrame({**frame, "bucket": pd.Series(keys, dtype=object), "count": pd.Series(counts, dtype=object)})

    return texts.mapInPandas(rows, "doc_id long, n_words long, n_features long, bucket array<int>, count array<int>")


def bucket_counts(rows: DataFrame, name: str) -> DataFrame:
    pairs = rows.select(F.explode(F.arrays_zip("bucket", "count")).alias("p"))
    return pairs.groupBy(F.col("p.bucket").alias("bucket")).agg(F.sum("p.count").alias(name))


def gains(documents: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """The gain of each bucket, from the features of both sides; ``buckets`` numbers."""
    spark = documents.sparkSession
    size = lambda rows: rows.agg(F.coalesce(F.sum("n_features"), F.lit(0))).first()[0]
    ours, theirs = float(size(documents)), float(size(target))
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(bucket_counts(documents, "s"), "bucket", "left").join(bucket_counts(target, "t"), "bucket", "left")
    s, t = (F.coalesce(c, F.lit(0)).cast("double") for c in ("s", "t"))
    ratio = (t + 1.0) * F.lit(ours + buckets) / ((s + 1.0) * F.lit(theirs + buckets))
    found = both.select("bucket", F.floor(1000.0 * F.log(ratio)).cast("bigint").alias("gain")).collect()
    out = [0] * buckets
    for row in found:
        out[row["bucket"]] = row["gain"]
    return out


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of a hash of the doc_id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


def weighed(rows: DataFrame, gain: list[int]) -> DataFrame:
    """``rows`` with ``weight`` in place of the buckets."""
    sent = rows.sparkSession.sparkContext.broadcast(np.array(gain, np.int64))

    @F.pandas_udf("long")
    def weight(bucket: pd.Series, count: pd.Series) -> pd.Series:
        held = sent.value
        return pd.Series([int(held[b] @ c.astype(np.int64)) if len(b) else 0 for b, c in zip(bucket, count)], dtype="int64")

    kept = [c for c in rows.columns if c not in ("bucket", "count")]
    return rows.select(*kept, weight("bucket", "count").alias("weight"))


def resampled(
    documents: DataFrame,
    target: DataFrame,
    percent: int = DRAWN_PERCENT,
    buckets: int = BUCKETS,
    longest: int = LONGEST,
    least_words: int = LEAST_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null if not drawn) of every document."""
    text = F.col("text").cast("string").alias("text")
    ours = saved(features(documents.select(F.col("doc_id").cast("long").alias("doc_id"), text), buckets, longest), "resample-features")
    theirs = saved(features(target.select(F.lit(None).cast("long").alias("doc_id"), text), buckets, longest), "resample-target")
    may_be = F.col("n_words") >= least_words
    drawn = percent * ours.where(may_be).count() // 100
    rows = weighed(ours, gains(ours, theirs, buckets))
    rows = rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    rows = rows.select("doc_id", "n_features", "weight", "score", (~may_be).alias("_out"), (-F.col("score")).alias("_down"))
    # Checkpointed inside, as ranges and their sizes must come from the same rows.
    placed = ordered(rows, [], ["_out", "_down", "doc_id"], number="_place", hot_rows=RANK_ROWS)
    rank = F.when(~F.col("_out") & (F.col("_place") <= drawn), F.col("_place"))
    return placed.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))
