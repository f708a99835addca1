"""Line dedup: lines that several documents share stay in the first of them only.

Lines are normalised and hashed; per hash the smallest and largest document are found, which
is a sum every task makes before the shuffle, so a line in a third of all documents costs one
row per task. The lines to drop come back per document as a set of hashes, and each text is
filtered and put together again in line order where it stands; texts are shuffled once.

Defined cases: a null or empty text is one empty line. Rows with the same doc_id count as one
document; rows without doc_id count together as one document that comes after all others, but
their sets are made per text, so that such rows, however many, are never gathered.
Extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, let, lower_ascii, packed, saved, text_of

MIN_CHARS = 10


def line_key(line: Column) -> Column:
    return lower_ascii(F.trim(line, F.lit(SPACE)))


def key_hash(key: Column) -> Column:
    """128 bits as two independent 64-bit hashes."""
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit("second"), key).alias("b"))


def _part() -> Column:
    """Null but for rows without doc_id, which it tells apart by their text."""
    return F.when(F.col("doc_id").isNull(), F.xxhash64(text_of()))


def shared_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = 2) -> DataFrame:
    """One row per document (``_doc``, ``_part``) with the ``_drop`` set of line hashes it must lose.

    ``min_documents`` above two needs the count of distinct documents instead of the two ends.
    """
    lines = docs.select(F.col("doc_id").alias("_doc"), _part().alias("_part"), F.explode(F.split(text_of(), "\n")).alias("_line"))
    keys = lines.select("_doc", "_part", line_key(F.col("_line")).alias("_key")).where(F.length("_key") >= min_chars)
    hashed = keys.select("_doc", "_part", key_hash(F.col("_key")).alias("_h")).select("_doc", "_part", "_h.a", "_h.b")
    if min_documents == 2:
        ends = hashed.groupBy("a", "b").agg(
            F.min("_doc").alias("_first"), F.max("_doc").alias("_last"), F.bool_or(F.col("_doc").isNull()).alias("_none")
        )
        many = ends.where((F.col("_first") != F.col("_last")) | (F.col("_none") & F.col("_first").isNotNull()))
    else:
        once = hashed.select("_doc", "a", "b").distinct()
        many = once.groupBy("a", "b").agg(F.min("_doc").alias("_first"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_documents)
    # Written once: the join below then shuffles both sides, and a hot hash can be split.
    many = saved(many.select("a", "b", "_first"), "shared-lines")
    found = hashed.join(many, ["a", "b"]).where(~F.col("_doc").eqNullSafe(F.col("_first")))
    return found.groupBy("_doc", "_part").agg(F.collect_set(F.struct("a", "b")).alias("_drop"))


def deduplicated(docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = 2) -> DataFrame:
    """``_row``, ``n_lines``, ``n_dropped`` and ``_kept``, the text that stays."""
    drop = shared_lines(docs, min_chars, min_documents).withColumnsRenamed({"_doc": "_doc2", "_part": "_part2"})
    rows = packed(docs, F.col("doc_id").alias("_doc"), _part().alias("_part"), text_of().alias("_text"))
    joined = rows.join(drop, F.col("_doc").eqNullSafe(F.col("_doc2")) & F.col("_part").eqNullSafe(F.col("_part2")), "left")

    def stays(names: Column):
        def keep(line: Column) -> Column:
            return let(line_key(line), lambda k: (F.length(k) < min_chars) | ~F.array_contains(names, key_hash(k)))
        return keep

    lines = F.split(F.col("_text"), "\n")
    kept = F.when(F.col("_drop").isNull(), F.split(F.col("_text"), "\n")).otherwise(F.filter(lines, stays(F.col("_drop"))))
    out = joined.select("_row", "_text", "_drop", kept.alias("_lines"), F.size(lines).cast("bigint").alias("n_lines"))
    return out.select(
        "_row", "n_lines", (F.col("n_lines") - F.size("_lines")).cast("bigint").alias("n_dropped"),
        F.array_join("_lines", "\n").alias("_kept"),
    )


def cleaned(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with the shared lines gone from ``text`` and ``n_chars`` kept true.

    Rows stay, even if no line of theirs does. A null text stays null.
    """
    out = deduplicated(docs, min_chars)
    changed = {"text": F.when(F.col("_row.text").isNull(), None).otherwise(F.col("_kept"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("n_dropped") == 0, F.col("_row.n_chars")).otherwise(F.length("_kept").cast("bigint"))
    return out.select(*[changed[c].alias(c) if c in changed else F.col(f"_row.`{c}`") for c in docs.columns])
