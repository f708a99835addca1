"""A corpus in five stages: quality rules, line dedup, near-dedup, source mix, piece encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again before the next one. All but the last return the columns of ``documents``. Every stage takes nulls in any
column, empty and very long texts, repeated rows and further columns; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardlake.llm import line_dedup, mixing, near_dups, pieces, quality
from boardlake.llm.common import prepare, saved

#: Similarity from which documents are near-duplicates here; the query op3 has its own, 85.
NEAR_PERCENT = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects. Null and empty texts have no words and go; repeated rows get equal verdicts."""
    prepare(spark)
    return quality.passing(docs)


def shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without the lines that an earlier document has.

    The first document is the one with the smallest doc_id; rows without one, and repeated rows, count as one document. Null texts become empty.
    """
    prepare(spark)
    return line_dedup.cleaned(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest doc_id; texts without words are no duplicates.

    A row without doc_id stays only if nobody in its group has one.
    """
    prepare(spark)
    return near_dups.one_of_each(docs, NEAR_PERCENT)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix; rows without source are a source. The last stage states each one's place."""
    prepare(spark)
    return mixing.in_mixed_order(docs)


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every document that is left, whether they decode to the text, and its place in the mix.

    The place depends on the rows alone, not on files or partitions, so it is the one the stage before
    put them in. Null texts have null pieces, empty ones none.
    """
    prepare(spark)
    placed = mixing.with_position(docs).select("_row.doc_id", "_row.source", "_row.text", "cycle", "slot", "position")
    found = pieces.encode(placed)
    return found.select(*[F.col(f"_row.{c}") for c in ("doc_id", "source", "cycle", "slot", "position")], F.size("pieces").cast("bigint").alias("n_pieces"), "pieces", "lossless")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", shared_lines),
    ("near duplicates", near_duplicates),
    ("source mix", source_mix),
    ("piece encoding", piece_encoding),
]

#: The sampled segmentations and the near-duplicate stage have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
