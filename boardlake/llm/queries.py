"""One query per operator over its whole table, with production settings, and the SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language, line_dedup, manifest, mixing, near_dups, neighbours, pieces, quality, reputation, resampling, secrets, toxicity, warc
from .common import prepare
from .oracles import SQL  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(build: Callable[[SparkSession, str], DataFrame]):
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


@query
def op2_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("_row.doc_id", F.size("pieces").cast("bigint").alias("n_pieces"), "pieces", "lossless")


@query
def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dups.groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", near_dups.stays().alias("kept"))


@query
def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    apart = language.held_out(F.col("doc_id"))
    filters = language.learn(docs.where(~apart))
    found = language.identified(docs.select("doc_id", "text"), filters)
    return found.select("_row.doc_id", language.held_out(F.col("_row.doc_id")).alias("held_out"), "lang_pred", "score")


@query
def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"))


@query
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.deduplicated(docs).select("_row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("_kept").cast("binary"), 256).alias("kept_sha256"))


@query
def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *[F.size(f"_{k}").cast("bigint").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(secrets.written_out(F.col("base")).cast("binary"), 256).alias("base_sha256"), secrets.written_out(F.col("found")).alias("spans"),
    )


@query
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.round_trip(table(spark, sf_dir, "pages"))
    stored = F.col("payload").isNotNull()
    return back.select(
        "page_id", F.when(stored, F.length("payload").cast("bigint")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(stored, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to",
    )


@query
def op9_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return reputation.judged(table(spark, sf_dir, "pages"), outcomes)


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ordered = quality.plan_cascade(docs)
    rows = quality.with_measures(docs)
    measures = {n: F.col(n) for n in quality.MEASURES}
    base = quality.cascade(measures, [r for r in ordered if r in quality.BASE]).isNotNull()
    rejected = quality.cascade(measures, ordered)
    return rows.select(
        "_row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), rejected.isNull().alias("kept"),
    )


@query
def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    training = toxicity.training_rows(docs.where(~language.held_out(F.col("doc_id"))), table(spark, sf_dir, "labels"))
    found = toxicity.scored(docs, toxicity.fit(training))
    apart = language.held_out(F.col("_row.doc_id")).alias("held_out")
    return found.select("_row.doc_id", apart, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "offending")


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(table(spark, sf_dir, "documents"), tamper=True)


@query
def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
