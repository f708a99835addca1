"""Where micro-batches go: tables that a repeated micro-batch does not change.

Every table is a folder with one folder per micro-batch, which that micro-batch overwrites. What is
read while a micro-batch runs comes from the ones before it alone, so running it again, after a
failure halfway or by mistake, gives the same rows in the same place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import remove


def save_batch(batch: DataFrame, batch_id: int, folder: str) -> None:
    batch.write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")


def before(spark: SparkSession, folder: str, batch_id: int, schema: str) -> DataFrame:
    """Rows of the micro-batches before this one; empty for the first."""
    empty = spark.createDataFrame([], schema)
    if batch_id == 0:
        return empty.withColumn("batch_id", F.lit(0).cast("bigint"))
    typed = spark.read.option("ignoreMissingFiles", "true").schema(f"{schema}, batch_id bigint").parquet(folder)
    return typed.where(F.col("batch_id") < batch_id)


def split_batch(batch: DataFrame, batch_id: int, folder: str, routes: dict[str, Column]) -> None:
    """Each route's rows into a table of its own, ``folder/route``. A row may take one route only."""
    batch = batch.persist()
    try:
        for route, chosen in routes.items():
            save_batch(batch.where(chosen), batch_id, f"{folder}/{route}")
    finally:
        batch.unpersist()


def append_new_keys(batch: DataFrame, batch_id: int, folder: str, key: str) -> None:
    """Rows whose key no micro-batch before has stored, one per key."""
    spark = batch.sparkSession
    stored = before(spark, folder, batch_id, f"{key} string").select(key)
    save_batch(batch.dropDuplicates([key]).join(stored, key, "left_anti"), batch_id, folder)


class KeyedState:
    """One row per key, as of the end of each micro-batch, with the last two versions kept."""

    def __init__(self, folder: str, schema: str):
        self.folder, self.schema = folder, schema

    def load(self, spark: SparkSession, batch_id: int) -> DataFrame:
        if batch_id == 0:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(f"{self.folder}/version={batch_id - 1}")

    def store(self, rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/version={batch_id}")
        if batch_id > 1:
            remove(rows.sparkSession, f"{self.folder}/version={batch_id - 2}")
