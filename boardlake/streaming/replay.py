"""Runs a stream to completion over stored events, slice by slice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import fresh_path
from .sinks import save_batch

#: A sink takes a micro-batch, its number and the folder of its tables.
Sink = Callable[[DataFrame, int, str], None]


def replay(
    events: DataFrame,
    build: Callable[[DataFrame], DataFrame],
    name: str,
    mode: str = "append",
    time: str = "ts",
    slices: int = 4,
    sink: Sink | None = None,
    close_after: str | None = None,
) -> DataFrame:
    """Feed stored events to a streaming query in time order and return what it wrote.

    Each time slice is written in parallel to the source folder of one running query, which takes it
    as a micro-batch before the next slice comes, so events of a slice may come in any order without
    being late. ``close_after`` is the last watermark step: one more event, a copy of the latest, comes that much
    later and lets all that is open before it close; what belongs to that event itself stays open.
    The table of a plain sink is partitioned by micro-batch, and a repeated micro-batch overwrites
    its own folder. Without events the result is empty.
    """
    folder = replayed(events, build, name, mode, time, slices, sink, close_after)
    spark = events.sparkSession
    if folder is None:
        typed = events.withColumn(time, F.col(time).cast("timestamp"))
        return spark.createDataFrame([], build(typed).schema).withColumn("batch_id", F.lit(0))
    return spark.read.parquet(folder)


def replayed(
    events: DataFrame,
    build: Callable[[DataFrame], DataFrame],
    name: str,
    mode: str = "append",
    time: str = "ts",
    slices: int = 4,
    sink: Sink | None = None,
    close_after: str | None = None,
) -> str | None:
    """The folder a replay's sink wrote to, None without events."""
    spark = events.sparkSession
    typed = events.withColumn(time, F.col(time).cast("timestamp"))
    micros = F.unix_micros(time)
    ends = typed.agg(F.min(micros).alias("lo"), F.max(micros).alias("hi")).first()
    if ends["lo"] is None:
        return None
    width = (ends["hi"] - ends["lo"]) // slices + 1
    source, out, progress = (fresh_path(spark, f"{name}-{part}") for part in ("source", "table", "progress"))
    save = sink or save_batch
    # The folder has to be there, with a schema, before the query starts.
    typed.where("false").write.parquet(source)
    stream = build(spark.readStream.schema(typed.schema).parquet(source))
    query = stream.writeStream.outputMode(mode).foreachBatch(lambda batch, batch_id: save(batch, batch_id, out)).option(
        "checkpointLocation", progress).start()
    try:
        for i in range(slices):
            low = ends["lo"] + i * width
            typed.where((micros >= low) & (micros < low + width)).write.mode("append").parquet(source)
            query.processAllAvailable()
        if close_after:
            last = typed.where(micros == ends["hi"]).limit(1)
            last.withColumn(time, F.col(time) + F.expr(f"INTERVAL {close_after}")).write.mode("append").parquet(source)
            query.processAllAvailable()
    finally:
        query.stop()
    return out


def latest_state(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Last update per key of an update-mode table."""
    values = [c for c in updates.columns if c not in (*keys, "batch_id")]
    folded = updates.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("_v"))
    return folded.select(*keys, "_v.*")
