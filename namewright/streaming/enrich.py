"""Structured Streaming: names from a stream are looked up as they come. An addition; batch operators don't depend on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def enrich_stream(names: DataFrame, surfaces: DataFrame, name: str = "name", time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """A stream of names with the candidate cids of each; repeated (name, time) within the watermark come once. Works on batches too."""
    keyed = names.withColumn("normalized_name", T.normalize(F.col(name), "n3"))
    if names.isStreaming:
        keyed = keyed.withWatermark(time, late).dropDuplicatesWithinWatermark(["normalized_name", time])
    else:
        keyed = keyed.dropDuplicates(["normalized_name", time])
    return keyed.join(surfaces.select("normalized_name", "candidate_cids"), "normalized_name", "left")


def windowed_counts(events: DataFrame, time: str = "ts", key: str = "event_type", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by tumbling window and key; late events beyond the watermark are dropped by Spark."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, width), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), key, "n")


def write_each(stream: DataFrame, path: str, checkpoint: str):
    """Appends each micro-batch to Parquet under its batch id, so that a repeated batch replaces itself."""

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()
