"""Structured Streaming: change feeds, last states and windows over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_files(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def latest_state(events: DataFrame, key: str, seq: str, value: str) -> DataFrame:
    """Last value of each key; run it in update or complete mode. Batch frames give the same result."""
    return events.groupBy(key).agg(F.max_by(value, seq).alias(value), F.max(seq).alias(seq))


def tumbling(events: DataFrame, ts: str, length: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    stamped = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if events.isStreaming:
        stamped = stamped.withWatermark(ts, late)
    return stamped.groupBy(F.window(ts, length), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, ts: str, gap: str, key: str, late: str = "1 hour") -> DataFrame:
    stamped = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if events.isStreaming:
        stamped = stamped.withWatermark(ts, late)
    return stamped.groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def once_per_batch(stream: DataFrame, apply, checkpoint: str):
    """Run apply(batch, batch_id) exactly once for each batch, if apply skips ids that it has seen, and stop when the source is read."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
