"""An append-only event log as a stream: an extension, not part of any report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_log(spark: SparkSession, folder: str, schema: str = SCHEMA) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of each kind in tumbling windows; state older than the watermark is dropped. The same on a batch."""
    events = events.withWatermark("ts", late) if events.isStreaming else events
    counted = events.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
