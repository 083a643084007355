"""Streaming counterpart of the daily aggregate (an extension): watermark, deduplication, windows by day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Events from parquet files as they arrive."""
    return spark.readStream.schema(schema).parquet(path)


def daily_counts(events: DataFrame, time: str, key: list[str], late: str = "2 days") -> DataFrame:
    """(day, event_type, n_events, total): each key once, events later than `late` dropped by the watermark.

    On a batch DataFrame the same code gives the same result, without watermark.
    """
    df = events.withColumn("__t", F.col(time).cast("timestamp"))
    if events.isStreaming:
        df = df.withWatermark("__t", late).dropDuplicatesWithinWatermark(key)
    else:
        df = df.dropDuplicates(key)
    w = F.window("__t", "1 day")
    return df.groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("total")).select(F.to_date("window.start").alias("day"), "event_type", "n_events", "total")
