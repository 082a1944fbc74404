"""Hourly zone counts and quote sessions from a stream. The reference has no streams; these are additions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hourly_counts(events: DataFrame, zone: Column, converted: Column, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Quotes and trips by zone and hour; an hour is final when the watermark has passed it."""
    return (
        events.withColumn("at", F.col(ts).cast("timestamp")).withWatermark("at", late)
        .groupBy(F.window("at", "1 hour").alias("w"), zone.alias("h3_zone"))
        .agg(F.count("*").alias("quote_count"), F.count_if(converted).alias("trip_count"))
        .select("h3_zone", F.col("w.start").alias("hour_bucket"), "quote_count", "trip_count", (F.col("trip_count") / F.col("quote_count")).alias("conversion_rate"))
    )


def sessions(events: DataFrame, key: str, ts: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a key: calls no more than a gap apart."""
    return (
        events.withColumn("at", F.col(ts).cast("timestamp")).withWatermark("at", late)
        .groupBy(F.session_window("at", gap).alias("w"), key)
        .agg(F.count("*").alias("calls"))
        .select(key, F.col("w.start").alias("first_call"), F.col("w.end").alias("closed"), "calls")
    )


def drained(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """All that a stream over files gives once its present input is read, written as Parquet at a path and read again."""
    stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
