"""Streaming forms of the time buckets, and stream totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from skywarden.operators import buckets


def transport_stream(packets: DataFrame, duration: str = "1 second", delay: str = "2 seconds",
                     limits: buckets.TransportLimits = buckets.TransportLimits()) -> DataFrame:
    """Transport buckets, each out once when the watermark passes its end; later rows are dropped and counted."""
    return buckets.transport_buckets(packets.withWatermark("ts", delay), duration, limits, streaming=True)


def application_stream(packets: DataFrame, duration: str = "1 second", delay: str = "2 seconds",
                       limits: buckets.ApplicationLimits = buckets.ApplicationLimits()) -> DataFrame:
    return buckets.application_buckets(packets.withWatermark("ts", delay), duration, limits)


def packet_counts(packets: DataFrame, duration: str = "30 seconds", delay: str = "2 seconds") -> DataFrame:
    """Packets and bytes per sensor and stretch of time, for periodic statistics."""
    counts = packets.withWatermark("ts", delay).groupBy(F.window("ts", duration), "sensor_id").agg(
        F.count("*").alias("packets"), F.sum("packet_size").alias("bytes"))
    return counts.withColumn("window_start", F.col("window.start")).drop("window")


def observed(packets: DataFrame, name: str | Observation = "packets") -> DataFrame:
    """Rows unchanged, with running totals in the query's progress (or in an ``Observation`` for batch)."""
    return packets.observe(name, F.count(F.lit(1)).alias("packets"), F.max("ts").alias("latest"))
