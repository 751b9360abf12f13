"""Readers for packets and layer logs. Schemas are always given; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skywarden import schema as S


def read_packets(spark: SparkSession, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """Packet records from Parquet, ORC, Avro or JSON files (CSV cannot hold the nested columns)."""
    return spark.read.schema(S.PACKETS).options(**options).format(fmt).load(path)


def stream_packets(spark: SparkSession, path: str, fmt: str = "parquet", files_per_trigger: int | None = None,
                   delay: str | None = None) -> DataFrame:
    """The same as a stream of arriving files; ``delay`` sets the watermark on ``ts``."""
    reader = spark.readStream.schema(S.PACKETS).format(fmt)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    stream = reader.load(path)
    return stream.withWatermark("ts", delay) if delay else stream


def read_log(spark: SparkSession, path: str, layer: str, fmt: str = "csv") -> DataFrame:
    """A layer log with the layer's columns."""
    reader = spark.read.schema(S.LOGS[layer])
    return (reader.option("header", True) if fmt == "csv" else reader).format(fmt).load(path)
