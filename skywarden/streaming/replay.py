"""Running a stream over files that are already there, to the end."""

from __future__ import annotations

from pyspark.sql import DataFrame

from skywarden.session import fresh_folder


def run_to_end(stream: DataFrame, name: str) -> DataFrame:
    """Process all available input and return what came out, as a table. Open windows stay in the checkpoint."""
    spark = stream.sparkSession
    out, checkpoint = fresh_folder(spark, f"{name}-out"), fresh_folder(spark, f"{name}-state")
    query = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
             .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
