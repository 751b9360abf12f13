"""Per-packet flags gathered from several detectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def flags_by_packet(found: DataFrame, detectors: Sequence[str], more: Sequence[str] = ()) -> DataFrame:
    """One row per packet with hits: a 0/1 column per detector and the maximum of each further column."""
    flags = [F.max(F.when(F.col("detector") == d, 1).otherwise(0)).alias(d.lower()) for d in detectors]
    return found.groupBy("packet_id").agg(*flags, *[F.max(c).alias(c) for c in more])


def with_flags(rows: DataFrame, flags: DataFrame) -> DataFrame:
    """Rows with their flags; packets without hits get 0."""
    names = [c for c in flags.columns if c != "packet_id"]
    joined = rows.join(flags, "packet_id", "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in names})
