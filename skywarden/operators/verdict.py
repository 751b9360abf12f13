"""Combining detector findings into one verdict per packet."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from skywarden.functions import scalars as X

HIT = ["packet_id", "detector", "position", "severity", "details"]


def finding(detector: str, detected: Column, severity: Column, details: Column) -> Column:
    return F.struct(F.lit(detector).alias("detector"), F.coalesce(detected, F.lit(False)).alias("detected"),
                    severity.cast("double").alias("severity"), details.cast("string").alias("details"))


def verdict(findings: Sequence[Column]) -> Column:
    """Most severe finding of an array of structs, first listed on ties; else NORMAL."""
    ranked = F.array(*[
        F.when(f["detected"] & (f["severity"] > 0), F.struct(
            f["severity"].alias("severity"), F.lit(-i).alias("order"), f["detector"].alias("attack_type"),
            f["details"].alias("details"))) for i, f in enumerate(findings)])
    best = F.array_max(F.array_compact(ranked))
    return F.struct(F.coalesce(best["attack_type"], F.lit("NORMAL")).alias("attack_type"),
                    F.coalesce(best["severity"], F.lit(0.0)).alias("severity"),
                    F.coalesce(best["details"], F.lit("")).alias("details"))


def hits(rows: DataFrame, detector: str, position: int, severity: Column, details: Column) -> DataFrame:
    """Rows of one detector in the shape that ``resolve`` combines."""
    return rows.select("packet_id", F.lit(detector).alias("detector"), F.lit(position).alias("position"),
                       severity.cast("double").alias("severity"), details.cast("string").alias("details"))


def all_hits(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def resolve(found: DataFrame) -> DataFrame:
    """One row per packet with hits: the most severe, first listed on ties. A hit of severity 0 decides nothing.

    Only hits are shuffled, by packet.
    """
    best = F.max(F.struct(F.col("severity"), (-F.col("position")).alias("order"), F.col("detector"), F.col("details")))
    return (found.where(F.col("severity") > 0).groupBy("packet_id").agg(best.alias("best"))
            .select("packet_id", F.col("best.detector").alias("attack_type"), "best.severity", "best.details"))


def resolve_layers(found: DataFrame, outranked: Sequence[str] = ()) -> DataFrame:
    """One row per layer and packet with hits, as ``resolve``. ``outranked`` names detectors with hits of rank 1, which count only where
    the packet has none of rank 0 of the same name; any other hit of the packet competes as usual."""
    best = F.struct(F.col("severity"), (-F.col("position")).alias("order"), F.col("detector"), F.col("details"))
    first = F.col("rank") == 0
    replaced = first & F.col("detector").isin([*outranked])
    by = found.where(F.col("severity") > 0).groupBy("layer", "packet_id").agg(
        F.max(F.when(first, best)).alias("a"), F.max(F.when(~first, best)).alias("b"), F.max(X.flag(replaced)).alias("replaced"))
    won = F.greatest(F.col("a"), F.when(F.col("replaced") == 0, F.col("b")))
    return by.withColumn("best", won).select("layer", "packet_id", F.col("best.detector").alias("attack_type"), "best.severity", "best.details")


def with_verdict(rows: DataFrame, found: DataFrame) -> DataFrame:
    """All rows with ``attack_type``, ``severity`` and ``details``; rows without a hit are NORMAL."""
    return with_best(rows, resolve(found))


def with_best(rows: DataFrame, best: DataFrame) -> DataFrame:
    """All rows with the verdict of their packet, if it has one."""
    return rows.join(best, "packet_id", "left").withColumns({
        "attack_type": F.coalesce("attack_type", F.lit("NORMAL")),
        "severity": F.coalesce("severity", F.lit(0.0)),
        "details": F.coalesce("details", F.lit(""))})


def combine_layers(alerts: dict[str, DataFrame]) -> DataFrame:
    """Alerts of several layers as one table with a ``layer`` column."""
    named = [df.withColumn("layer", F.lit(layer)) for layer, df in alerts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def alert_table(packets: DataFrame, alerts: DataFrame) -> DataFrame:
    """Alerts of any layers with the packet's time and addresses: ts, packet_id, layer, attack_type, severity, details,
    src_mac, dst_mac, src_ip, dst_ip. Only these columns of the packets are shuffled, once, by packet."""
    where = packets.select("packet_id", "ts", *[X.lower_mac(c).alias(c) for c in ("src_mac", "dst_mac")], "src_ip", "dst_ip")
    found = alerts.select("packet_id", "layer", "attack_type", "severity", "details")
    return found.join(where, "packet_id").select("ts", *found.columns, *where.columns[2:])


def hybrid_verdict(rule: Column, prediction: Column, confidence: Column, layer: str, floor: float = 0.7) -> Column:
    """The rule's (attack_type, confidence) if any, else a confident model's, else null."""
    model = F.when((prediction == 1) & (confidence > floor), F.struct(
        F.lit(f"{layer}_attack").alias("attack_type"), confidence.cast("double").alias("confidence")))
    return F.coalesce(rule, model)
