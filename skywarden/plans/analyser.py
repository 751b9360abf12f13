"""Stateless rules on single packets, and the combination of rules with a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from skywarden.functions import scalars as X, scope
from skywarden.operators.verdict import hybrid_verdict

RULE_CONFIDENCE = 0.8


def suspicion() -> Column:
    """Name of the first rule a packet breaks, else null."""
    size, ttl, ip = F.col("packet_size"), F.col("ttl"), X.is_ip()
    return (F.when((size < 20) | (size > 9000), "unusual_packet_size")
            .when(ip & ((ttl < 10) | (ttl > 255)), "unusual_ttl")
            .when(ip & X.has_bits("ip_flags", 1), "fragmented_packet")
            .when(X.is_tcp() & (F.col("tcp_flags") == X.SYN), "potential_syn_flood")
            .when(X.is_tcp() & (F.col("sport") == F.col("dport")), "same_port_attack"))


def rule_alerts(packets: DataFrame, target_ip: str) -> DataFrame:
    """Packets of the target (and non-IP packets) that break a rule."""
    named = scope.target_or_non_ip(packets, target_ip).withColumn("attack_type", suspicion())
    return named.where(F.col("attack_type").isNotNull()).select(
        "packet_id", "ts", "attack_type", F.lit(RULE_CONFIDENCE).alias("confidence"), "src_ip", "dst_ip", "ip_proto")


def features(packets: DataFrame) -> DataFrame:
    """The nine numeric model features, with defaults for absent layers."""
    tcp = X.is_tcp()
    ports = tcp | X.is_udp()

    def where(test: Column, column: str, default: int) -> Column:
        return F.coalesce(F.when(test, F.col(column)), F.lit(default)).cast("int")
    return packets.select(
        "packet_id", "ts", "src_ip", "dst_ip", F.col("packet_size"), where(X.is_ip(), "ip_len", 0).alias("ip_len"),
        where(X.is_ip(), "ttl", 64).alias("ttl"), where(X.is_ip(), "ip_proto", 0).alias("protocol"),
        where(X.is_ip(), "ip_flags", 0).alias("flags"), where(ports, "sport", 0).alias("src_port"),
        where(ports, "dport", 0).alias("dst_port"), where(tcp, "tcp_flags", 0).alias("tcp_flags"),
        where(tcp, "tcp_window", 0).alias("window"))


def with_rule(packets: DataFrame, target_ip: str) -> DataFrame:
    named = scope.target_or_non_ip(packets, target_ip).withColumn("attack_type", suspicion())
    return named.withColumn("rule", F.when(F.col("attack_type").isNotNull(), F.struct(
        "attack_type", F.lit(RULE_CONFIDENCE).alias("confidence")))).drop("attack_type")


def hybrid_alerts(scored: DataFrame, layer: str, floor: float = 0.7) -> DataFrame:
    """Alerts of rows with ``rule``, ``prediction`` and ``confidence``: the rule first, then a confident model."""
    both = scored.withColumn("verdict", hybrid_verdict(F.col("rule"), F.col("prediction"), F.col("confidence"), layer, floor))
    return both.where(F.col("verdict").isNotNull()).select(
        "packet_id", "ts", "verdict.attack_type", "verdict.confidence", "src_ip", "dst_ip")
