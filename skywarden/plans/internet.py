"""General internet layer: IP spoofing, ping, SYN and UDP floods, port scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from skywarden.functions import scalars as X, scope
from skywarden.operators.ordered import RateRule, first_binding, seen_distinct
from skywarden.operators.tracks import FIRST, SEEN, Track, fired, followed, of_rule
from skywarden.operators.verdict import hits
from skywarden.plans.marks import flags_by_packet, with_flags
from skywarden.plans.rates import Limits, limited, rate_hits

DETECTORS = ("IP_SPOOFING", "PING_FLOOD", "SYN_FLOOD", "UDP_FLOOD", "PORT_SCAN")


def ip_spoofing(packets: DataFrame, ttl_change: int = 10) -> DataFrame:
    """Rows whose TTL is far from, or whose MAC differs from, the source's first row."""
    rows = scope.ip_packets(packets).select("packet_id", "ts", "src_ip", "ttl", "src_mac")
    bound = first_binding(rows, ["src_ip"], ["ttl", "src_mac"])
    changed = ((F.abs(F.col("ttl") - F.col("first_ttl")) > ttl_change)
               | ~F.col("src_mac").eqNullSafe(F.col("first_src_mac")))
    return hits(bound.where(changed), "IP_SPOOFING", 0, F.lit(1), F.lit(""))


def flood_rules() -> list[RateRule]:
    kind = X.protocol_class()
    ip = X.is_ip()
    return [RateRule("PING_FLOOD", ip & (kind == "ICMP"), ("src_ip",), 10, 10),
            RateRule("SYN_FLOOD", ip & (kind == "TCP-SYN"), ("src_ip",), 10, 100),
            RateRule("UDP_FLOOD", ip & (kind == "UDP"), ("src_ip",), 10, 100)]


def floods(packets: DataFrame, limits: Limits | None = None, only: str | None = None) -> DataFrame:
    rules = [r for r in limited(flood_rules(), limits) if only in (None, r.name)]
    return rate_hits(packets, rules, {d: i for i, d in enumerate(DETECTORS)}).drop("rate")


def port_scan(packets: DataFrame, limit: int = 20) -> DataFrame:
    """Rows of sources with more than ``limit`` destination ports so far; rows without a port count as port 0."""
    rows = scope.ip_packets(packets).select(
        "packet_id", "ts", "src_ip", F.coalesce(X.transport_port("dport"), F.lit(0)).alias("port"))
    seen = seen_distinct(rows, ["src_ip"], "port").where(F.col("n_distinct") > limit)
    return hits(seen, "PORT_SCAN", 4, F.lit(1), F.lit(""))


def tracks(limits: Limits | None = None, ports: int = 20, ttl_change: int = 10) -> list[Track]:
    """The layer's detectors as tracks."""
    value, first = (lambda i: F.get("values", F.lit(i))), (lambda i: F.get("first", F.lit(i)))
    changed = (F.abs(value(0).cast("int") - first(0).cast("int")) > ttl_change) | ~value(1).eqNullSafe(first(1))
    return [
        Track("IP_SPOOFING", FIRST, X.is_ip(), ("src_ip",), changed, F.lit(1), values=(F.col("ttl"), F.col("src_mac"))),
        *[of_rule(rule, i) for i, rule in enumerate(limited(flood_rules(), limits), 1)],
        Track("PORT_SCAN", SEEN, X.is_ip(), ("src_ip",), F.col("n") > ports, F.lit(1), position=4,
              values=(F.coalesce(X.transport_port("dport"), F.lit(0)),))]


def internet_hits(packets: DataFrame, limits: Limits | None = None, ports: int = 20) -> DataFrame:
    followed_by = tracks(limits, ports)
    return fired(followed(packets, followed_by), followed_by)


def alert_text(detectors: tuple[str, ...] = DETECTORS) -> Column:
    return X.joined_names({d: F.col(d.lower()) == 1 for d in detectors})


def internet_log(packets: DataFrame, limits: Limits | None = None, ports: int = 20) -> DataFrame:
    """One row per IP packet: protocol fields, five flags, and the names of the set flags joined with ``+``."""
    rows = scope.ip_packets(packets).select(
        "packet_id", "ts", "src_mac", "src_ip", "dst_ip", X.protocol_class().alias("protocol"), "ttl", "packet_size",
        *[F.coalesce(X.transport_port(p), F.lit(0)).alias(p) for p in ("sport", "dport")],
        F.when(X.is_tcp(), F.col("tcp_flags")).otherwise(0).alias("tcp_flags"),
        F.when(X.is_icmp(), F.col("icmp_type")).otherwise(0).alias("icmp_type"))
    flags = flags_by_packet(internet_hits(packets, limits, ports), DETECTORS)
    return with_flags(rows, flags).withColumn("alert", alert_text())


def internet_alerts(packets: DataFrame, limits: Limits | None = None, ports: int = 20) -> DataFrame:
    """(packet_id, alert) of packets with any flag; only hits are shuffled."""
    return flags_by_packet(internet_hits(packets, limits, ports), DETECTORS).select("packet_id", alert_text().alias("alert"))


def internet_findings(packets: DataFrame, limits: Limits | None = None, ports: int = 20) -> DataFrame:
    """The alerts in the shape of the other layers; an alert of this layer has severity 1 and no details."""
    return internet_alerts(packets, limits, ports).select(
        "packet_id", F.col("alert").alias("attack_type"), F.lit(1.0).alias("severity"), F.lit("").alias("details"))
