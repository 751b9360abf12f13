"""Drone internet layer: MAC changes, GPS injection, routing anomalies, ICMP and fragment floods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from skywarden.functions import scalars as X, scope
from skywarden.operators.ordered import RateRule, seen_distinct
from skywarden.operators.tracks import SEEN, Track, fired, followed, of_rule
from skywarden.operators.verdict import hits, with_verdict
from skywarden.plans.rates import Limits, rate_hits

DETECTORS = ("IP_SPOOFING", "GPS_INJECTION", "ROUTING_ATTACK", "ICMP_FLOOD", "FRAG_ATTACK")
POSITION = {d: i for i, d in enumerate(DETECTORS)}


def _per(window_s: float) -> str:
    return f"/{window_s:g}s"


def many_macs(packets: DataFrame, fleet: Sequence[str], limit: int = 3) -> DataFrame:
    """Rows of a source IP seen with more than ``limit`` MACs so far."""
    rows = scope.fleet_scope(packets, fleet).select(
        "packet_id", "ts", "src_ip", F.coalesce("src_mac", F.lit("unknown")).alias("mac"))
    seen = seen_distinct(rows, ["src_ip"], "mac", ["src_ip"]).where(F.col("n_distinct") > limit)
    return hits(seen, "IP_SPOOFING", 0, F.least(F.col("n_distinct") + 5, F.lit(10)),
                X.text("ip:", F.col("src_ip"), ",macs:", F.col("n_distinct")))


def odd_ttl() -> Column:
    return F.coalesce((F.col("ttl") > 128) | (F.col("ttl") < 10), F.lit(False))


def unexpected_gateway(drone_ip: str, gateways: Sequence[str], subnet: str = "192.168.4.") -> Column:
    return ((F.col("dst_ip") == drone_ip) & ~F.col("src_ip").isin([*gateways])
            & ~F.startswith(F.col("src_ip"), F.lit(subnet)))


def rules(drone_ip: str, gateways: Sequence[str] = ("",), limits: Limits | None = None) -> list[RateRule]:
    ttl, gateway = odd_ttl(), unexpected_gateway(drone_ip, gateways)

    def gps(window_s: float = 10, limit: int = 10) -> RateRule:
        where = X.is_udp() & (F.col("dport") == 5760) & (X.payload_size() >= 20) & (X.byte_at("payload", 0) == 0xFD)
        return RateRule("GPS_INJECTION", where, ("src_ip",), window_s, limit, severity=lambda n: F.lit(8),
                        details=lambda n: X.text("gps_rate:", n, _per(window_s) + ",from:", F.col("src_ip")))

    def routing(window_s: float = 10, limit: int = 5) -> RateRule:
        causes = X.text(F.when(ttl, X.text("suspicious_ttl:", F.col("ttl"), ",")),
                        F.when(gateway, X.text("unexpected_gateway:", F.col("src_ip"), ",")))
        return RateRule("ROUTING_ATTACK", ttl | gateway, ("src_ip", "dst_ip"), window_s, limit,
                        severity=lambda n: F.lit(7), details=lambda n: X.text(causes, "anomaly_count:", n))

    def icmp(window_s: float = 5, limit: int = 20) -> RateRule:
        return RateRule("ICMP_FLOOD", X.is_icmp(), ("src_ip",), window_s, limit,
                        severity=lambda n: X.capped_ratio(n, 2),
                        details=lambda n: X.text("icmp_rate:", n, _per(window_s) + ",type:", F.col("icmp_type")))

    def fragments(window_s: float = 5, limit: int = 15) -> RateRule:
        return RateRule("FRAG_ATTACK", X.is_fragmented(), ("src_ip",), window_s, limit, severity=lambda n: F.lit(6),
                        details=lambda n: X.text("frag_rate:", n, _per(window_s) + ",flags:", X.ip_flag_names(),
                                                 ",offset:", F.col("ip_frag")))

    limits = limits or {}
    return [make(*limits.get(name, ())) for name, make in
            (("GPS_INJECTION", gps), ("ROUTING_ATTACK", routing), ("ICMP_FLOOD", icmp), ("FRAG_ATTACK", fragments))]


def internet_rates(packets: DataFrame, fleet: Sequence[str], gateways: Sequence[str] = ("",),
                   limits: Limits | None = None, only: str | None = None) -> DataFrame:
    """Rate detectors of the layer; ``fleet[0]`` is the drone itself."""
    wanted = [r for r in rules(fleet[0], gateways, limits) if only in (None, r.name)]
    carry = ["src_ip", "dst_ip", "ttl", "icmp_type", "ip_flags", "ip_frag"]
    return rate_hits(scope.fleet_scope(packets, fleet), wanted, POSITION, carry).drop("rate")


def drone_internet_hits(packets: DataFrame, fleet: Sequence[str], gateways: Sequence[str] = ("",),
                        limits: Limits | None = None, macs: int = 3) -> DataFrame:
    followed_by = tracks(fleet, gateways, limits, macs)
    return fired(followed(packets, followed_by, CARRY), followed_by)


CARRY = ("src_ip", "dst_ip", "ttl", "icmp_type", "ip_flags", "ip_frag")


def tracks(fleet: Sequence[str], gateways: Sequence[str] = ("",), limits: Limits | None = None, macs: int = 3) -> list[Track]:
    """The layer's detectors as tracks."""
    n, mine = F.col("n"), scope.in_fleet(fleet)
    return [
        Track("IP_SPOOFING", SEEN, mine, ("src_ip",), n > macs, F.least(n + 5, F.lit(10)), X.text("ip:", F.col("src_ip"), ",macs:", n),
              values=(F.coalesce("src_mac", F.lit("unknown")),)),
        *[of_rule(rule, POSITION[rule.name], mine) for rule in rules(fleet[0], gateways, limits)]]


def drone_internet_log(packets: DataFrame, fleet: Sequence[str], gateways: Sequence[str] = ("",),
                       limits: Limits | None = None, macs: int = 3) -> DataFrame:
    rows = scope.fleet_scope(packets, fleet).select(
        "packet_id", "ts", "src_ip", "dst_ip", "ttl", F.col("ip_id"), F.col("ip_proto").alias("protocol"),
        X.flag(X.is_fragmented()).alias("is_fragmented"))
    return with_verdict(rows, drone_internet_hits(packets, fleet, gateways, limits, macs))
