"""Drone transport layer: SYN and UDP floods, port scans, connection hijacking, session replay."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from skywarden import schema as S
from skywarden.functions import scalars as X, scope
from skywarden.operators import lookups
from skywarden.operators.ordered import RateRule, seen_distinct
from skywarden.operators.sequence import CONNECTION, judged_alerts, sequence_alerts, sequence_rows
from skywarden.operators.suppress import greedy_suppress
from skywarden.operators.tracks import FEED, SEEN, Track, events, fed, fired, of_rule, state_of
from skywarden.operators.verdict import HIT, all_hits, hits, with_verdict
from skywarden.plans.rates import Limits, rate_hits
from skywarden.session import written

DETECTORS = ("SYN_FLOOD", "UDP_FLOOD", "PORT_SCAN", "CONNECTION_HIJACK", "SESSION_REPLAY")
POSITION = {d: i for i, d in enumerate(DETECTORS)}


def _per(window_s: float) -> str:
    return f"/{window_s:g}s"


def rules(limits: Limits | None = None) -> list[RateRule]:
    def syn(window_s: float = 5, limit: int = 30) -> RateRule:
        opening = X.has_bits("tcp_flags", X.SYN) & ~X.has_bits("tcp_flags", X.ACK)
        return RateRule("SYN_FLOOD", X.is_tcp() & opening, ("src_ip",), window_s, limit,
                        severity=lambda n: X.capped_ratio(n, 3),
                        details=lambda n: X.text("syn_rate:", n, _per(window_s) + ",target_port:", F.col("dport")))

    def udp(window_s: float = 5, limit: int = 50) -> RateRule:
        service = lookups.name_of("dport", S.DRONE_PORTS)
        return RateRule("UDP_FLOOD", X.is_udp(), ("src_ip",), window_s, limit, severity=lambda n: X.capped_ratio(n, 5),
                        details=lambda n: X.text("udp_rate:", n, _per(window_s) + ",service:", service, ",port:",
                                                 F.col("dport")))

    limits = limits or {}
    return [make(*limits.get(name, ())) for name, make in (("SYN_FLOOD", syn), ("UDP_FLOOD", udp))]


def transport_floods(packets: DataFrame, fleet: Sequence[str], limits: Limits | None = None, only: str | None = None) -> DataFrame:
    wanted = [r for r in rules(limits) if only in (None, r.name)]
    return rate_hits(scope.fleet_transport_scope(packets, fleet), wanted, POSITION, ["dport"]).drop("rate")


def port_scan(packets: DataFrame, fleet: Sequence[str], limit: int = 10, keys: Sequence[str] = ("src_ip", "dst_ip")) -> DataFrame:
    """Probing rows (UDP, or TCP with SYN) of a flow with more than ``limit`` destination ports so far."""
    probes = scope.fleet_transport_scope(packets, fleet).where(X.is_udp() | X.has_bits("tcp_flags", X.SYN)).select(
        "packet_id", "ts", "src_ip", "dst_ip", "dport")
    known = F.col("value").isin(list(S.DRONE_PORTS))
    seen = seen_distinct(probes, keys, "dport", also=known).where(F.col("n_distinct") > limit)
    return hits(seen, "PORT_SCAN", 2, X.capped_ratio(F.col("n_distinct"), 2),
                X.text("ports_scanned:", F.col("n_distinct"), ",drone_ports:", F.col("n_also")))


def connection_hijack(packets: DataFrame, fleet: Sequence[str], threshold: int = 5,
                      keys: Sequence[str] = CONNECTION) -> DataFrame:
    return hijack_hits(sequence_alerts(scope.fleet_transport_scope(packets, fleet), threshold, keys))


def hijack_hits(alerts: DataFrame) -> DataFrame:
    return hits(alerts, "CONNECTION_HIJACK", 3, F.lit(8),
                X.text("seq_anomalies:", F.col("anomalies"), ",expected:", F.col("expected"), ",got:", F.col("got")))


def session_replay(packets: DataFrame, fleet: Sequence[str], gap_s: float = 2) -> DataFrame:
    """Payloads seen on the same flow at most ``gap_s`` after their last stored copy."""
    data = scope.fleet_transport_scope(packets, fleet).where(X.has_payload()).select(
        "packet_id", "ts", "src_ip", "dst_ip", X.payload_md5().alias("hash"))
    return replay_hits(data, gap_s)


def replay_hits(data: DataFrame, gap_s: float) -> DataFrame:
    again = greedy_suppress(data, ["src_ip", "dst_ip", "hash"], gap_s).where("flagged")
    gap = (X.micros("ts") - X.micros("anchor_ts")) / 1e6
    return hits(again, "SESSION_REPLAY", 4, F.lit(7), X.text(
        "replay_detected,hash:", F.left("hash", F.lit(8)), ",time_diff:", X.two_decimals(gap), "s"))


def drone_transport_hits(packets: DataFrame, fleet: Sequence[str], limits: Limits | None = None, ports: int = 10,
                         anomalies: int = 5, gap_s: float = 2) -> DataFrame:
    followed_by = tracks(fleet, limits, ports)
    tagged = written(events(prepared(packets, fleet), followed_by, CARRY), "events")
    return all_hits([fired(state_of(tagged, followed_by), followed_by).select(*HIT), fed_hits(tagged, followed_by, anomalies, gap_s)])


CARRY = ("src_ip", "dst_ip", "sport", "dport", "ip_proto", "tcp_flags", "tcp_seq", "hash", "size")


def prepared(packets: DataFrame, fleet: Sequence[str]) -> DataFrame:
    """Packets with the size and, where the layer needs it, the hash of their payload."""
    return packets.withColumns({"size": X.payload_size(), "hash": F.when(scope.in_fleet_transport(fleet) & X.has_payload(), X.payload_md5())})


def tracks(fleet: Sequence[str], limits: Limits | None = None, ports: int = 10) -> list[Track]:
    """The layer's detectors as tracks; connections and payloads are fed to the sequence machine and the suppression operator."""
    n, mine = F.col("n"), scope.in_fleet_transport(fleet)
    probe = X.is_udp() | X.has_bits("tcp_flags", X.SYN)
    return [
        *[of_rule(rule, POSITION[rule.name], mine) for rule in rules(limits)],
        Track("PORT_SCAN", SEEN, mine & probe, ("src_ip", "dst_ip"), n > ports, X.capped_ratio(n, 2),
              X.text("ports_scanned:", n, ",drone_ports:", F.col("also")), values=(F.col("dport"),),
              also=F.col("dport").isin(list(S.DRONE_PORTS)), position=2),
        Track("CONNECTION_HIJACK", FEED, mine & X.is_tcp() & F.col("tcp_seq").isNotNull()),
        Track("SESSION_REPLAY", FEED, mine & X.has_payload())]


def fed_hits(tagged: DataFrame, followed_by: Sequence[Track], anomalies: int = 5, gap_s: float = 2) -> DataFrame:
    connections = sequence_rows(fed(tagged, followed_by, "CONNECTION_HIJACK"), size=F.col("size"))
    payloads = fed(tagged, followed_by, "SESSION_REPLAY").select("packet_id", "ts", "src_ip", "dst_ip", "hash")
    return all_hits([hijack_hits(judged_alerts(connections, anomalies)), replay_hits(payloads, gap_s)])


def drone_transport_log(packets: DataFrame, fleet: Sequence[str], limits: Limits | None = None, ports: int = 10,
                        anomalies: int = 5, gap_s: float = 2) -> DataFrame:
    tcp = X.is_tcp()
    rows = scope.fleet_transport_scope(packets, fleet).select(
        "packet_id", "ts", "src_ip", "dst_ip", F.col("sport").alias("src_port"), F.col("dport").alias("dst_port"),
        X.transport_protocol().alias("protocol"), F.when(tcp, F.col("tcp_flags")).otherwise(0).alias("tcp_flags"),
        F.when(tcp, F.col("tcp_seq")).otherwise(0).cast("long").alias("sequence_num"), X.payload_size().alias("payload_size"))
    return with_verdict(rows, drone_transport_hits(packets, fleet, limits, ports, anomalies, gap_s))
