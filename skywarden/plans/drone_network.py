"""Drone link layer: command, MQTT and deauthentication floods, GPS spoofing, video hijacking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from skywarden.functions import scalars as X, scope
from skywarden.operators.ordered import RateRule
from skywarden.operators.report import stream_size_stats
from skywarden.operators.suppress import greedy_suppress
from skywarden.operators.tracks import FEED, RUNNING, Track, events, fed, fired, of_rule, state_of
from skywarden.operators.verdict import HIT, all_hits, hits, with_verdict
from skywarden.session import written
from skywarden.plans.rates import Limits, limited, rate_hits

DETECTORS = ("COMMAND_FLOOD", "GPS_SPOOF", "VIDEO_HIJACK", "MQTT_FLOOD", "WIFI_DEAUTH")
POSITION = {d: i for i, d in enumerate(DETECTORS)}


def _per(window_s: float) -> str:
    return f"/{window_s:g}s"


def rules(limits: Limits | None = None) -> list[RateRule]:
    def command(window_s: float = 5, limit: int = 15) -> RateRule:
        return RateRule("COMMAND_FLOOD", X.is_udp() & (F.col("dport") == 5760), ("src_ip",), window_s, limit,
                        severity=lambda n: F.least(n, F.lit(10)),
                        details=lambda n: X.text("rate:", n, _per(window_s)))

    def mqtt(window_s: float = 5, limit: int = 25) -> RateRule:
        return RateRule("MQTT_FLOOD", X.is_tcp() & (F.col("dport") == 1883), ("src_ip",), window_s, limit,
                        severity=lambda n: X.capped_ratio(n, 3),
                        details=lambda n: X.text("mqtt_rate:", n, _per(window_s)))

    def deauth(window_s: float = 5, limit: int = 10) -> RateRule:
        mac = F.when(F.coalesce("src_mac", F.lit("")) == "", "unknown").otherwise(F.col("src_mac"))
        return RateRule("WIFI_DEAUTH", X.is_deauth(), (mac,), window_s, limit, severity=lambda n: F.lit(9),
                        details=lambda n: X.text("deauth_rate:", n, _per(window_s) + ",mac:", mac))

    limits = limits or {}
    return [make(*limits.get(name, ())) for name, make in
            (("COMMAND_FLOOD", command), ("MQTT_FLOOD", mqtt), ("WIFI_DEAUTH", deauth))]


def link_floods(packets: DataFrame, drone_ips: Sequence[str], limits: Limits | None = None, only: str | None = None) -> DataFrame:
    wanted = [r for r in rules(limits) if only in (None, r.name)]
    return rate_hits(scope.drone_link_scope(packets, drone_ips), wanted, POSITION, ["src_mac"]).drop("rate")


def gps_spoof(packets: DataFrame, drone_ips: Sequence[str], gap_s: float = 1) -> DataFrame:
    """Large MAVLink datagrams less than ``gap_s`` after the sensor's last accepted one."""
    return rapid_updates(packets.where(scope.in_drone_link(drone_ips) & _position_update()), gap_s)


def _position_update() -> Column:
    return X.is_udp() & (F.col("dport") == 5760) & (X.payload_size() > 30)


def rapid_updates(updates: DataFrame, gap_s: float) -> DataFrame:
    updates = updates.select("packet_id", "ts", "sensor_id")
    rapid = greedy_suppress(updates, ["sensor_id"], gap_s, inclusive=False).where("flagged")
    return hits(rapid, "GPS_SPOOF", 1, F.lit(8), F.lit("rapid_gps_changes"))


def video_hijack(packets: DataFrame, drone_ips: Sequence[str], small: int = 100, samples: int = 10,
                 share: float = 0.3) -> DataFrame:
    """Video packets of a stream of which too many packets so far were small."""
    video = scope.drone_link_scope(packets, drone_ips).where(X.is_udp() & (F.col("dport") == 554)).select(
        "packet_id", "ts", "src_ip", "sport", "packet_size")
    stats = stream_size_stats(video, small)
    odd = stats.where((F.col("packet_count") > samples) & (F.col("small_count") / F.col("packet_count") > share))
    return hits(odd, "VIDEO_HIJACK", 2, F.lit(7),
                X.text("anomaly_rate:", X.ratio_text(F.col("small_count"), F.col("packet_count"))))


def drone_network_hits(packets: DataFrame, drone_ips: Sequence[str], limits: Limits | None = None, gap_s: float = 1,
                       samples: int = 10) -> DataFrame:
    followed_by = tracks(drone_ips, limits, samples)
    tagged = written(events(packets, followed_by, CARRY), "events")
    return all_hits([fired(state_of(tagged, followed_by), followed_by).select(*HIT), fed_hits(tagged, followed_by, gap_s)])


CARRY = ("sensor_id", "src_mac")


def tracks(drone_ips: Sequence[str], limits: Limits | None = None, samples: int = 10, small: int = 100, share: float = 0.3) -> list[Track]:
    """The layer's detectors as tracks; position updates are fed to the suppression operator."""
    n, some = F.col("n"), F.col("also")
    mine = scope.in_drone_link(drone_ips)
    return [
        *[of_rule(rule, POSITION[rule.name], mine) for rule in rules(limits)],
        Track("VIDEO_HIJACK", RUNNING, mine & X.is_udp() & (F.col("dport") == 554), ("src_ip", "sport"), (n > samples) & (some / n > share),
              F.lit(7), X.text("anomaly_rate:", X.ratio_text(some, n)), amount=F.lit(1), also=X.flag(F.col("packet_size") < small), position=2),
        Track("GPS_SPOOF", FEED, mine & _position_update())]


def fed_hits(tagged: DataFrame, followed_by: Sequence[Track], gap_s: float = 1) -> DataFrame:
    return rapid_updates(fed(tagged, followed_by, "GPS_SPOOF"), gap_s)


def drone_network_log(packets: DataFrame, drone_ips: Sequence[str], limits: Limits | None = None, gap_s: float = 1,
                      samples: int = 10) -> DataFrame:
    rows = scope.drone_link_scope(packets, drone_ips).select(
        "packet_id", "ts", F.coalesce("src_ip", F.lit("unknown")).alias("src_ip"),
        F.coalesce("dst_ip", F.lit("unknown")).alias("dst_ip"), F.coalesce(X.transport_port("dport"), F.lit(0)).alias("port"),
        X.link_protocol().alias("protocol"), "packet_size")
    return with_verdict(rows, drone_network_hits(packets, drone_ips, limits, gap_s, samples))
