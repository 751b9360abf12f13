"""General link layer: ARP spoofing, deauthentication floods, evil twins, MAC flooding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from skywarden.functions import scalars as X, scope
from skywarden.operators.ordered import RateRule, distinct_over, first_binding, running_counts, seen_distinct
from skywarden.operators.tracks import FIRST, RECENT, RUNNING, SEEN, Track, fired, followed, of_rule
from skywarden.operators.verdict import all_hits, hits, resolve
from skywarden.plans.rates import Limits, limited, rate_hits

SAMPLED = "SAMPLED"
DETECTORS = ("ARP_SPOOFING", "DEAUTH_ATTACK", "EVIL_TWIN", "MAC_FLOODING")


def arp_spoofing(packets: DataFrame) -> DataFrame:
    """ARP rows whose sender MAC is not the first one seen for the sender IP."""
    arp = scope.wlan_frames(packets).where(F.col("arp_psrc").isNotNull()).select(
        "packet_id", "ts", "arp_psrc", F.lower("arp_hwsrc").alias("mac"))
    changed = first_binding(arp, ["arp_psrc"], ["mac"]).where(~F.col("mac").eqNullSafe(F.col("first_mac")))
    return hits(changed, "ARP_SPOOFING", 0, F.lit(0.8), F.lit(""))


def deauth_rule() -> RateRule:
    return RateRule("DEAUTH_ATTACK", X.is_deauth(), (X.lower_mac("src_mac"),), 10, 5,
                    severity=lambda n: X.saturating(0.7, n * F.lit(0.05), 0.95))


def deauth_attack(packets: DataFrame, limits: Limits | None = None) -> DataFrame:
    return rate_hits(packets, limited([deauth_rule()], limits), {"DEAUTH_ATTACK": 1}).drop("rate")


def evil_twin(packets: DataFrame, limit: int = 1) -> DataFrame:
    """Beacons whose network name was seen with more than ``limit`` BSSIDs so far."""
    beacons = packets.where(X.is_beacon() & (F.col("ssid") != "") & (F.col("bssid") != "")).select(
        "packet_id", "ts", "ssid", F.lower("bssid").alias("bssid"))
    seen = seen_distinct(beacons, ["ssid"], "bssid").where(F.col("n_distinct") > limit)
    return hits(seen, "EVIL_TWIN", 2, F.lit(0.7), F.lit(""))


def mac_rates(packets: DataFrame, window_s: float = 5) -> DataFrame:
    """Distinct source MACs per sensor in the trailing window, at every frame that is no beacon or deauth."""
    management = F.coalesce(X.is_deauth() | X.is_beacon(), F.lit(False))
    frames = scope.wlan_frames(packets).where(~management & (X.lower_mac("src_mac") != "")).select(
        "packet_id", "ts", "sensor_id", X.lower_mac("src_mac").alias("mac"))
    return distinct_over(frames, ["sensor_id"], "mac", window_s)


def mac_flooding(packets: DataFrame, window_s: float = 5, limit: int = 30) -> DataFrame:
    return _mac_hits(mac_rates(packets, window_s), limit)


def _mac_hits(rates: DataFrame, limit: int) -> DataFrame:
    return hits(rates.where(F.col("n_distinct") > limit), "MAC_FLOODING", 3,
                X.saturating(0.6, F.col("n_distinct") * F.lit(0.01), 0.95), F.lit(""))


def sampled(packets: DataFrame, every: int = 10) -> DataFrame:
    """(packet_id) of every n-th packet of a sensor, all packets counted."""
    return running_counts(packets, ["sensor_id"], {"n": F.lit(1)}).where(F.col("n") % every == 0).select("packet_id")


def _target(target_mac: str) -> Column:
    return (X.lower_mac("src_mac") == target_mac) | (X.lower_mac("dst_mac") == target_mac)


def tracks(limits: Limits | None = None, twins: int = 1, mac_window_s: float = 5, mac_limit: int = 30, every: int | None = None) -> list[Track]:
    """The layer's detectors as tracks. With ``every``, each frame's MAC rate and every n-th packet come out too, with severity 0."""
    n, wlan = F.col("n"), X.is_wlan()
    changed = ~F.get("values", F.lit(0)).eqNullSafe(F.get("first", F.lit(0)))
    management = F.coalesce(X.is_deauth() | X.is_beacon(), F.lit(False))
    mac = X.lower_mac("src_mac")
    over = n > mac_limit
    found = [
        Track("ARP_SPOOFING", FIRST, wlan & F.col("arp_psrc").isNotNull(), ("arp_psrc",), changed, F.lit(0.8), values=(F.lower("arp_hwsrc"),)),
        of_rule(limited([deauth_rule()], limits)[0], 1),
        Track("EVIL_TWIN", SEEN, X.is_beacon() & (F.col("ssid") != "") & (F.col("bssid") != ""), ("ssid",), n > twins, F.lit(0.7),
              values=(F.lower("bssid"),), position=2),
        Track("MAC_FLOODING", RECENT, wlan & ~management & (mac != ""), ("sensor_id",), over if every is None else F.lit(True),
              F.when(over, X.saturating(0.6, n * F.lit(0.01), 0.95)).otherwise(0), window_s=mac_window_s, values=(mac,), position=3)]
    if every is not None:
        found.append(Track(SAMPLED, RUNNING, F.lit(True), ("sensor_id",), n % every == 0, F.lit(0), amount=F.lit(1), position=4))
    return found


def network_log(packets: DataFrame, target_mac: str = "", limits: Limits | None = None, twins: int = 1,
                mac_window_s: float = 5, mac_limit: int = 30, every: int = 10, all_rows: bool = False) -> DataFrame:
    """The link-layer log: one verdict per 802.11 frame. Attacks, target rows and every n-th other packet are kept."""
    followed_by = tracks(limits, twins, mac_window_s, mac_limit, every)
    marks = fired(followed(packets, followed_by), followed_by)
    hit = F.col("severity") > 0
    best = F.max(F.when(hit, F.struct("severity", (-F.col("position")).alias("order"), "detector"))).alias("best")
    # one shuffle by packet gathers verdict, flags, MAC rate and sampling mark
    by_packet = marks.groupBy("packet_id").agg(
        best, *[F.max(X.flag(hit & (F.col("detector") == d))).alias(d.lower()) for d in DETECTORS],
        F.max(F.when(F.col("detector") == "MAC_FLOODING", F.col("n"))).alias("packet_rate"),
        F.max(F.when(F.col("detector") == SAMPLED, 1)).alias("is_sampled"))
    rows = scope.wlan_frames(packets).select(
        "packet_id", "ts", X.lower_mac("src_mac").alias("src_mac"), X.lower_mac("dst_mac").alias("dst_mac"),
        X.rssi_or_zero().alias("rssi"), F.coalesce("channel", X.channel_of()).alias("channel"), "packet_size",
        X.flag(F.lower("dst_mac") == "ff:ff:ff:ff:ff:ff").alias("is_broadcast"),
        X.flag(F.col("arp_psrc").isNotNull()).alias("has_arp"), X.flag(X.is_beacon()).alias("has_beacon"),
        X.flag(X.is_deauth()).alias("has_deauth"), X.flag(X.is_probe_request()).alias("has_probe_req"),
        X.flag(_target(target_mac.lower())).alias("is_target_related"))
    log = rows.join(by_packet, "packet_id", "left")
    zero = {d.lower(): F.coalesce(d.lower(), F.lit(0)) for d in DETECTORS}
    log = log.withColumns({**zero, "packet_rate": F.coalesce("packet_rate", F.lit(0)).cast("int"),
                           "attack_type": F.coalesce("best.detector", F.lit("NORMAL")),
                           "confidence": F.coalesce("best.severity", F.lit(0.0))})
    if not all_rows:
        log = log.where((F.col("attack_type") != "NORMAL") | (F.col("is_target_related") == 1) | (F.col("is_sampled") == 1))
    return log.select(
        "packet_id", "ts", "src_mac", "dst_mac", "attack_type", "confidence", *[d.lower() for d in DETECTORS], "rssi",
        "channel", "packet_rate", "packet_size", "is_broadcast", "has_arp", "has_beacon", "has_deauth", "has_probe_req",
        "is_target_related")


def network_hits(packets: DataFrame, limits: Limits | None = None, twins: int = 1, mac_window_s: float = 5,
                 mac_limit: int = 30) -> DataFrame:
    return all_hits([arp_spoofing(packets), deauth_attack(packets, limits), evil_twin(packets, twins),
                     mac_flooding(packets, mac_window_s, mac_limit)])


def network_alerts(packets: DataFrame, **settings: object) -> DataFrame:
    """(packet_id, attack_type, severity, details) of attacked frames: highest confidence, first listed on ties."""
    followed_by = tracks(**settings)
    return resolve(fired(followed(packets, followed_by), followed_by))
