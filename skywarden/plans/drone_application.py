"""Drone application layer: MAVLink injection, HTTP attacks, MQTT hijacking, video manipulation, brute force."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from skywarden import schema as S
from skywarden.functions import patterns as P, scalars as X, scope
from skywarden.operators import lookups
from skywarden.operators.ordered import RateRule, running_counts, trailing_rates
from skywarden.operators.tracks import RATE, RUNNING, Track, fired, followed, of_rule
from skywarden.operators.verdict import all_hits, hits, resolve_layers, with_best
from skywarden.plans.rates import Limits, rate_hits

OUTRANKED = ("MAVLINK_INJECTION",)
DETECTORS = ("MAVLINK_INJECTION", "HTTP_ATTACK", "MQTT_HIJACKING", "VIDEO_MANIPULATION", "BRUTE_FORCE")
POSITION = {d: i for i, d in enumerate(DETECTORS)}


def _per(window_s: float) -> str:
    return f"/{window_s:g}s"


def messages(packets: DataFrame, fleet: Sequence[str]) -> DataFrame:
    """Scope rows with what the payload says; the payload itself goes no further and is never shuffled."""
    return scope.fleet_application_scope(packets, fleet).select("packet_id", "ts", "src_ip", "sport", "dport", *message_columns())


def message_columns() -> list[Column]:
    """What a payload says; each pattern is only looked for on the ports of its protocol."""
    tcp, port = X.is_tcp(), F.col("dport")
    http = tcp & port.isin(80, 8080, 443)
    mqtt = tcp & port.isin(1883, 8883) & (X.payload_size() >= 2)
    rtsp = tcp & (port == 554)
    login = tcp & port.isin(22, 23)
    none = F.array().cast("array<string>")

    def only(test, value):
        return F.when(test, value).otherwise(none)
    return [
        F.when(X.is_udp() & port.isin(5760, 14550), X.mavlink_header()).alias("mavlink"),
        X.flag(http & P.has_http_verb()).alias("http"), only(http, P.malicious_http()).alias("http_patterns"),
        X.flag(mqtt).alias("mqtt"), F.when(mqtt, X.mqtt_type()).alias("mqtt_type"),
        only(mqtt, P.suspicious_topics()).alias("topics"),
        X.flag(rtsp & P.has_rtsp_method()).alias("rtsp"), only(rtsp, P.suspicious_rtsp()).alias("rtsp_patterns"),
        X.flag(login).alias("login"), only(login, P.login_markers()).alias("markers")]


def mavlink_injection(rows: DataFrame, rate: tuple[float, int] = (10, 20), dangerous: tuple[float, int] = (5, 5)) -> DataFrame:
    """Too many MAVLink messages of a source, else too many dangerous ones at a dangerous one. ``rows``: ``messages``."""
    message = F.col("mavlink.message_id")
    frames = F.col("mavlink").isNotNull()
    risky = frames & message.isin(list(S.MAVLINK_DANGEROUS))
    rates = trailing_rates(rows, [RateRule("all", frames, ("src_ip",), *rate),
                                  RateRule("dangerous", risky, ("src_ip",), *dangerous)], ["mavlink"])
    over = rates.where(F.col("rate") > F.when(F.col("rule") == 0, rate[1]).otherwise(dangerous[1]))
    best = over.groupBy("packet_id").agg(
        F.max(F.when(F.col("rule") == 0, F.col("rate"))).alias("total"),
        F.max(F.when(F.col("rule") == 1, F.col("rate"))).alias("risky"), F.first("mavlink").alias("mavlink"))
    total, name = F.col("total"), lookups.message_name("mavlink.message_id", S.MAVLINK_DANGEROUS)
    flood = X.text("rate:", total, _per(rate[0]) + ",cmd:", name, ",sys_id:", F.col("mavlink.system_id"))
    risk = X.text("dangerous_cmd:", name, ",count:", F.col("risky"), _per(dangerous[0]))
    return hits(best, "MAVLINK_INJECTION", 0,
                F.when(total.isNotNull(), F.least(F.lit(8) + F.floor(total / 10), F.lit(10))).otherwise(9),
                F.when(total.isNotNull(), flood).otherwise(risk))


def _http(window_s: float = 5, limit: int = 15) -> RateRule:
    found = F.col("http_patterns")
    bad = F.size(found) > 0
    return RateRule(
        "HTTP_ATTACK", F.col("http") == 1, ("src_ip",), window_s, limit, emit=lambda n: bad | (n > limit),
        severity=lambda n: F.when(bad, F.least(F.lit(7) + F.size(found), F.lit(10))).otherwise(X.capped_ratio(n, 3)),
        details=lambda n: F.when(bad, X.text("malicious_patterns:", P.first_joined(found, 3), ",rate:", n, _per(window_s)))
        .otherwise(X.text("http_flood:rate:", n, _per(window_s))))


def _mqtt(window_s: float = 5, limit: int = 10) -> RateRule:
    return RateRule(
        "MQTT_HIJACKING", F.col("mqtt") == 1, ("src_ip",), window_s, limit,
        emit=lambda n: (F.size("topics") == 0) & (n > limit), severity=lambda n: X.capped_ratio(n, 2),
        details=lambda n: X.text("mqtt_flood:rate:", n, _per(window_s) + ",type:", F.col("mqtt_type")))


def _video(window_s: float = 10, limit: int = 20) -> RateRule:
    return RateRule(
        "VIDEO_MANIPULATION", F.col("rtsp") == 1, ("src_ip", F.col("sport").cast("string")), window_s, limit,
        emit=lambda n: (F.size("rtsp_patterns") == 0) & (n > limit), severity=lambda n: X.capped_ratio(n, 5),
        details=lambda n: X.text("rtsp_flood:rate:", n, _per(window_s)))


def _login(window_s: float = 30, limit: int = 8) -> RateRule:
    service = F.when(F.col("dport") == 22, "SSH").otherwise("Telnet")
    return RateRule(
        "BRUTE_FORCE", F.col("login") == 1, ("src_ip",), window_s, limit,
        severity=lambda n: F.least(F.lit(6) + F.floor(n / 5), F.lit(10)),
        details=lambda n: X.text("brute_force:", service, ",attempts:", n, _per(window_s) + ",patterns:",
                                 P.first_joined(F.col("markers"), 2)))


def application_rates(rows: DataFrame, limits: Limits | None = None, only: str | None = None) -> DataFrame:
    """Rate parts of the HTTP, MQTT, video and login detectors, in one shuffle. ``rows``: ``messages``."""
    limits = limits or {}
    rules = [make(*limits.get(name, ())) for name, make in (
        ("HTTP_ATTACK", _http), ("MQTT_HIJACKING", _mqtt), ("VIDEO_MANIPULATION", _video), ("BRUTE_FORCE", _login))
        if only in (None, name)]
    carry = ["dport", "http_patterns", "mqtt_type", "topics", "rtsp_patterns", "markers"]
    return rate_hits(rows, rules, POSITION, carry).drop("rate")


def topic_hits(rows: DataFrame) -> DataFrame:
    """MQTT messages with suspicious topics, with the source's running number of matches."""
    bad = rows.where((F.col("mqtt") == 1) & (F.size("topics") > 0))
    total = running_counts(bad, ["src_ip"], {"total": F.size("topics")}, ["topics"])
    return hits(total, "MQTT_HIJACKING", 2, F.lit(8), X.text(
        "suspicious_topics:", F.array_join("topics", ","), ",total_suspicious:", F.col("total")))


def rtsp_hits(rows: DataFrame) -> DataFrame:
    """RTSP requests with suspicious headers, with the stream's running number of matches."""
    bad = rows.where((F.col("rtsp") == 1) & (F.size("rtsp_patterns") > 0))
    total = running_counts(bad, ["src_ip", "sport"], {"total": F.size("rtsp_patterns")}, ["rtsp_patterns"])
    return hits(total, "VIDEO_MANIPULATION", 3, F.lit(7), X.text(
        "rtsp_attack:", P.first_joined(F.col("rtsp_patterns"), 2), ",total_suspicious:", F.col("total")))


def http_attack(rows: DataFrame, limits: Limits | None = None) -> DataFrame:
    return application_rates(rows, limits, "HTTP_ATTACK")


def mqtt_hijacking(rows: DataFrame, limits: Limits | None = None) -> DataFrame:
    return all_hits([topic_hits(rows), application_rates(rows, limits, "MQTT_HIJACKING")])


def video_manipulation(rows: DataFrame, limits: Limits | None = None) -> DataFrame:
    return all_hits([rtsp_hits(rows), application_rates(rows, limits, "VIDEO_MANIPULATION")])


def brute_force(rows: DataFrame, limits: Limits | None = None) -> DataFrame:
    return application_rates(rows, limits, "BRUTE_FORCE")


def drone_application_hits(packets: DataFrame, fleet: Sequence[str], limits: Limits | None = None,
                           mavlink: tuple[float, int] = (10, 20), dangerous: tuple[float, int] = (5, 5)) -> DataFrame:
    followed_by = tracks(limits=limits, mavlink=mavlink, dangerous=dangerous)
    return fired(followed(messages(packets, fleet), followed_by, CARRY), followed_by)


CARRY = ("dport", "http_patterns", "mqtt_type", "topics", "rtsp_patterns", "markers", "mavlink")
LAYER = "drone_application"


def tracks(scope_of: Column | None = None, limits: Limits | None = None, mavlink: tuple[float, int] = (10, 20),
           dangerous: tuple[float, int] = (5, 5)) -> list[Track]:
    """The layer's detectors as tracks over rows with ``message_columns``; without a scope, of all rows."""
    n, limits = F.col("n"), limits or {}
    frames = F.col("mavlink").isNotNull()
    risky = frames & F.col("mavlink.message_id").isin(list(S.MAVLINK_DANGEROUS))
    name = lookups.message_name("mavlink.message_id", S.MAVLINK_DANGEROUS)

    def within(where: Column) -> Column:
        return where if scope_of is None else scope_of & where
    found = [
        Track("MAVLINK_INJECTION", RATE, within(frames), ("src_ip",), n > mavlink[1], F.least(F.lit(8) + F.floor(n / 10), F.lit(10)),
              X.text("rate:", n, _per(mavlink[0]) + ",cmd:", name, ",sys_id:", F.col("mavlink.system_id")), mavlink[0]),
        Track("MAVLINK_INJECTION", RATE, within(risky), ("src_ip",), n > dangerous[1], F.lit(9),
              X.text("dangerous_cmd:", name, ",count:", n, _per(dangerous[0])), dangerous[0], rank=1)]
    found += [of_rule(make(*limits.get(rule, ())), POSITION[rule], scope_of) for rule, make in (
        ("HTTP_ATTACK", _http), ("MQTT_HIJACKING", _mqtt), ("VIDEO_MANIPULATION", _video), ("BRUTE_FORCE", _login))]
    topics, headers = F.size("topics"), F.size("rtsp_patterns")
    return [*found,
            Track("MQTT_HIJACKING", RUNNING, within((F.col("mqtt") == 1) & (topics > 0)), ("src_ip",), F.lit(True), F.lit(8),
                  X.text("suspicious_topics:", F.array_join("topics", ","), ",total_suspicious:", n), amount=topics, position=2),
            Track("VIDEO_MANIPULATION", RUNNING, within((F.col("rtsp") == 1) & (headers > 0)), ("src_ip", "sport"), F.lit(True), F.lit(7),
                  X.text("rtsp_attack:", P.first_joined(F.col("rtsp_patterns"), 2), ",total_suspicious:", n), amount=headers, position=3)]


def drone_application_verdicts(packets: DataFrame, fleet: Sequence[str], **settings: object) -> DataFrame:
    """(packet_id, attack_type, severity, details) of attacked packets."""
    return resolve_layers(drone_application_hits(packets, fleet, **settings), OUTRANKED).drop("layer")


def drone_application_log(packets: DataFrame, fleet: Sequence[str], limits: Limits | None = None,
                          mavlink: tuple[float, int] = (10, 20), dangerous: tuple[float, int] = (5, 5)) -> DataFrame:
    rows = scope.fleet_application_scope(packets, fleet).select(
        "packet_id", "ts", "src_ip", "dst_ip", F.col("sport").alias("src_port"), F.col("dport").alias("dst_port"),
        X.transport_protocol().alias("protocol"), X.payload_sample().alias("payload_sample"),
        lookups.name_of("dport", S.APP_PORTS).alias("service_targeted"))
    return with_best(rows, drone_application_verdicts(packets, fleet, limits=limits, mavlink=mavlink, dangerous=dangerous))
