"""Time buckets, totals, breakdowns and reports."""

from __future__ import annotations

from pyspark.sql import Observation, functions as F

from skywarden.catalog.base import P, TARGET_IP, packets, running, table
from skywarden.functions import scalars as X, scope
from skywarden.streaming.buckets import observed
from skywarden.operators import buckets, report
from skywarden.operators.buckets import ApplicationLimits, TransportLimits
from skywarden.plans import analyser

HOURS = 6
DURATION, BUCKET = f"{HOURS} hours", f"(epoch_us(ts) // {HOURS * 3600 * 1000000})::BIGINT"
T_LIMITS = TransportLimits(syn=3, rst=2, ack=2, ports=2)
A_LIMITS = ApplicationLimits(requests=3, dns_spoof=1, dns_tunnel=1, xss=1, sqli=1, sslstrip=1, creds=1)


def numbered(df):
    """Window start as a bucket number, averages rounded."""
    return df.withColumn("bucket", F.floor(F.unix_micros("window_start") / F.lit(HOURS * 3600 * 1_000_000))).drop("window_start")


def bits(mask):
    return f"count(*) FILTER ((tcp_flags // {mask}) % 2 = 1)"


IP_INT = ("(split_part(src_ip, '.', 1)::BIGINT * 16777216 + split_part(src_ip, '.', 2)::BIGINT * 65536 + "
          "split_part(src_ip, '.', 3)::BIGINT * 256 + split_part(src_ip, '.', 4)::BIGINT)")
TRANSPORT = P + f""", b AS (SELECT {BUCKET} AS bucket, src_ip, {bits(2)} AS tcp_syn, {bits(4)} AS tcp_rst, {bits(16)} AS tcp_ack,
  {bits(1)} AS tcp_fin, count(DISTINCT dport) AS dst_ports, round(avg(packet_size), 6) AS avg_len
  FROM packets WHERE ip_proto = 6 GROUP BY 1, 2)
SELECT *, {IP_INT} AS src_ip_int, CASE WHEN tcp_syn > {T_LIMITS.syn} THEN 'SYN_FLOOD' WHEN tcp_rst > {T_LIMITS.rst} THEN 'RST_FLOOD'
  WHEN tcp_ack > {T_LIMITS.ack} THEN 'CONNECTION_FLOOD' WHEN dst_ports > {T_LIMITS.ports} AND tcp_syn > 0 THEN 'PORT_SCAN'
  ELSE 'NONE' END AS label FROM b"""
HTTP = "(ip_proto = 6 AND (dport = 80 OR sport = 80))"
COUNTS = P + f""", c AS (SELECT packet_id, ts, src_ip,
  CASE WHEN ip_proto = 17 AND dport = 53 AND dns_qr = 1 THEN (k < 60)::INT ELSE 0 END AS dns_spoof,
  CASE WHEN ip_proto = 17 AND dport = 53 AND dns_qr = 1 THEN (k + 50 > 100)::INT ELSE 0 END AS dns_tunnel,
  coalesce({HTTP} AND regexp_matches(payload_words, '(?i)<script|%3cscript'), false)::INT AS http_xss,
  coalesce({HTTP} AND regexp_matches(payload_words, '(?i)union.*select|''\\s*or\\s*1=1'), false)::INT AS http_sqli,
  coalesce({HTTP} AND contains(lower(payload_words), 'location: http://') AND (contains(payload_words, '301')
    OR contains(payload_words, '302')), false)::INT AS http_sslstrip,
  coalesce({HTTP} AND regexp_matches(payload_words, '(?i)password=|Authorization:\\s*Basic'), false)::INT AS http_creds,
  coalesce({HTTP}, false)::INT AS http_reqs FROM packets WHERE src_ip IS NOT NULL)"""
APPLICATION = COUNTS + f""", b AS (SELECT {BUCKET} AS bucket, src_ip, {', '.join(f'sum({c})::BIGINT AS {c}' for c in buckets.COUNTS)}
  FROM c GROUP BY 1, 2)
SELECT *, {IP_INT} AS src_ip_int, CASE WHEN http_reqs > {A_LIMITS.requests} THEN 'DOS' WHEN dns_spoof > {A_LIMITS.dns_spoof} THEN 'DNS_SPOOFING'
  WHEN dns_tunnel > {A_LIMITS.dns_tunnel} THEN 'DNS_TUNNELING' WHEN http_xss > {A_LIMITS.xss} THEN 'XSS'
  WHEN http_sqli > {A_LIMITS.sqli} THEN 'SQLI' WHEN http_sslstrip > {A_LIMITS.sslstrip} THEN 'SSL_STRIP'
  WHEN http_creds > {A_LIMITS.creds} THEN 'CREDENTIAL_THEFT' ELSE 'NONE' END AS attack_label FROM b"""

SUSPICION = """CASE WHEN packet_size < 20 OR packet_size > 9000 THEN 'unusual_packet_size'
  WHEN src_ip IS NOT NULL AND (ttl < 10 OR ttl > 255) THEN 'unusual_ttl'
  WHEN src_ip IS NOT NULL AND ip_flags % 2 = 1 THEN 'fragmented_packet' WHEN ip_proto = 6 AND tcp_flags = 2 THEN 'potential_syn_flood'
  WHEN ip_proto = 6 AND sport = dport THEN 'same_port_attack' END"""
ALERTS = P + f""", a AS (SELECT *, {SUSPICION} AS attack_type FROM packets
  WHERE src_ip IS NULL OR src_ip = '{TARGET_IP}' OR dst_ip = '{TARGET_IP}'),
  alerts AS (SELECT * FROM a WHERE attack_type IS NOT NULL)"""


def rule_alerts(s, d):
    return analyser.rule_alerts(packets(s, d), TARGET_IP)


def rule_log(s, d):
    return packets(s, d).withColumn("attack_type", F.coalesce(analyser.suspicion(), F.lit("NORMAL")))


def report_row(s, d):
    r = report.summary_report(packets(s, d).select("ts"), rule_alerts(s, d), TARGET_IP)
    alert = lambda a: F.concat_ws("|", a["time"], a["type"], a["confidence"].cast("string"), a["src"], a["dst"])
    return r.select("total_packets", "total_attacks", F.round("runtime", 3).alias("runtime"), "target_ip",
                    F.array_join(F.transform("attacks", alert), ";").alias("attacks"))


def entities():
    return {
        "connections": F.when(X.is_tcp(), F.struct("src_ip", "sport", "dst_ip", "dport")),
        "scanners": F.when(X.is_udp() | X.has_bits("tcp_flags", X.SYN), F.struct("src_ip", "dst_ip")),
        "sessions": F.when(X.has_payload(), F.struct("src_ip", "dst_ip")),
        "mavlink_sources": F.when(X.mavlink_header().isNotNull(), F.col("src_ip")),
        "mqtt_sources": F.when(X.is_tcp() & F.col("dport").isin(1883, 8883), F.col("src_ip")),
        "login_sources": F.when(X.is_tcp() & F.col("dport").isin(22, 23), F.col("src_ip")),
    }


def request_entities():
    """The sources of HTTP requests and the video streams, as the application layer tracks them."""
    text = F.col("payload").cast("string")
    return {
        "http_sources": F.when(X.is_tcp() & F.col("dport").isin(80, 8080, 443) & text.rlike("^(GET|POST|PUT|DELETE) "), F.col("src_ip")),
        "video_streams": F.when(X.is_tcp() & (F.col("dport") == 554) & text.rlike("DESCRIBE|SETUP|PLAY|TEARDOWN|OPTIONS"),
                                F.struct("src_ip", "sport")),
    }


STREAMS = "ip_proto = 17 AND dport = 554"

def entity_estimates(s, d):
    """Sketches of each day, merged, beside the exact counts: one row per entity, with whether the estimate is within 3 %."""
    p, kinds = packets(s, d), {**entities(), **request_entities()}
    days = report.entity_sketches(p, kinds, F.to_date("ts").alias("day"))
    sides = [df.unpivot([], list(kinds), "entity", n) for df, n in (
        (report.merged_entities(days, list(kinds)), "estimate"), (report.entity_summary(p, kinds), "n"))]
    return sides[0].join(sides[1], "entity").select("entity", "n", (F.abs(F.col("estimate") - F.col("n")) <= 0.03 * F.col("n")).alias("is_close"))


def stream_totals(s, d):
    """The running totals that a job reports while it reads the packets."""
    seen = Observation("totals")
    observed(packets(s, d), seen).write.format("noop").mode("overwrite").save()
    return s.createDataFrame([(seen.get["packets"], seen.get["latest"])], "packets long, latest timestamp").withColumn("latest", F.unix_micros("latest"))


QUERIES = {
    "transport_buckets": (
        lambda s, d: numbered(buckets.transport_buckets(packets(s, d), DURATION, T_LIMITS)).withColumn(
            "avg_len", F.round("avg_len", 6)), TRANSPORT),
    "application_counts": (
        lambda s, d: buckets.application_counts(packets(s, d)).drop("ts"), COUNTS + " SELECT * EXCLUDE (ts) FROM c"),
    "application_buckets": (
        lambda s, d: numbered(buckets.application_buckets(packets(s, d), DURATION, A_LIMITS)), APPLICATION),
    "application_labels_by_source": (
        lambda s, d: report.breakdown(buckets.application_buckets(packets(s, d), DURATION, A_LIMITS), "src_ip", "attack_label"),
        APPLICATION.replace("SELECT *, " + IP_INT + " AS src_ip_int,", ", l AS (SELECT *,") + ") SELECT src_ip, attack_label, count(*) AS n FROM l GROUP BY ALL"),
    "dns_answers_either_port": (
        lambda s, d: buckets.application_counts(packets(s, d), either_port=True).agg(
            F.sum("dns_spoof").alias("dns_spoof"), F.sum("dns_tunnel").alias("dns_tunnel"), F.sum("http_reqs").alias("http_reqs")),
        COUNTS + " SELECT sum(dns_spoof)::BIGINT AS dns_spoof, sum(dns_tunnel)::BIGINT AS dns_tunnel, sum(http_reqs)::BIGINT AS http_reqs FROM c"),
    "packet_totals": (
        lambda s, d: report.totals(rule_log(s, d), F.col("packet_id") % 10 == 0),
        P + f"""SELECT count(*) AS packets, count(*) FILTER (packet_id % 10 = 0) AS stored,
        count(*) FILTER (({SUSPICION}) IS NOT NULL) AS attacks FROM packets"""),
    "entity_summary": (
        lambda s, d: report.entity_summary(packets(s, d), entities()),
        P + """SELECT count(DISTINCT CASE WHEN ip_proto = 6 THEN src_ip || '|' || sport || '|' || dst_ip || '|' || dport END) AS connections,
        count(DISTINCT CASE WHEN ip_proto = 17 OR (tcp_flags // 2) % 2 = 1 THEN src_ip || '|' || dst_ip END) AS scanners,
        count(DISTINCT CASE WHEN payload IS NOT NULL THEN src_ip || '|' || dst_ip END) AS sessions,
        count(DISTINCT CASE WHEN payload_hex LIKE 'FD%' AND length(payload_hex) >= 22 THEN src_ip END) AS mavlink_sources,
        count(DISTINCT CASE WHEN ip_proto = 6 AND dport IN (1883, 8883) THEN src_ip END) AS mqtt_sources,
        count(DISTINCT CASE WHEN ip_proto = 6 AND dport IN (22, 23) THEN src_ip END) AS login_sources FROM packets"""),
    "running_stream_size": (
        lambda s, d: report.running_sizes(packets(s, d).where(X.is_udp() & (F.col("dport") == 554))).withColumn(
            "smoothed_size", F.round("smoothed_size", 6)),
        P + f"""SELECT packet_id, round(list_reduce(list(packet_size::DOUBLE) OVER (PARTITION BY src_ip, sport ORDER BY ts, packet_id
        ROWS UNBOUNDED PRECEDING), lambda s, x: (s + x) / 2), 6) AS smoothed_size FROM packets WHERE {STREAMS}"""),
    "observed_totals": (stream_totals, P + "SELECT count(*) AS packets, max(epoch_us(ts)) AS latest FROM packets"),
    "entity_summary_requests": (
        lambda s, d: report.entity_summary(packets(s, d), request_entities()),
        P + """SELECT count(DISTINCT CASE WHEN ip_proto = 6 AND dport IN (80, 8080, 443)
          AND regexp_matches(payload_words, '^(GET|POST|PUT|DELETE) ') THEN src_ip END) AS http_sources,
        count(DISTINCT CASE WHEN ip_proto = 6 AND dport = 554 AND regexp_matches(payload_words, 'DESCRIBE|SETUP|PLAY|TEARDOWN|OPTIONS')
          THEN src_ip || ':' || sport END) AS video_streams FROM packets"""),
    "alerts_by_type_and_hour": (
        lambda s, d: report.breakdown(rule_alerts(s, d), "attack_type", F.hour("ts").alias("hour")),
        ALERTS + " SELECT attack_type, hour(ts)::INT AS hour, count(*) AS n FROM alerts GROUP BY 1, 2"),
    "alerts_rollup_type_source": (
        lambda s, d: report.breakdown_rollup(rule_alerts(s, d), "attack_type", "src_ip"),
        ALERTS + " SELECT attack_type, src_ip, count(*) AS n FROM alerts GROUP BY ROLLUP (attack_type, src_ip)"),
    "video_stream_running_stats": (
        lambda s, d: report.stream_size_stats(packets(s, d).where(X.is_udp() & (F.col("dport") == 554))).drop("ts"),
        P + f"""SELECT packet_id, packet_size, {running("src_ip || ':' || sport", '1')}::BIGINT AS packet_count,
        {running("src_ip || ':' || sport", '(packet_size < 100)::INT')}::BIGINT AS small_count FROM packets WHERE {STREAMS}"""),
    "video_stream_state": (
        lambda s, d: report.stream_state(packets(s, d).where(X.is_udp() & (F.col("dport") == 554))).withColumn(
            "smoothed_size", F.round("smoothed_size", 6)),
        P + f"""SELECT src_ip, sport, count(*) AS packet_count, count(*) FILTER (packet_size < 100) AS small_count,
        round(list_reduce(list(packet_size::DOUBLE ORDER BY ts, packet_id), lambda a, b: (a + b) / 2), 6) AS smoothed_size
        FROM packets WHERE {STREAMS} GROUP BY 1, 2"""),
    "recent_alerts": (
        lambda s, d: report.recent_alerts(rule_alerts(s, d)).drop("ts", "confidence"),
        ALERTS + " SELECT packet_id, attack_type, src_ip, dst_ip, ip_proto FROM alerts ORDER BY ts DESC, packet_id DESC LIMIT 50"),
    "latest_three_alerts": (
        lambda s, d: report.recent_alerts(rule_alerts(s, d), 3).drop("ts", "confidence"),
        ALERTS + " SELECT packet_id, attack_type, src_ip, dst_ip, ip_proto FROM alerts ORDER BY ts DESC, packet_id DESC LIMIT 3"),
    "summary_report": (
        report_row,
        ALERTS + f""", l AS (SELECT * FROM alerts ORDER BY ts DESC, packet_id DESC LIMIT 50)
        SELECT (SELECT count(*) FROM packets) AS total_packets, (SELECT count(*) FROM alerts) AS total_attacks,
        round((SELECT (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 FROM packets), 3) AS runtime, '{TARGET_IP}' AS target_ip,
        (SELECT string_agg(strftime(ts, '%H:%M:%S') || '|' || attack_type || '|0.8|' || coalesce(src_ip, 'N/A') || '|' ||
         coalesce(dst_ip, 'N/A'), ';' ORDER BY ts, packet_id) FROM l) AS attacks"""),
}

# the six entities of the first query and the two of the second
NAMES = {"entity_summary": ("connections", "scanners", "sessions", "mavlink_sources", "mqtt_sources", "login_sources"),
         "entity_summary_requests": ("http_sources", "video_streams")}
QUERIES["entity_estimates"] = (entity_estimates, " UNION ALL ".join(
    f"SELECT '{name}' AS entity, {name} AS n, true AS is_close FROM ({QUERIES[query][1]})" for query, names in NAMES.items() for name in names))
