"""Filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from skywarden import schema as S
from skywarden.catalog.base import APPLICATION, FLEET, IN_FLEET, LINK, P, TARGET_IP, TRANSPORT, contained, packets, running, table
from skywarden.functions import patterns, scalars as X, scope
from skywarden.plans import network

TCP_TEXT = "ip_proto = 6 AND payload_words IS NOT NULL"


def ids(df):
    return df.select("packet_id")


def tcp_data(s, d):
    return packets(s, d).where(X.is_tcp() & X.has_payload())


def joined(column):
    return F.array_join(column, "|")


def page_paths(s, d):
    path = F.regexp_extract("url", r"^[a-z]+://[^/]+([^?#]*)", 1)
    # the generated pages have numeric paths; append a section by page so that every class occurs
    sections = F.array(*[F.lit(x) for x in ("/control/arm", "/telemetry/live", "/flight/position", "/about")])
    section = F.element_at(sections, (F.col("page_id") % 4 + 1).cast("int"))
    return table(s, d, "pages").select("page_id", F.concat(path, section).alias("path"))


QUERIES = {
    "only_wlan_frames": (lambda s, d: ids(scope.wlan_frames(packets(s, d))),
                         P + "SELECT packet_id FROM packets WHERE wlan_type IS NOT NULL"),
    "only_ip_packets": (lambda s, d: ids(scope.ip_packets(packets(s, d))),
                        P + "SELECT packet_id FROM packets WHERE src_ip IS NOT NULL"),
    "only_tcp_packets": (lambda s, d: ids(scope.tcp_packets(packets(s, d))),
                         P + "SELECT packet_id FROM packets WHERE ip_proto = 6"),
    "host_filter": (lambda s, d: ids(scope.host_filter(packets(s, d), TARGET_IP)),
                    P + f"SELECT packet_id FROM packets WHERE src_ip = '{TARGET_IP}' OR dst_ip = '{TARGET_IP}'"),
    "target_or_non_ip": (
        lambda s, d: ids(scope.target_or_non_ip(packets(s, d), TARGET_IP)),
        P + f"SELECT packet_id FROM packets WHERE src_ip IS NULL OR src_ip = '{TARGET_IP}' OR dst_ip = '{TARGET_IP}'"),
    "drone_link_scope": (lambda s, d: ids(scope.drone_link_scope(packets(s, d), FLEET[:1])),
                         P + f"SELECT packet_id FROM packets WHERE {LINK}"),
    "fleet_scope": (lambda s, d: ids(scope.fleet_scope(packets(s, d), FLEET)),
                    P + f"SELECT packet_id FROM packets WHERE {IN_FLEET}"),
    "fleet_transport_scope": (lambda s, d: ids(scope.fleet_transport_scope(packets(s, d), FLEET)),
                              P + f"SELECT packet_id FROM packets WHERE {TRANSPORT}"),
    "fleet_application_scope": (lambda s, d: ids(scope.fleet_application_scope(packets(s, d), FLEET)),
                                P + f"SELECT packet_id FROM packets WHERE {APPLICATION}"),
    "http_path_class": (
        lambda s, d: page_paths(s, d).select("page_id", patterns.path_class("path").alias("path_class")),
        """SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'command' WHEN 1 THEN 'telemetry' WHEN 2 THEN 'both' ELSE 'other' END
        AS path_class FROM pages"""),
    "every_tenth_packet": (
        lambda s, d: network.sampled(packets(s, d), 10),
        P + f", n AS (SELECT packet_id, {running('sensor_id', '1')} AS n FROM packets) SELECT packet_id FROM n WHERE n % 10 = 0"),
    "byte_patterns": (
        lambda s, d: tcp_data(s, d).select(
            "packet_id", X.flag(patterns.has_xss()).alias("xss"), X.flag(patterns.has_sqli()).alias("sqli"),
            X.flag(patterns.has_credentials()).alias("creds")),
        P + f"""SELECT packet_id, regexp_matches(payload_words, '(?i)<script|%3cscript')::INT AS xss,
        regexp_matches(payload_words, '(?i)union.*select|''\\s*or\\s*1=1')::INT AS sqli,
        regexp_matches(payload_words, '(?i)password=|Authorization:\\s*Basic')::INT AS creds FROM packets WHERE {TCP_TEXT}"""),
    "page_patterns": (
        lambda s, d: table(s, d, "pages").select("page_id", F.col("html").cast("binary").alias("payload")).select(
            "page_id", X.flag(patterns.has_xss()).alias("xss"), X.flag(patterns.has_sqli()).alias("sqli"),
            X.flag(patterns.has_credentials()).alias("creds"), joined(patterns.malicious_http()).alias("http")),
        f"""SELECT page_id, regexp_matches(html, '(?i)<script|%3cscript')::INT AS xss,
        regexp_matches(html, '(?i)union.*select|''\\s*or\\s*1=1')::INT AS sqli,
        regexp_matches(html, '(?i)password=|Authorization:\\s*Basic')::INT AS creds,
        array_to_string({contained('html', S.HTTP_PATTERNS)}, '|') AS http FROM pages"""),
    "document_patterns": (
        lambda s, d: table(s, d, "documents").select("doc_id", F.col("text").cast("binary").alias("payload")).select(
            "doc_id", X.flag(patterns.has_sqli()).alias("sqli"), X.flag(patterns.has_credentials()).alias("creds"),
            joined(patterns.malicious_http()).alias("http"), joined(patterns.login_markers(F.lit(22))).alias("ssh")),
        f"""SELECT doc_id, regexp_matches(text, '(?i)union.*select|''\\s*or\\s*1=1')::INT AS sqli,
        regexp_matches(text, '(?i)password=|Authorization:\\s*Basic')::INT AS creds,
        array_to_string({contained('text', S.HTTP_PATTERNS)}, '|') AS http,
        array_to_string({contained('text', S.SSH_MARKERS)}, '|') AS ssh FROM documents"""),
    "downgrade_redirect": (
        lambda s, d: ids(tcp_data(s, d).where(patterns.is_downgrade_redirect())),
        P + f"""SELECT packet_id FROM packets WHERE {TCP_TEXT} AND contains(lower(payload_words), 'location: http://')
        AND (contains(payload_words, '301') OR contains(payload_words, '302'))"""),
    "malicious_http": (
        lambda s, d: tcp_data(s, d).select("packet_id", joined(patterns.malicious_http()).alias("found")),
        P + f"""SELECT packet_id, array_to_string({contained('payload_words', S.HTTP_PATTERNS)}, '|') AS found
        FROM packets WHERE {TCP_TEXT}"""),
    "http_verb": (
        lambda s, d: ids(tcp_data(s, d).where(patterns.has_http_verb())),
        P + f"SELECT packet_id FROM packets WHERE {TCP_TEXT} AND regexp_matches(payload_words, '^(GET|POST|PUT|DELETE) ')"),
    "suspicious_topics": (
        lambda s, d: tcp_data(s, d).select("packet_id", joined(patterns.suspicious_topics()).alias("found")),
        P + f"""SELECT packet_id, array_to_string({contained('payload_words', S.MQTT_TOPICS)}, '|') AS found
        FROM packets WHERE {TCP_TEXT}"""),
    "rtsp_methods_and_patterns": (
        lambda s, d: tcp_data(s, d).select("packet_id", X.flag(patterns.has_rtsp_method()).alias("method"),
                                           joined(patterns.suspicious_rtsp()).alias("found")),
        P + f"""SELECT packet_id, regexp_matches(payload_words, 'DESCRIBE|SETUP|PLAY|TEARDOWN|OPTIONS')::INT AS method,
        array_to_string({contained('payload_words', S.RTSP_PATTERNS)}, '|') AS found FROM packets WHERE {TCP_TEXT}"""),
    "login_markers": (
        lambda s, d: tcp_data(s, d).where(F.col("dport").isin(22, 23)).select(
            "packet_id", joined(patterns.login_markers()).alias("found"),
            patterns.first_joined(patterns.login_markers(), 2).alias("first_two")),
        P + f""", m AS (SELECT packet_id, CASE WHEN dport = 22 THEN {contained('payload_words', S.SSH_MARKERS)}
        ELSE {contained('payload_words', S.TELNET_MARKERS)} END AS f FROM packets WHERE {TCP_TEXT} AND dport IN (22, 23))
        SELECT packet_id, array_to_string(f, '|') AS found, array_to_string(f[1:2], ',') AS first_two FROM m"""),
}
