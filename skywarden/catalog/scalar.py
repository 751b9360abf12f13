"""Scalar functions and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from skywarden.catalog.base import P, TARGET_MAC, packets, table
from skywarden.functions import patterns, scalars as X
from skywarden.plans import analyser, internet

QUERIES = {
    "ipv4_to_int": (
        lambda s, d: packets(s, d).where(X.is_ip()).select("packet_id", X.ipv4_to_int("src_ip").alias("src_ip_int")),
        P + """SELECT packet_id, split_part(src_ip, '.', 1)::BIGINT * 16777216 + split_part(src_ip, '.', 2)::BIGINT * 65536
        + split_part(src_ip, '.', 3)::BIGINT * 256 + split_part(src_ip, '.', 4)::BIGINT AS src_ip_int
        FROM packets WHERE src_ip IS NOT NULL"""),
    "time_bucket": (
        lambda s, d: packets(s, d).select("packet_id", X.time_bucket("ts", 60).cast("long").alias("bucket")),
        P + "SELECT packet_id, (epoch_us(ts) // 60000000)::BIGINT AS bucket FROM packets"),
    "tcp_flag_bits_and_label": (
        lambda s, d: packets(s, d).where(X.is_tcp()).select(
            "packet_id", X.flag(X.has_bits("tcp_flags", X.SYN)).alias("syn"),
            X.flag(X.has_bits("tcp_flags", X.RST)).alias("rst"), X.flag(X.has_bits("tcp_flags", X.ACK)).alias("ack"),
            X.flag_label().alias("label")),
        P + """SELECT packet_id, (tcp_flags // 2) % 2 AS syn, (tcp_flags // 4) % 2 AS rst, (tcp_flags // 16) % 2 AS ack,
        CASE WHEN (tcp_flags // 2) % 2 = 1 THEN 'SYN' WHEN (tcp_flags // 4) % 2 = 1 THEN 'RST'
             WHEN (tcp_flags // 16) % 2 = 1 THEN 'ACK' ELSE 'NONE' END AS label FROM packets WHERE ip_proto = 6"""),
    "protocol_class": (
        lambda s, d: packets(s, d).where(X.is_ip()).select(
            "packet_id", X.protocol_class().alias("protocol"),
            F.coalesce(X.transport_port("sport"), F.lit(0)).alias("sport"),
            F.coalesce(X.transport_port("dport"), F.lit(0)).alias("dport"),
            F.when(X.is_tcp(), F.col("tcp_flags")).otherwise(0).alias("tcp_flags"),
            F.when(X.is_icmp(), F.col("icmp_type")).otherwise(0).alias("icmp_type")),
        P + """SELECT packet_id, CASE WHEN ip_proto = 1 THEN 'ICMP' WHEN ip_proto = 17 THEN 'UDP'
        WHEN ip_proto = 6 AND tcp_flags = 2 THEN 'TCP-SYN' WHEN ip_proto = 6 THEN 'TCP' ELSE 'OTHER' END AS protocol,
        coalesce(sport, 0) AS sport, coalesce(dport, 0) AS dport, coalesce(tcp_flags, 0) AS tcp_flags,
        coalesce(icmp_type, 0) AS icmp_type FROM packets WHERE src_ip IS NOT NULL"""),
    "link_protocol_and_port": (
        lambda s, d: packets(s, d).select(
            "packet_id", X.link_protocol().alias("protocol"), F.coalesce(X.transport_port("dport"), F.lit(0)).alias("port"),
            F.coalesce("src_ip", F.lit("unknown")).alias("src_ip")),
        P + """SELECT packet_id, CASE WHEN ip_proto = 17 THEN 'UDP' WHEN ip_proto = 6 THEN 'TCP'
        WHEN wlan_type IS NOT NULL THEN '802.11' ELSE 'OTHER' END AS protocol, coalesce(dport, 0) AS port,
        coalesce(src_ip, 'unknown') AS src_ip FROM packets"""),
    "mac_lower_case": (
        lambda s, d: packets(s, d).select("packet_id", X.lower_mac("src_mac").alias("src_mac")),
        P + "SELECT packet_id, coalesce(lower(src_mac), '') AS src_mac FROM packets"),
    "wlan_channel": (
        lambda s, d: packets(s, d).where(X.is_wlan()).select("packet_id", X.channel_of("elements").alias("channel")),
        P + """SELECT packet_id, CASE WHEN kind = 'error' AND wlan_subtype = 8 AND k % 7 <> 0 THEN 1 + k % 13 ELSE 0 END
        AS channel FROM packets WHERE wlan_type IS NOT NULL"""),
    "rssi_or_zero": (
        lambda s, d: packets(s, d).select("packet_id", X.rssi_or_zero().alias("rssi")),
        P + "SELECT packet_id, coalesce(rssi, 0) AS rssi FROM packets"),
    "frame_indicators": (
        lambda s, d: packets(s, d).where(X.is_wlan()).select(
            "packet_id", X.flag(F.col("arp_psrc").isNotNull()).alias("has_arp"), X.flag(X.is_beacon()).alias("has_beacon"),
            X.flag(X.is_deauth()).alias("has_deauth"), X.flag(X.is_probe_request()).alias("has_probe_req"),
            X.flag(F.lower("dst_mac") == "ff:ff:ff:ff:ff:ff").alias("is_broadcast"),
            X.flag((X.lower_mac("src_mac") == TARGET_MAC) | (X.lower_mac("dst_mac") == TARGET_MAC)).alias("is_target")),
        P + f"""SELECT packet_id, (arp_psrc IS NOT NULL)::INT AS has_arp,
        coalesce(wlan_type = 0 AND wlan_subtype = 8, false)::INT AS has_beacon,
        coalesce(wlan_type = 0 AND wlan_subtype = 12, false)::INT AS has_deauth,
        coalesce(wlan_type = 0 AND wlan_subtype = 4, false)::INT AS has_probe_req,
        (lower(dst_mac) = 'ff:ff:ff:ff:ff:ff')::INT AS is_broadcast,
        (coalesce(lower(src_mac), '') = '{TARGET_MAC}' OR lower(dst_mac) = '{TARGET_MAC}')::INT AS is_target
        FROM packets WHERE wlan_type IS NOT NULL"""),
    "is_fragmented": (
        lambda s, d: packets(s, d).where(X.is_ip()).select(
            "packet_id", X.flag(X.is_fragmented()).alias("is_fragmented"), X.ip_flag_names().alias("flag_names")),
        P + """SELECT packet_id, (ip_flags % 2 = 1 OR ip_frag > 0)::INT AS is_fragmented,
        CASE ip_flags WHEN 1 THEN 'MF' WHEN 2 THEN 'DF' ELSE '' END AS flag_names FROM packets WHERE src_ip IS NOT NULL"""),
    "mavlink_header": (
        lambda s, d: packets(s, d).select("packet_id", X.mavlink_header().alias("h")).where("h IS NOT NULL").select("packet_id", "h.*"),
        P + """SELECT packet_id, ('0x' || substr(payload_hex, 3, 2))::INT AS length,
        ('0x' || substr(payload_hex, 11, 2))::INT AS system_id, ('0x' || substr(payload_hex, 13, 2))::INT AS component_id,
        ('0x' || substr(payload_hex, 19, 2) || substr(payload_hex, 17, 2) || substr(payload_hex, 15, 2))::INT AS message_id
        FROM packets WHERE payload_hex LIKE 'FD%' AND length(payload_hex) >= 22"""),
    "mqtt_message_type": (
        lambda s, d: packets(s, d).where(X.is_tcp() & (F.col("dport") == 1883) & (X.payload_size() >= 2)).select(
            "packet_id", X.mqtt_type().alias("mqtt_type")),
        P + """SELECT packet_id, (ascii(payload_words) // 16)::INT AS mqtt_type FROM packets
        WHERE ip_proto = 6 AND dport = 1883 AND length(payload_words) >= 2"""),
    "payload_text_and_sample": (
        lambda s, d: packets(s, d).where(X.is_tcp()).select(
            "packet_id", X.payload_text().alias("words"), X.payload_sample().alias("sample")),
        P + """SELECT packet_id, payload_words AS words,
        coalesce(replace(substr(payload_words, 1, 50), chr(10), '\\n'), '') AS sample FROM packets WHERE ip_proto = 6"""),
    "payload_hash_and_size": (
        lambda s, d: packets(s, d).select(
            "packet_id", X.payload_md5().alias("hash"), F.left(X.payload_md5(), F.lit(8)).alias("prefix"),
            X.payload_size().alias("size")),
        P + """SELECT packet_id, md5(payload) AS hash, left(md5(payload), 8) AS prefix,
        coalesce(octet_length(payload), 0)::INT AS size FROM packets"""),
    "document_hash": (
        lambda s, d: table(s, d, "documents").select(
            "doc_id", X.payload_md5(F.col("text").cast("binary")).alias("hash"),
            X.payload_size(F.col("text").cast("binary")).cast("long").alias("size")),
        "SELECT doc_id, md5(text) AS hash, octet_length(encode(text))::BIGINT AS size FROM documents"),
    "composite_keys": (
        lambda s, d: packets(s, d).where(X.is_tcp()).select(
            "packet_id", X.flow_text().alias("flow"), X.endpoint_text().alias("endpoint"), X.connection_text().alias("connection")),
        P + """SELECT packet_id, src_ip || '->' || dst_ip AS flow, src_ip || ':' || sport AS endpoint,
        src_ip || ':' || sport || '->' || dst_ip || ':' || dport AS connection FROM packets WHERE ip_proto = 6"""),
    "model_features": (
        lambda s, d: analyser.features(packets(s, d)).drop("ts"),
        P + """SELECT packet_id, src_ip, dst_ip, packet_size, coalesce(ip_len, 0) AS ip_len, coalesce(ttl, 64) AS ttl,
        coalesce(ip_proto, 0) AS protocol, coalesce(ip_flags, 0) AS flags, coalesce(sport, 0) AS src_port,
        coalesce(dport, 0) AS dst_port, coalesce(tcp_flags, 0) AS tcp_flags, coalesce(tcp_window, 0) AS "window" FROM packets"""),
    "formatted_times": (
        lambda s, d: packets(s, d).select(
            "packet_id", *[X.time_text("ts", style).alias(style) for style in ("millis", "seconds", "iso", "clock")]),
        P + """SELECT packet_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS millis, strftime(ts, '%Y-%m-%d %H:%M:%S') AS seconds,
        strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS iso, strftime(ts, '%H:%M:%S') AS clock FROM packets"""),
    "iso_times_with_fraction": (
        lambda s, d: packets(s, d).select("packet_id", X.time_text("ts", "iso_micros").alias("iso")),
        P + """SELECT packet_id, CASE WHEN epoch_us(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00')
        ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f+00:00') END AS iso FROM packets"""),
    "scores_and_details": (
        lambda s, d: packets(s, d).select(
            "packet_id", F.round(X.saturating(0.7, F.col("k") * F.lit(0.05), 0.95), 6).alias("score"),
            X.capped_ratio(F.col("k"), 3).alias("severity"),
            X.text("rate:", F.col("k"), "/5s,share:", X.ratio_text(F.col("k"), F.lit(200))).alias("details")),
        P + """SELECT packet_id, round(least(0.7::DOUBLE + k * 0.05::DOUBLE, 0.95::DOUBLE), 6) AS score,
        least(k // 3, 10)::INT AS severity, 'rate:' || k || '/5s,share:' || printf('%.2f', k / 200.0::DOUBLE) AS details
        FROM packets"""),
    "any_positive_label": (
        lambda s, d: packets(s, d).select("packet_id", X.any_positive("ip_flags", "ip_frag", "icmp_type").alias("is_attack")),
        P + """SELECT packet_id, (coalesce(ip_flags, 0) > 0 OR coalesce(ip_frag, 0) > 0 OR coalesce(icmp_type, 0) > 0)::INT
        AS is_attack FROM packets"""),
    "combined_alert_text": (
        lambda s, d: packets(s, d).where(X.is_ip()).withColumns(
            {n.lower(): X.flag(F.col("k") % m == 0) for n, m in zip(internet.DETECTORS, (2, 3, 5, 7, 11))}).select(
            "packet_id", internet.alert_text().alias("alert")),
        P + """SELECT packet_id, concat_ws('+', CASE WHEN k % 2 = 0 THEN 'IP_SPOOFING' END,
        CASE WHEN k % 3 = 0 THEN 'PING_FLOOD' END, CASE WHEN k % 5 = 0 THEN 'SYN_FLOOD' END,
        CASE WHEN k % 7 = 0 THEN 'UDP_FLOOD' END, CASE WHEN k % 11 = 0 THEN 'PORT_SCAN' END) AS alert
        FROM packets WHERE src_ip IS NOT NULL"""),
}
