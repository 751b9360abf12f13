"""Layer logs, alerts of all layers, and the hybrid verdict."""

from __future__ import annotations

from pyspark.sql import functions as F

from skywarden import schema as S
from skywarden.catalog import detectors as D
from skywarden.catalog.aggregates import ALERTS
from skywarden.catalog.base import APPLICATION, DAY, FLEET, GATEWAYS, IN_FLEET, LINK, P, SIZE, TARGET_IP, TARGET_MAC, TRANSPORT, packets, running
from skywarden.operators import report
from skywarden.operators.verdict import alert_table, combine_layers, resolve
from skywarden.plans import (analyser, drone_application, drone_internet, drone_network, drone_transport, internet, layers, network,
                             transport)

D3 = D.D3
NETWORK = {"limits": {"DEAUTH_ATTACK": (DAY, 1)}, "twins": 2, "mac_window_s": DAY, "mac_limit": 12}
INTERNET = {"limits": {"PING_FLOOD": (DAY, 2), "SYN_FLOOD": (DAY, 2), "UDP_FLOOD": (DAY, 3)}, "ports": 20}
LINK_LIMITS = {"limits": {"COMMAND_FLOOD": (DAY, 1), "MQTT_FLOOD": (D3, 2), "WIFI_DEAUTH": (DAY, 1)}, "gap_s": DAY, "samples": 4}
L3_LIMITS = {"limits": {"GPS_INJECTION": (D3, 1), "ROUTING_ATTACK": (DAY, 1), "ICMP_FLOOD": (DAY, 1), "FRAG_ATTACK": (DAY, 1)}}
L4_LIMITS = {"limits": {"SYN_FLOOD": (D3, 4), "UDP_FLOOD": (D3, 5)}, "ports": 10, "gap_s": 10 * DAY}
L7_LIMITS = {"limits": {"HTTP_ATTACK": (DAY, 1), "MQTT_HIJACKING": (D3, 1), "VIDEO_MANIPULATION": (D3, 1), "BRUTE_FORCE": (D3, 2)},
             "mavlink": (DAY, 3), "dangerous": (D3, 4)}
SETTINGS = {"network": NETWORK, "internet": INTERNET, "drone_network": LINK_LIMITS, "drone_internet": L3_LIMITS, "drone_transport": L4_LIMITS,
            "drone_application": L7_LIMITS}


def hits_sql(*names: str) -> str:
    """All hits of several detectors, each as a sub-select of its own SQL."""
    parts = [f"SELECT *, {i} AS position FROM ({D.SQL[name]})" for i, name in enumerate(names)]
    return "(" + " UNION ALL ".join(parts) + ")"


def best_sql(*names: str) -> str:
    return (f"(SELECT packet_id, detector AS attack_type, severity, details FROM {hits_sql(*names)} WHERE severity > 0 "
            "QUALIFY row_number() OVER (PARTITION BY packet_id ORDER BY severity DESC, position) = 1)")


def log_sql(columns: str, rows: str, *names: str) -> str:
    return P + f"""SELECT {columns}, epoch_us(ts) AS ts, coalesce(b.attack_type, 'NORMAL') AS attack_type, coalesce(b.severity, 0.0) AS severity,
      coalesce(b.details, '') AS details FROM packets p LEFT JOIN {best_sql(*names)} b ON p.packet_id = b.packet_id WHERE {rows}"""


def plain(df):
    """Log rows with the time in microseconds, severities rounded."""
    return df.withColumns({"ts": F.unix_micros("ts"), "severity": F.round("severity", 6)})


NETWORK_SQL = ("arp_spoofing", "deauth_attack", "evil_twin", "mac_flooding")
INTERNET_SQL = ("ip_spoofing", "ping_flood", "syn_flood", "udp_flood", "port_scan")
LINK_SQL = ("command_flood", "gps_spoof", "video_hijack", "mqtt_flood", "wifi_deauth")
L3_SQL = ("many_macs_per_ip", "gps_injection", "routing_attack", "icmp_flood", "fragment_attack")
L7_SQL = ("mavlink_injection", "http_attack", "mqtt_hijacking", "video_manipulation", "brute_force")

# the layer runs the sequence machine per connection, and a replay hit needs its details
HIJACK = D.P + D.MACHINE.format(rows=TRANSPORT + " AND ip_proto = 6", key="src_ip || ':' || sport || dst_ip || ':' || dport", limit=5) + D.hit(
    "CONNECTION_HIJACK", "8", "'seq_anomalies:' || anomalies || ',expected:' || expected || ',got:' || got", "true", "hijack")
REPLAY = D.suppressed_sql(f"{TRANSPORT} AND payload IS NOT NULL AND octet_length(payload) > 0",
                          "src_ip || '|' || dst_ip || '|' || md5(payload)", 10 * DAY * 1_000_000, True) + """
  SELECT j.packet_id, 'SESSION_REPLAY' AS detector, 7.0::DOUBLE AS severity, 'replay_detected,hash:' || left(md5(p.payload), 8)
    || ',time_diff:' || printf('%.2f', (epoch_us(p.ts) - j.anchor) / 1e6::DOUBLE) || 's' AS details
  FROM judged j JOIN packets p ON p.packet_id = j.packet_id WHERE flagged"""
D.SQL["connection_hijack_by_connection"], D.SQL["session_replay_hits"] = HIJACK, REPLAY
L4_SQL = ("drone_syn_flood", "drone_udp_flood", "drone_port_scan", "connection_hijack_by_connection", "session_replay_hits")


def network_rows(s, d):
    log = network.network_log(packets(s, d), TARGET_MAC, **NETWORK)
    return log.drop("ts").withColumn("confidence", F.round("confidence", 6))


NETWORK_LOG = P + f""", h AS {hits_sql(*NETWORK_SQL)},
  f AS (SELECT packet_id, max((detector = 'ARP_SPOOFING')::INT) AS arp_spoofing, max((detector = 'DEAUTH_ATTACK')::INT) AS deauth_attack,
    max((detector = 'EVIL_TWIN')::INT) AS evil_twin, max((detector = 'MAC_FLOODING')::INT) AS mac_flooding FROM h GROUP BY 1),
  macs AS (SELECT packet_id, count(DISTINCT lower(src_mac)) OVER (PARTITION BY sensor_id ORDER BY ts
    RANGE BETWEEN INTERVAL {DAY} SECONDS PRECEDING AND CURRENT ROW) AS n FROM packets
    WHERE wlan_type IS NOT NULL AND NOT {D.DEAUTH} AND NOT {D.BEACON} AND coalesce(src_mac, '') <> ''),
  turn AS (SELECT packet_id, {running('sensor_id', '1')} AS i FROM packets),
  l AS (SELECT p.packet_id, coalesce(lower(src_mac), '') AS src_mac, lower(dst_mac) AS dst_mac,
    coalesce(b.attack_type, 'NORMAL') AS attack_type, coalesce(b.severity, 0.0) AS confidence,
    coalesce(arp_spoofing, 0) AS arp_spoofing, coalesce(deauth_attack, 0) AS deauth_attack, coalesce(evil_twin, 0) AS evil_twin,
    coalesce(mac_flooding, 0) AS mac_flooding, coalesce(rssi, 0) AS rssi,
    CASE WHEN kind = 'error' AND wlan_subtype = 8 AND k % 7 <> 0 THEN 1 + k % 13 ELSE 0 END AS channel,
    coalesce(macs.n, 0)::INT AS packet_rate, packet_size, (lower(dst_mac) = 'ff:ff:ff:ff:ff:ff')::INT AS is_broadcast,
    (arp_psrc IS NOT NULL)::INT AS has_arp, (wlan_type = 0 AND wlan_subtype = 8)::INT AS has_beacon,
    (wlan_type = 0 AND wlan_subtype = 12)::INT AS has_deauth, (wlan_type = 0 AND wlan_subtype = 4)::INT AS has_probe_req,
    (coalesce(lower(src_mac), '') = '{TARGET_MAC}' OR lower(dst_mac) = '{TARGET_MAC}')::INT AS is_target_related, i
    FROM packets p LEFT JOIN {best_sql(*NETWORK_SQL)} b ON b.packet_id = p.packet_id LEFT JOIN f ON f.packet_id = p.packet_id
    LEFT JOIN macs ON macs.packet_id = p.packet_id JOIN turn ON turn.packet_id = p.packet_id WHERE wlan_type IS NOT NULL)
SELECT * EXCLUDE (i) FROM l WHERE attack_type <> 'NORMAL' OR is_target_related = 1 OR i % 10 = 0"""

FLAGS = ", ".join(f"max((detector = '{n}')::INT) AS {n.lower()}" for n in internet.DETECTORS)
NAMES = ", ".join(f"CASE WHEN {n.lower()} = 1 THEN '{n}' END" for n in internet.DETECTORS)
INTERNET_LOG = P + f""", f AS (SELECT packet_id, {FLAGS} FROM {hits_sql(*INTERNET_SQL)} GROUP BY 1)
  SELECT p.packet_id, src_mac, src_ip, dst_ip, CASE WHEN ip_proto = 1 THEN 'ICMP' WHEN ip_proto = 17 THEN 'UDP'
    WHEN tcp_flags = 2 THEN 'TCP-SYN' ELSE 'TCP' END AS protocol, ttl, packet_size, coalesce(sport, 0) AS sport,
    coalesce(dport, 0) AS dport, coalesce(tcp_flags, 0) AS tcp_flags, coalesce(icmp_type, 0) AS icmp_type,
    {', '.join(f'coalesce({n.lower()}, 0) AS {n.lower()}' for n in internet.DETECTORS)}, concat_ws('+', {NAMES}) AS alert
  FROM packets p LEFT JOIN f ON f.packet_id = p.packet_id WHERE src_ip IS NOT NULL"""


def layer_alerts(s, d):
    """Alerts of every layer, one row per packet and layer."""
    return layers.alerts_of_layers(packets(s, d), FLEET, GATEWAYS, SETTINGS)


def alerts_layer_by_layer(s, d):
    """The same from each layer's own plan."""
    p = packets(s, d)
    return combine_layers({
        "network": network.network_alerts(p, **NETWORK), "internet": internet.internet_findings(p, **INTERNET),
        "drone_network": resolve(drone_network.drone_network_hits(p, FLEET[:1], **LINK_LIMITS)),
        "drone_internet": resolve(drone_internet.drone_internet_hits(p, FLEET, GATEWAYS, **L3_LIMITS)),
        "drone_transport": resolve(drone_transport.drone_transport_hits(p, FLEET, **L4_LIMITS)),
        "drone_application": drone_application.drone_application_verdicts(p, FLEET, **L7_LIMITS),
    })


def all_alerts(s, d):
    table = alert_table(packets(s, d), layer_alerts(s, d))
    return table.withColumns({"ts": F.unix_micros("ts"), "severity": F.round("severity", 6)})


LAYERS = {"network": NETWORK_SQL, "drone_network": LINK_SQL, "drone_internet": L3_SQL, "drone_transport": L4_SQL, "drone_application": L7_SQL}


def every_alert(names_of: dict[str, tuple[str, ...]]) -> str:
    parts = [f"SELECT '{layer}' AS layer, packet_id, attack_type, severity, details FROM {best_sql(*names)}" for layer, names in names_of.items()]
    flags = f"(SELECT packet_id, {FLAGS} FROM {hits_sql(*INTERNET_SQL)} GROUP BY 1)"
    parts.append(f"SELECT 'internet', packet_id, alert, 1.0, '' FROM (SELECT packet_id, concat_ws('+', {NAMES}) AS alert FROM {flags})")
    return "(" + " UNION ALL ".join(parts) + ")"


EVERY_ALERT = every_alert(LAYERS)


def hybrid(s, d):
    """Rules first, then a stand-in score read off the packet."""
    scored = analyser.with_rule(packets(s, d), TARGET_IP).withColumns({
        "prediction": (F.col("k") % 2).cast("double"), "confidence": F.col("k") / 100})
    return analyser.hybrid_alerts(scored, "network").drop("ts").withColumn("confidence", F.round("confidence", 6))


def transport_rows(s, d):
    return transport.transport_log(packets(s, d)).drop("ts")


QUERIES = {
    "network_log": (network_rows, NETWORK_LOG),
    "network_alerts": (
        lambda s, d: network.network_alerts(packets(s, d), **NETWORK).withColumn("severity", F.round("severity", 6)),
        f"SELECT * FROM {best_sql(*NETWORK_SQL)}"),
    "internet_log": (lambda s, d: internet.internet_log(packets(s, d), **INTERNET).drop("ts"), INTERNET_LOG),
    "transport_log": (
        transport_rows,
        P + """SELECT packet_id, src_ip, dst_ip, sport, dport, (tcp_flags // 2) % 2 AS tcp_syn, (tcp_flags // 4) % 2 AS tcp_rst,
        (tcp_flags // 16) % 2 AS tcp_ack, packet_size, CASE WHEN (tcp_flags // 2) % 2 = 1 THEN 'SYN' WHEN (tcp_flags // 4) % 2 = 1
        THEN 'RST' WHEN (tcp_flags // 16) % 2 = 1 THEN 'ACK' ELSE 'NONE' END AS flag_label FROM packets WHERE ip_proto = 6"""),
    "drone_network_log": (
        lambda s, d: plain(drone_network.drone_network_log(packets(s, d), FLEET[:1], **LINK_LIMITS)),
        log_sql("""p.packet_id, coalesce(src_ip, 'unknown') AS src_ip, coalesce(dst_ip, 'unknown') AS dst_ip, coalesce(dport, 0) AS port,
        CASE WHEN ip_proto = 17 THEN 'UDP' WHEN ip_proto = 6 THEN 'TCP' WHEN wlan_type IS NOT NULL THEN '802.11' ELSE 'OTHER' END
        AS protocol, packet_size""", LINK, *LINK_SQL)),
    "drone_internet_log": (
        lambda s, d: plain(drone_internet.drone_internet_log(packets(s, d), FLEET, GATEWAYS, **L3_LIMITS)),
        log_sql("""p.packet_id, src_ip, dst_ip, ttl, ip_id, ip_proto AS protocol, (ip_flags % 2 = 1 OR ip_frag > 0)::INT
        AS is_fragmented""", IN_FLEET, *L3_SQL)),
    "drone_transport_log": (
        lambda s, d: plain(drone_transport.drone_transport_log(packets(s, d), FLEET, **L4_LIMITS)),
        log_sql(f"""p.packet_id, src_ip, dst_ip, sport AS src_port, dport AS dst_port,
        CASE ip_proto WHEN 6 THEN 'TCP' ELSE 'UDP' END AS protocol, coalesce(tcp_flags, 0) AS tcp_flags,
        coalesce(tcp_seq, 0)::BIGINT AS sequence_num, {SIZE}::INT AS payload_size""", TRANSPORT, *L4_SQL)),
    "drone_application_log": (
        lambda s, d: plain(drone_application.drone_application_log(packets(s, d), FLEET, **L7_LIMITS)).withColumn(
            "payload_sample", F.when(F.col("protocol") == "TCP", F.col("payload_sample"))),  # SQL cannot decode the bytes of the others
        log_sql(f"""p.packet_id, CASE WHEN ip_proto = 6 THEN replace(left(coalesce(payload_words, ''), 50), chr(10), '\\n') END AS payload_sample, src_ip, dst_ip, sport AS src_port, dport AS dst_port, CASE ip_proto WHEN 6 THEN 'TCP' ELSE 'UDP' END
        AS protocol, {D.service(S.APP_PORTS)} AS service_targeted""", APPLICATION, *L7_SQL)),
    "alerts_by_layer": (lambda s, d: report.breakdown(layer_alerts(s, d), "layer", "attack_type"),
                        f"SELECT layer, attack_type, count(*) AS n FROM {EVERY_ALERT} GROUP BY 1, 2"),
    "alerts_by_single_layers": (
        lambda s, d: report.breakdown(alerts_layer_by_layer(s, d), "layer", "attack_type"),
        f"SELECT layer, attack_type, count(*) AS n FROM {EVERY_ALERT} GROUP BY 1, 2"),
    "alerts_of_all_layers": (all_alerts, P + f"""SELECT epoch_us(ts) AS ts, a.packet_id, layer, attack_type, round(severity::DOUBLE, 6) AS severity,
        details, coalesce(lower(src_mac), '') AS src_mac, coalesce(lower(dst_mac), '') AS dst_mac, src_ip, dst_ip
        FROM {EVERY_ALERT} a JOIN packets p ON p.packet_id = a.packet_id"""),
    "hybrid_verdict": (
        hybrid,
        ALERTS + """ SELECT packet_id, coalesce(attack_type, 'network_attack') AS attack_type,
        round(CASE WHEN attack_type IS NOT NULL THEN 0.8 ELSE k / 100.0 END, 6)::DOUBLE AS confidence, src_ip, dst_ip FROM a
        WHERE attack_type IS NOT NULL OR (k % 2 = 1 AND k / 100.0::DOUBLE > 0.7)"""),
}
