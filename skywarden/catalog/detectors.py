"""The detectors, one query each. SQL twins use plain trailing windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from skywarden import schema as S
from skywarden.catalog.base import (APPLICATION, BEACON, DAY, DEAUTH, FLEET, GATEWAYS, IN_FLEET, LINK, P, SIZE, TARGET_IP,
                                    TRANSPORT, contained, packets, per_second, rate, running, seen)
from skywarden.catalog.aggregates import ALERTS
from skywarden.catalog.blocks import MACHINE, suppressed_sql
from skywarden.functions import scalars as X
from skywarden.plans import (analyser, drone_application, drone_internet, drone_network, drone_transport, internet, network)

D3 = 3 * DAY
DRONE = FLEET[:1]


def found(df):
    return df.select("packet_id", "detector", F.round("severity", 6).alias("severity"), "details")


def counted(rows: str, key: str, seconds: float, more: str = "") -> str:
    return P + f", r AS (SELECT *, {rate(key, seconds)} AS n{more} FROM packets WHERE {rows})"


def hit(name: str, severity: str, details: str, where: str, source: str = "r") -> str:
    return f" SELECT packet_id, '{name}' AS detector, round(({severity})::DOUBLE, 6) AS severity, {details} AS details FROM {source} WHERE {where}"


def service(names, column="dport"):
    return f"CASE {column} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in names.items()) + " ELSE 'Unknown' END"


def app(s, d):
    return drone_application.messages(packets(s, d), FLEET)


MAC = "coalesce(lower(src_mac), '')"
PER1, PER3 = per_second(DAY), per_second(D3)
HEADER = f"""{APPLICATION} AND ip_proto = 17 AND dport IN (5760, 14550) AND payload_hex LIKE 'FD%' AND length(payload_hex) >= 22"""
MESSAGE = "('0x' || substr(payload_hex, 19, 2) || substr(payload_hex, 17, 2) || substr(payload_hex, 15, 2))::INT"
NAMES = "CASE m " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in S.MAVLINK_DANGEROUS.items()) + " ELSE 'MSG_' || m END"
RISKY = "(76, 11, 400, 21, 84)"
MAVLINK = P + f""", r AS (SELECT packet_id, ts, src_ip, {MESSAGE} AS m, ('0x' || substr(payload_hex, 11, 2))::INT AS sys
    FROM packets WHERE {HEADER}),
  a AS (SELECT *, {rate('src_ip', DAY)} AS n FROM r),
  b AS (SELECT packet_id, {rate('src_ip', D3)} AS risky FROM r WHERE m IN {RISKY}),
  c AS (SELECT a.*, b.risky FROM a LEFT JOIN b USING (packet_id))"""
HTTP_ROWS = f"{APPLICATION} AND ip_proto = 6 AND dport IN (80, 8080, 443) AND regexp_matches(payload_words, '^(GET|POST|PUT|DELETE) ')"
MQTT_ROWS = f"{APPLICATION} AND ip_proto = 6 AND dport IN (1883, 8883) AND octet_length(payload) >= 2"
RTSP_ROWS = f"{APPLICATION} AND ip_proto = 6 AND dport = 554 AND regexp_matches(payload_words, 'DESCRIBE|SETUP|PLAY|TEARDOWN|OPTIONS')"
LOGIN_ROWS = f"{APPLICATION} AND ip_proto = 6 AND dport IN (22, 23)"

SQL = {
    "arp_spoofing": P + """, r AS (SELECT packet_id, lower(arp_hwsrc) AS mac, first_value(lower(arp_hwsrc)) OVER
        (PARTITION BY arp_psrc ORDER BY ts, packet_id) AS first FROM packets WHERE wlan_type IS NOT NULL AND arp_psrc IS NOT NULL)"""
    + hit("ARP_SPOOFING", "0.8", "''", "mac <> first"),
    "deauth_attack": counted(DEAUTH, MAC, DAY) + hit("DEAUTH_ATTACK", "least(0.7 + n * 0.05, 0.95)", "''", "n > 1"),
    "evil_twin": P + f", r AS (SELECT packet_id, {seen('ssid', 'lower(bssid)')} AS n FROM packets WHERE {BEACON} AND ssid <> '' AND bssid <> '')"
    + hit("EVIL_TWIN", "0.7", "''", "n > 2"),
    "mac_flooding": P + f""", r AS (SELECT packet_id, count(DISTINCT lower(src_mac)) OVER (PARTITION BY sensor_id ORDER BY ts
        RANGE BETWEEN INTERVAL {DAY} SECONDS PRECEDING AND CURRENT ROW) AS n FROM packets
        WHERE wlan_type IS NOT NULL AND NOT {DEAUTH} AND NOT {BEACON} AND coalesce(src_mac, '') <> '')"""
    + hit("MAC_FLOODING", "least(0.6 + n * 0.01, 0.95)", "''", "n > 12"),
    "ip_spoofing": P + """, r AS (SELECT packet_id, ttl, src_mac, first_value(ttl) OVER w AS t0, first_value(src_mac) OVER w AS m0
        FROM packets WHERE src_ip IS NOT NULL WINDOW w AS (PARTITION BY src_ip ORDER BY ts, packet_id))"""
    + hit("IP_SPOOFING", "1", "''", "abs(ttl - t0) > 10 OR src_mac IS DISTINCT FROM m0"),
    "ping_flood": counted("ip_proto = 1", "src_ip", DAY) + hit("PING_FLOOD", "1", "''", "n > 2"),
    "syn_flood": counted("ip_proto = 6 AND tcp_flags = 2", "src_ip", DAY) + hit("SYN_FLOOD", "1", "''", "n > 2"),
    "udp_flood": counted("ip_proto = 17", "src_ip", DAY) + hit("UDP_FLOOD", "1", "''", "n > 3"),
    "port_scan": P + f", r AS (SELECT packet_id, {seen('src_ip', 'coalesce(dport, 0)')} AS n FROM packets WHERE src_ip IS NOT NULL)"
    + hit("PORT_SCAN", "1", "''", "n > 20"),
    "command_flood": counted(f"{LINK} AND ip_proto = 17 AND dport = 5760", "src_ip", DAY)
    + hit("COMMAND_FLOOD", "least(n, 10)", f"'rate:' || n || '{PER1}'", "n > 1"),
    "gps_spoof": suppressed_sql(f"{LINK} AND ip_proto = 17 AND dport = 5760 AND {SIZE} > 30", "sensor_id", DAY * 1_000_000, False)
    + hit("GPS_SPOOF", "8", "'rapid_gps_changes'", "flagged", "judged"),
    "video_hijack": P + f""", r AS (SELECT packet_id, {running("src_ip || ':' || sport", '1')} AS n,
        {running("src_ip || ':' || sport", '(packet_size < 100)::INT')} AS a FROM packets WHERE {LINK} AND ip_proto = 17 AND dport = 554)"""
    + hit("VIDEO_HIJACK", "7", "'anomaly_rate:' || printf('%.2f', a / n::DOUBLE)", "n > 4 AND a / n::DOUBLE > 0.3"),
    "mqtt_flood": counted(f"{LINK} AND ip_proto = 6 AND dport = 1883", "src_ip", D3)
    + hit("MQTT_FLOOD", "least(n // 3, 10)", f"'mqtt_rate:' || n || '{PER3}'", "n > 2"),
    "wifi_deauth": counted(f"{LINK} AND {DEAUTH}", "coalesce(src_mac, 'unknown')", DAY)
    + hit("WIFI_DEAUTH", "9", f"'deauth_rate:' || n || '{PER1},mac:' || coalesce(src_mac, 'unknown')", "n > 1"),
    "many_macs_per_ip": P + f", r AS (SELECT packet_id, src_ip, {seen('src_ip', 'src_mac')} AS n FROM packets WHERE {IN_FLEET})"
    + hit("IP_SPOOFING", "least(n + 5, 10)", "'ip:' || src_ip || ',macs:' || n", "n > 3"),
    "gps_injection": counted(f"{IN_FLEET} AND ip_proto = 17 AND dport = 5760 AND {SIZE} >= 20 AND payload_hex LIKE 'FD%'", "src_ip", D3)
    + hit("GPS_INJECTION", "8", f"'gps_rate:' || n || '{PER3},from:' || src_ip", "n > 1"),
    "routing_attack": P + f""", q AS (SELECT *, (ttl > 128 OR ttl < 10) AS odd,
        (dst_ip = '{FLEET[0]}' AND src_ip NOT IN {GATEWAYS} AND src_ip NOT LIKE '192.168.4.%') AS gw FROM packets WHERE {IN_FLEET}),
        r AS (SELECT *, {rate('src_ip, dst_ip', DAY)} AS n FROM q WHERE odd OR gw)"""
    + hit("ROUTING_ATTACK", "7", """CASE WHEN odd THEN 'suspicious_ttl:' || ttl || ',' ELSE '' END ||
        CASE WHEN gw THEN 'unexpected_gateway:' || src_ip || ',' ELSE '' END || 'anomaly_count:' || n""", "n > 1"),
    "icmp_flood": counted(f"{IN_FLEET} AND ip_proto = 1", "src_ip", DAY)
    + hit("ICMP_FLOOD", "least(n // 2, 10)", f"'icmp_rate:' || n || '{PER1},type:' || icmp_type", "n > 1"),
    "fragment_attack": counted(f"{IN_FLEET} AND (ip_flags % 2 = 1 OR ip_frag > 0)", "src_ip", DAY)
    + hit("FRAG_ATTACK", "6", f"""'frag_rate:' || n || '{PER1},flags:' || CASE ip_flags WHEN 1 THEN 'MF' WHEN 2 THEN 'DF' ELSE '' END
        || ',offset:' || ip_frag""", "n > 1"),
    "drone_syn_flood": counted(f"{TRANSPORT} AND ip_proto = 6 AND (tcp_flags // 2) % 2 = 1 AND (tcp_flags // 16) % 2 = 0", "src_ip", D3)
    + hit("SYN_FLOOD", "least(n // 3, 10)", f"'syn_rate:' || n || '{PER3},target_port:' || dport", "n > 4"),
    "drone_udp_flood": counted(f"{TRANSPORT} AND ip_proto = 17", "src_ip", D3)
    + hit("UDP_FLOOD", "least(n // 5, 10)", f"'udp_rate:' || n || '{PER3},service:' || {service(S.DRONE_PORTS)} || ',port:' || dport", "n > 5"),
    "drone_port_scan": P + f""", r AS (SELECT packet_id, {seen('src_ip, dst_ip', 'dport')} AS n,
        {seen('src_ip, dst_ip', 'CASE WHEN dport IN (5760, 14550, 554, 1883, 8080, 22, 23) THEN dport END')} AS m
        FROM packets WHERE {TRANSPORT} AND (ip_proto = 17 OR (tcp_flags // 2) % 2 = 1))"""
    + hit("PORT_SCAN", "least(n // 2, 10)", "'ports_scanned:' || n || ',drone_ports:' || m", "n > 10"),
    "connection_hijack": P + MACHINE.format(rows=TRANSPORT + " AND ip_proto = 6", key="src_ip || dst_ip", limit=2)
    + hit("CONNECTION_HIJACK", "8", "'seq_anomalies:' || anomalies || ',expected:' || expected || ',got:' || got", "true", "hijack"),
    "session_replay": suppressed_sql(f"{TRANSPORT} AND payload IS NOT NULL AND octet_length(payload) > 0",
                                     "src_ip || '|' || dst_ip || '|' || md5(payload)", 10 * DAY * 1_000_000, True)
    + hit("SESSION_REPLAY", "7", "'replay_detected,hash:' || left(md5(payload), 8) || ',time_diff:' || "
          "printf('%.2f', (epoch_us(ts) - anchor) / 1e6::DOUBLE) || 's'", "flagged", "(judged JOIN packets USING (packet_id))"),
    "mavlink_injection": MAVLINK + hit(
        "MAVLINK_INJECTION", "CASE WHEN n > 3 THEN least(8 + n // 10, 10) ELSE 9 END",
        f"""CASE WHEN n > 3 THEN 'rate:' || n || '{PER1},cmd:' || {NAMES} || ',sys_id:' || sys
        ELSE 'dangerous_cmd:' || {NAMES} || ',count:' || risky || '{PER3}' END""", f"n > 3 OR (m IN {RISKY} AND risky > 4)", "c"),
    "http_attack": P + f""", q AS (SELECT *, {contained('payload_words', S.HTTP_PATTERNS)} AS f FROM packets WHERE {HTTP_ROWS}),
        r AS (SELECT *, {rate('src_ip', DAY)} AS n FROM q)"""
    + hit("HTTP_ATTACK", "CASE WHEN len(f) > 0 THEN least(7 + len(f), 10) ELSE least(n // 3, 10) END",
          f"""CASE WHEN len(f) > 0 THEN 'malicious_patterns:' || array_to_string(f[1:3], ',') || ',rate:' || n || '{PER1}'
          ELSE 'http_flood:rate:' || n || '{PER1}' END""", "len(f) > 0 OR n > 1"),
    "mqtt_hijacking": P + f""", q AS (SELECT *, {contained('payload_words', S.MQTT_TOPICS)} AS f FROM packets WHERE {MQTT_ROWS}),
        r AS (SELECT *, {rate('src_ip', D3)} AS n, {running('src_ip', 'len(f)')} AS total FROM q)"""
    + hit("MQTT_HIJACKING", "CASE WHEN len(f) > 0 THEN 8 ELSE least(n // 2, 10) END",
          f"""CASE WHEN len(f) > 0 THEN 'suspicious_topics:' || array_to_string(f, ',') || ',total_suspicious:' || total
          ELSE 'mqtt_flood:rate:' || n || '{PER3},type:' || ascii(payload_words) // 16 END""", "len(f) > 0 OR n > 1"),
    "video_manipulation": P + f""", q AS (SELECT *, {contained('payload_words', S.RTSP_PATTERNS)} AS f FROM packets WHERE {RTSP_ROWS}),
        r AS (SELECT *, {rate('src_ip, sport', D3)} AS n, {running('src_ip, sport', 'len(f)')} AS total FROM q)"""
    + hit("VIDEO_MANIPULATION", "CASE WHEN len(f) > 0 THEN 7 ELSE least(n // 5, 10) END",
          f"""CASE WHEN len(f) > 0 THEN 'rtsp_attack:' || array_to_string(f[1:2], ',') || ',total_suspicious:' || total
          ELSE 'rtsp_flood:rate:' || n || '{PER3}' END""", "len(f) > 0 OR n > 1"),
    "brute_force": P + f""", q AS (SELECT *, CASE WHEN dport = 22 THEN {contained('payload_words', S.SSH_MARKERS)}
        ELSE {contained('payload_words', S.TELNET_MARKERS)} END AS f FROM packets WHERE {LOGIN_ROWS}),
        r AS (SELECT *, {rate('src_ip', D3)} AS n FROM q)"""
    + hit("BRUTE_FORCE", "least(6 + n // 5, 10)",
          f"""'brute_force:' || CASE WHEN dport = 22 THEN 'SSH' ELSE 'Telnet' END || ',attempts:' || n || '{PER3},patterns:' ||
          array_to_string(f[1:2], ',')""", "n > 2"),
    "rule_chain": ALERTS + " SELECT packet_id, attack_type, round(0.8, 6)::DOUBLE AS confidence, src_ip, dst_ip FROM alerts",
}

SPARK = {
    "arp_spoofing": lambda s, d: found(network.arp_spoofing(packets(s, d))),
    "deauth_attack": lambda s, d: found(network.deauth_attack(packets(s, d), {"DEAUTH_ATTACK": (DAY, 1)})),
    "evil_twin": lambda s, d: found(network.evil_twin(packets(s, d), 2)),
    "mac_flooding": lambda s, d: found(network.mac_flooding(packets(s, d), DAY, 12)),
    "ip_spoofing": lambda s, d: found(internet.ip_spoofing(packets(s, d))),
    "ping_flood": lambda s, d: found(internet.floods(packets(s, d), {"PING_FLOOD": (DAY, 2)}, "PING_FLOOD")),
    "syn_flood": lambda s, d: found(internet.floods(packets(s, d), {"SYN_FLOOD": (DAY, 2)}, "SYN_FLOOD")),
    "udp_flood": lambda s, d: found(internet.floods(packets(s, d), {"UDP_FLOOD": (DAY, 3)}, "UDP_FLOOD")),
    "port_scan": lambda s, d: found(internet.port_scan(packets(s, d), 20)),
    "command_flood": lambda s, d: found(drone_network.link_floods(packets(s, d), DRONE, {"COMMAND_FLOOD": (DAY, 1)}, "COMMAND_FLOOD")),
    "gps_spoof": lambda s, d: found(drone_network.gps_spoof(packets(s, d), DRONE, DAY)),
    "video_hijack": lambda s, d: found(drone_network.video_hijack(packets(s, d), DRONE, samples=4)),
    "mqtt_flood": lambda s, d: found(drone_network.link_floods(packets(s, d), DRONE, {"MQTT_FLOOD": (D3, 2)}, "MQTT_FLOOD")),
    "wifi_deauth": lambda s, d: found(drone_network.link_floods(packets(s, d), DRONE, {"WIFI_DEAUTH": (DAY, 1)}, "WIFI_DEAUTH")),
    "many_macs_per_ip": lambda s, d: found(drone_internet.many_macs(packets(s, d), FLEET)),
    "gps_injection": lambda s, d: found(drone_internet.internet_rates(packets(s, d), FLEET, GATEWAYS, {"GPS_INJECTION": (D3, 1)}, "GPS_INJECTION")),
    "routing_attack": lambda s, d: found(drone_internet.internet_rates(packets(s, d), FLEET, GATEWAYS, {"ROUTING_ATTACK": (DAY, 1)}, "ROUTING_ATTACK")),
    "icmp_flood": lambda s, d: found(drone_internet.internet_rates(packets(s, d), FLEET, GATEWAYS, {"ICMP_FLOOD": (DAY, 1)}, "ICMP_FLOOD")),
    "fragment_attack": lambda s, d: found(drone_internet.internet_rates(packets(s, d), FLEET, GATEWAYS, {"FRAG_ATTACK": (DAY, 1)}, "FRAG_ATTACK")),
    "drone_syn_flood": lambda s, d: found(drone_transport.transport_floods(packets(s, d), FLEET, {"SYN_FLOOD": (D3, 4)}, "SYN_FLOOD")),
    "drone_udp_flood": lambda s, d: found(drone_transport.transport_floods(packets(s, d), FLEET, {"UDP_FLOOD": (D3, 5)}, "UDP_FLOOD")),
    "drone_port_scan": lambda s, d: found(drone_transport.port_scan(packets(s, d), FLEET, 10)),
    "connection_hijack": lambda s, d: found(drone_transport.connection_hijack(packets(s, d), FLEET, 2, ("src_ip", "dst_ip"))),
    "session_replay": lambda s, d: found(drone_transport.session_replay(packets(s, d), FLEET, 10 * DAY)),
    "mavlink_injection": lambda s, d: found(drone_application.mavlink_injection(app(s, d), (DAY, 3), (D3, 4))),
    "http_attack": lambda s, d: found(drone_application.http_attack(app(s, d), {"HTTP_ATTACK": (DAY, 1)})),
    "mqtt_hijacking": lambda s, d: found(drone_application.mqtt_hijacking(app(s, d), {"MQTT_HIJACKING": (D3, 1)})),
    "video_manipulation": lambda s, d: found(drone_application.video_manipulation(app(s, d), {"VIDEO_MANIPULATION": (D3, 1)})),
    "brute_force": lambda s, d: found(drone_application.brute_force(app(s, d), {"BRUTE_FORCE": (D3, 2)})),
    "rule_chain": lambda s, d: analyser.rule_alerts(packets(s, d), TARGET_IP).drop("ts", "ip_proto"),
}

QUERIES = {name: (SPARK[name], SQL[name]) for name in SPARK}
