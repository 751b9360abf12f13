"""Table schemas and the small fixed rule tables."""

from __future__ import annotations

# Column lists are DDL text, which every reader takes as a schema.
PACKETS = """
    packet_id BIGINT, ts TIMESTAMP, sensor_id STRING, packet_size INT,
    src_mac STRING, dst_mac STRING, bssid STRING, wlan_type INT, wlan_subtype INT, rssi INT,
    ssid STRING, channel INT, elements ARRAY<STRUCT<id: INT, info: BINARY>>,
    arp_psrc STRING, arp_hwsrc STRING,
    src_ip STRING, dst_ip STRING, ip_len INT, ip_id INT, ttl INT, ip_proto INT, ip_flags INT, ip_frag INT,
    sport INT, dport INT, tcp_flags INT, tcp_seq BIGINT, tcp_ack BIGINT, tcp_window INT,
    icmp_type INT, dns_qr INT, dns_answers ARRAY<STRUCT<type: INT, ttl: BIGINT, rdata: BINARY>>,
    payload BINARY"""

# Log columns (fixed values).
LOGS = {
    "network": "timestamp STRING, src_mac STRING, dst_mac STRING, attack_type STRING, confidence DOUBLE, "
    "arp_spoofing INT, deauth_attack INT, evil_twin INT, mac_flooding INT, rssi INT, channel INT, packet_rate INT, "
    "packet_size INT, is_broadcast INT, has_arp INT, has_beacon INT, has_deauth INT, has_probe_req INT, "
    "is_target_related INT",
    "internet": "timestamp STRING, src_mac STRING, src_ip STRING, dst_ip STRING, protocol STRING, ttl INT, "
    "packet_size INT, sport INT, dport INT, tcp_flags INT, icmp_type INT, ip_spoofing INT, ping_flood INT, "
    "syn_flood INT, udp_flood INT, port_scan INT",
    "transport": "timestamp STRING, src_ip STRING, dst_ip STRING, sport INT, dport INT, tcp_syn INT, tcp_rst INT, "
    "tcp_ack INT, packet_size INT, flag_label STRING",
    "application": "timestamp STRING, src_ip STRING, src_ip_int BIGINT, dns_spoof BIGINT, dns_tunnel BIGINT, "
    "http_xss BIGINT, http_sqli BIGINT, http_sslstrip BIGINT, http_creds BIGINT, http_reqs BIGINT, "
    "attack_label STRING",
    "drone_network": "timestamp STRING, src_ip STRING, dst_ip STRING, port INT, protocol STRING, attack_type STRING, "
    "severity INT, packet_size INT, attack_details STRING",
    "drone_internet": "timestamp STRING, src_ip STRING, dst_ip STRING, ttl INT, packet_id INT, protocol INT, "
    "attack_type STRING, severity INT, attack_details STRING, is_fragmented INT",
    "drone_transport": "timestamp STRING, src_ip STRING, dst_ip STRING, src_port INT, dst_port INT, protocol STRING, "
    "attack_type STRING, severity INT, attack_details STRING, tcp_flags INT, sequence_num BIGINT, payload_size INT",
    "drone_application": "timestamp STRING, src_ip STRING, dst_ip STRING, src_port INT, dst_port INT, "
    "protocol STRING, attack_type STRING, severity INT, attack_details STRING, payload_sample STRING, "
    "service_targeted STRING",
}

# Service names by port (fixed values).
DRONE_PORTS = {5760: "MAVLink", 14550: "MAVLink_GCS", 554: "RTSP", 1883: "MQTT", 8080: "HTTP_ALT", 22: "SSH", 23: "Telnet"}
APP_PORTS = {5760: "MAVLink", 14550: "MAVLink_GCS", 80: "HTTP", 8080: "HTTP_ALT", 443: "HTTPS", 1883: "MQTT",
             8883: "MQTTS", 554: "RTSP", 22: "SSH", 23: "Telnet"}
DRONE_LINK_PORTS = (5760, 554, 1883, 8080)

# MAVLink messages that change flight state (fixed values).
MAVLINK_DANGEROUS = {76: "COMMAND_LONG", 11: "SET_MODE", 400: "COMPONENT_ARM_DISARM", 21: "PARAM_SET",
                     84: "SET_POSITION_TARGET"}

# Text patterns (fixed values).
HTTP_PATTERNS = ("<script>", "SELECT * FROM", "../../../", "<iframe", "javascript:", "cmd.exe", "/etc/passwd")
HTTP_VERBS = ("GET ", "POST ", "PUT ", "DELETE ")
MQTT_TOPICS = ("/admin/", "/config/", "/emergency/", "/override/", "/../")
RTSP_METHODS = ("DESCRIBE", "SETUP", "PLAY", "TEARDOWN", "OPTIONS")
RTSP_PATTERNS = ("User-Agent: exploit", "Authorization: Basic", "Range: bytes=", "Transport: RTP/AVP/TCP")
SSH_MARKERS = ("SSH-2.0", "diffie-hellman", "password", "publickey")
TELNET_MARKERS = ("login:", "password:", "Login incorrect")
COMMAND_PATHS = ("/api/command", "/control", "/movement", "/flight", "/navigate")
TELEMETRY_PATHS = ("/api/status", "/telemetry", "/position", "/battery", "/sensors")
XSS_REGEX = r"<script|%3cscript"
SQLI_REGEX = r"union.*select|'\s*or\s*1=1"
CREDENTIAL_REGEX = r"password=|Authorization:\s*Basic"

# Exposure rules (fixed values): port weights, then names with the ports that raise them.
PORT_WEIGHTS = {554: 3, 1935: 3, 5760: 5, 14550: 5, 80: 1, 443: 1, 8080: 1, 23: 2, 5555: 2}
SERVICE_RULES = (("RTSP Video Stream", (554,)), ("MAVLink Protocol", (5760, 14550)), ("Web Interface", (80, 8080)),
                 ("Secure Web Interface", (443, 8443)), ("Telnet Access", (23,)), ("SSH Access", (22,)),
                 ("ADB Debug Interface", (5555,)))
FINDING_RULES = (("Unencrypted Telnet Access", (23,)), ("Android Debug Bridge Exposed", (5555,)),
                 ("FTP Service Available", (21,)), ("Potentially Unsecured RTSP Stream", (554,)),
                 ("MAVLink Protocol Exposed", (5760, 14550)))
