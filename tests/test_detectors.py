"""Detectors at their real time scale: at the limit, one above, window edges, ties, absent layers."""

from __future__ import annotations

import pytest

from packet_ids import ids
from skywarden.plans import (analyser, drone_application, drone_internet, drone_network, drone_transport, internet, network)

DRONE = ["10.0.0.9"]


def udp(at, **more):
    return {"at": at, "src_ip": "1.1.1.1", "dst_ip": "10.0.0.9", "ip_proto": 17, "sport": 5, "dport": 5760, "ttl": 64,
            "ip_flags": 0, "ip_frag": 0, **more}


def tcp(at, **more):
    return {**udp(at), "ip_proto": 6, "dport": 80, "tcp_flags": 2, "tcp_seq": 0, **more}


def wlan(at, subtype=12, **more):
    return {"at": at, "wlan_type": 0, "wlan_subtype": subtype, "src_mac": "Aa", "dst_mac": "Bb", **more}


RATES = {
    "deauth": (lambda p: network.deauth_attack(p), wlan, 10, 5),
    "ping": (lambda p: internet.floods(p, only="PING_FLOOD"), lambda t: udp(t, ip_proto=1, dport=None), 10, 10),
    "syn": (lambda p: internet.floods(p, only="SYN_FLOOD"), tcp, 10, 100),
    "udp": (lambda p: internet.floods(p, only="UDP_FLOOD"), udp, 10, 100),
    "command": (lambda p: drone_network.link_floods(p, DRONE, only="COMMAND_FLOOD"), udp, 5, 15),
    "mqtt": (lambda p: drone_network.link_floods(p, DRONE, only="MQTT_FLOOD"), lambda t: tcp(t, dport=1883), 5, 25),
    "wifi_deauth": (lambda p: drone_network.link_floods(p, DRONE, only="WIFI_DEAUTH"), wlan, 5, 10),
    "gps": (lambda p: drone_internet.internet_rates(p, DRONE, only="GPS_INJECTION"), lambda t: udp(t, payload=b"\xfd" + b"0" * 19), 10, 10),
    "routing": (lambda p: drone_internet.internet_rates(p, DRONE, only="ROUTING_ATTACK"), lambda t: udp(t, ttl=9, src_ip="192.168.4.7"), 10, 5),
    "icmp": (lambda p: drone_internet.internet_rates(p, DRONE, only="ICMP_FLOOD"), lambda t: udp(t, ip_proto=1), 5, 20),
    "fragments": (lambda p: drone_internet.internet_rates(p, DRONE, only="FRAG_ATTACK"), lambda t: udp(t, ip_frag=8), 5, 15),
    "drone_syn": (lambda p: drone_transport.transport_floods(p, DRONE, only="SYN_FLOOD"), tcp, 5, 30),
    "drone_udp": (lambda p: drone_transport.transport_floods(p, DRONE, only="UDP_FLOOD"), udp, 5, 50),
    "http": (lambda p: drone_application.http_attack(drone_application.messages(p, DRONE)), lambda t: tcp(t, payload=b"GET / "), 5, 15),
    "mqtt_l7": (lambda p: drone_application.mqtt_hijacking(drone_application.messages(p, DRONE)), lambda t: tcp(t, dport=8883, payload=b"0x"), 5, 10),
    "rtsp": (lambda p: drone_application.video_manipulation(drone_application.messages(p, DRONE)), lambda t: tcp(t, dport=554, payload=b"PLAY"), 10, 20),
    "login": (lambda p: drone_application.brute_force(drone_application.messages(p, DRONE)), lambda t: tcp(t, dport=22, payload=b"SSH-2.0"), 30, 8),
}


@pytest.mark.parametrize("name", RATES)
def test_rate_detectors_at_their_limit(frames, name):
    detect, row, window, limit = RATES[name]
    last = limit  # id of row number limit + 1
    spread = [i * window / (limit * 2) for i in range(limit)]
    assert ids(detect(frames([row(t) for t in spread]))) == []
    assert ids(detect(frames([row(t) for t in spread] + [row(window)]))) == [last]
    assert ids(detect(frames([row(t) for t in spread] + [row(window + 1e-6)]))) == []
    assert ids(detect(frames([row(1.0) for _ in range(limit + 1)]))) == [last]


def test_arp_and_ip_spoofing_keep_the_first_binding(frames):
    arp = [{"at": i, "wlan_type": 2, "arp_psrc": "1", "arp_hwsrc": m} for i, m in enumerate(("AA", "aa", "bb", "AA"))]
    assert ids(network.arp_spoofing(frames(arp))) == [2]
    rows = [udp(i, ttl=t, src_mac=m) for i, (t, m) in enumerate(((64, "a"), (74, "a"), (75, "a"), (64, "b"), (64, None)))]
    assert ids(internet.ip_spoofing(frames(rows))) == [2, 3, 4]


def test_evil_twin_and_mac_flooding(frames):
    beacons = [wlan(i, 8, ssid=s, bssid=b) for i, (s, b) in enumerate((("n", "A"), ("n", "a"), ("n", "b"), ("n", "a"), ("", "c"), ("n", None)))]
    assert ids(network.evil_twin(frames(beacons))) == [2, 3]
    flood = [wlan(i / 10, 4, src_mac=f"m{i}") for i in range(31)] + [wlan(3.1, 12, src_mac="x"), wlan(9.0, 4, src_mac="m0")]
    assert ids(network.mac_flooding(frames(flood))) == [30]
    two = [wlan(i / 10, 4, src_mac=f"m{i}", sensor_id=f"s{i % 2}") for i in range(31)]
    assert ids(network.mac_flooding(frames(two))) == []


def test_port_scans(frames):
    rows = [tcp(i, dport=i) for i in range(21)] + [udp(30, ip_proto=1, dport=None)]
    assert ids(internet.port_scan(frames(rows))) == [20, 21]
    rows = [tcp(i, dport=i) for i in range(10)] + [tcp(11, dport=99, tcp_flags=16), tcp(12, dport=23), tcp(13, dport=1)]
    got = {r.packet_id: r.details for r in drone_transport.port_scan(frames(rows), DRONE).collect()}
    assert got == {11: "ports_scanned:11,drone_ports:1", 12: "ports_scanned:11,drone_ports:1"}


def test_gps_spoof_and_replay(frames):
    rows = [udp(t, payload=b"x" * 31) for t in (0, 0.9, 1.0, 1.5)] + [udp(1.6, payload=b"x" * 30)]
    assert ids(drone_network.gps_spoof(frames(rows), DRONE)) == [1, 3]
    rows = [udp(t, payload=p) for t, p in ((0, b"a"), (1.5, b"a"), (1.6, b"b"), (2.0, b"a"), (3.0, b"a"))]
    got = {r.packet_id: r.details for r in drone_transport.session_replay(frames(rows), DRONE).collect()}
    assert got == {1: "replay_detected,hash:0cc175b9,time_diff:1.50s", 3: "replay_detected,hash:0cc175b9,time_diff:2.00s"}


def test_video_hijack_share(frames):
    rows = [udp(i, dport=554, packet_size=50 if i < 3 else 500) for i in range(10)]
    assert ids(drone_network.video_hijack(frames(rows), DRONE)) == []
    rows.append(udp(10, dport=554, packet_size=50))
    got = drone_network.video_hijack(frames(rows), DRONE).collect()
    assert [(r.packet_id, r.details) for r in got] == [(10, "anomaly_rate:0.36")]


def test_routing_names_both_causes(frames):
    rows = [udp(i / 10, ttl=200) for i in range(6)]
    got = drone_internet.internet_rates(frames(rows), DRONE, only="ROUTING_ATTACK").collect()
    assert [r.details for r in got] == ["suspicious_ttl:200,unexpected_gateway:1.1.1.1,anomaly_count:6"]
    assert ids(drone_internet.internet_rates(frames([udp(i / 10) for i in range(6)]), DRONE, ["1.1.1.1"], only="ROUTING_ATTACK")) == []


def mavlink(message, system=7):
    return b"\xfd\x09\x00\x00\x01" + bytes([system, 1]) + message.to_bytes(3, "little") + b"\x00"


def test_mavlink_injection(frames):
    def detect(rows):
        found = drone_application.mavlink_injection(drone_application.messages(frames(rows), DRONE))
        return [(r.packet_id, r.severity, r.details) for r in found.collect()]
    risky = [udp(i / 10, payload=mavlink(400)) for i in range(6)]
    assert detect(risky) == [(5, 9.0, "dangerous_cmd:COMPONENT_ARM_DISARM,count:6/5s")]
    many = [udp(i / 10, payload=mavlink(33)) for i in range(21)]
    assert detect(many) == [(20, 10.0, "rate:21/10s,cmd:MSG_33,sys_id:7")]
    assert detect([udp(i / 10, payload=mavlink(400)[:10]) for i in range(30)]) == []


def test_patterns_come_before_rates(frames):
    rows = [tcp(0, payload=b"GET /../../../ <script> <iframe javascript: "), tcp(1, payload=b"GET /<SCRIPT>"),
            tcp(2, payload=b"xGET /<script>"), tcp(3, dport=1883, payload=b"\x30/admin/ /config/"), tcp(4, dport=1883, payload=b"\x30/admin/"),
            tcp(5, dport=554, payload=b"SETUP Range: bytes=0")]
    m = drone_application.messages(frames(rows), DRONE)
    assert [(r.packet_id, r.severity, r.details) for r in drone_application.http_attack(m).collect()] == [
        (0, 10.0, "malicious_patterns:<script>,../../../,<iframe,rate:1/5s")]
    topics = sorted((r.packet_id, r.details) for r in drone_application.mqtt_hijacking(m).collect())
    assert topics == [(3, "suspicious_topics:/admin/,/config/,total_suspicious:2"), (4, "suspicious_topics:/admin/,total_suspicious:3")]
    assert [r.details for r in drone_application.video_manipulation(m).collect()] == ["rtsp_attack:Range: bytes=,total_suspicious:1"]


def test_rule_chain_first_match_wins(frames):
    rows = [udp(0, packet_size=19, ttl=5), udp(1, ttl=9), udp(2, ip_flags=1), tcp(3), tcp(4, tcp_flags=16, sport=80), udp(5),
            {"at": 6, "packet_size": 9001}, tcp(7, src_ip="x", dst_ip="y")]
    got = {r.packet_id: r.attack_type for r in analyser.rule_alerts(frames(rows), "10.0.0.9").collect()}
    assert got == {0: "unusual_packet_size", 1: "unusual_ttl", 2: "fragmented_packet", 3: "potential_syn_flood",
                   4: "same_port_attack", 6: "unusual_packet_size"}
