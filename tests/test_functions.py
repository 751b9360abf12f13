"""Expressions whose edge cases the test tables do not reach."""

from __future__ import annotations

from pyspark.sql import functions as F

from skywarden import schema as S
from skywarden.functions import patterns as P, scalars as X
from skywarden.operators import buckets, exposure, report, verdict
from skywarden.plans import network


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_payload_bytes(spark):
    df = spark.createDataFrame([(b"\xffGET /\n\xe9",), (b"ab\rUNION\rSELECT",), (b"union\nselect",)], "payload BINARY")
    texts = [r[0] for r in df.select(X.payload_text()).collect()]
    assert texts[0] == "GET /\n"
    assert df.select(X.payload_sample()).first()[0] == "GET /\\n"
    assert [r[0] for r in df.select(P.has_sqli()).collect()] == [False, True, False]
    assert df.select(P.has_http_verb()).first()[0] is True


def test_ratio_text_rounds_like_a_binary_double(spark):
    pairs = [(a, b) for b in range(1, 60) for a in range(b + 1)] + [(29, 200), (1, 8), (3, 8)]
    df = spark.createDataFrame(pairs, "a BIGINT, b BIGINT")
    got = [r[0] for r in df.select(X.ratio_text(F.col("a"), F.col("b"))).collect()]
    assert got == [f"{a / b:.2f}" for a, b in pairs]


def test_verdict_ties_and_nothing_found(spark):
    def f(name, on, severity):
        return verdict.finding(name, F.lit(on), F.lit(severity), F.lit(name.lower()))
    tie = one(spark, v=verdict.verdict([f("A", True, 7), f("B", True, 7), f("C", False, 9)])).v
    none = one(spark, v=verdict.verdict([f("A", False, 7), f("B", True, 0)])).v
    assert (tie.attack_type, tie.details) == ("A", "a")
    assert (none.attack_type, none.severity, none.details) == ("NORMAL", 0.0, "")


def test_bucket_edges_and_labels(frames):
    rows = [{"at": t, "src_ip": "1.2.3.4", "ip_proto": 6, "dport": 80, "sport": 9, "tcp_flags": 2,
             "payload": b"<script> password="} for t in (0.0, 0.999999, 1.0)]
    got = {r.window_start.second: r for r in buckets.application_buckets(frames(rows)).collect()}
    assert (got[0].http_reqs, got[1].http_reqs) == (2, 1)
    assert got[0].src_ip_int == 16909060
    limits = buckets.ApplicationLimits(xss=1, creds=0)
    labels = {r.attack_label for r in buckets.application_buckets(frames(rows), limits=limits).collect()}
    assert labels == {"XSS", "CREDENTIAL_THEFT"}


def test_dns_answers(frames):
    answers = [(1, 59, b""), (1, 60, b""), (16, 300, b"t" * 101), (16, 300, b"t" * 100), (5, None, b"")]
    rows = [{"at": 0, "src_ip": "1.1.1.1", "ip_proto": 17, "sport": 53, "dport": p, "dns_qr": 1, "dns_answers": answers} for p in (53, 99)]
    def counts(**how):
        return [(r.dns_spoof, r.dns_tunnel) for r in buckets.application_counts(frames(rows), **how).orderBy("packet_id").collect()]
    assert counts() == [(2, 1), (0, 0)]
    assert counts(either_port=True) == [(2, 1), (2, 1)]


def test_exposure(spark):
    assets = spark.createDataFrame([("a", 554), ("a", 80), ("a", 80), ("b", 80), ("b", 8080), ("b", 23), ("c", 80)] + [
        ("d", p) for p in (554, 1935, 5760, 14550, 21, 5555)], "ip STRING, port INT")
    got = {r.ip: (r.score, r.confidence, r.services) for r in exposure.exposure_scores(assets).collect()}
    assert got == {"a": (4, 40, ["RTSP Video Stream", "Web Interface"]), "b": (4, 40, ["Web Interface", "Telnet Access"]),
                   "d": (18, 100, ["RTSP Video Stream", "MAVLink Protocol", "ADB Debug Interface"])}
    found = exposure.exposure_findings(assets)
    assert [(r.ip, r.n_findings) for r in exposure.most_exposed(found, 2).collect()] == [("d", 4), ("a", 1)]


def test_network_log_keeps_attacks_target_and_samples(frames):
    rows = [{"at": i, "wlan_type": 2, "src_mac": "AA" if i == 3 else "bb", "dst_mac": "cc"} for i in range(25)]
    log = network.network_log(frames(rows), "aa")
    assert sorted(r.packet_id for r in log.collect()) == [3, 9, 19]
    assert log.drop("packet_id", "ts").columns == [c.split()[0] for c in S.LOGS["network"].split(", ")][1:]


def test_smoothed_stream_size(frames):
    sizes = [100, 50, 900, 30] * 250
    rows = [{"at": i, "src_ip": "a", "sport": 1, "packet_size": n} for i, n in enumerate(sizes)]
    smoothed = sizes[0]
    for n in sizes:
        smoothed = (smoothed + n) / 2
    got = report.stream_state(frames(rows)).first()
    assert (got.packet_count, got.small_count) == (1000, 500)
    assert abs(got.smoothed_size - smoothed) < 1e-9


def test_two_decimals_round_as_binary_doubles(spark):
    values = [0.0, 0.125, 0.375, 1.005, 1.115, 2.675, 0.005, 0.015, 99.995, 1234567.125, 0.994999, 0.995, 3.0, 12.34]
    values += [k / 200 for k in range(1, 400, 2)] + [i / 1e6 for i in range(5000, 9_000_000, 77_003)]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", X.two_decimals(F.col("x")).alias("t")).collect()
    assert [r.t for r in rows] == [f"{r.x:.2f}" for r in rows]


def test_severity_zero_is_no_verdict(spark):
    hits = spark.createDataFrame([(1, "A", 0, 0.0, "a"), (2, "A", 0, 0.0, "a"), (2, "B", 1, 3.0, "b")],
                                 "packet_id long, detector string, position int, severity double, details string")
    assert [(r.packet_id, r.attack_type) for r in verdict.resolve(hits).collect()] == [(2, "B")]
