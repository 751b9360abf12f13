"""Fixed-length time buckets per source: counts and labels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from skywarden.functions import patterns as P, scalars as X


@dataclass(frozen=True)
class TransportLimits:
    syn: int = 150
    rst: int = 150
    ack: int = 150
    ports: int = 50


@dataclass(frozen=True)
class ApplicationLimits:
    requests: int = 100
    dns_spoof: int = 20
    dns_tunnel: int = 10
    xss: int = 3
    sqli: int = 3
    sslstrip: int = 5
    creds: int = 3


def _window(duration: str) -> Column:
    return F.window("ts", duration)


def _with_start(df: DataFrame) -> DataFrame:
    return df.withColumn("window_start", F.col("window.start")).drop("window")


def transport_buckets(packets: DataFrame, duration: str = "1 second", limits: TransportLimits = TransportLimits(),
                      streaming: bool = False) -> DataFrame:
    """TCP flag counts, distinct destination ports and mean size per source and bucket, with a label.

    Streams count ports with a collected set, since exact distinct counts need a second pass; it holds at most the 65,536
    port numbers.
    """
    ports = F.size(F.collect_set("dport")) if streaming else F.count_distinct("dport")
    stats = packets.where(X.is_ip() & X.is_tcp()).groupBy(_window(duration), "src_ip").agg(
        F.count_if(X.has_bits("tcp_flags", X.SYN)).alias("tcp_syn"),
        F.count_if(X.has_bits("tcp_flags", X.RST)).alias("tcp_rst"),
        F.count_if(X.has_bits("tcp_flags", X.ACK)).alias("tcp_ack"),
        F.count_if(X.has_bits("tcp_flags", X.FIN)).alias("tcp_fin"),
        ports.cast("long").alias("dst_ports"), F.avg("packet_size").alias("avg_len"))
    return _with_start(stats).withColumns({
        "src_ip_int": X.ipv4_to_int("src_ip"), "label": transport_label(limits)})


def transport_label(limits: TransportLimits = TransportLimits()) -> Column:
    scan = (F.col("dst_ports") > limits.ports) & (F.col("tcp_syn") > 0)
    return (F.when(F.col("tcp_syn") > limits.syn, "SYN_FLOOD").when(F.col("tcp_rst") > limits.rst, "RST_FLOOD")
            .when(F.col("tcp_ack") > limits.ack, "CONNECTION_FLOOD").when(scan, "PORT_SCAN").otherwise("NONE"))


def dns_counts(either_port: bool = False) -> tuple[Column, Column]:
    """(answers with a short TTL, long TXT answers) of one DNS response; zero for other packets."""
    port = F.col("dport") == 53
    if either_port:
        port = port | (F.col("sport") == 53)
    response = X.is_udp() & port & (F.col("dns_qr") == 1)
    short = F.size(F.filter("dns_answers", lambda a: F.coalesce(a["ttl"], F.lit(0)) < 60))
    tunnel = F.size(F.filter("dns_answers", lambda a: (a["type"] == 16) & (F.octet_length(a["rdata"]) > 100)))
    present = response & F.col("dns_answers").isNotNull()
    return F.when(present, short).otherwise(0), F.when(present, tunnel).otherwise(0)


def is_http() -> Column:
    return X.is_tcp() & ((F.col("dport") == 80) | (F.col("sport") == 80))


def application_counts(packets: DataFrame, either_port: bool = False) -> DataFrame:
    """The seven per-packet counts that the buckets add up. Patterns are tested on HTTP packets only."""
    spoof, tunnel = dns_counts(either_port)
    http = F.coalesce(is_http(), F.lit(False))

    def on_http(test: Column) -> Column:
        return F.when(http, X.flag(test)).otherwise(0)
    return packets.where(X.is_ip()).select(
        "packet_id", "ts", "src_ip", spoof.alias("dns_spoof"), tunnel.alias("dns_tunnel"),
        on_http(P.has_xss()).alias("http_xss"), on_http(P.has_sqli()).alias("http_sqli"),
        on_http(P.is_downgrade_redirect()).alias("http_sslstrip"), on_http(P.has_credentials()).alias("http_creds"),
        http.cast("int").alias("http_reqs"))


COUNTS = ("dns_spoof", "dns_tunnel", "http_xss", "http_sqli", "http_sslstrip", "http_creds", "http_reqs")


def application_buckets(packets: DataFrame, duration: str = "1 second", limits: ApplicationLimits = ApplicationLimits(),
                        either_port: bool = False) -> DataFrame:
    """DNS and HTTP counts per source and bucket, with a label."""
    sums = application_counts(packets, either_port).groupBy(_window(duration), "src_ip").agg(
        *[F.sum(c).alias(c) for c in COUNTS])
    return _with_start(sums).withColumns({
        "src_ip_int": X.ipv4_to_int("src_ip"), "attack_label": application_label(limits)})


def application_label(limits: ApplicationLimits = ApplicationLimits()) -> Column:
    rules = (("http_reqs", limits.requests, "DOS"), ("dns_spoof", limits.dns_spoof, "DNS_SPOOFING"),
             ("dns_tunnel", limits.dns_tunnel, "DNS_TUNNELING"), ("http_xss", limits.xss, "XSS"),
             ("http_sqli", limits.sqli, "SQLI"), ("http_sslstrip", limits.sslstrip, "SSL_STRIP"),
             ("http_creds", limits.creds, "CREDENTIAL_THEFT"))
    label = F.lit("NONE")
    for column, limit, name in reversed(rules):
        label = F.when(F.col(column) > limit, name).otherwise(label)
    return label
