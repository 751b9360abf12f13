"""General transport layer: the TCP flag log."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skywarden.functions import scalars as X, scope


def transport_log(packets: DataFrame, target_ip: str | None = None) -> DataFrame:
    """One row per TCP packet with its flags as 0/1 and a label."""
    if target_ip:
        packets = scope.host_filter(packets, target_ip)
    return scope.tcp_packets(packets).select(
        "packet_id", "ts", "src_ip", "dst_ip", "sport", "dport", X.flag(X.has_bits("tcp_flags", X.SYN)).alias("tcp_syn"),
        X.flag(X.has_bits("tcp_flags", X.RST)).alias("tcp_rst"), X.flag(X.has_bits("tcp_flags", X.ACK)).alias("tcp_ack"),
        F.col("packet_size"), X.flag_label().alias("flag_label"))
