"""What each layer's model learns from its log."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from skywarden.functions import scalars as X


@dataclass(frozen=True)
class LayerSpec:
    """``label`` is learnt from all columns but ``drop``; ``leaky`` columns determine the label."""

    name: str
    label: str
    drop: tuple[str, ...]
    any_of: tuple[str, ...] = ()  # columns merged into a 0/1 label
    text: tuple[str, ...] = ()    # text features, encoded as numbers
    leaky: tuple[str, ...] = ()
    binary: bool = False


SPECS = {s.name: s for s in (
    LayerSpec("network", "attack_type", ("timestamp", "src_mac", "dst_mac"),
              leaky=("confidence", "arp_spoofing", "deauth_attack", "evil_twin", "mac_flooding")),
    LayerSpec("internet", "is_attack", ("timestamp", "src_mac", "src_ip", "dst_ip"),
              any_of=("ip_spoofing", "ping_flood", "udp_flood"), text=("protocol",), binary=True),
    LayerSpec("transport", "flag_label", ("timestamp", "src_ip", "dst_ip"), leaky=("tcp_syn", "tcp_rst", "tcp_ack")),
    LayerSpec("application", "attack_label", ("timestamp", "src_ip"),
              leaky=("dns_spoof", "dns_tunnel", "http_xss", "http_sqli", "http_sslstrip", "http_creds", "http_reqs")),
)}
NORMAL_LABELS = ("normal", "none", "0")


def training_rows(log: DataFrame, spec: LayerSpec, exclude_leaky: bool = False) -> DataFrame:
    """Features and the label as lower-case text, identifiers dropped."""
    if spec.any_of:
        log = log.withColumn(spec.label, X.any_positive(*spec.any_of)).drop(*spec.any_of)
    log = log.drop(*spec.drop)
    if exclude_leaky:
        log = log.drop(*spec.leaky)
    return log.withColumn(spec.label, F.lower(F.col(spec.label).cast("string")))


def is_test_row(row_id: str, percent: int = 20, seed: int = 42) -> Column:
    """Stable split by a hash of the row id: the same rows whatever the partitioning."""
    digest = F.md5(F.concat(F.col(row_id).cast("string"), F.lit(f"/{seed}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 100 < percent
