"""Row filters that put packets in scope of a layer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from skywarden import schema as S
from skywarden.functions import scalars as X


def wlan_frames(packets: DataFrame) -> DataFrame:
    return packets.where(X.is_wlan())


def ip_packets(packets: DataFrame) -> DataFrame:
    return packets.where(X.is_ip())


def tcp_packets(packets: DataFrame) -> DataFrame:
    return packets.where(X.is_ip() & X.is_tcp())


def host_filter(packets: DataFrame, target_ip: str) -> DataFrame:
    return packets.where((F.col("src_ip") == target_ip) | (F.col("dst_ip") == target_ip))


def target_or_non_ip(packets: DataFrame, target_ip: str) -> DataFrame:
    return packets.where(~X.is_ip() | (F.col("src_ip") == target_ip) | (F.col("dst_ip") == target_ip))


def involves(addresses: Sequence[str]) -> Column:
    """Source or destination is one of a configured list of addresses."""
    addresses = list(addresses)
    return F.col("src_ip").isin(addresses) | F.col("dst_ip").isin(addresses)


def in_drone_link(drone_ips: Sequence[str]) -> Column:
    transport = X.is_ip() & F.col("ip_proto").isin(X.TCP, X.UDP)
    other = F.col("src_ip").isNull() | F.col("ip_proto").isNull() | ~F.col("ip_proto").isin(X.TCP, X.UDP)
    wanted = involves(drone_ips) | F.col("dport").isin(list(S.DRONE_LINK_PORTS))
    # TCP/UDP rows are decided by address and port alone; the 802.11 test is for the rest
    return (transport & wanted) | (X.is_wlan() & other)


def drone_link_scope(packets: DataFrame, drone_ips: Sequence[str]) -> DataFrame:
    """Drone or drone-port TCP/UDP traffic, and any 802.11 frame."""
    return packets.where(in_drone_link(drone_ips))


def in_fleet(fleet: Sequence[str]) -> Column:
    return X.is_ip() & involves(fleet)


def fleet_scope(packets: DataFrame, fleet: Sequence[str]) -> DataFrame:
    return packets.where(in_fleet(fleet))


def in_fleet_transport(fleet: Sequence[str]) -> Column:
    wanted = involves(fleet) | F.col("dport").isin(list(S.DRONE_PORTS))
    return X.is_ip() & (X.is_tcp() | X.is_udp()) & wanted


def fleet_transport_scope(packets: DataFrame, fleet: Sequence[str]) -> DataFrame:
    return packets.where(in_fleet_transport(fleet))


def in_fleet_application(fleet: Sequence[str]) -> Column:
    wanted = involves(fleet) | F.col("dport").isin(list(S.APP_PORTS))
    return X.is_ip() & (X.is_tcp() | X.is_udp()) & X.has_payload() & wanted


def fleet_application_scope(packets: DataFrame, fleet: Sequence[str]) -> DataFrame:
    return packets.where(in_fleet_application(fleet))
