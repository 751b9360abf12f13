"""Shared settings and SQL fragments. The test events are sparse, so windows are wider than the defaults."""

from __future__ import annotations

from skywarden.derived import packets, packets_sql, table  # noqa: F401  (re-exported to the query modules)

DAY = 86400
FLEET = ("10.0.0.1", "10.0.0.2", "192.168.4.7")
GATEWAYS = ("172.16.0.3", "172.16.0.6")
TARGET_IP = "10.0.0.1"
TARGET_MAC = "0a:00:00:00:00:17"

P = packets_sql("duckdb")
FLEET_LIST = "(" + ", ".join(f"'{ip}'" for ip in FLEET) + ")"
IN_FLEET = f"(src_ip IN {FLEET_LIST} OR dst_ip IN {FLEET_LIST})"
DRONE_LIST = "('10.0.0.1')"

# row conditions in SQL
DEAUTH = "(wlan_type = 0 AND wlan_subtype = 12)"
BEACON = "(wlan_type = 0 AND wlan_subtype = 8)"
LINK = (f"((ip_proto IN (6, 17) AND (src_ip IN {DRONE_LIST} OR dst_ip IN {DRONE_LIST} OR dport IN (5760, 554, 1883, 8080)))"
        " OR (wlan_type IS NOT NULL AND (ip_proto IS NULL OR ip_proto NOT IN (6, 17))))")
TRANSPORT = f"(ip_proto IN (6, 17) AND ({IN_FLEET} OR dport IN (5760, 14550, 554, 1883, 8080, 22, 23)))"
APPLICATION = (f"(ip_proto IN (6, 17) AND payload IS NOT NULL AND octet_length(payload) > 0 AND ({IN_FLEET} OR dport IN "
               "(5760, 14550, 80, 8080, 443, 1883, 8883, 554, 22, 23)))")
SIZE = "coalesce(octet_length(payload), 0)"


def rate(key: str, seconds: float) -> str:
    """Rows of the key in the trailing window, rows at one time in packet order."""
    return (f"(count(*) OVER (PARTITION BY {key} ORDER BY ts RANGE BETWEEN INTERVAL {seconds} SECONDS PRECEDING AND CURRENT ROW)"
            f" - (count(*) OVER (PARTITION BY {key}, ts) - row_number() OVER (PARTITION BY {key}, ts ORDER BY packet_id)))")


def seen(key: str, value: str) -> str:
    return f"count(DISTINCT {value}) OVER (PARTITION BY {key} ORDER BY ts, packet_id ROWS UNBOUNDED PRECEDING)"


def running(key: str, amount: str) -> str:
    return f"sum({amount}) OVER (PARTITION BY {key} ORDER BY ts, packet_id ROWS UNBOUNDED PRECEDING)"


def per_second(seconds: float) -> str:
    return f"/{seconds:g}s"


def contained(text: str, needles: tuple[str, ...]) -> str:
    """List of the needles in the text, in order."""
    cases = ", ".join("CASE WHEN contains({0}, '{1}') THEN '{1}' END".format(text, n.replace("'", "''")) for n in needles)
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"
