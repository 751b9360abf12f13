"""Joins and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from skywarden import schema as S
from skywarden.catalog.base import FLEET, GATEWAYS, P, packets
from skywarden.functions import scalars as X
from skywarden.operators import exposure, lookups
from skywarden.operators.ordered import first_binding


def assets(s, d):
    """An inventory of open ports per host, read off the traffic."""
    return packets(s, d).where(X.is_tcp() | X.is_udp()).select(F.col("src_ip").alias("ip"), F.col("dport").alias("port"))


def some_assets(s, d):
    """The same per host and source port, for hosts with fewer ports each."""
    return packets(s, d).where(X.is_tcp() | X.is_udp()).select(
        F.concat_ws("/", "src_ip", F.col("k").cast("string")).alias("ip"), F.col("dport").alias("port"))


def case(column, names, default):
    return "CASE " + column + " " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in names.items()) + f" ELSE {default} END"


def raised(rules):
    cases = ", ".join(f"CASE WHEN bool_or(port IN ({', '.join(map(str, ports))})) THEN '{name}' END" for name, ports in rules)
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


ASSETS = P + ", assets AS (SELECT DISTINCT src_ip || '/' || k AS ip, dport AS port FROM packets WHERE ip_proto IN (6, 17))"
HOSTS = P + ", assets AS (SELECT DISTINCT src_ip AS ip, dport AS port FROM packets WHERE ip_proto IN (6, 17))"
WEIGHT = "CASE " + " ".join(f"WHEN port = {p} THEN {w}" for p, w in S.PORT_WEIGHTS.items()) + " ELSE 0 END"
ROLES = {FLEET[0]: "drone", FLEET[1]: "ground_station", FLEET[2]: "controller"}
ROLE = "CASE {0} " + " ".join(f"WHEN '{ip}' THEN '{role}'" for ip, role in ROLES.items()) + " END"

QUERIES = {
    "drone_service_of_port": (
        lambda s, d: lookups.with_service(
            packets(s, d).where(F.col("dport").isNotNull()).select("packet_id", "dport"),
            lookups.rule_table(s, S.DRONE_PORTS, ("port", "service"))),
        P + f"SELECT packet_id, dport, {case('dport', S.DRONE_PORTS, chr(39) + 'Unknown' + chr(39))} AS service FROM packets WHERE dport IS NOT NULL"),
    "application_service_of_port": (
        lambda s, d: packets(s, d).where(F.col("dport").isNotNull()).select(
            "packet_id", lookups.name_of("dport", S.APP_PORTS).alias("service")),
        P + f"SELECT packet_id, {case('dport', S.APP_PORTS, chr(39) + 'Unknown' + chr(39))} AS service FROM packets WHERE dport IS NOT NULL"),
    "mavlink_message_name": (
        lambda s, d: packets(s, d).select("packet_id", X.mavlink_header().alias("h")).where("h IS NOT NULL").select(
            "packet_id", lookups.message_name("h.message_id", S.MAVLINK_DANGEROUS).alias("name")),
        P + f""", m AS (SELECT packet_id, ('0x' || substr(payload_hex, 19, 2) || substr(payload_hex, 17, 2)
        || substr(payload_hex, 15, 2))::INT AS m FROM packets WHERE payload_hex LIKE 'FD%' AND length(payload_hex) >= 22)
        SELECT packet_id, {case('m', S.MAVLINK_DANGEROUS, "'MSG_' || m")} AS name FROM m"""),
    "asset_exposure_score": (
        lambda s, d: exposure.exposure_scores(some_assets(s, d)).select(
            "ip", "score", "confidence", F.array_join("services", "|").alias("services")),
        ASSETS + f""" SELECT ip, sum({WEIGHT})::BIGINT AS score, least(sum({WEIGHT}) * 10, 100)::BIGINT AS confidence,
        array_to_string({raised(S.SERVICE_RULES)}, '|') AS services FROM assets GROUP BY ip HAVING sum({WEIGHT}) >= 4"""),
    "host_exposure_score": (
        lambda s, d: exposure.exposure_scores(assets(s, d)).select(
            "ip", "score", "confidence", F.array_join("services", "|").alias("services")),
        HOSTS + f""" SELECT ip, sum({WEIGHT})::BIGINT AS score, least(sum({WEIGHT}) * 10, 100)::BIGINT AS confidence,
        array_to_string({raised(S.SERVICE_RULES)}, '|') AS services FROM assets GROUP BY ip HAVING sum({WEIGHT}) >= 4"""),
    "exposure_findings": (
        lambda s, d: exposure.exposure_findings(some_assets(s, d)).select(
            "ip", F.array_join("findings", "|").alias("findings"), "n_findings"),
        ASSETS + f""", f AS (SELECT ip, {raised(S.FINDING_RULES)} AS f FROM assets GROUP BY ip)
        SELECT ip, array_to_string(f, '|') AS findings, len(f)::BIGINT AS n_findings FROM f WHERE len(f) > 0"""),
    "most_exposed_hosts": (
        lambda s, d: exposure.most_exposed(exposure.exposure_findings(some_assets(s, d))).select("ip", "n_findings"),
        ASSETS + f""", f AS (SELECT ip, {raised(S.FINDING_RULES)} AS f FROM assets GROUP BY ip)
        SELECT ip, len(f)::BIGINT AS n_findings FROM f WHERE len(f) > 0 ORDER BY n_findings DESC, ip LIMIT 5"""),
    "outside_gateways": (
        lambda s, d: lookups.outside_gateways(
            packets(s, d).where(X.is_ip()).select("packet_id", "src_ip"),
            s.createDataFrame([(g,) for g in GATEWAYS], ["ip"])),
        P + f"""SELECT packet_id, src_ip FROM packets WHERE src_ip IS NOT NULL AND src_ip NOT IN {GATEWAYS}
        AND src_ip NOT LIKE '192.168.4.%'"""),
    "first_ttl_and_mac": (
        lambda s, d: first_binding(packets(s, d).where(X.is_ip()), ["src_ip"], ["ttl", "src_mac"]).select(
            "packet_id", "src_ip", "ttl", "src_mac", "first_ttl", "first_src_mac"),
        P + """SELECT packet_id, src_ip, ttl, src_mac, first_value(ttl) OVER w AS first_ttl,
        first_value(src_mac) OVER w AS first_src_mac FROM packets WHERE src_ip IS NOT NULL
        WINDOW w AS (PARTITION BY src_ip ORDER BY ts, packet_id)"""),
    "fleet_enrichment": (
        lambda s, d: lookups.with_fleet(
            packets(s, d).where(X.is_ip()).select("packet_id", "src_ip", "dst_ip"),
            s.createDataFrame(list(ROLES.items()), ["ip", "role"])).withColumn(
                "involves_fleet", F.col("involves_fleet").cast("int")),
        P + f""", r AS (SELECT packet_id, src_ip, dst_ip, {ROLE.format('src_ip')} AS src_role, {ROLE.format('dst_ip')} AS dst_role
        FROM packets WHERE src_ip IS NOT NULL)
        SELECT *, (src_role IS NOT NULL OR dst_role IS NOT NULL)::INT AS involves_fleet FROM r"""),
}
