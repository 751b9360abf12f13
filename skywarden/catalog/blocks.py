"""The shared ordered operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from skywarden.catalog.base import DAY, P, packets, rate, running, seen
from skywarden.operators import ordered
from skywarden.operators.sequence import sequence_alerts
from skywarden.operators.suppress import greedy_suppress
from skywarden.operators.verdict import finding, verdict


def suppressed_sql(rows: str, key: str, micros: int, inclusive: bool) -> str:
    """Anchors by following, from each key's first row, the next row beyond the gap."""
    beyond = "<" if inclusive else "<="
    return P + f""", r AS MATERIALIZED (SELECT packet_id, epoch_us(ts) AS t, {key} AS key FROM packets WHERE {rows}),
  d AS MATERIALIZED (SELECT key, t, min(packet_id) AS packet_id, t + {micros} AS until FROM r GROUP BY ALL),
  nxt AS MATERIALIZED (SELECT a.packet_id, b.packet_id AS next FROM d a ASOF JOIN d b ON a.key = b.key AND a.until {beyond} b.t),
  anchors AS (WITH RECURSIVE c AS (
      SELECT arg_min(packet_id, t) AS packet_id FROM d GROUP BY key
      UNION ALL SELECT n.next FROM c JOIN nxt n ON n.packet_id = c.packet_id) SELECT * FROM c),
  judged AS (SELECT r.packet_id, a.packet_id IS NULL AS flagged,
    max(CASE WHEN a.packet_id IS NOT NULL THEN t END) OVER (PARTITION BY key ORDER BY t, r.packet_id) AS anchor
    FROM r LEFT JOIN anchors a ON a.packet_id = r.packet_id)"""


MACHINE = """, r AS MATERIALIZED (SELECT packet_id, {key} AS key, tcp_seq AS seq, coalesce(octet_length(payload), 0) AS len,
    (tcp_flags // 2) % 2 = 1 OR (tcp_flags // 16) % 2 = 1 AS resets,
    row_number() OVER (PARTITION BY {key} ORDER BY ts, packet_id) AS i FROM packets WHERE {rows}),
  m AS (WITH RECURSIVE s AS (
    SELECT key, i, packet_id, seq, resets AS est, seq + 1 AS exp, 0 AS cnt, false AS alert, seq + 1 AS was FROM r WHERE i = 1
    UNION ALL
    SELECT key, i, packet_id, seq, est,
      CASE WHEN resets THEN seq + 1 WHEN NOT est OR (seq <> exp AND cnt > {limit}) OR len = 0 THEN exp ELSE seq + len END,
      cnt, NOT resets AND est AND seq <> exp AND cnt > {limit}, exp
    FROM (SELECT r.key, r.i, r.packet_id, r.seq, r.len, r.resets, s.est OR r.resets AS est, s.exp,
            CASE WHEN r.resets OR NOT s.est THEN s.cnt WHEN r.seq <> s.exp THEN s.cnt + 1 ELSE greatest(s.cnt - 1, 0) END AS cnt
          FROM s JOIN r ON r.key = s.key AND r.i = s.i + 1)) SELECT * FROM s),
  hijack AS (SELECT packet_id, cnt::BIGINT AS anomalies, was::BIGINT AS expected, seq::BIGINT AS got FROM m WHERE alert)"""


def machine_sql(rows: str, key: str, limit: int) -> str:
    return P + MACHINE.format(rows=rows, key=key, limit=limit)


def three_findings(s, d):
    k = F.col("k")
    found = [finding("A", k % 2 == 0, k % 5, F.concat(F.lit("a"), k.cast("string"))),
             finding("B", k % 3 == 0, k % 4, F.lit("b")), finding("C", k % 5 == 0, F.lit(2), F.lit("c"))]
    return packets(s, d).select("packet_id", verdict(found).alias("v")).select(
        "packet_id", "v.attack_type", F.col("v.severity").cast("int").alias("severity"), "v.details")


# the first form of each operator has other keys than its second form below; both read all packets
QUERIES = {
    "trailing_rate": (
        lambda s, d: ordered.rate_over(packets(s, d), ["src_ip", "dst_ip", "dport"], DAY).select("packet_id", "rate"),
        P + f"SELECT packet_id, {rate('src_ip, dst_ip, dport', DAY)} AS rate FROM packets"),
    "trailing_rate_short_slices": (
        lambda s, d: ordered.rate_over(packets(s, d), ["sensor_id"], DAY, slice_s=3600).select("packet_id", "rate"),
        P + f"SELECT packet_id, {rate('sensor_id', DAY)} AS rate FROM packets"),
    "rate_exceeds": (
        lambda s, d: ordered.exceeds(packets(s, d).select("packet_id", "ts", "src_mac", "dst_mac"), ["src_mac", "dst_mac"], 3, DAY).select(
            "packet_id", F.col("exceeds").cast("int").alias("exceeds")),
        P + f"SELECT packet_id, ({rate('src_mac, dst_mac', DAY)} > 3)::INT AS exceeds FROM packets"),
    "trailing_distinct": (
        lambda s, d: ordered.distinct_over(packets(s, d), ["sensor_id"], "src_ip", 2 * DAY).select("packet_id", "n_distinct"),
        P + f"""SELECT packet_id, count(DISTINCT src_ip) OVER (PARTITION BY sensor_id ORDER BY ts
        RANGE BETWEEN INTERVAL {2 * DAY} SECONDS PRECEDING AND CURRENT ROW) AS n_distinct FROM packets"""),
    "distinct_so_far": (
        lambda s, d: ordered.seen_distinct(packets(s, d), ["sensor_id", "ip_proto"], "dport").select("packet_id", "n_distinct"),
        P + f"SELECT packet_id, {seen('sensor_id, ip_proto', 'dport')} AS n_distinct FROM packets"),
    "running_counts": (
        lambda s, d: ordered.running_counts(packets(s, d), ["sensor_id", "dst_mac"], {"n": F.lit(1), "bytes": F.col("packet_size")}).drop("ts"),
        P + f"""SELECT packet_id, {running('sensor_id, dst_mac', '1')}::BIGINT AS n, {running('sensor_id, dst_mac', 'packet_size')}::BIGINT AS bytes
        FROM packets"""),
    "overlapping_slices": (
        lambda s, d: ordered.overlap_slices(packets(s, d), 2 * DAY).groupBy("slice").agg(
            F.count_if("native").alias("own"), F.count("*").alias("all_rows")),
        P + f""", s AS (SELECT epoch_us(ts) // {2 * DAY * 1000000} AS slice FROM packets)
        SELECT slice::BIGINT AS slice, sum(own)::BIGINT AS own, count(*) AS all_rows FROM
        (SELECT slice, 1 AS own FROM s UNION ALL SELECT slice + 1, 0 FROM s) GROUP BY 1"""),
    "greedy_suppress_inclusive": (
        lambda s, d: greedy_suppress(packets(s, d).select("packet_id", "ts", "sensor_id", "dst_mac"), ["sensor_id", "dst_mac"], DAY / 4).select(
            "packet_id", F.col("flagged").cast("int").alias("flagged"), F.unix_micros("anchor_ts").alias("anchor")),
        suppressed_sql("true", "sensor_id || '/' || dst_mac", DAY // 4 * 1_000_000, True) + " SELECT packet_id, flagged::INT AS flagged, anchor FROM judged"),
    "greedy_suppress_exclusive": (
        lambda s, d: greedy_suppress(packets(s, d).select("packet_id", "ts", "sensor_id"), ["sensor_id"], 3600, inclusive=False).select(
            "packet_id", F.col("flagged").cast("int").alias("flagged"), F.unix_micros("anchor_ts").alias("anchor")),
        suppressed_sql("true", "sensor_id", 3600 * 1_000_000, False) + " SELECT packet_id, flagged::INT AS flagged, anchor FROM judged"),
    "sequence_machine": (
        lambda s, d: sequence_alerts(packets(s, d), 5, ["src_ip"]),
        machine_sql("ip_proto = 6", "src_ip", 5) + " SELECT * FROM hijack"),
    "most_severe_finding": (
        three_findings,
        P + """, f AS (SELECT packet_id, k, CASE WHEN k % 2 = 0 THEN k % 5 ELSE 0 END AS a, CASE WHEN k % 3 = 0 THEN k % 4 ELSE 0 END AS b,
        CASE WHEN k % 5 = 0 THEN 2 ELSE 0 END AS c FROM packets)
        SELECT packet_id, CASE WHEN greatest(a, b, c) = 0 THEN 'NORMAL' WHEN a >= b AND a >= c THEN 'A' WHEN b >= c THEN 'B' ELSE 'C' END
        AS attack_type, greatest(a, b, c)::INT AS severity, CASE WHEN greatest(a, b, c) = 0 THEN '' WHEN a >= b AND a >= c THEN 'a' || k
        WHEN b >= c THEN 'b' ELSE 'c' END AS details FROM f"""),
}


def over_all(rows) -> dict:
    """Queries of the operators over all packets, those without an address among them."""
    return {
        "trailing_rate_all_packets": (
            lambda s, d: ordered.rate_over(rows(s, d), ["src_ip"], DAY).select("packet_id", "rate"),
            P + f"SELECT packet_id, {rate('src_ip', DAY)} AS rate FROM packets"),
        "trailing_rate_short_slices_all_packets": (
            lambda s, d: ordered.rate_over(rows(s, d), ["src_ip", "dst_ip"], DAY, slice_s=3600).select("packet_id", "rate"),
            P + f"SELECT packet_id, {rate('src_ip, dst_ip', DAY)} AS rate FROM packets"),
        "rate_exceeds_all_packets": (
            lambda s, d: ordered.exceeds(rows(s, d).select("packet_id", "ts", "src_ip"), ["src_ip"], 3, DAY).select(
                "packet_id", F.col("exceeds").cast("int").alias("exceeds")),
            P + f"SELECT packet_id, ({rate('src_ip', DAY)} > 3)::INT AS exceeds FROM packets"),
        "trailing_distinct_all_packets": (
            lambda s, d: ordered.distinct_over(rows(s, d), ["src_ip"], "dport", 2 * DAY).select("packet_id", "n_distinct"),
            P + f"""SELECT packet_id, count(DISTINCT dport) OVER (PARTITION BY src_ip ORDER BY ts
            RANGE BETWEEN INTERVAL {2 * DAY} SECONDS PRECEDING AND CURRENT ROW) AS n_distinct FROM packets"""),
        "distinct_so_far_all_packets": (
            lambda s, d: ordered.seen_distinct(rows(s, d), ["src_ip"], "dport").select("packet_id", "n_distinct"),
            P + f"SELECT packet_id, {seen('src_ip', 'dport')} AS n_distinct FROM packets"),
        "running_counts_all_packets": (
            lambda s, d: ordered.running_counts(rows(s, d), ["src_ip"], {"n": F.lit(1), "bytes": F.col("packet_size")}).drop("ts"),
            P + f"""SELECT packet_id, {running('src_ip', '1')}::BIGINT AS n, {running('src_ip', 'packet_size')}::BIGINT AS bytes
            FROM packets"""),
        "overlapping_slices_all_packets": (
            lambda s, d: ordered.overlap_slices(rows(s, d), DAY).groupBy("slice").agg(
                F.count_if("native").alias("own"), F.count("*").alias("all_rows")),
            P + f""", s AS (SELECT epoch_us(ts) // {DAY * 1000000} AS slice FROM packets)
            SELECT slice::BIGINT AS slice, sum(own)::BIGINT AS own, count(*) AS all_rows FROM
            (SELECT slice, 1 AS own FROM s UNION ALL SELECT slice + 1, 0 FROM s) GROUP BY 1"""),
        "greedy_suppress_inclusive_all_packets": (
            lambda s, d: greedy_suppress(rows(s, d).select("packet_id", "ts", "src_ip"), ["src_ip"], DAY).select(
                "packet_id", F.col("flagged").cast("int").alias("flagged"), F.unix_micros("anchor_ts").alias("anchor")),
            suppressed_sql("true", "coalesce(src_ip, '')", DAY * 1_000_000, True) + " SELECT packet_id, flagged::INT AS flagged, anchor FROM judged"),
    }


QUERIES |= over_all(packets)
