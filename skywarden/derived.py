"""A ``packets`` table derived from the ``events`` table.

The test tables hold no captured traffic, so queries run over packets computed row by row from ``events``: the event
type picks the frame kind and the number ``k`` in ``props`` picks ports, flags and payloads. The same text runs on
Spark and on other SQL engines but for the cast of text to bytes.

The packets are written once per session and input folder, so that queries read columns of a table, with filters pushed
to the scan, as they would read captured traffic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from skywarden.session import written

PACKETS_SQL = """
WITH base AS (
  SELECT event_id AS e, {ts} AS ts, user_id AS u, event_type AS kind, value AS v,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k
  FROM events),
typed AS (
  SELECT *, CASE kind WHEN 'click' THEN 6 WHEN 'purchase' THEN 6 WHEN 'view' THEN 17
                 WHEN 'signup' THEN CASE WHEN k >= 50 THEN 1 END END AS proto,
         CASE WHEN u % 3 = 0 THEN '172.16.0.' ELSE '192.168.4.' END || CAST(u % 30 AS STRING) AS ip,
         CASE WHEN k % 9 = 0 THEN '0A' ELSE '0a' END || ':00:00:00:00:' ||
           CAST(10 + (u % 30 + CASE WHEN k < 8 THEN k ELSE 0 END) % 90 AS STRING) AS mac,
         CASE k % 8 WHEN 0 THEN 8080 WHEN 1 THEN 554 WHEN 2 THEN 1883 WHEN 3 THEN 80 WHEN 4 THEN 22
                    WHEN 5 THEN 443 WHEN 6 THEN 23 ELSE 1000 + k END AS tcp_dport,
         CASE k % 4 WHEN 0 THEN 5760 WHEN 1 THEN 14550 WHEN 2 THEN 554
                    ELSE CASE WHEN k % 8 = 3 THEN 53 ELSE 1000 + k END END AS udp_dport,
         CASE k % 5 WHEN 0 THEN 'GET /a?q=<script>' WHEN 1 THEN 'POST /x union all select'
                    WHEN 2 THEN 'PUT /u password=p' WHEN 3 THEN 'DELETE /../../../etc/passwd'
                    ELSE 'SETUP rtsp://c RTSP/1.0 Range: bytes=0-' END ||
         CASE k % 7 WHEN 0 THEN '' WHEN 1 THEN ' /config/ /admin/' WHEN 2 THEN ' SSH-2.0-x diffie-hellman publickey'
                    WHEN 3 THEN ' login: password:'
                    WHEN 4 THEN ' HTTP/1.1 302 Found' || chr(10) || 'Location: http://h/'
                    WHEN 5 THEN ' User-Agent: exploit' ELSE ' SELECT * FROM t javascript: cmd.exe' END AS tcp_text,
         CASE WHEN k % 13 = 0 THEN 'FE' ELSE 'FD' END || '1000000' || CAST(k % 10 AS STRING) ||
           '0' || CAST(1 + u % 9 AS STRING) || '01' ||
           CASE k % 6 WHEN 0 THEN '4C0000' WHEN 1 THEN '0B0000' WHEN 2 THEN '900100' WHEN 3 THEN '150000'
                      WHEN 4 THEN '540000' ELSE '210000' END || repeat('AB', k % 40) AS mavlink_hex
  FROM base),
packets AS (
  SELECT e AS packet_id, ts, 's' || CAST(u % 4 AS STRING) AS sensor_id,
    CAST(CASE WHEN v < 1 THEN 10 WHEN v > 300 THEN 9500 ELSE 20 + floor(v * 10) END AS INT) AS packet_size,
    CASE WHEN kind = 'error' AND k % 20 = 5 THEN NULL ELSE mac END AS src_mac,
    CASE WHEN k % 10 = 0 THEN 'FF:FF:FF:FF:FF:FF' ELSE '02:00:00:00:01:01' END AS dst_mac,
    CASE WHEN kind = 'error' AND k % 19 <> 0 THEN '0b:00:00:00:00:' || CAST(10 + u % 45 AS STRING) END AS bssid,
    CASE WHEN kind = 'error' THEN 0 WHEN kind = 'purchase' THEN 2 WHEN kind = 'signup' AND k < 50 THEN 2 END AS wlan_type,
    CASE WHEN kind = 'error' THEN CASE WHEN k < 60 THEN 12 WHEN k < 90 THEN 8 ELSE 4 END
         WHEN kind = 'purchase' THEN 0 WHEN kind = 'signup' AND k < 50 THEN 0 END AS wlan_subtype,
    CASE WHEN kind = 'error' AND k % 6 <> 0 THEN -30 - k % 50 END AS rssi,
    CASE WHEN kind = 'error' THEN CASE WHEN k % 17 = 0 THEN '' ELSE 'ssid' || CAST(u % 30 AS STRING) END END AS ssid,
    CASE WHEN kind = 'signup' AND k < 50 THEN '10.1.0.' || CAST(u % 20 AS STRING) END AS arp_psrc,
    CASE WHEN kind = 'signup' AND k < 50 THEN CASE WHEN k % 2 = 0 THEN 'AA:BB' ELSE 'aa:bb' END || ':00:00:00:' ||
      CAST(10 + u % 20 + CASE WHEN k < 4 THEN k ELSE 0 END AS STRING) END AS arp_hwsrc,
    CASE WHEN proto IS NOT NULL THEN ip END AS src_ip,
    CASE WHEN proto IS NOT NULL THEN '10.0.0.' || CAST(1 + k % 3 AS STRING) END AS dst_ip,
    CASE WHEN proto IS NOT NULL THEN 40 + k END AS ip_len,
    CASE WHEN proto IS NOT NULL THEN CAST(e % 65536 AS INT) END AS ip_id,
    CASE WHEN proto IS NOT NULL THEN CASE WHEN k < 4 THEN 5 WHEN k > 95 THEN 200 ELSE 64 END END AS ttl,
    proto AS ip_proto,
    CASE WHEN proto IS NOT NULL THEN CASE WHEN k % 11 = 0 THEN 1 WHEN k % 11 = 1 THEN 2 ELSE 0 END END AS ip_flags,
    CASE WHEN proto IS NOT NULL THEN CASE WHEN k % 12 = 0 THEN k ELSE 0 END END AS ip_frag,
    CASE WHEN proto = 6 AND k % 16 = 15 THEN 80 WHEN proto = 6 AND k % 24 = 0 THEN tcp_dport
         WHEN proto IN (6, 17) THEN 40000 + k % 2 END AS sport,
    CASE proto WHEN 6 THEN tcp_dport WHEN 17 THEN udp_dport END AS dport,
    CASE WHEN kind = 'click' THEN CASE WHEN k % 3 = 0 THEN 8 ELSE 2 END
         WHEN kind = 'purchase' THEN CASE k % 4 WHEN 0 THEN 18 WHEN 1 THEN 16 WHEN 2 THEN 4 ELSE 24 END END AS tcp_flags,
    CASE WHEN proto = 6 THEN 1000 + k % 4 END AS tcp_seq,
    CASE WHEN proto = 6 THEN 500 + k END AS tcp_ack,
    CASE WHEN proto = 6 THEN 1024 * (k % 8) END AS tcp_window,
    CASE WHEN proto = 1 THEN CASE WHEN k % 2 = 0 THEN 8 ELSE 0 END END AS icmp_type,
    CASE WHEN proto = 17 AND udp_dport = 53 THEN CASE WHEN k % 3 = 0 THEN 0 ELSE 1 END END AS dns_qr,
    CASE WHEN proto = 6 AND k % 20 <> 7 THEN {text_of_tcp}
         WHEN proto = 17 AND k % 4 < 2 THEN unhex(mavlink_hex) END AS payload,
    CASE WHEN proto = 6 AND k % 20 <> 7 THEN tcp_text END AS payload_words,
    CASE WHEN proto = 17 AND k % 4 < 2 THEN mavlink_hex END AS payload_hex,
    kind, k
  FROM typed)
"""


def packets_sql(engine: str = "spark") -> str:
    """The common table expressions that define ``packets``."""
    if engine == "spark":
        parts = {"ts": "CAST(ts AS TIMESTAMP)", "text_of_tcp": "CAST(tcp_text AS BINARY)"}
    else:
        parts = {"ts": "ts", "text_of_tcp": "encode(tcp_text)"}
    return PACKETS_SQL.format(**parts)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_tables: dict[tuple[str, str], DataFrame] = {}


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived packets as a table."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    place = (spark.sparkContext.applicationId, sf_dir)
    if place not in _tables:
        # files by time, as captured traffic comes, so that a scan has a task for each core
        files = spark.sparkContext.defaultParallelism
        _tables[place] = written(derive(spark, sf_dir, files), "packets")
    return _tables[place]


def derive(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """The derived packets with all columns of the packet schema, as a plan over ``events``. ``parts`` deals the events by ranges of time
    first: they are narrow, and their bounds are found without deriving a packet."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    events = table(spark, sf_dir, "events")
    if parts is not None:
        events = events.repartitionByRange(parts, F.col("ts").cast("timestamp"))
    events.createOrReplaceTempView("events")
    rows = spark.sql(packets_sql() + "SELECT * FROM packets")
    beacon = F.col("wlan_subtype") == 8
    channel = F.unhex(F.lpad(F.hex(1 + F.col("k") % 13), 2, "0"))
    no_info = F.lit("").cast("binary")
    return rows.withColumns({
        "elements": F.when((F.col("kind") == "error") & beacon, F.array(
            F.struct(F.lit(0).alias("id"), F.col("ssid").cast("binary").alias("info")),
            F.struct(F.lit(3).alias("id"), F.when(F.col("k") % 7 == 0, no_info).otherwise(channel).alias("info")))),
        "channel": F.lit(None).cast("int"),
        "dns_answers": F.when(F.col("dns_qr").isNotNull(), F.array(
            F.struct(F.lit(1).alias("type"), F.col("k").cast("long").alias("ttl"), F.unhex(F.lit("0A000001")).alias("rdata")),
            F.struct(F.lit(16).alias("type"), F.lit(300).cast("long").alias("ttl"),
                     F.repeat(F.lit("t"), F.col("k") + 50).cast("binary").alias("rdata")))),
    }).drop("payload_words", "payload_hex")
