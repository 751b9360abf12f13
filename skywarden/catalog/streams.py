"""Streams replayed over the packet files, compared with the batch operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from skywarden import schema as S
from skywarden.catalog.aggregates import A_LIMITS, APPLICATION, COUNTS, DURATION, HOURS, T_LIMITS, TRANSPORT, numbered
from skywarden.catalog.base import DAY, FLEET, GATEWAYS, P, packets, rate
from skywarden.catalog.blocks import machine_sql, suppressed_sql
from skywarden.plans.analyser import suspicion
from skywarden.catalog import detectors as D, verdicts as V
from skywarden.operators.tracks import FIRST, RATE, RECENT, Track
from skywarden.plans import internet, layers, network
from skywarden.session import ROCKSDB, fresh_folder
from skywarden.sources import readers, sinks
from skywarden.operators import buckets as O
from skywarden.streaming import buckets, late, stateful
from skywarden.streaming.following import stream_followed, stream_hits
from skywarden.streaming.replay import run_to_end

# A window is out once the watermark (latest time less the delay, here one hour) has passed its end.
CLOSED = f"(bucket + 1) * {HOURS * 3600 * 1_000_000} <= (SELECT (max(epoch_us(ts)) // 1000) * 1000 FROM packets) - 3600000000"


def stream(s, d):
    """The packet files as a stream."""
    s.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    table = packets(s, d)
    return s.readStream.schema(table.schema).parquet(table.inputFiles()[0].rsplit("/", 1)[0])


def alerts(s, d):
    """Alert sink of a stream, with its batches read back."""
    rows = stream(s, d).select("packet_id", "packet_size", "src_ip", "ttl", "ip_flags", "ip_proto", "tcp_flags", "sport", "dport")
    found = rows.withColumn("attack_type", suspicion()).where(F.col("attack_type").isNotNull()).select("packet_id", "attack_type")
    out = fresh_folder(s, "stream-alerts")
    sinks.stream_alerts(found, out, fresh_folder(s, "stream-alerts-state")).awaitTermination()
    return s.read.schema("packet_id BIGINT, attack_type STRING, batch BIGINT").parquet(out).drop("batch")


def layer_alerts(s, d):
    """Alerts of all layers from a stream, resolved batch by batch and read back."""
    hits = layers.hits_of_stream(stream(s, d), FLEET, GATEWAYS, V.SETTINGS)
    out = fresh_folder(s, "stream-layers")
    sinks.stream_verdicts(hits, out, fresh_folder(s, "stream-layers-state"), layers.verdicts).awaitTermination()
    rows = s.read.schema("layer STRING, packet_id BIGINT, attack_type STRING, severity DOUBLE, details STRING, batch BIGINT").parquet(out)
    return rows.drop("batch").withColumn("severity", F.round("severity", 6))


def spoofing(s, d, module):
    """Hits of a layer's first-binding detector from a stream."""
    wanted = [t for t in module.tracks() if t.kind == FIRST]
    return run_to_end(stream_hits(stream(s, d), wanted), "bindings").select(
        "packet_id", "detector", F.round("severity", 6).alias("severity"), "details")


def recent(s, d):
    track = Track("RECENT", RECENT, F.lit(True), ("sensor_id",), F.lit(True), F.lit(0), window_s=2 * DAY, values=(F.col("src_ip"),))
    return run_to_end(stream_followed(stream(s, d), [track], delay="90 days"), "recent").select("packet_id", "n")


def sliding(s, d):
    track = Track("RATE", RATE, F.lit(True), ("src_ip",), F.lit(True), F.lit(0), window_s=DAY)
    return run_to_end(stream_followed(stream(s, d), [track], delay="90 days"), "sliding").select("packet_id", "n")


def reopened(s, d):
    """Two files: most packets, then every tenth of them much too late."""
    folder = fresh_folder(s, "late-packets")
    rows = packets(s, d).select(*s.createDataFrame([], S.PACKETS).columns)
    for part in ("packet_id % 10 <> 7", "packet_id % 10 = 7"):
        rows.where(part).coalesce(1).write.mode("append").parquet(folder)
    arriving = readers.stream_packets(s, folder, files_per_trigger=1)
    return numbered(run_to_end(late.reopening_buckets(arriving, HOURS * 3600, "1 hour", A_LIMITS, keep_s=365 * DAY), "late"))


SIX_HOURS = HOURS * 3600 * 1_000_000
REOPENED = COUNTS + f""", w AS (SELECT max(epoch_us(ts)) // 1000 * 1000 - 3600000000 AS last,
    max(CASE WHEN packet_id % 10 <> 7 THEN epoch_us(ts) END) // 1000 * 1000 - 3600000000 AS first FROM packets),
  l AS (SELECT c.*, (epoch_us(ts) // {SIX_HOURS})::BIGINT AS bucket, packet_id % 10 = 7 AND (epoch_us(ts) // {SIX_HOURS} + 1) * {SIX_HOURS} <= w.first AS late
    FROM c, w),
  b AS (SELECT bucket, src_ip, late, {', '.join(f'sum({c})::BIGINT AS {c}' for c in O.COUNTS)} FROM l GROUP BY ALL),
  e AS (SELECT *, row_number() OVER (PARTITION BY bucket, src_ip ORDER BY late) AS edition FROM b)
  SELECT * EXCLUDE (late, last, first), {APPLICATION[APPLICATION.rindex('SELECT *, ') + 10:APPLICATION.rindex(' FROM b')]}
  FROM e, w WHERE late OR (bucket + 1) * {SIX_HOURS} <= w.last"""


def with_closed(sql: str) -> str:
    return f"SELECT * FROM ({sql}) WHERE " + CLOSED.replace("FROM packets", "FROM events").replace("epoch_us(ts)", "epoch_us(events.ts)")


STREAMED = {**V.LAYERS, "drone_network": tuple(n for n in V.LINK_SQL if n != "gps_spoof"), "drone_transport": V.L4_SQL[:3]}

QUERIES = {
    "stream_sliding_rates": (sliding, P + f"SELECT packet_id, {rate('src_ip', DAY)} AS n FROM packets"),
    "stream_recent_distinct": (recent, P + f"""SELECT packet_id, count(DISTINCT src_ip) OVER (PARTITION BY sensor_id ORDER BY ts
        RANGE BETWEEN INTERVAL {2 * DAY} SECONDS PRECEDING AND CURRENT ROW) AS n FROM packets"""),
    "stream_arp_spoofing": (lambda s, d: spoofing(s, d, network), D.SQL["arp_spoofing"]),
    "stream_ip_spoofing": (lambda s, d: spoofing(s, d, internet), D.SQL["ip_spoofing"]),
    "stream_layer_alerts": (layer_alerts, f"SELECT layer, packet_id, attack_type, round(severity::DOUBLE, 6) AS severity, details FROM {V.every_alert(STREAMED)}"),
    "stream_reopened_buckets": (reopened, REOPENED),
    "stream_transport_buckets": (
        lambda s, d: numbered(run_to_end(buckets.transport_stream(stream(s, d), DURATION, "1 hour", T_LIMITS), "transport")).withColumn(
            "avg_len", F.round("avg_len", 6)), with_closed(TRANSPORT)),
    "stream_application_buckets": (
        lambda s, d: numbered(run_to_end(buckets.application_stream(stream(s, d), DURATION, "1 hour", A_LIMITS), "application")),
        with_closed(APPLICATION)),
    "stream_packet_counts": (
        lambda s, d: numbered(run_to_end(buckets.packet_counts(stream(s, d), DURATION, "1 hour"), "counts")),
        with_closed(P + f"""SELECT (epoch_us(ts) // {HOURS * 3600 * 1_000_000})::BIGINT AS bucket, sensor_id, count(*) AS packets,
        sum(packet_size)::BIGINT AS bytes FROM packets GROUP BY 1, 2""")),
    "stream_trailing_rate": (
        lambda s, d: run_to_end(stateful.stream_rates(stream(s, d), ["src_ip", "dst_ip", "dport"], DAY), "rates").drop("key"),
        P + f"SELECT packet_id, {rate('src_ip, dst_ip, dport', DAY)} AS rate FROM packets"),
    "stream_first_sightings": (
        lambda s, d: run_to_end(stateful.first_sightings(stream(s, d), ["sensor_id"], "src_mac"), "sightings"),
        P + "SELECT DISTINCT sensor_id, src_mac FROM packets"),
    "stream_greedy_suppress": (
        lambda s, d: run_to_end(stateful.stream_suppress(stream(s, d), ["sensor_id", "dst_mac"], DAY / 4), "suppress").select(
            "packet_id", F.col("flagged").cast("int").alias("flagged"), "anchor"),
        suppressed_sql("true", "sensor_id || '/' || dst_mac", DAY // 4 * 1_000_000, True) + " SELECT packet_id, flagged::INT AS flagged, anchor FROM judged"),
    "stream_sequence_machine": (
        lambda s, d: run_to_end(stateful.stream_sequence_alerts(stream(s, d), 5, ("src_ip",)), "sequence").drop("key"),
        machine_sql("ip_proto = 6", "src_ip", 5) + " SELECT * FROM hijack"),
    "stream_approximate_rates": (
        lambda s, d: run_to_end(stateful.approximate_rates(stream(s, d), "sensor_id", "24 hours", "6 hours", "1 hour"), "approximate")
        .withColumn("bucket", F.floor(F.unix_micros("window_start") / F.lit(HOURS * 3600 * 1_000_000))).drop("window_start"),
        P + f""", b AS (SELECT sensor_id, unnest(generate_series((epoch_us(ts) // {HOURS * 3600 * 1_000_000}) - 3,
          epoch_us(ts) // {HOURS * 3600 * 1_000_000}))::BIGINT AS bucket FROM packets)
        SELECT sensor_id, bucket, count(*) AS n FROM b WHERE (bucket + 4) * {HOURS * 3600 * 1_000_000}
          <= (SELECT (max(epoch_us(ts)) // 1000) * 1000 FROM packets) - 3600000000 GROUP BY 1, 2"""),
    "stream_alerts": (
        alerts,
        P + """SELECT * FROM (SELECT packet_id, CASE WHEN packet_size < 20 OR packet_size > 9000 THEN 'unusual_packet_size'
        WHEN src_ip IS NOT NULL AND (ttl < 10 OR ttl > 255) THEN 'unusual_ttl' WHEN src_ip IS NOT NULL AND ip_flags % 2 = 1
        THEN 'fragmented_packet' WHEN ip_proto = 6 AND tcp_flags = 2 THEN 'potential_syn_flood'
        WHEN ip_proto = 6 AND sport = dport THEN 'same_port_attack' END AS attack_type FROM packets) WHERE attack_type IS NOT NULL"""),
}

# the generic operators over all packets, those without an address among them
QUERIES |= {
    "stream_trailing_rate_all_packets": (
        lambda s, d: run_to_end(stateful.stream_rates(stream(s, d), ["src_ip"], DAY), "rates").drop("key"),
        P + f"SELECT packet_id, {rate('src_ip', DAY)} AS rate FROM packets"),
    "stream_first_sightings_all_packets": (
        lambda s, d: run_to_end(stateful.first_sightings(stream(s, d), ["src_ip"], "dport"), "sightings"),
        P + "SELECT DISTINCT src_ip, dport FROM packets"),
    "stream_greedy_suppress_all_packets": (
        lambda s, d: run_to_end(stateful.stream_suppress(stream(s, d), ["src_ip"], DAY), "suppress").select(
            "packet_id", F.col("flagged").cast("int").alias("flagged"), "anchor"),
        suppressed_sql("true", "coalesce(src_ip, '')", DAY * 1_000_000, True) + " SELECT packet_id, flagged::INT AS flagged, anchor FROM judged"),
    "stream_approximate_rates_all_packets": (
        lambda s, d: run_to_end(stateful.approximate_rates(stream(s, d), "src_ip", "24 hours", "6 hours", "1 hour"), "approximate")
        .withColumn("bucket", F.floor(F.unix_micros("window_start") / F.lit(HOURS * 3600 * 1_000_000))).drop("window_start"),
        P + f""", b AS (SELECT src_ip, unnest(generate_series((epoch_us(ts) // {HOURS * 3600 * 1_000_000}) - 3,
          epoch_us(ts) // {HOURS * 3600 * 1_000_000}))::BIGINT AS bucket FROM packets)
        SELECT src_ip, bucket, count(*) AS n FROM b WHERE (bucket + 4) * {HOURS * 3600 * 1_000_000}
          <= (SELECT (max(epoch_us(ts)) // 1000) * 1000 FROM packets) - 3600000000 GROUP BY 1, 2"""),
}
