"""Round trips through the sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from skywarden import schema as S
from skywarden.catalog.aggregates import SUSPICION, rule_alerts, rule_log
from skywarden.catalog.base import P, TARGET_IP, packets
from skywarden.operators import report
from skywarden.plans import transport
from skywarden.session import fresh_folder
from skywarden.sources import readers, sinks


def written_and_read(s, d, fmt):
    """Packets written in a format and read with the packet schema."""
    folder = fresh_folder(s, f"packets-{fmt}")
    names = s.createDataFrame([], S.PACKETS).columns
    options = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"} if fmt == "json" else {}  # JSON keeps milliseconds only if not told
    packets(s, d).select(*names).write.options(**options).format(fmt).save(folder)
    return readers.read_packets(s, folder, fmt, **options)


def all_packet_files(s, d, fmt):
    """All packets read back, with each DNS answer as text."""
    answer = lambda a: F.concat_ws("|", a["type"].cast("string"), a["ttl"].cast("string"), F.hex(a["rdata"]))
    return written_and_read(s, d, fmt).select("packet_id", "src_ip", F.md5("payload").alias("hash"),
                                              F.array_join(F.transform("dns_answers", answer), ";").alias("answers"))


def packet_files(s, d, fmt):
    """Numbers, texts and times of all packets read back, with how many DNS answers each has."""
    return written_and_read(s, d, fmt).select(
        "packet_id", F.unix_micros("ts").alias("ts"), "sensor_id", "packet_size", "src_mac", "dst_ip", "dport", "tcp_seq", F.size("elements").alias("elements"),
        F.md5("payload").alias("hash"), F.coalesce(F.size("dns_answers"), F.lit(0)).alias("answers"))


PACKET_FILES = P + """SELECT packet_id, epoch_us(ts) AS ts, sensor_id, packet_size, src_mac, dst_ip, dport, tcp_seq,
  CASE WHEN kind = 'error' AND wlan_subtype = 8 THEN 2 END AS elements, md5(payload) AS hash,
  CASE WHEN dns_qr IS NOT NULL THEN 2 ELSE 0 END AS answers FROM packets"""

ALL_PACKET_FILES = P + """SELECT packet_id, src_ip, md5(payload) AS hash,
  CASE WHEN dns_qr IS NOT NULL THEN '1|' || k || '|0A000001;16|300|' || repeat('74', k + 50) END AS answers FROM packets"""


def transport_log_file(fmt, times):
    def query(s, d):
        folder = fresh_folder(s, f"log-{fmt}")
        rows = transport.transport_log(packets(s, d))
        for _ in range(times):
            sinks.append_log(rows, folder, "transport", fmt)
        return readers.read_log(s, folder, "transport", fmt).groupBy("flag_label", "tcp_syn").agg(
            F.count("*").alias("n"), F.sum("packet_size").alias("bytes"), F.min("timestamp").alias("first_seen"))
    return query


def replaced_log(s, d):
    folder = fresh_folder(s, "log-replaced")
    rows = transport.transport_log(packets(s, d))
    for part in (rows, rows.where("dport = 80")):
        sinks.replace_log(part, folder, "transport")
    return readers.read_log(s, folder, "transport", "parquet").groupBy("dport").agg(F.count("*").alias("n"))


def alert_table(s, d):
    folder = fresh_folder(s, "alerts")
    sinks.write_alerts(rule_log(s, d).select("packet_id", "attack_type", "src_ip"), folder)
    return s.read.schema("packet_id BIGINT, attack_type STRING, src_ip STRING").parquet(folder)


def report_file(s, d):
    folder = fresh_folder(s, "report")
    sinks.write_report(report.summary_report(packets(s, d).select("ts"), rule_alerts(s, d), TARGET_IP), folder)
    read = s.read.schema("total_packets BIGINT, total_attacks BIGINT, target_ip STRING, attacks ARRAY<STRUCT<type: STRING>>").json(folder)
    return read.select("total_packets", "total_attacks", "target_ip", F.size("attacks").alias("n_attacks"))


LABEL = """CASE WHEN (tcp_flags // 2) % 2 = 1 THEN 'SYN' WHEN (tcp_flags // 4) % 2 = 1 THEN 'RST'
  WHEN (tcp_flags // 16) % 2 = 1 THEN 'ACK' ELSE 'NONE' END"""


def log_counts(times: int) -> str:
    return P + f"""SELECT {LABEL} AS flag_label, (tcp_flags // 2) % 2 AS tcp_syn, {times} * count(*) AS n,
      ({times} * sum(packet_size))::BIGINT AS bytes, min(CASE WHEN epoch_us(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00')
      ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f+00:00') END) AS first_seen FROM packets WHERE ip_proto = 6 GROUP BY 1, 2"""


QUERIES = {
    "packets_from_parquet": (lambda s, d: packet_files(s, d, "parquet"), PACKET_FILES),
    "packets_from_json": (lambda s, d: packet_files(s, d, "json"), PACKET_FILES),
    "packets_from_orc": (lambda s, d: packet_files(s, d, "orc"), PACKET_FILES),
    "all_packets_from_parquet": (lambda s, d: all_packet_files(s, d, "parquet"), ALL_PACKET_FILES),
    "all_packets_from_json": (lambda s, d: all_packet_files(s, d, "json"), ALL_PACKET_FILES),
    "all_packets_from_orc": (lambda s, d: all_packet_files(s, d, "orc"), ALL_PACKET_FILES),
    "appended_parquet_log": (transport_log_file("parquet", 2), log_counts(2)),
    "appended_csv_log": (transport_log_file("csv", 2), log_counts(2)),
    "replaced_log": (replaced_log, P + "SELECT dport, count(*) AS n FROM packets WHERE ip_proto = 6 AND dport = 80 GROUP BY 1"),
    "alert_table": (alert_table, P + f"""SELECT * FROM (SELECT packet_id, {SUSPICION} AS attack_type, src_ip FROM packets)
      WHERE attack_type IS NOT NULL"""),
    "report_file": (report_file, P + f"""SELECT (SELECT count(*) FROM packets) AS total_packets, count(*) AS total_attacks,
      '{TARGET_IP}' AS target_ip, least(count(*), 50)::INT AS n_attacks FROM packets
      WHERE (src_ip IS NULL OR src_ip = '{TARGET_IP}' OR dst_ip = '{TARGET_IP}') AND ({SUSPICION}) IS NOT NULL"""),
}
