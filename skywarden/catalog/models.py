"""Label encoding, split, training, scoring and evaluation. Trees differ between libraries, so trained models have no SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from skywarden.catalog.base import P, TARGET_IP, packets, table
from skywarden.catalog.aggregates import DURATION, A_LIMITS
from skywarden.catalog.verdicts import INTERNET, INTERNET_LOG, NETWORK
from skywarden.ml import calibration, hybrid, models
from skywarden.ml.layers import SPECS, is_test_row, training_rows
from skywarden.operators import buckets
from skywarden.operators.verdict import combine_layers
from skywarden.plans import analyser, internet, network, transport
from skywarden.session import fresh_folder, written
from skywarden.sources.sinks import log_columns

ROUNDS = 10  # of the boosted models behind whole-layer queries


def layer_rows(s, d, layer):
    """The layer's rows with their keys."""
    p = packets(s, d)
    if layer == "network":
        return network.network_log(p, **NETWORK, all_rows=True)
    if layer == "internet":
        return internet.internet_log(p, **INTERNET)
    if layer == "transport":
        return transport.transport_log(p)
    return buckets.application_buckets(p, DURATION, A_LIMITS)


def layer_log(s, d, layer):
    return log_columns(layer_rows(s, d, layer), layer, "window_start" if layer == "application" else "ts")


def with_id(rows):
    """Logs carry no key; the hash of a whole row splits them the same way in every run."""
    return rows.withColumn("row_id", F.md5(F.to_json(F.struct(*rows.columns))))


def predictions(s, d, layer, kind="boosted", exclude_leaky=False):
    spec = SPECS[layer]
    rows = with_id(training_rows(written(layer_log(s, d, layer), "log"), spec, exclude_leaky))
    model = models.train(rows.where(~is_test_row("row_id")), spec, kind, id_column="row_id")
    return models.score(rows.where(is_test_row("row_id")), model), spec


def evaluated(layer, kind="boosted", exclude_leaky=False):
    def query(s, d):
        scored, spec = predictions(s, d, layer, kind, exclude_leaky)
        return models.classification_report(scored, spec.label, "predicted")
    return query


def saved_and_loaded(s, d):
    """Train, save, load, score all packets that no rule names, and combine."""
    p = packets(s, d)
    spec = SPECS["internet"]
    trained = models.train(training_rows(layer_log(s, d, "internet"), spec), spec)
    folder = fresh_folder(s, "models")
    models.save({"internet": trained}, folder)
    loaded = models.load(folder)["internet"]
    rows = analyser.with_rule(p, TARGET_IP)
    features = analyser.features(p.join(rows.where("rule IS NULL").select("packet_id"), "packet_id", "left_semi"))
    scored = models.score(features.withColumn("protocol", F.lit("OTHER")), loaded).select(
        "packet_id", F.col("is_attack").alias("prediction"), "confidence")
    return analyser.hybrid_alerts(rows.join(scored, "packet_id", "left"), "internet").groupBy("attack_type").agg(
        F.count("*").alias("n"))


def calibrated(s, d):
    """How far confidences are from the share that is right, on rows that neither trees nor curves have seen."""
    found = {}
    for layer in ("network", "transport", "application"):
        spec = SPECS[layer]
        rows = with_id(training_rows(written(layer_log(s, d, layer), "log"), spec))
        model = models.train(rows.where(~is_test_row("row_id")), spec, rounds=ROUNDS, id_column="row_id")
        scored = models.score(rows.where(is_test_row("row_id")), model)
        found[layer] = calibration.calibration_error(calibration.reliability(scored, F.col("predicted") == F.col(spec.label)))
    return combine_layers(found)


def hybrid_of_all_layers(s, d):
    """Train four models side by side, save and load them, score the packets of each log, and combine with the rules."""
    rows = {layer: written(layer_rows(s, d, layer), "log") for layer in SPECS}
    folder = fresh_folder(s, "models")
    models.save(models.train_all({layer: log_columns(r, layer, "window_start" if layer == "application" else "ts")
                                  for layer, r in rows.items()}, rounds=ROUNDS), folder)
    keys = {layer: ["window_start", "src_ip"] if layer == "application" else ["packet_id"] for layer in SPECS}
    findings = hybrid.layer_findings(rows, models.load(folder), keys)
    p = packets(s, d)
    findings["application"] = hybrid.of_buckets(p, findings["application"], F.window("ts", DURATION)["start"])
    return hybrid.hybrid_alerts(p, findings, TARGET_IP).withColumns(
        {"ts": F.unix_micros("ts"), "confidence": F.round("confidence", 6)})


def encoded_labels(s, d):
    spec = SPECS["transport"]
    rows = training_rows(transport.transport_log(packets(s, d)), spec).select("packet_id", spec.label)
    coded = models.label_indexer(spec.label).fit(rows).transform(rows)
    return coded.select("packet_id", F.col("label").cast("int").alias("code"))


def encoded_protocol(s, d):
    rows = internet.internet_log(packets(s, d), **INTERNET).select("packet_id", "protocol")
    return models.label_indexer("protocol", "code").fit(rows).transform(rows).select("packet_id", F.col("code").cast("int").alias("code"))


REPORT = """WITH p AS (SELECT quality AS label, toxic AS prediction FROM labels),
  c AS (SELECT label AS class FROM p UNION SELECT prediction FROM p),
  s AS (SELECT class, (SELECT count(*) FROM p WHERE label = class) AS support, (SELECT count(*) FROM p WHERE prediction = class) AS predicted,
        (SELECT count(*) FROM p WHERE label = class AND prediction = class) AS hit FROM c),
  m AS (SELECT class::VARCHAR AS class, CASE WHEN predicted = 0 THEN 0 ELSE hit / predicted::DOUBLE END AS precision,
        CASE WHEN support = 0 THEN 0 ELSE hit / support::DOUBLE END AS recall, support FROM s)
  SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall,
    round(CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END, 6) AS f1, support FROM m
  UNION ALL SELECT 'accuracy', NULL, NULL, round((SELECT sum(hit) FROM s) / (SELECT count(*) FROM p)::DOUBLE, 6), (SELECT count(*) FROM p)"""

QUERIES = {
    "encoded_labels": (
        encoded_labels,
        P + """, l AS (SELECT packet_id, lower(CASE WHEN (tcp_flags // 2) % 2 = 1 THEN 'SYN' WHEN (tcp_flags // 4) % 2 = 1 THEN 'RST'
        WHEN (tcp_flags // 16) % 2 = 1 THEN 'ACK' ELSE 'NONE' END) AS label FROM packets WHERE ip_proto = 6)
        SELECT packet_id, (dense_rank() OVER (ORDER BY label) - 1)::INT AS code FROM l"""),
    "encoded_protocol": (
        encoded_protocol,
        P + """, l AS (SELECT packet_id, CASE WHEN ip_proto = 1 THEN 'ICMP' WHEN ip_proto = 17 THEN 'UDP' WHEN tcp_flags = 2 THEN 'TCP-SYN'
        ELSE 'TCP' END AS label FROM packets WHERE src_ip IS NOT NULL)
        SELECT packet_id, (dense_rank() OVER (ORDER BY label) - 1)::INT AS code FROM l"""),
    "train_test_split": (
        lambda s, d: packets(s, d).select("packet_id", is_test_row("packet_id").cast("int").alias("is_test")),
        P + """SELECT packet_id, (('0x' || substr(md5(packet_id || '/42'), 1, 8))::BIGINT % 100 < 20)::INT AS is_test FROM packets"""),
    "training_rows_internet": (
        lambda s, d: training_rows(internet.internet_log(packets(s, d), **INTERNET), SPECS["internet"]).select(
            "packet_id", "protocol", "ttl", "packet_size", "syn_flood", "port_scan", "is_attack"),
        f"""SELECT packet_id, protocol, ttl, packet_size, syn_flood, port_scan,
        (ip_spoofing + ping_flood + udp_flood > 0)::INT::VARCHAR AS is_attack FROM ({INTERNET_LOG})"""),
    "classification_report": (
        lambda s, d: models.classification_report(table(s, d, "labels"), "quality", "toxic").withColumns(
            {c: F.round(c, 6) for c in ("precision", "recall", "f1")}), REPORT),
    "boosted_internet_model": (evaluated("internet"), None),
    "boosted_transport_model": (evaluated("transport"), None),
    "forest_network_model": (evaluated("network", "forest"), None),
    "forest_application_model_without_leaks": (evaluated("application", "forest", exclude_leaky=True), None),
    "saved_model_hybrid_alerts": (saved_and_loaded, None),
    "calibrated_boosting": (calibrated, None),
    "hybrid_alerts_of_all_layers": (hybrid_of_all_layers, None),
}
