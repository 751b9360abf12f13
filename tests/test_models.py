"""Training, saving, scoring and the hybrid verdict on a table that a single column decides."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from skywarden.ml import models
from skywarden.ml.layers import SPECS, training_rows
from skywarden.plans import analyser


@pytest.fixture(scope="module")
def log(spark):
    """Packets with a TTL of 200 are attacks."""
    flags = [f"cast(id % 4 = 0 AND '{n}' = 'ping_flood' AS int) AS {n}" for n in ("ip_spoofing", "ping_flood", "syn_flood", "udp_flood", "port_scan")]
    return spark.range(400).selectExpr(
        "cast(id AS string) AS timestamp", "'m' AS src_mac", "'a' AS src_ip", "'b' AS dst_ip", "CASE WHEN id % 3 = 0 THEN 'UDP' ELSE 'TCP' END AS protocol",
        "CASE WHEN id % 4 = 0 THEN 200 ELSE 64 END AS ttl", "cast(40 + id % 7 AS int) AS packet_size", *flags)


@pytest.fixture(scope="module")
def trained(log):
    return models.train(training_rows(log, SPECS["internet"]), SPECS["internet"], rounds=4)


def test_a_separable_log_is_learnt(log, trained):
    scored = models.score(training_rows(log, SPECS["internet"]), trained)
    report = {r["class"]: r.f1 for r in models.classification_report(scored, "is_attack", "predicted").collect()}
    assert report == {"0": 1.0, "1": 1.0, "accuracy": 1.0}
    assert scored.where((F.col("ttl") == 200) != (F.col("predicted") == "1")).count() == 0
    assert scored.where("confidence < 0.5 OR confidence > 1").count() == 0
    assert scored.where("(is_attack = 1) <> (predicted = '1')").count() == 0


def test_saved_and_loaded_models_score_alike(log, trained, tmp_path):
    models.save({"internet": trained}, str(tmp_path))
    loaded = models.load(str(tmp_path))
    assert set(loaded) == {"internet"}
    rows = training_rows(log, SPECS["internet"]).drop("protocol")  # a missing column is filled
    both = [models.score(rows, m).select("ttl", "packet_size", "predicted", "confidence").orderBy("ttl", "packet_size").collect() for m in (trained, loaded["internet"])]
    assert both[0] == both[1]


def test_a_layer_that_fails_leaves_the_others(spark, log):
    broken = spark.createDataFrame([("x",)], "attack_label string")
    found = models.train_all({"application": broken, "nowhere": log, "internet": log}, rounds=2)
    assert set(found) == {"internet"}


def test_without_a_model_only_rules_speak(spark, frames, tmp_path):
    assert models.load(str(tmp_path)) == {}
    packets = frames([{"at": 0, "packet_size": 10}, {"at": 1, "src_ip": "a", "dst_ip": "t", "ttl": 64, "ip_proto": 17, "packet_size": 100},
                      {"at": 2, "src_ip": "a", "dst_ip": "t", "ttl": 5, "ip_proto": 17, "packet_size": 100}])
    rows = analyser.with_rule(packets, "t").withColumns({"prediction": F.lit(None).cast("int"), "confidence": F.lit(None).cast("double")})
    alerts = analyser.hybrid_alerts(rows, "internet").orderBy("packet_id").collect()
    assert [(r.packet_id, r.attack_type, r.confidence) for r in alerts] == [(0, "unusual_packet_size", 0.8), (2, "unusual_ttl", 0.8)]
    scored = rows.withColumns({"prediction": F.lit(1), "confidence": F.when(F.col("packet_id") == 1, 0.9).otherwise(0.6)})
    assert [(r.packet_id, r.attack_type) for r in analyser.hybrid_alerts(scored, "internet").orderBy("packet_id").collect()] == [
        (0, "unusual_packet_size"), (1, "internet_attack"), (2, "unusual_ttl")]
