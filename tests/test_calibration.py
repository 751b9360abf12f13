"""Confidences of several-class boosting, and the hybrid verdict of all layers."""

from __future__ import annotations

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from skywarden.ml import calibration, hybrid, models
from skywarden.ml.layers import SPECS, training_rows

SPEC = SPECS["transport"]


@pytest.fixture(scope="module")
def noisy(spark):
    """Three labels; the size tells NONE for sure and SYN from RST in seven of ten cases."""
    return spark.range(3000).selectExpr(
        "cast(id AS string) AS timestamp", "'a' AS src_ip", "'b' AS dst_ip", "cast(id % 3 AS int) AS packet_size",
        "CASE WHEN id % 3 = 0 THEN 'NONE' WHEN (id % 3 = 1) = (pmod(hash(id), 10) < 7) THEN 'SYN' ELSE 'RST' END AS flag_label")


@pytest.fixture(scope="module")
def trained(noisy):
    return models.train(training_rows(noisy, SPEC), SPEC, rounds=5)


def test_confidences_follow_the_share_that_is_right(noisy, trained):
    scored = models.score(training_rows(noisy, SPEC), trained)
    table = {r.packet_size: (r.c, r.a) for r in scored.groupBy("packet_size").agg(
        F.avg("confidence").alias("c"), F.avg((F.col("predicted") == F.col("flag_label")).cast("double")).alias("a")).collect()}
    assert table[0][1] == 1.0 and table[0][0] > 0.999  # a curve is read between its points, which are STEP apart
    for size in (1, 2):
        assert abs(table[size][1] - 0.7) < 0.05 and abs(table[size][0] - 0.7) < 0.06
    error = calibration.calibration_error(calibration.reliability(scored, F.col("predicted") == F.col("flag_label"))).first()
    assert error.n == 3000 and abs(error.accuracy - 0.8) < 0.05 and error.calibration_error < 0.05
    assert scored.where("confidence < 0 OR confidence > 1 OR confidence IS NULL").count() == 0
    assert not [c for c in scored.columns if c.startswith("calibrated")]


def test_curves_are_saved_with_the_model(noisy, trained, tmp_path):
    models.save({"transport": trained}, str(tmp_path))
    rows = training_rows(noisy, SPEC)
    both = [sorted({tuple(r) for r in models.score(rows, m).select("packet_size", "predicted", "confidence").collect()})
            for m in (trained, models.load(str(tmp_path))["transport"])]
    assert both[0] == both[1] and len(both[0]) == 3


def test_a_label_of_one_row_and_a_table_of_two(spark, noisy):
    rare = noisy.where("timestamp < '2'").unionByName(
        noisy.limit(1).withColumns({"flag_label": F.lit("ACK"), "packet_size": F.lit(9)}))
    model = models.train(training_rows(rare, SPEC), SPEC, rounds=2)
    assert models.label_names(model) == ["ack", "none", "rst", "syn"]
    assert models.score(training_rows(rare, SPEC), model).where("confidence IS NULL").count() == 0
    few = spark.createDataFrame([("t", "a", "b", 1, "SYN"), ("t", "a", "b", 2, "RST")], noisy.schema)
    assert models.score(training_rows(few, SPEC), models.train(training_rows(few, SPEC), SPEC, rounds=1)).count() == 2


def test_equal_rows_are_dealt_apart(spark):
    rows = spark.range(2000).select(F.lit(1).alias("x"))
    held = calibration.dealt(rows, "test").where(f"{calibration.DEALT} < 20").count()
    assert 300 < held < 500


def test_reliability_against_plain_counts(spark):
    rows = [(i / 37 % 1.0, i % 4 != 0) for i in range(200)] + [(1.0, True), (None, True), (0.95, None)]
    scored = spark.createDataFrame(rows, "confidence double, good boolean")
    want = {}
    for c, good in rows:
        if c is not None:
            want.setdefault(min(int(c * 10), 9), []).append((c, bool(good)))
    got = {r.bin: (r.n, round(r.confidence, 9), round(r.accuracy, 9)) for r in calibration.reliability(scored, F.col("good")).collect()}
    assert got == {b: (len(v), round(sum(c for c, _ in v) / len(v), 9), round(sum(g for _, g in v) / len(v), 9)) for b, v in want.items()}
    assert calibration.calibration_error(calibration.reliability(scored.limit(0), F.col("good"))).first().calibration_error is None


def test_the_rule_comes_first_then_the_surest_layer(spark, frames):
    packets = frames([
        {"at": 0, "src_ip": "a", "dst_ip": "t", "ttl": 5, "ip_proto": 17},
        {"at": 1, "src_ip": "a", "dst_ip": "t", "ttl": 64, "ip_proto": 17},
        {"at": 2, "src_ip": "a", "dst_ip": "t", "ttl": 64, "ip_proto": 17},
        {"at": 3, "src_ip": "a", "dst_ip": "elsewhere", "ttl": 64, "ip_proto": 17},
        {"at": 4, "src_ip": "a", "dst_ip": "t", "ttl": 64, "ip_proto": 17}])
    say = {"transport": [(0, 0.99), (1, 0.9), (2, 0.8), (3, 0.9)], "internet": [(1, 0.8), (2, 0.8)]}
    findings = {layer: spark.createDataFrame(rows, "packet_id long, confidence double") for layer, rows in say.items()}
    got = [(r.packet_id, r.attack_type, r.confidence) for r in hybrid.hybrid_alerts(packets, findings, "t").orderBy("packet_id").collect()]
    assert got == [(0, "unusual_ttl", 0.8), (1, "transport_attack", 0.9), (2, "internet_attack", 0.8)]
    only = hybrid.hybrid_alerts(packets, {}, "t").collect()
    assert [(r.packet_id, r.attack_type) for r in only] == [(0, "unusual_ttl")]


def test_findings_keep_keys_out_of_the_features(noisy, trained):
    log = noisy.withColumn("packet_id", F.col("timestamp").cast("long"))
    found = hybrid.layer_findings({"transport": log}, {"transport": trained, "network": trained}, {"transport": ["packet_id"]}, floor=0.5)
    assert list(found) == ["transport"] and found["transport"].columns == ["packet_id", "confidence"]
    assert found["transport"].where("packet_id % 3 = 0").count() == 0  # NONE is no attack
    assert found["transport"].count() == 2000
    sure = hybrid.layer_findings({"transport": log}, {"transport": trained}, {"transport": ["packet_id"]}, floor=0.9)
    assert sure["transport"].count() == 0


def test_a_condition_on_findings_brings_no_copies_of_the_model(noisy, trained):
    log = noisy.withColumn("packet_id", F.col("timestamp").cast("long"))
    found = hybrid.layer_findings({"transport": log}, {"transport": trained}, {"transport": ["packet_id"]}, floor=0.5)["transport"]
    assert "UDF(" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_a_class_only_among_held_rows_has_no_curve(spark):
    rows = [(float(i % 3), Vectors.dense([i / 10, 1 - i / 10])) for i in range(9)]  # the model knows classes 0 and 1
    found = calibration.curves(spark.createDataFrame(rows, ["label", "rawPrediction"]), 3)
    assert [curve.getFeatureIndex() for curve in found] == [0, 1]
    scored = spark.createDataFrame(rows, ["label", "rawPrediction"])
    for curve in found:
        scored = curve.transform(scored)
    assert scored.count() == scored.where("calibrated_0 >= 0 AND calibrated_1 >= 0").count() == 9
