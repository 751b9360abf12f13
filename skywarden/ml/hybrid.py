"""The hybrid verdict with a model for each layer: packets are scored by the logs the models were trained on."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, functions as F

from skywarden.ml import models
from skywarden.ml.layers import SPECS, training_rows
from skywarden.plans import analyser
from skywarden.session import written

ORDER = tuple(SPECS)


def layer_findings(logs: Mapping[str, DataFrame], trained: Mapping[str, PipelineModel], keys: Mapping[str, list[str]],
                   floor: float = 0.7) -> dict[str, DataFrame]:
    """For each layer with a log and a model: the key columns and ``confidence`` of rows that the model is sure are attacks.

    ``keys`` names a layer's key columns, such as ``["packet_id"]``; they are kept out of the features. Rows are scored where
    they lie; nothing is shuffled here. What the model says of each row is written before the sure ones are picked: a condition on
    it would move below the scoring, and with it copies of the whole model, one for each mention.
    """
    found = {}
    for layer in ORDER:
        if layer in logs and layer in trained:
            named = logs[layer].withColumns({f"_key_{c}": F.col(c) for c in keys[layer]})
            scored = models.score(training_rows(named, SPECS[layer]), trained[layer])
            said = written(scored.select(*[F.col(f"_key_{c}").alias(c) for c in keys[layer]], "is_attack", "confidence"), "scores")
            found[layer] = said.where((F.col("is_attack") == 1) & (F.col("confidence") > floor)).drop("is_attack")
    return found


def of_buckets(packets: DataFrame, findings: DataFrame, window_start: Column) -> DataFrame:
    """(packet_id, confidence) of the packets in found buckets; ``window_start`` is a packet's bucket."""
    placed = packets.select("packet_id", window_start.alias("window_start"), "src_ip")
    return placed.join(findings, ["window_start", "src_ip"]).select("packet_id", "confidence")


def best_model(findings: Mapping[str, DataFrame]) -> DataFrame | None:
    """(packet_id, model) with the most confident layer's (attack_type, confidence); equal ones by the order of the layers."""
    if not findings:
        return None
    named = [df.select("packet_id", F.struct(F.col("confidence").cast("double").alias("confidence"),
                                             F.lit(-ORDER.index(layer)).alias("turn"), F.lit(f"{layer}_attack").alias("attack_type")).alias("m"))
             for layer, df in findings.items()]
    best = reduce(DataFrame.unionByName, named).groupBy("packet_id").agg(F.max("m").alias("m"))
    return best.select("packet_id", F.struct("m.attack_type", "m.confidence").alias("model"))


def hybrid_alerts(packets: DataFrame, findings: Mapping[str, DataFrame], target_ip: str) -> DataFrame:
    """(packet_id, ts, attack_type, confidence, src_ip, dst_ip): the rule first, then the surest model; without models only rules.

    Packets are those of the target and non-IP ones.
    """
    rows = analyser.with_rule(packets.select("packet_id", "ts", "src_ip", "dst_ip", "packet_size", "ttl", "ip_proto", "ip_flags",
                                             "tcp_flags", "sport", "dport"), target_ip)
    models_say = best_model(findings)
    verdict = F.col("rule")
    if models_say is not None:
        rows, verdict = rows.join(models_say, "packet_id", "left"), F.coalesce("rule", "model")
    found = rows.withColumn("verdict", verdict).where(F.col("verdict").isNotNull())
    return found.select("packet_id", "ts", "verdict.attack_type", "verdict.confidence", "src_ip", "dst_ip")
