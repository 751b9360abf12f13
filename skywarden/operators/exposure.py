"""Exposure of an owner's own hosts, from an inventory of (ip, port) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from skywarden import schema as S


def _raised(rules: tuple[tuple[str, tuple[int, ...]], ...]) -> Column:
    """Positions of the rules a port raises."""
    return F.array_compact(F.array(*[F.when(F.col("port").isin(list(ports)), F.lit(i))
                                     for i, (_, ports) in enumerate(rules)]))


def _names(positions: Column, rules: tuple[tuple[str, tuple[int, ...]], ...]) -> Column:
    names = F.array(*[F.lit(name) for name, _ in rules])
    return F.transform(F.array_sort(positions), lambda i: F.get(names, i))


def exposure_scores(assets: DataFrame, minimum: int = 4) -> DataFrame:
    """(ip, score, confidence, services) of hosts whose port weights add up to ``minimum`` or more."""
    # a port may raise several rules; its weight counts once
    weights = F.create_map(*[F.lit(x) for p in S.PORT_WEIGHTS.items() for x in p])
    ports = assets.select("ip", "port").distinct()
    scored = ports.select("ip", F.coalesce(F.element_at(weights, F.col("port")), F.lit(0)).alias("weight"),
                          _raised(S.SERVICE_RULES).alias("raised"))
    hosts = scored.groupBy("ip").agg(F.sum("weight").alias("score"),
                                     F.flatten(F.collect_set("raised")).alias("raised"))
    return hosts.where(F.col("score") >= minimum).select(
        "ip", "score", F.least(F.col("score") * 10, F.lit(100)).alias("confidence"),
        _names(F.array_distinct("raised"), S.SERVICE_RULES).alias("services"))


def exposure_findings(assets: DataFrame) -> DataFrame:
    """(ip, findings, n_findings) of hosts with at least one finding."""
    raised = assets.select("ip", F.explode(_raised(S.FINDING_RULES)).alias("rule")).groupBy("ip").agg(
        F.collect_set("rule").alias("raised"))
    return raised.select("ip", _names(F.col("raised"), S.FINDING_RULES).alias("findings"),
                         F.size("raised").cast("long").alias("n_findings"))


def most_exposed(findings: DataFrame, n: int = 5) -> DataFrame:
    return findings.orderBy(F.desc("n_findings"), "ip").limit(n)
