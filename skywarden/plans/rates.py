"""Detectors that count rows of a key in a trailing window, as rules that run together."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from skywarden.operators.ordered import RateRule, trailing_rates

Limits = Mapping[str, tuple[float, int]]


def limited(rules: Sequence[RateRule], limits: Limits | None) -> list[RateRule]:
    """Rules with (window, limit) replaced by name."""
    return [replace(r, window_s=limits[r.name][0], limit=limits[r.name][1]) if limits and r.name in limits else r
            for r in rules]


def _pick(columns: Sequence[Column]) -> Column:
    return F.coalesce(*[F.when(F.col("rule") == i, c) for i, c in enumerate(columns)])


def rate_hits(packets: DataFrame, rules: Sequence[RateRule], positions: Mapping[str, int] | None = None,
              carry: Sequence[str | Column] = (), slice_s: float | None = None) -> DataFrame:
    """Hits of all rules from one scan and one shuffle: packet_id, detector, position, severity, details, rate."""
    rates = trailing_rates(packets, rules, carry, slice_s)
    n = F.col("rate")
    fires = reduce(lambda a, b: a | b, [(F.col("rule") == i) & r.fires(n) for i, r in enumerate(rules)])
    position = {r.name: i for i, r in enumerate(rules)} if positions is None else positions
    severity = [(r.severity(n) if r.severity else F.lit(1)).cast("double") for r in rules]
    details = [r.details(n) if r.details else F.lit("") for r in rules]
    return rates.where(fires).select(
        "packet_id", _pick([F.lit(r.name) for r in rules]).alias("detector"),
        _pick([F.lit(position[r.name]) for r in rules]).alias("position"),
        _pick(severity).alias("severity"), _pick(details).alias("details"), n.alias("rate"))
