"""Named queries over the test tables, each with the same question in plain SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def everything() -> dict[str, tuple[Query, str | None]]:
    from skywarden.catalog import aggregates, blocks, detectors, filters, lookup, models, scalar, sinks, streams, verdicts
    found: dict[str, tuple[Query, str | None]] = {}
    for module in (scalar, filters, lookup, aggregates, blocks, detectors, verdicts, sinks, models, streams):
        for name, entry in module.QUERIES.items():
            if name in found:
                raise ValueError(f"query {name} is registered twice")
            found[name] = entry
    return found
