"""Totals, breakdowns and reports over alerts and logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from skywarden.functions import scalars as X
from skywarden.operators.ordered import running_counts, to_micros


def totals(log: DataFrame, stored: Column | None = None) -> DataFrame:
    """Packet, stored and attack totals of a log with ``attack_type``."""
    return log.agg(F.count("*").alias("packets"),
                   F.count_if(F.lit(True) if stored is None else stored).alias("stored"),
                   F.count_if(F.col("attack_type") != "NORMAL").alias("attacks"))


def entity_summary(packets: DataFrame, entities: dict[str, Column], approximate: bool = False) -> DataFrame:
    """Distinct entities, each a (possibly null) expression. ``approximate`` uses sketches of fixed size."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    return packets.agg(*[count(e).alias(n) for n, e in entities.items()])


def entity_sketches(packets: DataFrame, entities: dict[str, Column], *by: str | Column, precision: int = 14) -> DataFrame:
    """A mergeable sketch of fixed size per entity (and per ``by``, such as a day). Rows are not expanded, and later days are merged in."""
    return packets.groupBy(*by).agg(*[
        F.hll_sketch_agg(F.when(e.isNotNull(), F.to_json(F.struct(e.alias("e")))), F.lit(precision)).alias(n) for n, e in entities.items()])


def merged_entities(sketches: DataFrame, names: Sequence[str]) -> DataFrame:
    """Estimated distinct entities over any rows of ``entity_sketches``; the error is about 1.04 / sqrt(2 ** precision)."""
    return sketches.agg(*[F.hll_sketch_estimate(F.hll_union_agg(n)).alias(n) for n in names])


def breakdown(alerts: DataFrame, *by: str | Column) -> DataFrame:
    return alerts.groupBy(*by).agg(F.count("*").alias("n"))


def breakdown_rollup(alerts: DataFrame, *by: str) -> DataFrame:
    return alerts.rollup(*by).agg(F.count("*").alias("n"))


def recent_alerts(alerts: DataFrame, n: int = 50) -> DataFrame:
    return alerts.orderBy(F.desc("ts"), F.desc("packet_id")).limit(n)


def summary_report(packets: DataFrame, alerts: DataFrame, target_ip: str, n: int = 50) -> DataFrame:
    """One row: totals, runtime in seconds of event time, target and the last ``n`` alerts, oldest first."""
    span = (F.max(X.micros()) - F.min(X.micros())) / 1e6
    counts = packets.agg(F.count("*").alias("total_packets"), span.alias("runtime"))
    found = alerts.agg(F.count("*").alias("total_attacks"))
    entry = F.struct(X.time_text("ts", "clock").alias("time"), F.col("attack_type").alias("type"), "confidence",
                     F.coalesce("src_ip", F.lit("N/A")).alias("src"), F.coalesce("dst_ip", F.lit("N/A")).alias("dst"))
    last = recent_alerts(alerts, n).agg(F.array_sort(F.collect_list(F.struct("ts", "packet_id", entry.alias("a")))).alias("l"))
    # three one-row tables laid side by side; the array holds at most n alerts
    rows = counts.unionByName(found, allowMissingColumns=True).unionByName(last, allowMissingColumns=True)
    return rows.agg(*[F.first(c, ignorenulls=True).alias(c) for c in rows.columns]).select(
        "total_packets", "total_attacks", "runtime", F.lit(target_ip).alias("target_ip"),
        F.transform("l", lambda x: x["a"]).alias("attacks"))


def stream_size_stats(packets: DataFrame, small: int = 100, slice_s: float = 60) -> DataFrame:
    """Running packet and small-packet counts of each ``src_ip:sport`` stream."""
    return running_counts(packets, ["src_ip", "sport"], {
        "packet_count": F.lit(1), "small_count": X.flag(F.col("packet_size") < small)}, ["packet_size"], slice_s)


REMEMBERED = 64  # packets; what lies further back weighs less than the last bit of a double


def running_sizes(packets: DataFrame, slice_s: float = 60) -> DataFrame:
    """packet_id, smoothed_size: each packet's stream (``src_ip``, ``sport``) smoothed by ``(smoothed + size) / 2`` up to and with it.

    A slice maps what it starts with to ``value + start / 2 ** n``; these maps are composed over the slices before a slice, and inside it
    a packet folds what follows its opening row. Weights halve with each packet, so ``REMEMBERED`` maps or packets are enough, and
    no stream is in one task.
    """
    stream = ["src_ip", "sport"]

    def fold(values: Column) -> Column:
        return F.aggregate(F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0))), F.get(values, F.lit(0)), lambda s, x: (s + x) / 2)
    size = F.col("packet_size").cast("double")
    rows = packets.select(*stream, "ts", "packet_id", size.alias("value"), X.floor_div(X.micros(), to_micros(slice_s)).alias("slice"), F.lit(1).alias("kind"))
    newest = Window.partitionBy(*stream, "slice").orderBy(F.desc("ts"), F.desc("packet_id"))
    maps = rows.withColumn("place", F.row_number().over(newest)).groupBy(*stream, "slice").agg(
        F.sum(F.col("value") * F.pow(F.lit(0.5), "place")).alias("value"), F.count("*").alias("n"), F.min(F.struct("ts", "packet_id", "value")).alias("first"))
    slices = Window.partitionBy(*stream).orderBy("slice")
    earlier = F.collect_list(F.struct("value", "n", F.col("first.value").alias("start"))).over(slices.rowsBetween(-REMEMBERED, -1))
    opening = F.aggregate("earlier", F.get("earlier", F.lit(0))["start"], lambda s, m: s * F.pow(F.lit(0.5), m["n"]) + m["value"])
    opens = maps.select(*stream, "slice", earlier.alias("earlier")).where(F.size("earlier") > 0).select(
        *stream, "slice", opening.alias("value"), F.lit(0).alias("kind"))
    order = Window.partitionBy(*stream, "slice").orderBy("kind", "ts", "packet_id").rowsBetween(-REMEMBERED, 0)
    both = opens.unionByName(rows, allowMissingColumns=True)
    return (both.withColumn("near", F.collect_list("value").over(order)).where("kind = 1")
            .select("packet_id", fold(F.col("near")).alias("smoothed_size")))


def stream_state(packets: DataFrame, small: int = 100, slice_s: float = 60) -> DataFrame:
    """Final state of each ``src_ip:sport`` stream: counts, and the size smoothed by ``(smoothed + size) / 2`` over all packets.

    A packet weighs 1/2 for each packet from itself to the end, the first one counts once more. Weights inside a time slice
    and the packets of later slices are found apart, so no stream is in one task and none is cut.
    """
    stream, half = ["src_ip", "sport"], F.lit(0.5)
    place = F.struct("ts", "packet_id", F.col("packet_size").cast("double").alias("size"))
    newest = Window.partitionBy(*stream, "_slice").orderBy(F.desc("ts"), F.desc("packet_id"))
    rows = packets.select(*stream, "ts", "packet_id", "packet_size", X.floor_div(X.micros(), to_micros(slice_s)).alias("_slice"))
    slices = rows.withColumn("_place", F.row_number().over(newest)).groupBy(*stream, "_slice").agg(
        F.sum(F.col("packet_size") * F.pow(half, "_place")).alias("value"), F.count("*").alias("n"),
        F.count_if(F.col("packet_size") < small).alias("small"), F.min(place).alias("first"))
    later = F.sum("n").over(Window.partitionBy(*stream).orderBy(F.desc("_slice")).rowsBetween(Window.unboundedPreceding, -1))
    totals = slices.withColumn("later", F.coalesce(later, F.lit(0))).groupBy(*stream).agg(
        F.sum("n").alias("packet_count"), F.sum("small").alias("small_count"),
        F.sum(F.col("value") * F.pow(half, "later")).alias("value"), F.min("first").alias("first"))
    smoothed = F.col("value") + F.col("first.size") * F.pow(half, "packet_count")
    return totals.select(*stream, "packet_count", "small_count", smoothed.alias("smoothed_size"))
