"""Ordered per-key operators: running totals, trailing rates, distinct counts, first bindings.

No operator here sorts a whole key in one task. A key is cut into time slices; per-slice totals are aggregated map-side,
accumulated over the (few) slices, and handed to each slice as one extra row. Rows are therefore partitioned by
(key, slice), so a source that sends a third of all traffic is spread over as many tasks as it has slices.

Event rows carry ``at`` (event time, microseconds), ``seq`` (tie order, the packet id) and ``step`` (order inside one
packet). Order is always (at, seq, step).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from skywarden.functions import scalars as X

SECOND = 1_000_000
LAST = 2**63 - 1  # sorts after every packet id at the same time
DEFAULT_SLICE_S = 60
RATE_SLICE = "spark.skywarden.rateSliceSeconds"  # session setting: shorter slices for very dense floods


def to_micros(seconds: float) -> int:
    return int(round(seconds * SECOND))


def key_of(keys: Sequence[str | Column]) -> Column:
    """Any number of keys of any types as one value; null is a value of its own, apart from an empty text."""
    return F.array(*[X.col(k).cast("string") for k in keys])


def running_totals(events: DataFrame, keys: Sequence[str], totals: Sequence[str], slice_s: float = DEFAULT_SLICE_S) -> DataFrame:
    """Replace each column of ``totals`` by its running sum per key, current row included.

    ``slice_s`` bounds the rows one task sorts: pick it so that the busiest key has no more than a few million rows in
    one slice. Results do not depend on it.
    """
    keys = list(keys)
    slices = events.withColumn("_slice", X.floor_div(F.col("at"), to_micros(slice_s)))
    sums = slices.groupBy(*keys, "_slice").agg(*[F.sum(c).alias(c) for c in totals])
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    opening = sums.select(*keys, "_slice", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in totals],
                          F.lit(0).alias("_kind"))
    rows = opening.unionByName(slices.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    inside = (Window.partitionBy(*keys, "_slice").orderBy("_kind", "at", "seq", "step")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (rows.withColumns({c: F.sum(c).over(inside) for c in totals})
            .where(F.col("_kind") == 1).drop("_kind", "_slice"))


# --- trailing rates -------------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class RateRule:
    """Rows of ``where`` counted per key over the trailing ``window_s`` seconds; fires above ``limit``."""

    name: str
    where: Column
    keys: tuple[str | Column, ...]
    window_s: float
    limit: int
    severity: Callable[[Column], Column] | None = None
    details: Callable[[Column], Column] | None = None
    emit: Callable[[Column], Column] | None = field(default=None)

    def fires(self, rate: Column) -> Column:
        return self.emit(rate) if self.emit else rate > F.lit(self.limit)


def trailing_rates(packets: DataFrame, rules: Sequence[RateRule], carry: Sequence[str | Column] = (),
                   slice_s: float | None = None) -> DataFrame:
    """``rate`` of every (row, rule) pair: rows of the same rule and key in ``[t - window, t]``, this row included.

    All rules share one scan and one shuffle. Each row arrives at ``t`` and expires just after ``t + window``. Slices as
    long as the window let a slice count its own opening balance (every row alive at its start expires inside it), so
    no second pass is needed. Where one window of one key is too much for a task, pass a shorter ``slice_s`` (or set it
    for the session): slices are then opened with pre-aggregated totals, at the price of a second scan.
    """
    setting = packets.sparkSession.conf.get(RATE_SLICE, None)
    slice_s = float(setting) if slice_s is None and setting else slice_s
    def group(i: int, rule: RateRule) -> list[Column]:
        return [F.lit(i).alias("rule"), key_of(rule.keys).alias("key"), F.lit(to_micros(rule.window_s)).cast("long").alias("window")]

    carried = F.struct(F.col("packet_id"), F.col("ts"), *[X.col(c) for c in carry])
    base = [X.micros().alias("t"), F.col("packet_id").alias("id"), carried.alias("row")]
    if len(rules) == 1:
        matches = packets.where(rules[0].where).select(*base, *group(0, rules[0]))
    else:
        wanted = F.array_compact(F.array(*[F.when(r.where, F.struct(*group(i, r))) for i, r in enumerate(rules)]))
        any_rule = reduce(lambda a, b: a | b, [r.where for r in rules])
        matches = packets.where(any_rule).select(*base, F.explode(wanted).alias("m")).select("t", "id", "row", "m.*")
    moments = F.array(
        F.struct(F.col("t").alias("at"), F.col("id").alias("seq"), F.lit(1).alias("rate"), F.col("row").alias("row")),
        F.struct((F.col("t") + F.col("window")).alias("at"), F.lit(LAST).alias("seq"), F.lit(-1).alias("rate"),
                 F.lit(None).alias("row")))
    keys = ["rule", "key"]
    events = matches.select(*keys, "window", F.explode(moments).alias("e")).select(*keys, "window", "e.*")
    if slice_s is None:
        events = events.withColumn("_slice", X.floor_div(F.col("at"), F.col("window")))
        order = Window.partitionBy(*keys, "_slice").orderBy("at", "seq")
        running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        expiring = F.sum((F.col("rate") < 0).cast("int")).over(whole)
        counted = events.withColumn("rate", expiring + F.sum("rate").over(running)).drop("_slice")
    else:
        counted = running_totals(events.withColumn("step", F.lit(0)), keys, ["rate"], slice_s).drop("step")
    return counted.where(F.col("row").isNotNull()).select("rule", F.col("rate").cast("long").alias("rate"), "row.*")


def rate_over(packets: DataFrame, keys: Sequence[str | Column], window_s: float, where: Column | None = None,
              carry: Sequence[str | Column] = (), slice_s: float | None = None) -> DataFrame:
    """Trailing rate of one key over the rows of ``where``."""
    rule = RateRule("rate", F.lit(True) if where is None else where, tuple(keys), window_s, 0)
    return trailing_rates(packets, [rule], carry, slice_s).drop("rule")


def overlap_slices(packets: DataFrame, slice_s: float) -> DataFrame:
    """Copy each row to its own time slice and the next one; ``native`` marks the original.

    With slices no shorter than a look-back window, a native row finds its whole window inside its slice.
    """
    own = X.floor_div(X.micros(), to_micros(slice_s))
    copies = F.array(F.struct(own.alias("slice"), F.lit(True).alias("native")),
                     F.struct((own + 1).alias("slice"), F.lit(False).alias("native")))
    return packets.select("*", F.explode(copies).alias("_copy")).select("*", "_copy.*").drop("_copy")


def exceeds(packets: DataFrame, keys: Sequence[str], limit: int, window_s: float) -> DataFrame:
    """Add ``exceeds``: more than ``limit`` rows of the key in the trailing window. Uses the row ``limit`` places back."""
    order = Window.partitionBy(*keys, "slice").orderBy("ts", "packet_id")
    earlier = F.lag(X.micros(), limit).over(order)
    over = F.coalesce(earlier >= X.micros() - F.lit(to_micros(window_s)), F.lit(False))
    return (overlap_slices(packets, window_s).withColumn("exceeds", over)
            .where("native").drop("slice", "native"))


# --- distinct counts ------------------------------------------------------------------------------------------------

def _probes(rows: DataFrame, keys: Sequence[str], carry: Sequence[str | Column], totals: Sequence[str]) -> DataFrame:
    carried = F.struct(F.col("packet_id"), F.col("ts"), *[X.col(c) for c in carry])
    return rows.select(*keys, X.micros().alias("at"), F.col("packet_id").alias("seq"), F.lit(1).alias("step"),
                       *[F.lit(0).alias(c) for c in totals], carried.alias("row"))


def _after(events: DataFrame, keys: Sequence[str], totals: Sequence[str], slice_s: float) -> DataFrame:
    counted = running_totals(events, keys, totals, slice_s).where(F.col("row").isNotNull())
    return counted.select(*[F.col(c).cast("long").alias(c) for c in totals], "row.*")


def seen_distinct(packets: DataFrame, keys: Sequence[str], value: str, carry: Sequence[str | Column] = (),
                  also: Column | None = None, slice_s: float = DEFAULT_SLICE_S) -> DataFrame:
    """``n_distinct``: distinct values of the key so far, never expiring; ``n_also`` counts values meeting ``also``. Null is no value.

    First sightings are found by a map-side aggregate; rows meet them by (key, slice), never by the bare key.
    """
    keys = list(keys)
    first = F.min(F.struct(X.micros().alias("at"), F.col("packet_id").alias("seq"))).alias("first")
    firsts = packets.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("value")).agg(first)
    totals = ["n_distinct"] + (["n_also"] if also is not None else [])
    starts = firsts.withColumn(value, F.col("value")).select(
        *keys, "first.at", "first.seq", F.lit(0).alias("step"), F.lit(1).alias("n_distinct"),
        *([X.flag(also).alias("n_also")] if also is not None else []))
    events = _probes(packets, keys, carry, totals).unionByName(starts, allowMissingColumns=True)
    return _after(events, keys, totals, slice_s)


def distinct_over(packets: DataFrame, keys: Sequence[str], value: str, window_s: float,
                  carry: Sequence[str | Column] = (), slice_s: float | None = None) -> DataFrame:
    """``n_distinct``: distinct values of the key in ``[t - window, t]``. Null is no value.

    Sightings of one value inside one window-long slice are never further apart than the window, so first and last
    sighting per slice (a map-side aggregate) give the exact stretches during which a value counts.
    """
    keys, window = list(keys), to_micros(window_s)
    sighting = F.struct(X.micros().alias("at"), F.col("packet_id").alias("seq"))
    spans = packets.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("value"), X.floor_div(X.micros(), window).alias("_span")).agg(
        F.min(sighting).alias("lo"), F.max(X.micros()).alias("hi"))
    order = Window.partitionBy(*keys, "value").orderBy("_span")
    spans = spans.withColumns({"since": F.col("lo.at") - F.lag("hi").over(order),
                               "until": F.lead("lo.at").over(order) - F.col("hi")})
    moments = F.array_compact(F.array(
        F.when(F.col("since").isNull() | (F.col("since") > window), F.struct(
            F.col("lo.at").alias("at"), F.col("lo.seq").alias("seq"), F.lit(0).alias("step"), F.lit(1).alias("n_distinct"))),
        F.when(F.col("until").isNull() | (F.col("until") > window), F.struct(
            (F.col("hi") + window).alias("at"), F.lit(LAST).alias("seq"), F.lit(2).alias("step"),
            F.lit(-1).alias("n_distinct")))))
    changes = spans.select(*keys, F.explode(moments).alias("e")).select(*keys, "e.*")
    events = _probes(packets, keys, carry, ["n_distinct"]).unionByName(changes, allowMissingColumns=True)
    return _after(events, keys, ["n_distinct"], slice_s if slice_s is not None else max(window_s, 1))


# --- bindings -------------------------------------------------------------------------------------------------------

def first_binding(packets: DataFrame, keys: Sequence[str], values: Sequence[str],
                  slice_s: float = DEFAULT_SLICE_S) -> DataFrame:
    """Add ``first_<value>``: the values of the key's first row. Null keys equal each other.

    First rows come from a map-side aggregate by (key, slice); each slice gets the key's one as an extra row, so rows are
    shuffled by (key, slice) and a busy key is spread over its slices.
    """
    keys = list(keys)
    rows = packets.withColumn("_slice", X.floor_div(X.micros(), to_micros(slice_s)))
    earliest = F.min(F.struct(F.col("ts"), F.col("packet_id"), *[F.col(v) for v in values]))
    firsts = rows.groupBy(*keys, "_slice").agg(earliest.alias("_first"))
    opening = firsts.select(*keys, "_slice", F.min("_first").over(Window.partitionBy(*keys)).alias("_first"), F.lit(0).alias("_kind"))
    both = opening.unionByName(rows.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    inside = Window.partitionBy(*keys, "_slice").orderBy("_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bound = both.withColumn("_first", F.first("_first").over(inside)).where(F.col("_kind") == 1)
    return bound.select(*packets.columns, *[F.col(f"_first.{v}").alias(f"first_{v}") for v in values])


def running_counts(packets: DataFrame, keys: Sequence[str], amounts: dict[str, Column],
                   carry: Sequence[str | Column] = (), slice_s: float = DEFAULT_SLICE_S) -> DataFrame:
    """Running sums of ``amounts`` per key, never expiring, current row included."""
    carried = F.struct(F.col("packet_id"), F.col("ts"), *[X.col(c) for c in carry])
    events = packets.select(*keys, X.micros().alias("at"), F.col("packet_id").alias("seq"), F.lit(0).alias("step"),
                            *[v.cast("long").alias(n) for n, v in amounts.items()], carried.alias("row"))
    return _after(events, keys, list(amounts), slice_s)
