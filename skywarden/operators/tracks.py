"""Tracks: the ordered state of many detectors from one pass over the packets.

Each detector names what it follows: a trailing rate, a running sum, values seen so far or in a window, or a key's first
values. A packet becomes one tagged event for each track it belongs to (two for a rate: it arrives and it expires). The events are
narrow - payloads and other columns stay behind - and are written once, so the packets themselves are read once for any
number of detectors and layers.

All tracks then share one exchange by (track, key, slice). What a slice must know of earlier ones (totals, values first seen, first
values) comes from one map-side aggregate over the events and reaches the slice as an opening row. Openings are prefix sums in two
levels, so neither the rows nor the slices of one key meet in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from skywarden.functions import scalars as X
from skywarden.operators.ordered import DEFAULT_SLICE_S, LAST, RateRule, key_of, to_micros
from skywarden.session import written

RATE, RUNNING, SEEN, RECENT, FIRST, FEED = "rate", "running", "seen", "recent", "first", "feed"
ERA = 1024  # slices added up together in the first level of the prefix sums
KEYS = ["track", "key"]
PLACE = [*KEYS, "slice"]


@dataclass(frozen=True)
class Track:
    """What a detector follows over the rows of ``where``, and when it fires.

    ``n`` is, for RATE, the rows of the key in the trailing window; for RUNNING, the sum of ``amount`` so far (``also``: a second sum);
    for SEEN, the distinct values so far (``also``: those of them that meet it); for RECENT, the distinct values in the window.
    FEED only hands its rows on to an operator of another kind. FIRST compares ``values`` with the key's ``first`` ones (texts). Null is no value. ``fires``, ``severity`` and ``details`` may
    use the columns n, also, values, first and all carried ones.
    """

    name: str
    kind: str
    where: Column
    keys: tuple[str | Column, ...] = ()
    fires: Column | None = None
    severity: Column | None = None
    details: Column | None = None
    window_s: float = DEFAULT_SLICE_S
    values: tuple[Column, ...] = ()
    amount: Column | None = None
    also: Column | None = None
    position: int = 0
    rank: int = 0  # a hit of rank 1 counts only where the packet has none of the same name of rank 0
    layer: str = ""

    @property
    def length(self) -> int:
        """Microseconds of a slice: the window, where there is one, so that what arrives in a slice expires in the next."""
        return max(1, to_micros(self.window_s if self.kind in (RATE, RECENT) else DEFAULT_SLICE_S))


def of_rule(rule: RateRule, position: int, scope: Column | None = None) -> Track:
    """A rate rule as a track; a packet out of ``scope`` does not count."""
    n = F.col("n")
    where = rule.where if scope is None else scope & rule.where
    return Track(rule.name, RATE, where, tuple(rule.keys), rule.fires(n), rule.severity(n) if rule.severity else F.lit(1),
                 rule.details(n) if rule.details else None, rule.window_s, position=position)


def _tag(number: int, track: Track) -> Column:
    """The packet's part in a track, or null: only what differs between tracks."""
    values = F.array(*[v.cast("string") for v in track.values]) if track.values else F.lit(None).cast("array<string>")
    amount = F.lit(1) if track.kind == RATE else F.lit(0) if track.amount is None else track.amount
    also = F.lit(0) if track.also is None else track.also if track.kind == RUNNING else X.flag(track.also)
    return F.when(track.where, F.struct(
        F.lit(number).alias("track"), key_of(track.keys).cast("array<string>").alias("key"), amount.cast("long").alias("amount"),
        also.cast("long").alias("also"), values.alias("values")))


def tags(tracks: Sequence[Track]) -> Column:
    """All tracks a packet belongs to, as an array."""
    return F.array_compact(F.array(*[_tag(i, track) for i, track in enumerate(tracks)]))


def _of_track(tracks: Sequence[Track], value: Callable[[Track], int]) -> Column:
    """A number by track."""
    return F.element_at(F.lit([value(track) for track in tracks]).cast("array<long>"), F.col("track") + 1)


def events(packets: DataFrame, tracks: Sequence[Track], carry: Sequence[str]) -> DataFrame:
    """Tagged events of all tracks from one scan; what expires carries nothing."""
    row = F.struct("packet_id", "ts", *carry)
    tagged = packets.select(row.alias("row"), F.explode(tags(tracks)).alias("e")).select("e.*", "row").withColumns(
        {"at": X.micros(F.col("row.ts")), "seq": F.col("row.packet_id").cast("long"), "length": _of_track(tracks, lambda track: track.length)})
    arrives = F.struct("at", "seq", F.lit(1).alias("step"), "amount", F.col("row").alias("row"))
    expires = F.struct((F.col("at") + F.col("length")).alias("at"), F.lit(LAST).alias("seq"), F.lit(1).alias("step"),
                       F.lit(-1).cast("long").alias("amount"), F.lit(None).alias("row"))
    moments = F.when(_among(tracks, RATE), F.array(arrives, expires)).otherwise(F.array(arrives))
    rows = tagged.select(*KEYS, "length", "also", "values", F.explode(moments).alias("m")).select(*KEYS, "length", "also", "values", "m.*")
    return rows.withColumn("slice", X.floor_div(F.col("at"), F.col("length"))).drop("length")


def opened(sums: DataFrame, totals: Sequence[str], least: str) -> DataFrame:
    """For each (track, key, slice): ``totals`` of all earlier slices, and the least ``least`` of these and its own."""
    eras = sums.withColumn("era", X.floor_div(F.col("slice"), ERA))
    whole = eras.groupBy(*KEYS, "era").agg(*[F.sum(c).alias(c) for c in totals], F.min(least).alias(least))
    earlier = Window.partitionBy(*KEYS).orderBy("era").rowsBetween(Window.unboundedPreceding, -1)
    start = whole.select(*KEYS, "era", *[F.sum(c).over(earlier).alias(c) for c in totals], F.min(least).over(earlier).alias(least),
                         F.lit(0).alias("kind"))
    rows = start.unionByName(eras.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    order = Window.partitionBy(*KEYS, "era").orderBy("kind", "slice")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return (rows.withColumns({**{c: F.coalesce(F.sum(c).over(before), F.lit(0)) for c in totals},
                              least: F.min(least).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
            .where(F.col("kind") == 1).select(*PLACE, *totals, least))


def _among(tracks: Sequence[Track], *kinds: str) -> Column:
    return F.col("track").isin([i for i, track in enumerate(tracks) if track.kind in kinds])


def _changes(seen: DataFrame, tracks: Sequence[Track]) -> DataFrame:
    """When a value starts and stops to count for its key."""
    length = _of_track(tracks, lambda track: track.length)
    value = F.col("counted").isNotNull()
    firsts = (seen.where(_among(tracks, SEEN) & value).groupBy(*KEYS, "counted").agg(F.min("lo").alias("lo"), F.max("also").alias("also"))
              .select(*KEYS, F.col("lo.at").alias("at"), F.col("lo.seq").alias("seq"), F.lit(0).alias("step"),
                      F.lit(1).cast("long").alias("amount"), "also"))
    order = Window.partitionBy(*KEYS, "counted").orderBy("slice")
    spans = seen.where(_among(tracks, RECENT) & value).withColumns(
        {"since": F.col("lo.at") - F.lag("hi").over(order), "until": F.lead("lo.at").over(order) - F.col("hi")})

    def change(test: str, at: Column, seq: Column, step: int, amount: int) -> Column:
        return F.when(F.col(test).isNull() | (F.col(test) > length), F.struct(
            at.alias("at"), seq.alias("seq"), F.lit(step).alias("step"), F.lit(amount).cast("long").alias("amount")))
    moments = F.array_compact(F.array(change("since", F.col("lo.at"), F.col("lo.seq"), 0, 1),
                                      change("until", F.col("hi") + length, F.lit(LAST), 2, -1)))
    moves = spans.select(*KEYS, F.explode(moments).alias("m")).select(*KEYS, "m.*", F.lit(0).cast("long").alias("also"))
    return firsts.unionByName(moves).withColumn("slice", X.floor_div(F.col("at"), length))


def followed(packets: DataFrame, tracks: Sequence[Track], carry: Sequence[str] = ()) -> DataFrame:
    """track, n, also, values, first, packet_id, ts and the carried columns for every packet of every track.

    Tracks other than rates need the past of a key: their events are aggregated by (track, key, slice, value) first, and that table
    is written too. Results do not depend on the length of slices.
    """
    return state_of(written(events(packets, tracks, carry), "events"), tracks)


def fed(tagged: DataFrame, tracks: Sequence[Track], name: str) -> DataFrame:
    """Rows of a FEED: packet_id, ts and the carried columns."""
    number = next(i for i, track in enumerate(tracks) if track.name == name and track.kind == FEED)
    return tagged.where(F.col("track") == number).select("row.*")


def state_of(tagged: DataFrame, tracks: Sequence[Track]) -> DataFrame:
    """What ``followed`` returns, from written ``events``."""
    tagged = tagged.where(~_among(tracks, FEED))
    stateful = [track for track in tracks if track.kind not in (RATE, FEED)]
    blank = {"kind": F.lit(1), "first": F.lit(None).cast("array<string>")}
    if stateful:
        counted = F.when(_among(tracks, SEEN, RECENT), F.get("values", F.lit(0)))
        running = _among(tracks, RUNNING)
        seen = written(
            tagged.where(~_among(tracks, RATE)).groupBy(*PLACE, counted.alias("counted")).agg(
                F.sum(F.when(running, F.col("amount")).otherwise(0)).alias("amount"), F.sum(F.when(running, F.col("also")).otherwise(0)).alias("more"),
                F.max("also").alias("also"), F.min(F.struct("at", "seq", "values")).alias("lo"), F.max("at").alias("hi")), "sightings")
        changes = _changes(seen, tracks)
        first = F.when(_among(tracks, FIRST), F.col("lo"))
        parts = seen.select(*PLACE, "amount", F.col("more").alias("also"), first.alias("lo")).unionByName(
            changes.select(*PLACE, "amount", "also"), allowMissingColumns=True)
        sums = parts.groupBy(*PLACE).agg(F.sum("amount").alias("amount"), F.sum("also").alias("also"), F.min("lo").alias("lo"))
        openings = opened(sums, ["amount", "also"], "lo").select(
            *PLACE, "amount", "also", F.col("lo.values").alias("first"), F.lit(0).alias("kind"))
        # a probe of SEEN carries the flag of its own value, which only the value's first sighting adds
        tagged = tagged.withColumn("also", F.when(running, F.col("also")).otherwise(0))
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True),
                      [tagged.withColumns(blank), changes.withColumns(blank), openings])
    else:
        rows = tagged.withColumns(blank)
    order = Window.partitionBy(*PLACE).orderBy("kind", "at", "seq", "step")
    so_far, whole = order.rowsBetween(Window.unboundedPreceding, Window.currentRow), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # all rows that a slice of a rate starts with expire inside it
    alive = F.sum(F.when(_among(tracks, RATE) & (F.col("amount") < 0), 1).otherwise(0)).over(whole)
    out = rows.withColumns({"n": F.sum("amount").over(so_far) + alive, "also": F.sum("also").over(so_far),
                            "first": F.first("first", ignorenulls=True).over(so_far)})
    return out.where(F.col("row").isNotNull()).select("track", "n", "also", "values", "first", "row.*")


def fired(rows: DataFrame, tracks: Sequence[Track]) -> DataFrame:
    """Hits of all tracks: packet_id, layer, detector, position, rank, severity, details, n."""
    def pick(columns: Sequence[Column]) -> Column:
        chosen = F
        for i, c in enumerate(columns):
            chosen = chosen.when(F.col("track") == i, c)
        return chosen
    tracks = [track for track in tracks if track.kind != FEED]  # feeds come last
    fires = reduce(lambda a, b: a | b, [(F.col("track") == i) & track.fires for i, track in enumerate(tracks)])
    none = F.lit("")
    return rows.where(fires).select(
        "packet_id", pick([F.lit(t.layer) for t in tracks]).alias("layer"), pick([F.lit(t.name) for t in tracks]).alias("detector"),
        pick([F.lit(t.position) for t in tracks]).alias("position"), pick([F.lit(t.rank) for t in tracks]).alias("rank"),
        pick([t.severity.cast("double") for t in tracks]).alias("severity"),
        pick([none if t.details is None else t.details.cast("string") for t in tracks]).alias("details"), "n")
