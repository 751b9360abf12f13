"""Greedy suppression: keep a row, flag what follows it too closely, keep the next one, and so on.

A kept row ("anchor") silences rows within ``gap`` of it; silenced rows do not move the anchor. One key may hold a third
of all rows (a replay flood is one payload), so a chain is never walked over a whole key:

* Sessions (no pause longer than the gap) come from a map-side aggregate per gap-long slice. A session no longer than
  the gap has one anchor, its first row; nothing else is needed.
* A longer session of few rows is folded as one bounded array.
* A longer one is cut into blocks of time. Each block says, for every row that could be its first anchor, which row would be
  its last one. Blocks of blocks are composed the same way, each level some 256 times smaller than the one below.
  The chain is then walked at the top and handed down level by level, all blocks in parallel.
* Blocks are bounded in time, so a session with so many rows in a gap that a block could exceed ``GROUP_ROWS`` goes another
  way: every time points to the next possible anchor, pointers are squared until none is left, and the anchors are
  those that pointers of falling length reach from the first row. These are joins on times that occur once, balanced by rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from skywarden.functions import scalars as X
from skywarden.operators.ordered import to_micros
from skywarden.session import ship_to_workers, written

ship_to_workers(__name__)
FANOUT = 256
FOLD_ROWS = 256  # sessions up to this many rows are folded as one array
GROUP_ROWS = 500_000  # no block of a session holds more
ENTRY = "gid string, at long, id long, exit long"


def last_anchor(entry: np.ndarray, leave: np.ndarray, gap: int) -> np.ndarray:
    """For every entry, where the chain that starts there leaves the block."""
    following = np.searchsorted(entry, leave + gap, side="right")
    pointer = np.where(following < len(entry), following, np.arange(len(entry)))
    while True:
        further = pointer[pointer]
        if np.array_equal(further, pointer):
            return leave[pointer]
        pointer = further


def chain(entry: np.ndarray, leave: np.ndarray, start: int, gap: int) -> np.ndarray:
    """Positions of the anchors met when the chain enters the block at position ``start``."""
    met, at = [], start
    while at < len(entry):
        met.append(at)
        at = int(np.searchsorted(entry, leave[at] + gap, side="right"))
    return np.asarray(met, dtype=np.int64)


def _columns(table: pa.Table) -> dict[str, np.ndarray]:
    table = table.sort_by("at")
    return {name: table.column(name).to_numpy() for name in ("at", "id", "exit")}


def _entries(gid: pa.Scalar, at: np.ndarray, ids: np.ndarray, leave: np.ndarray) -> pa.Table:
    return pa.table({"gid": pa.array([gid.as_py()] * len(at), pa.string()), "at": pa.array(at, pa.int64()),
                     "id": pa.array(ids, pa.int64()), "exit": pa.array(leave, pa.int64())})


def _compose(entries: DataFrame, gap: int, length: int) -> DataFrame:
    """One level up: possible first anchors of each block of ``length`` with the block's last anchor."""
    def block(key: tuple, table: pa.Table) -> pa.Table:
        c = _columns(table)
        leave = last_anchor(c["at"], c["exit"], gap)
        # an anchor before the block silences at most its first ``gap``; one more row can be the first anchor
        n = int(np.searchsorted(c["at"], key[1].as_py() * length + gap, side="right")) + 1
        return _entries(key[0], c["at"][:n], c["id"][:n], leave[:n])
    return entries.groupBy("gid", X.floor_div(F.col("at"), length).alias("block")).applyInArrow(block, ENTRY)


def _hand_down(entries: DataFrame, starts: DataFrame | None, gap: int, length: int | None) -> DataFrame:
    """Entries that are anchors, given the first anchor of each block (none: the first entry of the session)."""
    def block(key: tuple, table: pa.Table) -> pa.Table:
        marked = table.column("start").to_numpy(zero_copy_only=False)
        c = _columns(table.filter(pa.array(~marked)))
        if length is None:
            start = 0
        elif marked.any():
            start = int(np.searchsorted(c["at"], table.column("at").to_numpy()[marked][0]))
        else:
            start = len(c["at"])
        met = chain(c["at"], c["exit"], start, gap)
        return _entries(key[0], c["at"][met], c["id"][met], c["exit"][met])
    rows = entries.withColumn("start", F.lit(False))
    if starts is not None:
        rows = rows.unionByName(starts.withColumn("start", F.lit(True)))
    block_of = F.lit(0) if length is None else X.floor_div(F.col("at"), length)
    return rows.groupBy("gid", block_of.alias("block")).applyInArrow(block, ENTRY)


def _folded(times: DataFrame, gap: int) -> DataFrame:
    """Anchors of sessions with at most ``FOLD_ROWS`` rows."""
    place = F.struct("at", "id")
    session = times.groupBy("gid").agg(F.sort_array(F.collect_list(place)).alias("rows"))
    anchors = F.aggregate("rows", F.slice("rows", 1, 1), lambda kept, row: F.when(
        row["at"] - F.element_at(kept, -1)["at"] > gap, F.array_append(kept, row)).otherwise(kept))
    return session.select("gid", F.explode(anchors).alias("a")).select("gid", "a.at", "a.id")


def _long_anchors(rows: DataFrame, gap: int, levels: int) -> DataFrame:
    ladder, lengths = [rows], []
    for level in range(1, levels + 1):
        lengths.append(gap * FANOUT**level)
        ladder.append(_compose(ladder[-1], gap, lengths[-1]))
    met = _hand_down(ladder[-1], None, gap, None)
    for entries, length in zip(reversed(ladder[:-1]), reversed(lengths)):
        met = _hand_down(entries, met, gap, length)
    return met


def _following(times: DataFrame, gap: int) -> DataFrame:
    """(gid, at, nxt): for every time of a session the first one more than ``gap`` later; times without one are left out.

    Times and the ends of their gaps are sorted together in ranges of equal size; a range that a gap's end is the last thing of
    takes the first time of the next range that has one.
    """
    ends = F.array(F.struct(F.col("at").alias("pos"), F.lit(0).alias("ends")), F.struct((F.col("at") + gap).alias("pos"), F.lit(1).alias("ends")))
    placed = written(times.select("gid", "at", F.inline(ends)).repartitionByRange("gid", "pos", "ends")
                     .withColumn("part", F.spark_partition_id()), "times")
    time = F.when(F.col("ends") == 0, F.col("pos"))
    later = Window.partitionBy("gid").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("gid", "part").agg(F.min(time).alias("first")).select(
        "gid", "part", F.last("first", ignorenulls=True).over(later).alias("beyond"))
    after = (Window.partitionBy("gid", "part").orderBy(F.desc("pos"), F.desc("ends"))
             .rowsBetween(Window.unboundedPreceding, -1))
    found = placed.withColumn("nxt", F.last(time, ignorenulls=True).over(after)).where("ends = 1").join(parts, ["gid", "part"])
    return found.select("gid", "at", F.coalesce("nxt", "beyond").alias("nxt")).where("nxt IS NOT NULL")


def _dense_anchors(times: DataFrame, heads: DataFrame, gap: int) -> DataFrame:
    """(gid, at) of the anchors of sessions that start at ``heads``, for any number of rows in a gap."""
    step, ladder = written(_following(times, gap), "pointers"), []
    while not step.isEmpty():
        ladder.append(step)
        # the chain meets only first rows and rows that something points to
        targets = step.select("gid", F.col("nxt").alias("at")).unionByName(heads).distinct()
        onward = step.select("gid", F.col("at").alias("nxt"), F.col("nxt").alias("far"))
        twice = step.join(targets, ["gid", "at"], "left_semi").join(onward, ["gid", "nxt"])
        step = written(twice.select("gid", "at", F.col("far").alias("nxt")), "pointers")
    met = heads
    for step in reversed(ladder):
        reached = F.filter(F.array("at", "nxt"), lambda t: t.isNotNull())
        met = met.join(step, ["gid", "at"], "left").select("gid", F.explode(reached).alias("at"))
    return met


def greedy_suppress(packets: DataFrame, keys: Sequence[str], gap_s: float, inclusive: bool = True,
                    levels: int = 2) -> DataFrame:
    """Add ``flagged`` and ``anchor_ts``, the kept row that silences a flagged one (its own time for a kept row).

    Inclusive: flagged when at most ``gap_s`` after the anchor; exclusive: less than ``gap_s``. Rows at one time count
    by packet id. Null keys equal each other. ``levels`` is the number of composed levels of blocks; results do not depend on it.
    The totals of the slices, and the pointers of dense sessions, are written to the shared folder first.
    """
    # one key column that is never null: rows with null keys form groups of their own
    named = F.to_json(F.struct(*keys), {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    packets, keys = packets.withColumn("_key", F.md5(named)), ["_key"]
    gap = to_micros(gap_s) - (0 if inclusive else 1)
    if gap < 0:  # nothing is less than no time after an anchor
        return packets.withColumns({"flagged": F.lit(False), "anchor_ts": F.col("ts")}).drop("_key")
    slice_of = X.floor_div(F.col("_at"), max(gap, 1))
    rows = packets.withColumn("_at", X.micros()).withColumn("_slice", slice_of)

    first = F.min(F.struct(F.col("_at").alias("at"), F.col("packet_id").alias("id")))
    slices = rows.groupBy(*keys, "_slice").agg(first.alias("lo"), F.max("_at").alias("hi"), F.count("*").alias("n"))
    order = Window.partitionBy(*keys).orderBy("_slice")
    opens = F.when(F.coalesce(F.col("lo.at") - F.lag("hi").over(order) > gap, F.lit(True)), F.col("lo"))
    slices = slices.withColumn("opens", opens).withColumn(
        "session", F.last("opens", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # rows of a key are already together: the session's end and size need no further shuffle
    whole = Window.partitionBy(*keys, "session")
    slices = written(slices.withColumns({"end": F.max("hi").over(whole), "total": F.sum("n").over(whole), "peak": F.max("n").over(whole)}), "slices")
    span = F.col("end") - F.col("session.at")
    is_long = span > gap
    short = slices.where(~is_long & F.col("opens").isNotNull()).select(
        *keys, F.col("session.at").alias("at"), F.col("session.id").alias("id"))

    group = F.struct(*keys, F.col("session.at").alias("_session"))
    # a block is entered by its rows, or by those of the first gap of each block below; the top has all blocks of a session
    blocks = F.greatest(F.lit(FANOUT), (span / (max(gap, 1) * FANOUT**levels)).cast("long")) + 2
    way = (F.when(F.col("total") <= FOLD_ROWS, "few").when(blocks * (F.col("peak") + 2) > GROUP_ROWS, "dense").otherwise("blocks"))
    long_slices = slices.where(is_long).select(
        *keys, "_slice", way.alias("way"), F.to_json(group).alias("gid"), F.col("session.at").alias("head"))
    times = (rows.select(*keys, "_slice", "_at", "packet_id").join(long_slices.drop("head"), [*keys, "_slice"])
             .groupBy("gid", "way", F.col("_at").alias("at")).agg(F.min("packet_id").alias("id")))
    many = times.where("way = 'blocks'").select("gid", "at", "id", F.col("at").alias("exit"))
    met = _folded(times.where("way = 'few'"), gap).unionByName(_long_anchors(many, gap, levels).drop("exit"))
    heads = long_slices.where("way = 'dense'").select("gid", F.col("head").alias("at")).distinct()
    if not heads.isEmpty():
        dense = written(times.where("way = 'dense'").drop("way"), "dense")
        met = met.unionByName(dense.join(_dense_anchors(dense.drop("id"), heads, gap), ["gid", "at"], "left_semi"))
    fields = [packets.schema[k] for k in keys]
    key_type = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    met = met.select(F.from_json("gid", key_type).alias("g"), "at", "id")
    anchors = short.unionByName(met.select(*[F.col(f"g.{k}").alias(k) for k in keys], "at", "id"))

    # anchors are more than a gap apart: a slice has at most its own and the one before it
    own = X.floor_div(F.col("at"), max(gap, 1))
    places = F.array(F.struct(own.alias("_slice"), F.lit(True).alias("here")),
                     F.struct((own + 1).alias("_slice"), F.lit(False).alias("here")))
    anchor = F.struct("at", "id")
    near = anchors.select("*", F.explode(places).alias("p")).select("*", "p.*").groupBy(*keys, "_slice").agg(
        F.max(F.when(F.col("here"), anchor)).alias("own"), F.max(F.when(~F.col("here"), anchor)).alias("before"))
    holds = (F.col("own.at") < F.col("_at")) | ((F.col("own.at") == F.col("_at")) & (F.col("own.id") <= F.col("packet_id")))
    chosen = F.when(F.coalesce(holds, F.lit(False)), F.col("own")).otherwise(F.col("before"))
    return (rows.join(near, [*keys, "_slice"]).withColumn("_anchor", chosen)
            .withColumns({"flagged": F.col("_anchor.id") != F.col("packet_id"),
                          "anchor_ts": F.timestamp_micros(F.col("_anchor.at"))})
            .drop("_key", "_at", "_slice", "own", "before", "_anchor"))
