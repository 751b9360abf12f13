"""Tracks over a stream: all detectors of all layers as one stateful operator.

A packet becomes a tagged row for each track it belongs to, and each (track, key) keeps its own state:

* a rate keeps the times of its rows in slices of the window: one map entry with a slice's count, one with its times. A trigger reads the
  counts and the few slices it cuts, writes the slices it adds to, and drops those the window has left;
* values seen so far are a set; values in a window are a map from value to last time, which loses what the window has left;
* running sums and a key's first values are one small value.

With a ``delay`` the stream has a watermark, and an event-time timer removes what a silent key keeps. Without one, nothing is forgotten.
Rows of a trigger are put in (time, packet id) order; a stream that arrives in time order gives the batch results. A key's rows go through
its state in blocks (``runs``), so what a worker holds does not grow with a trigger.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from skywarden.functions import scalars as X
from skywarden.operators.ordered import LAST
from skywarden.operators.tracks import FEED, KEYS, RATE, RECENT, SEEN, Track, fired, tags
from skywarden.session import ROCKSDB, ship_to_workers
from skywarden.streaming.runs import COLUMNS, in_order

ship_to_workers(__name__)
OUT = "track int, n long, also long, values array<string>, first array<string>, at long, row string"
SLICES = 16  # of a window
# One store for each partition and executor: together they get so much, however many partitions there are.
BOUNDED = {"spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true", "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128"}


class Following(StatefulProcessor):
    """State of one (track, key); ``kinds`` and ``windows`` (microseconds) are by track."""

    def __init__(self, kinds: list[str], windows: list[int], timers: bool):
        self.kinds, self.windows, self.timers = kinds, windows, timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", "slice long", "n long")
        self.times = handle.getMapState("times", "slice long", "times array<long>")
        self.last = handle.getMapState("last", "value string", "at long")
        self.total = handle.getValueState("total", "n long, also long, first array<string>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        track = int(key[0])
        kind, window = self.kinds[track], self.windows[track]
        state = (_Rate(self.counts, self.times, window) if kind == RATE else _Recent(self.last, window) if kind == RECENT else
                 _Seen(self.last, self.total) if kind == SEEN else _Running(self.total))
        newest = None
        for new in in_order(frame[list(COLUMNS)] for frame in rows):
            at = new["at"].to_numpy(np.int64)
            n, also, first = state.step(at, new)
            newest = int(at.max()) if newest is None else max(newest, int(at.max()))
            yield pd.DataFrame({"track": track, "n": n, "also": also, "values": new["values"], "first": [first] * len(at),
                                "at": new["at"], "row": new["row"]})
        state.keep()
        if self.timers and kind in (RATE, RECENT):
            self._wake_after(newest + window)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """The watermark has passed all that the key keeps."""
        for state in (self.counts, self.times, self.last):
            state.clear()
        yield pd.DataFrame()

    def _wake_after(self, micros: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(micros // 1000 + 1)


# What a key keeps, over the blocks of a trigger: read when a block first needs it, written once after the last block. Blocks come in order,
# so what the window has left in one of them is dropped there.
Found = tuple[np.ndarray, np.ndarray, list[str | None] | None]  # n, also, first


class _Rate:
    def __init__(self, counts, times, window: int):
        self.stored, self.times, self.window, self.length = counts, times, window, max(1, window // SLICES)
        self.counts = {slice_[0]: n[0] for slice_, n in counts.iterator()}
        self.before, self.unread = set(self.counts), set(self.counts)
        self.held: dict[int, np.ndarray] = {}
        self.changed: set[int] = set()

    def _read(self, slice_: int) -> None:
        if slice_ in self.unread:
            self.unread.discard(slice_)
            self.held[slice_] = np.array(self.times.getValue((slice_,))[0], np.int64)

    def step(self, at: np.ndarray, new: pd.DataFrame) -> Found:
        own = at // self.length
        order = np.argsort(own, kind="stable")  # rows without a time come last
        mine, since = np.unique(own[order], return_index=True)
        for s in np.unique(np.concatenate([mine, (at - self.window) // self.length])).tolist():
            self._read(s)
        for s, times in zip(mine.tolist(), np.split(at[order], since[1:])):
            self.held[s] = np.sort(np.concatenate([self.held[s], times]), kind="stable") if s in self.held else times
            self.counts[s] = len(self.held[s])
            self.changed.add(s)
        slices = np.array(sorted(self.counts), np.int64)
        before = np.concatenate([[0], np.cumsum([self.counts[s] for s in slices.tolist()])]).astype(np.int64)
        read = np.array(sorted(self.held), np.int64)
        times = np.concatenate([self.held[s] for s in read.tolist()])  # slices follow each other, so this is in order
        starts = np.concatenate([[0], np.cumsum([len(self.held[s]) for s in read.tolist()])]).astype(np.int64)

        def up_to(moments: np.ndarray, side: str) -> np.ndarray:
            """Rows of the key before each time (left) or up to it (right)."""
            own = moments // self.length
            place = np.searchsorted(read, own)
            known = read[np.minimum(place, len(read) - 1)] == own
            inside = np.where(known, np.searchsorted(times, moments, side=side) - starts[place], 0)
            return before[np.searchsorted(slices, own)] + inside
        after = np.searchsorted(at, at, side="right") - 1 - np.arange(len(at))  # rows at one time count in packet order
        n = up_to(at, "right") - after - up_to(at - self.window, "left")
        gone = (int(at.max()) - self.window) // self.length
        for s in slices[slices < gone].tolist():
            del self.counts[s]
            self.held.pop(s, None)
        return n, np.zeros(len(at), np.int64), None

    def keep(self) -> None:
        for s in sorted(self.before - self.counts.keys()):
            self.stored.removeKey((s,))
            self.times.removeKey((s,))
        for s in sorted(self.changed & self.counts.keys()):
            self.stored.updateValue((s,), (self.counts[s],))
            self.times.updateValue((s,), (self.held[s].tolist(),))


class _Recent:
    def __init__(self, last, window: int):
        self.stored, self.window = last, window
        self.last = {value[0]: when[0] for value, when in last.iterator()}
        self.changed: set[str] = set()

    def step(self, at: np.ndarray, new: pd.DataFrame) -> Found:
        """A value counts from its first sighting's row on, until its last sighting leaves the window: ups and downs by row, added up."""
        codes, values = pd.factorize(_first_values(new["values"]))
        rows = np.argsort(codes, kind="stable")
        rows = rows[np.searchsorted(codes[rows], 0):]  # null is no value
        code, times = codes[rows], at[rows]
        opens = np.diff(code, prepend=-1) != 0  # a value's first row here, and its last one
        closes = np.diff(code, append=-1) != 0
        known = [self.last.get(value) for value in values]
        earlier = np.roll(times, 1)
        earlier[opens] = [at[0] if when is None else when for when in known]
        unknown = np.zeros(len(times), bool)
        unknown[opens] = [when is None for when in known]
        fresh = unknown | (times - earlier > self.window)
        sighted = dict(zip(values, times[closes].tolist()))
        held = np.array(list(self.last.values()), np.int64)
        silent = np.array([when for value, when in self.last.items() if value not in sighted], np.int64)
        ups = np.concatenate([rows[fresh], np.searchsorted(at, held, side="left")])
        left = np.concatenate([earlier[fresh & ~unknown], times[closes], silent]) + self.window
        downs = np.searchsorted(at, left, side="right")
        changes = np.bincount(ups, minlength=len(at) + 1) - np.bincount(downs, minlength=len(at) + 1)
        n = np.cumsum(changes[:-1])
        self.last.update(sighted)
        self.changed.update(sighted)
        oldest = int(at.max()) - self.window
        for value, when in [(value, when) for value, when in self.last.items() if when < oldest]:
            del self.last[value]
            if value in self.changed:  # what this trigger brought stays stored until a trigger without it
                self.changed.discard(value)
                self.stored.updateValue((value,), (when,))
            else:
                self.stored.removeKey((value,))
        return n, np.zeros(len(at), np.int64), None

    def keep(self) -> None:
        for value in self.changed:
            self.stored.updateValue((value,), (self.last[value],))


class _Seen:
    def __init__(self, known, total):
        self.stored, self.total, self.known = known, total, set()
        self.n, self.also, _ = total.get() if total.exists() else (0, 0, None)

    def step(self, at: np.ndarray, new: pd.DataFrame) -> Found:
        codes, values = pd.factorize(_first_values(new["values"]))
        _, rows = np.unique(codes[codes >= 0], return_index=True)  # by code, so by value
        rows = np.flatnonzero(codes >= 0)[rows]
        fresh = np.zeros(len(at), np.int64)
        for row, value in zip(rows.tolist(), values):
            if value in self.known:
                continue
            self.known.add(value)
            if not self.stored.containsKey((value,)):
                fresh[row] = 1
                self.stored.updateValue((value,), (0,))
        n, also = self.n + np.cumsum(fresh), self.also + np.cumsum(fresh * new["also"].to_numpy(np.int64))
        self.n, self.also = int(n[-1]), int(also[-1])
        return n, also, None

    def keep(self) -> None:
        self.total.update((self.n, self.also, None))


class _Running:
    def __init__(self, total):
        self.total, self.sums = total, total.get() if total.exists() else None

    def step(self, at: np.ndarray, new: pd.DataFrame) -> Found:
        n, also, first = self.sums or (0, 0, new["values"].iloc[0])
        n, also = n + new["amount"].to_numpy(np.int64).cumsum(), also + new["also"].to_numpy(np.int64).cumsum()
        first = None if first is None else list(first)
        self.sums = (int(n[-1]), int(also[-1]), first)
        return n, also, first

    def keep(self) -> None:
        self.total.update(self.sums)


def _first_values(values: pd.Series) -> np.ndarray:
    """The first of each row's values; null where there is none."""
    return np.array([None if value is None else value[0] for value in values], object)


def stream_followed(packets: DataFrame, tracks: Sequence[Track], carry: Sequence[str] = (), delay: str | None = None) -> DataFrame:
    """What ``followed`` gives for a table: track, n, also, values, first, packet_id, ts and the carried columns."""
    if any(track.kind == FEED for track in tracks):
        raise ValueError("tracks that feed other operators have no state of their own")
    spark = packets.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    for name, value in BOUNDED.items():
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, value)
    if delay is not None:
        packets = packets.withWatermark("ts", delay)
    row = F.struct("packet_id", *carry)
    schema = packets.select(row.alias("row")).schema["row"].dataType
    # a packet's row is made a text once, before its tags part
    texts = packets.select("ts", F.coalesce(F.col("packet_id").cast("long"), F.lit(LAST)).alias("seq"), F.to_json(row).alias("row"), tags(tracks).alias("tags"))
    tagged = texts.select("ts", "seq", "row", F.explode("tags").alias("e"))
    rows = tagged.select("e.track", F.to_json(F.struct("e.key"), {"ignoreNullFields": "false"}).alias("key"), X.micros("ts").alias("at"),
                         "seq", "e.amount", "e.also", "e.values", "ts", "row")
    processor = Following([track.kind for track in tracks], [track.length for track in tracks], delay is not None)
    out = rows.groupBy(*KEYS).transformWithStateInPandas(
        processor, StructType.fromDDL(OUT), "Append", "None" if delay is None else "EventTime")
    return out.withColumn("row", F.from_json("row", schema)).select(
        "track", "n", "also", "values", "first", "row.*", F.timestamp_micros("at").alias("ts"))


def stream_hits(packets: DataFrame, tracks: Sequence[Track], carry: Sequence[str] = (), delay: str | None = None) -> DataFrame:
    """Hits of all tracks as they arise. All hits of a packet come out of the trigger that reads it."""
    return fired(stream_followed(packets, tracks, carry, delay), tracks)
