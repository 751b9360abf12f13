"""Streaming forms of the ordered operators, one state per key.

Rows of one trigger are put in (time, packet id) order; a stream that arrives in time order gives the batch results.
State survives restarts in the query's checkpoint. Keys idle for longer than ``idle`` are forgotten; the default never
forgets, which is what the batch operators do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skywarden.functions import scalars as X
from skywarden.operators.ordered import to_micros
from skywarden.operators.sequence import CONNECTION
from skywarden.session import ship_to_workers

ship_to_workers(__name__)
Step = Callable[[tuple, pd.DataFrame, tuple | None], tuple[pd.DataFrame, tuple]]


def _trailing_rate(window: int) -> Step:
    """State: the times still inside the window."""
    def step(key: tuple, new: pd.DataFrame, state: tuple | None) -> tuple[pd.DataFrame, tuple]:
        old = np.asarray(state[0] if state else [], dtype=np.int64)
        mine = new["at"].to_numpy(dtype=np.int64)
        merged = np.sort(np.concatenate([old, mine]))
        # place of a new row among all: stored times up to it, and the new rows before it
        place = np.searchsorted(old, mine, side="right") + np.arange(1, len(mine) + 1)
        rate = place - np.searchsorted(merged, mine - window, side="left")
        kept = merged[merged >= merged[-1] - window]
        return pd.DataFrame({"key": key[0], "packet_id": new["packet_id"], "rate": rate}), (kept.tolist(),)
    return step


def _greedy_suppress(gap: int) -> Step:
    """State: the time of the last kept row."""
    def step(key: tuple, new: pd.DataFrame, state: tuple | None) -> tuple[pd.DataFrame, tuple]:
        times = new["at"].to_numpy(dtype=np.int64)
        anchor = state[0] if state else None
        flagged, since = np.ones(len(times), dtype=bool), np.zeros(len(times), dtype=np.int64)
        at = 0
        while at < len(times):
            if anchor is not None:  # everything up to the end of the gap is flagged at once
                end = max(at, int(np.searchsorted(times, anchor + gap, side="right")))
                since[at:end] = anchor
                at = end
            if at < len(times):
                anchor = int(times[at])
                flagged[at], since[at] = False, anchor
                at += 1
        out = pd.DataFrame({"key": key[0], "packet_id": new["packet_id"], "flagged": flagged, "anchor": since})
        return out, (anchor,)
    return step


def _sequence(threshold: int) -> Step:
    """State: (expected, counter, established) of the connection."""
    def step(key: tuple, new: pd.DataFrame, state: tuple | None) -> tuple[pd.DataFrame, tuple]:
        expected, counter, established = state or (0, 0, False)
        alerts = []
        for packet, seq, size, resets in zip(*(new[c].tolist() for c in ("packet_id", "tcp_seq", "size", "resets"))):
            if resets:
                expected, established = seq + 1, True
            elif established:
                wrong = seq != expected
                counter = counter + 1 if wrong else max(0, counter - 1)
                if wrong and counter > threshold:
                    alerts.append((packet, counter, expected, seq))
                elif size:
                    expected = seq + size
        out = pd.DataFrame(alerts, columns=["packet_id", "anomalies", "expected", "got"], dtype="int64")
        out.insert(0, "key", key[0])
        return out, (expected, counter, established)
    return step


def _keyed(packets: DataFrame, keys: list[str | Column], *more: Column) -> DataFrame:
    text = F.to_json(F.struct(*[X.col(k).alias(f"k{i}") for i, k in enumerate(keys)]))
    return packets.select(text.alias("key"), X.micros().alias("at"), "packet_id", *more)


def _run(rows: DataFrame, step: Step, schema: str, state_schema: str, idle_ms: int | None) -> DataFrame:
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        new = pd.concat(list(frames), ignore_index=True).sort_values(["at", "packet_id"], ignore_index=True)
        out, after = step(key, new, state.get if state.exists else None)
        state.update(after)
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield out
    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return rows.groupBy("key").applyInPandasWithState(run, schema, state_schema, "append", timeout)


def stream_rates(packets: DataFrame, keys: list[str | Column], window_s: float, idle_ms: int | None = None) -> DataFrame:
    return _run(_keyed(packets, keys), _trailing_rate(to_micros(window_s)), "key STRING, packet_id BIGINT, rate BIGINT",
                "times ARRAY<BIGINT>", idle_ms)


def stream_suppress(packets: DataFrame, keys: list[str | Column], gap_s: float, inclusive: bool = True,
                    idle_ms: int | None = None) -> DataFrame:
    gap = to_micros(gap_s) - (0 if inclusive else 1)
    return _run(_keyed(packets, keys), _greedy_suppress(gap), "key STRING, packet_id BIGINT, flagged BOOLEAN, anchor BIGINT",
                "anchor BIGINT", idle_ms)


def stream_sequence_alerts(packets: DataFrame, threshold: int = 5, keys: tuple[str, ...] = CONNECTION,
                           idle_ms: int | None = None) -> DataFrame:
    resets = F.col("tcp_flags").bitwiseAND(F.lit(X.SYN | X.ACK)) != 0
    rows = _keyed(packets.where(X.is_tcp() & F.col("tcp_seq").isNotNull()), list(keys), F.col("tcp_seq").cast("long").alias("tcp_seq"),
                  X.payload_size().alias("size"), X.flag(resets).alias("resets"))
    schema = "key STRING, packet_id BIGINT, anomalies BIGINT, expected BIGINT, got BIGINT"
    return _run(rows, _sequence(threshold), schema, "expected BIGINT, counter BIGINT, established BOOLEAN", idle_ms)


def first_sightings(packets: DataFrame, keys: list[str], value: str, expires: str | None = None) -> DataFrame:
    """Each (key, value) once, when first seen. The state is spread over (key, value), so no key grows in one place.

    ``expires`` (an event-time delay) forgets sightings, and so reports a value again later.
    """
    if expires is None:
        return packets.select(*keys, value).dropDuplicates([*keys, value])
    return packets.withWatermark("ts", expires).select(*keys, value, "ts").dropDuplicatesWithinWatermark([*keys, value])


def approximate_rates(packets: DataFrame, key: str, window: str, slide: str, delay: str) -> DataFrame:
    """Counts per sliding window: cheaper than exact rates, at the grain of ``slide``."""
    counts = packets.withWatermark("ts", delay).groupBy(F.window("ts", window, slide), key).agg(F.count("*").alias("n"))
    return counts.withColumn("window_start", F.col("window.start")).drop("window")
