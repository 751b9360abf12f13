"""One-second (or longer) buckets of a stream that lose no late packet.

A bucket is out once, as edition 1, when the watermark passes its end. Packets of a bucket that is already out open it again: each
trigger that brings some adds a row with the next edition and the counts of just these packets, as a detector does that flushes
what it has and starts anew. Editions add up to the whole bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from skywarden.functions import scalars as X
from skywarden.operators.buckets import COUNTS, ApplicationLimits, application_counts, application_label
from skywarden.session import ROCKSDB, ship_to_workers

ship_to_workers(__name__)
SUMS = ", ".join(f"{c} long" for c in COUNTS)


class Reopening(StatefulProcessor):
    """State of one (source, bucket): its counts until it is out, and the number of editions that are out."""

    def __init__(self, length_ms: int, keep_ms: int, columns: tuple[str, ...]):
        self.length, self.keep, self.columns = length_ms, keep_ms, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", ", ".join(f"{c} long" for c in self.columns))
        self.editions = handle.getValueState("editions", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        counts = sum((part[list(self.columns)].sum() for part in rows), start=0)
        end = (int(key[1]) + 1) * self.length
        if end <= timerValues.getCurrentWatermarkInMs():
            if self.open.exists():  # the timer of what came in time is due in this very trigger, after the rows
                before = self._out(key, list(self.open.get()))
                self.open.clear()
                yield before
            yield self._out(key, counts.tolist())
            return
        if self.open.exists():
            counts = counts + list(self.open.get())
        else:
            self.handle.registerTimer(end)
        self.open.update(tuple(int(x) for x in counts))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.open.exists():
            out = self._out(key, list(self.open.get()))
            self.open.clear()
            yield out
        else:
            if expiredTimerInfo.getExpiryTimeInMs() >= (int(key[1]) + 1) * self.length + self.keep:  # the editions are forgotten
                self.editions.clear()
            yield pd.DataFrame()

    def _out(self, key: tuple, counts: list[int]) -> pd.DataFrame:
        edition = 1 + (self.editions.get()[0] if self.editions.exists() else 0)
        if edition == 1:
            self.handle.registerTimer((int(key[1]) + 1) * self.length + self.keep)
        self.editions.update((edition,))
        return pd.DataFrame([[key[0], int(key[1]), *map(int, counts), edition]], columns=["src_ip", "bucket", *self.columns, "edition"])


def reopening_buckets(packets: DataFrame, seconds: int = 1, delay: str = "2 seconds", limits: ApplicationLimits = ApplicationLimits(),
                      keep_s: int = 86400, either_port: bool = False) -> DataFrame:
    """src_ip, window_start, the seven counts, src_ip_int, attack_label (of the edition's counts) and edition.

    A bucket's number of editions is remembered for ``keep_s`` seconds of event time after its end; later packets start at 1 again.
    """
    packets.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    counts = application_counts(packets.withWatermark("ts", delay), either_port)
    # without the event time itself, rows behind the watermark are not dropped
    rows = counts.select("src_ip", X.time_bucket("ts", seconds).alias("bucket"), *[F.col(c).cast("long").alias(c) for c in COUNTS])
    out = rows.groupBy("src_ip", "bucket").transformWithStateInPandas(
        Reopening(seconds * 1000, keep_s * 1000, COUNTS), StructType.fromDDL(f"src_ip string, bucket long, {SUMS}, edition long"), "Append", "EventTime")
    start = F.timestamp_micros(F.col("bucket") * (seconds * 1_000_000)).alias("window_start")
    return out.select("src_ip", start, *COUNTS, X.ipv4_to_int("src_ip").alias("src_ip_int"), application_label(limits).alias("attack_label"), "edition")
