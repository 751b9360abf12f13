"""Writers for logs, alerts and reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from skywarden import schema as S
from skywarden.functions import scalars as X

# Time style of each layer's log text.
TIME_STYLE = {"network": "millis", "internet": "millis", "transport": "iso_micros", "application": "iso",
              "drone_network": "seconds", "drone_internet": "seconds", "drone_transport": "seconds",
              "drone_application": "seconds"}


def log_columns(log: DataFrame, layer: str, time: str = "ts") -> DataFrame:
    """The layer's log columns in order, with the time as text."""
    out = log.withColumn("timestamp", X.time_text(time, TIME_STYLE[layer]))
    if layer.startswith("drone_"):
        names = {"details": "attack_details"}
        if layer == "drone_internet":
            out = out.drop("packet_id")
            names["ip_id"] = "packet_id"
        out = out.withColumnsRenamed(names)
    fields = [part.split() for part in S.LOGS[layer].split(", ")]
    return out.select(*[F.col(name).cast(kind.lower()).alias(name) for name, kind in fields])


def append_log(log: DataFrame, path: str, layer: str, fmt: str = "parquet", time: str = "ts") -> None:
    """Add rows to a layer log. Parquet logs are partitioned by date, so readers can skip days."""
    _write(log, path, layer, fmt, "append", time)


def replace_log(log: DataFrame, path: str, layer: str, fmt: str = "parquet", time: str = "ts") -> None:
    _write(log, path, layer, fmt, "overwrite", time)


def _write(log: DataFrame, path: str, layer: str, fmt: str, mode: str, time: str) -> None:
    rows = log_columns(log, layer, time)
    if fmt == "csv":
        rows.write.mode(mode).option("header", True).csv(path)
    else:
        dated = rows.withColumn("date", F.substring("timestamp", 1, 10))
        dated.write.mode(mode).partitionBy("date").format(fmt).save(path)


def write_alerts(log: DataFrame, path: str) -> None:
    """Rows whose verdict is not NORMAL."""
    log.where(F.col("attack_type") != "NORMAL").write.mode("append").parquet(path)


def stream_alerts(alerts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Alerts of a stream, written once per packet: a batch that is run again replaces its own folder."""
    def save(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates(["packet_id"]).write.mode("overwrite").parquet(f"{path}/batch={number}")
    return (alerts.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def stream_verdicts(hits: DataFrame, path: str, checkpoint: str, resolve: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Alerts of a stream of hits. All hits of a packet are in one batch, so each batch is resolved by itself; a packet has one row in
    each layer, and a batch that is run again replaces its own folder. The hits are kept on disk meanwhile: ``resolve`` may read them more
    than once, and each time would go through the state again."""
    def save(batch: DataFrame, number: int) -> None:
        found = batch.persist(StorageLevel.DISK_ONLY)
        try:
            resolve(found).write.mode("overwrite").parquet(f"{path}/batch={number}")
        finally:
            found.unpersist()
    return (hits.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def write_report(report: DataFrame, path: str) -> None:
    """The one-row report as JSON."""
    report.write.mode("overwrite").json(path)
