"""Streams over several triggers give the batch results; a late row of a closed bucket is dropped."""

from __future__ import annotations

import random
import time

import pandas as pd
from pyspark.sql import functions as F

from skywarden.operators import buckets, ordered
from skywarden.operators.sequence import sequence_alerts
from skywarden.operators.suppress import greedy_suppress
from skywarden.operators.tracks import FIRST, RATE, RECENT, RUNNING, SEEN, Track, followed
from skywarden.sources import sinks
from skywarden.sources.readers import stream_packets
from skywarden.streaming import buckets as sb, late, runs, stateful
from skywarden.streaming.following import Following, stream_followed
from skywarden.streaming.replay import run_to_end


def written_in_parts(frames, rows, folder, parts=4):
    step = len(rows) // parts
    for i in range(parts):
        part = [{**r, "packet_id": i * step + j} for j, r in enumerate(rows[i * step:(i + 1) * step])]
        frames(part).coalesce(1).write.mode("append").parquet(folder)


def traffic(seed=1, n=80):
    rng = random.Random(seed)
    return [{"at": i / 4, "src_ip": rng.choice("aab"), "ip_proto": 6, "sport": 1, "dport": 80, "tcp_flags": rng.choice([0, 0, 0, 2]),
             "tcp_seq": rng.randrange(3), "payload": b"x" * rng.randrange(2)} for i in range(n)]


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_stateful_streams_equal_batch(spark, frames, tmp_path):
    folder = str(tmp_path / "packets")
    written_in_parts(frames, traffic(), folder)
    batch = spark.read.parquet(folder)

    def stream():
        return stream_packets(spark, folder, files_per_trigger=1)
    rates = run_to_end(stateful.stream_rates(stream(), ["src_ip"], 3), "rates")
    assert rows_of(rates, "packet_id", "rate") == rows_of(ordered.rate_over(batch, ["src_ip"], 3), "packet_id", "rate")
    kept = run_to_end(stateful.stream_suppress(stream(), ["src_ip"], 1), "kept")
    assert rows_of(kept, "packet_id", "flagged") == rows_of(
        greedy_suppress(batch.select("packet_id", "ts", "src_ip"), ["src_ip"], 1), "packet_id", "flagged")
    columns = ("packet_id", "anomalies", "expected", "got")
    alerts = run_to_end(stateful.stream_sequence_alerts(stream(), 2, ("src_ip",)), "alerts")
    want = rows_of(sequence_alerts(batch, 2, ["src_ip"]), *columns)
    assert want and rows_of(alerts, *columns) == want


def test_buckets_close_with_the_watermark(spark, frames, tmp_path):
    folder = str(tmp_path / "packets")
    rows = traffic()
    written_in_parts(frames, rows, folder)
    frames([{**rows[0], "packet_id": 999}]).coalesce(1).write.mode("append").parquet(folder)  # late, bucket long closed
    out = run_to_end(sb.application_stream(stream_packets(spark, folder, files_per_trigger=1)), "buckets")
    batch = buckets.application_buckets(frames(rows)).where(F.col("window_start") < F.timestamp_micros(F.lit(1_704_067_217_000_000)))
    assert rows_of(out, "window_start", "src_ip", "http_reqs") == rows_of(batch, "window_start", "src_ip", "http_reqs")


def every_kind() -> list[Track]:
    always, none = F.lit(True), F.lit(0)
    size = F.octet_length("payload")
    return [
        Track("rate", RATE, always, ("src_ip",), always, none, window_s=3),
        Track("recent", RECENT, always, ("src_ip", "ip_proto"), always, none, window_s=2, values=(F.col("tcp_seq"),)),
        Track("seen", SEEN, F.col("tcp_flags") == 0, ("src_ip",), always, none, values=(F.col("dport"),), also=F.col("dport") < 3),
        Track("running", RUNNING, always, ("src_ip",), always, none, amount=size, also=F.lit(1)),
        Track("first", FIRST, always, ("src_ip",), always, none, values=(F.col("dport"), F.col("src_mac")))]


COLUMNS = ("track", "packet_id", "n", "also", "first", "sport")


def tracked(df):
    return sorted((r.track, r.packet_id, r.n, r.also, tuple(r.first or ()), r.sport) for r in df.select(*COLUMNS).collect())


def sources(seed: int) -> list[dict]:
    rng = random.Random(seed)
    rows = [{**r, "dport": rng.choice([None, 1, 2, 3, 4, 5]), "src_mac": rng.choice([None, "m"])} for r in traffic(seed, 90)]
    for i in rng.sample(range(1, 90), 20):  # equal times
        rows[i]["at"] = rows[i - 1]["at"]
    return rows


def run(stream, folder, checkpoint):
    stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(
        availableNow=True).start().awaitTermination()


def test_tracks_over_triggers_and_a_restart_equal_the_batch(spark, frames, tmp_path):
    rows = sources(2)
    folder, out, checkpoint = (str(tmp_path / x) for x in ("packets", "out", "state"))
    tracks = every_kind()

    def stream():
        return stream_followed(stream_packets(spark, folder, files_per_trigger=1), tracks, ["sport"])
    for part in (rows[:30], rows[30:60], rows[60:]):
        start = rows.index(part[0])
        frames([{**r, "packet_id": start + i} for i, r in enumerate(part)]).coalesce(1).write.mode("append").parquet(folder)
        if part is not rows[30:60]:
            run(stream(), out, checkpoint)
    batch = followed(spark.read.parquet(folder), tracks, ["sport"])
    assert tracked(spark.read.schema(stream().schema).parquet(out)) == tracked(batch)


def test_a_silent_key_leaves_no_state(spark, frames, tmp_path):
    folder, out, checkpoint = (str(tmp_path / x) for x in ("packets", "out", "state"))
    tracks = every_kind()[:2]
    for at, source in ((0, "idle"), (20, "busy"), (40, "busy")):
        frames([{"at": at + i / 10, "src_ip": source, "tcp_seq": i, "packet_id": at + i} for i in range(5)]).coalesce(1).write.mode("append").parquet(folder)
        run(stream_followed(stream_packets(spark, folder, files_per_trigger=1), tracks, delay="1 second"), out, checkpoint)
    assert spark.read.parquet(out).count() == 30
    for name in ("counts", "last"):
        state = spark.read.format("statestore").option("stateVarName", name).load(checkpoint)
        keys = {r.key.key for r in state.select("key").collect()}
        assert keys and not any("idle" in key for key in keys)


def test_late_packets_open_their_bucket_again(spark, frames, tmp_path):
    folder = str(tmp_path / "packets")
    http = {"src_ip": "10.0.0.1", "ip_proto": 6, "dport": 80, "payload": b"GET /"}
    for i, times in enumerate(([0.1, 0.2, 10], [0.3, 0.4, 20], [0.5, 20.5], [40])):
        frames([{**http, "at": at, "packet_id": 10 * i + j} for j, at in enumerate(times)]).coalesce(1).write.mode("append").parquet(folder)
    found = run_to_end(late.reopening_buckets(stream_packets(spark, folder, files_per_trigger=1)), "late")
    rows = sorted((r.window_start.second, r.edition, r.http_reqs) for r in found.collect())
    assert rows == [(0, 1, 2), (0, 2, 2), (0, 3, 1), (10, 1, 1), (20, 1, 2)]


class Kept:
    """A state store's handle that keeps all in dicts."""

    def __init__(self):
        self.maps = {}

    def getMapState(self, name, *_):  # noqa: N802
        return self.maps.setdefault(name, KeptMap())

    def getValueState(self, name, *_):  # noqa: N802
        return self.getMapState(name)


class KeptMap(dict):
    def iterator(self):
        return iter(list(self.items()))

    def getValue(self, key):  # noqa: N802
        return dict.get(self, key)

    def containsKey(self, key):  # noqa: N802
        return key in self

    def updateValue(self, key, value):  # noqa: N802
        self[key] = value

    def removeKey(self, key):  # noqa: N802
        self.pop(key, None)

    def exists(self):
        return "value" in self

    def get(self):
        return self["value"]

    def update(self, value):
        self["value"] = value


def key_rows(at, values):
    return pd.DataFrame({"at": at, "seq": range(len(at)), "amount": 1, "also": 0, "values": [[v] for v in values],
                         "ts": pd.to_datetime(at, unit="us"), "row": [str(i) for i in range(len(at))]})


def handled(kind, window, *triggers):
    """(row, n) of one key over triggers of frames, and the largest frame that came out."""
    operator = Following([kind], [window], False)
    operator.init(Kept())
    out = [frame for frames in triggers for frame in operator.handleInputRows((0, "k"), iter(frames), None)]
    return sorted((int(r), int(n)) for frame in out for r, n in zip(frame["row"], frame["n"])), max(map(len, out))


def test_one_tie_among_many_rows_of_a_key():
    at = [10 * i for i in range(300_000)]
    at[1] = at[0]
    began = time.monotonic()
    got, _ = handled(RECENT, 100, [key_rows(at, [str(i % 7) for i in range(len(at))])])
    assert time.monotonic() - began < 30  # a pass over all rows for each time takes minutes
    assert [n for _, n in got[:9]] == [1, 2, 3, 4, 5, 6, 7, 7, 7]


def test_a_large_trigger_is_handled_in_blocks():
    rng = random.Random(3)
    at = sorted(rng.randrange(40_000) for _ in range(120_000))  # many at one time
    rows = key_rows(at, [rng.choice([None, *"abcdefghijklmnop"]) for _ in at])
    parts = [rows.iloc[order] for order in (slice(1, None, 2), slice(0, None, 2))]  # not in order
    window = 9
    for kind, want in ((RECENT, lambda i, first: rows["values"][first:i + 1].map(lambda v: v[0]).nunique()), (RATE, lambda i, first: i - first + 1)):
        got, largest = handled(kind, window, [part.iloc[k:k + 10_000] for part in parts for k in range(0, len(part), 10_000)])
        assert len(got) == len(at) and largest < 60_000
        for i in [*range(0, len(at), 997), len(at) - 1]:
            assert got[i] == (i, want(i, rows["at"].searchsorted(at[i] - window)))
        halves = [rows.iloc[:70_000]], [rows.iloc[70_000:]]
        assert handled(kind, window, *halves)[0] == got


def test_tracks_in_merged_blocks_equal_the_batch(spark, frames, tmp_path, monkeypatch):
    for name, value in (("RUN", 7), ("PIECE", 2), ("FAN", 3)):
        monkeypatch.setattr(runs, name, value)
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(setting)
    spark.conf.set(setting, "3")
    folder = str(tmp_path / "packets")
    rows = [{**r, "at": i // 3 / 4} for i, r in enumerate(traffic(n=160))]
    written_in_parts(frames, rows, folder, parts=2)
    try:
        out = run_to_end(stream_followed(stream_packets(spark, folder), every_kind(), ["sport"]), "tracks")
        assert tracked(out) == tracked(followed(spark.read.parquet(folder), every_kind(), ["sport"]))
    finally:
        spark.conf.set(setting, usual)


def test_hits_go_through_the_state_once(spark, frames, tmp_path):
    folder = str(tmp_path / "packets")
    written_in_parts(frames, traffic(), folder, parts=1)
    runs_of_rows = spark.sparkContext.accumulator(0)

    def seen(number):
        runs_of_rows.add(1)
        return number
    hits = stream_packets(spark, folder).select("packet_id", F.udf(seen, "long")("packet_id").alias("n"))
    sinks.stream_verdicts(hits, str(tmp_path / "out"), str(tmp_path / "state"),
                          lambda found: found.where("n % 2 = 0").unionByName(found.where("n % 2 = 1"))).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 80
    assert runs_of_rows.value == 80


def test_rows_without_a_time_come_last_in_any_number():
    rows = key_rows(range(60_000), ["a"] * 60_000)
    rows["at"] = rows["at"].where(rows["at"] % 7 != 0)
    got = list(runs.in_order(rows.iloc[k:k + 9_000] for k in range(0, 60_000, 9_000)))
    assert len(got) > 1 and [r for block in got for r in block["row"]] == [*(str(i) for i in range(60_000) if i % 7), *(str(i) for i in range(0, 60_000, 7))]
    assert sum(int(block["at"].isna().sum()) for block in got) == 8572
