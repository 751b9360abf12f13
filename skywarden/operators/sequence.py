"""TCP sequence machine: rows of a connection whose sequence numbers do not continue it.

Per connection in time order: a row with SYN or ACK establishes it and sets the expected number to ``seq + 1``. Any
other row of an established connection is judged. Right number: the counter falls by one (not below zero). Wrong number:
it rises by one, and above the threshold the row is an alert and the expected number stays as it was. A judged row that
is no alert and has payload sets the expected number to ``seq + payload size``.

An alert feeds back into the expected number, so the tail of an attacked connection has to be read in order. Up to the
first alert it does not: the expected number comes from the rows before, so wrong rows can be counted with built-in
windows, cut by time slice. Connections with too few of them can never alert and are dropped. Of several establishing rows in
a row only the last matters.

One connection may hold a third of all rows, so what is left is cut into blocks of ``BLOCK_ROWS`` rows. What a block does to
the state (counter, expected number) is worked out for all blocks at once, whatever state they start from:

* The expected number a block starts with matters only by being equal to a number tested in it. Numbers that some earlier
  row sets and the block tests are cases of their own; any other number is one case, as it equals nothing.
* For one case the counter at the end is ``max(counter + shift, floor)`` on intervals of the counter. An interval splits where
  a wrong row with payload is an alert for its upper part only, and neighbours join when they agree again.

Walking the blocks of a connection then takes one small row each and gives every block its start; all blocks are judged
side by side, streamed through Arrow batches in sorted order with one small state.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute  # noqa: F401, reached as pa.compute
from pyspark.sql import Column, DataFrame, Window, functions as F

from skywarden.functions import scalars as X
from skywarden.operators.ordered import DEFAULT_SLICE_S, to_micros
from skywarden.session import ship_to_workers, written

ship_to_workers(__name__)
CONNECTION = ("src_ip", "sport", "dst_ip", "dport")
BLOCK_ROWS = 50_000
ANY = 1 << 60  # above every counter
CASES = "cases array<struct<entry: bigint, lo: bigint, hi: bigint, floor: bigint, shift: bigint, leave: bigint>>"


def _with_state_before(rows: DataFrame, slice_s: float) -> DataFrame:
    """Add ``expected`` and ``established`` as they stand before each row if no alert came earlier.

    ``next_resets`` says whether the next row of the slice establishes; null at the slice's end. ``place`` counts the rows of
    the connection from 1.
    """
    rows = rows.withColumn("_slice", X.floor_div(F.col("at"), to_micros(slice_s)))
    ends = rows.groupBy("conn", "_slice").agg(
        F.max(F.when(F.col("sets").isNotNull(), F.struct("at", "packet_id", "sets"))).alias("tail"),
        F.max("resets").alias("resets"), F.count("*").alias("n"))
    before = Window.partitionBy("conn").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    opening = ends.select("conn", "_slice", F.last("tail", ignorenulls=True).over(before)["sets"].alias("sets"),
                          F.max("resets").over(before).alias("resets"),
                          F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n"), F.lit(0).alias("_kind"))
    both = opening.unionByName(rows.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    earlier = (Window.partitionBy("conn", "_slice").orderBy("_kind", "at", "packet_id")
               .rowsBetween(Window.unboundedPreceding, -1))
    return both.withColumns({
        "expected": F.last("sets", ignorenulls=True).over(earlier),
        "established": F.coalesce(F.max("resets").over(earlier), F.lit(0)) == 1,
        "next_resets": F.lead("resets").over(Window.partitionBy("conn", "_slice").orderBy("_kind", "at", "packet_id")),
        "place": F.max("n").over(earlier) + F.count("*").over(earlier),
    }).where("_kind = 1").drop("_kind", "_slice", "n")


def _judge(threshold: int):
    """Arrow batches sorted by (conn, block, at, packet_id) in, alerts out; the state of one block is kept across batches.

    A row with ``resets`` -1 comes first in its block and holds the state it starts from: ``tcp_seq`` is the expected number,
    ``size`` the counter. A connection's first block has none.
    """
    names = ["packet_id", "anomalies", "expected", "got"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, counter, expected, established = None, 0, 0, False
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conn", "block", "packet_id", "resets", "tcp_seq", "size")]
            alerts = []
            for conn, block, packet, resets, seq, size in zip(*columns):
                if (conn, block) != current:
                    current, counter, established = (conn, block), 0, False
                if resets < 0:
                    established, expected, counter = True, seq, size
                elif resets:
                    established, expected = True, seq + 1
                elif established:
                    if seq != expected:
                        counter += 1
                        if counter > threshold:
                            alerts.append((packet, counter, expected, seq))
                            continue
                    else:
                        counter = max(0, counter - 1)
                    if size:
                        expected = seq + size
            yield pa.RecordBatch.from_arrays(
                [pa.array([a[i] for a in alerts], pa.int64()) for i in range(4)], names=names)
    return run


def _joined(parts: list[tuple]) -> list[tuple]:
    """Neighbouring intervals (lo, hi, floor, shift, expected) put together where one map says both."""
    kept = [parts[0]]
    for lo, hi, floor, shift, expected in parts[1:]:
        first, last, floor1, shift1, expected1 = kept[-1]
        same_below = shift1 == shift or max(last + shift1, last + shift) <= floor1
        same_above = floor1 == floor or lo + shift >= max(floor, floor1)
        if expected == expected1 and same_below and same_above:
            kept[-1] = (first, hi, floor1, shift, expected)
        else:
            kept.append((lo, hi, floor, shift, expected))
    return kept


def _step(parts: list[tuple], resets: int, seq: int, size: int, threshold: int) -> list[tuple]:
    """The intervals after one more row. An expected number of None is the one the block starts with, which equals no row's."""
    after = []
    for lo, hi, floor, shift, expected in parts:
        if resets:
            after.append((lo, hi, floor, shift, seq + 1))
        elif seq == expected:
            after.append((lo, hi, max(floor - 1, 0), shift - 1, seq + size if size else expected))
        else:
            alerting = lo if floor >= threshold else threshold - shift  # counters from here on make the row an alert
            if size and lo < alerting:
                after.append((lo, min(hi, alerting - 1), floor + 1, shift + 1, seq + size))
                lo = alerting
            if lo <= hi:
                after.append((lo, hi, floor + 1, shift + 1, expected))
    return _joined(after) if len(after) > 1 else after


def block_cases(rows: list[tuple[int, int, int]], entries: Sequence[int], threshold: int) -> list[tuple]:
    """What (resets, tcp_seq, size) rows do to any state: (entry, lo, hi, floor, shift, leave).

    A block entered with the expected number ``entry`` (None: any that is not listed) and a counter from ``lo`` to ``hi`` is left
    with the counter ``max(counter + shift, floor)`` and the expected number ``leave`` (None: as it was).
    """
    start = [(0, ANY, 0, 0)]
    cases = [([entry], [(*p, entry) for p in start]) for entry in (None, *entries)]
    for resets, seq, size in rows:
        cases = [(names, _step(parts, resets, seq, size, threshold)) for names, parts in cases]
        if len(cases) > 1 and (resets or size):  # cases that no longer differ go on as one
            together: dict[tuple, list] = {}
            for names, parts in cases:
                together.setdefault(tuple(parts), []).extend(names)
            cases = [(names, list(parts)) for parts, names in together.items()]
    return [(name, *part) for names, parts in cases for name in names for part in parts]


def _summaries(threshold: int):
    def block(key: tuple, table: pa.Table) -> pa.Table:
        entries = sorted(set(table.column("tcp_seq").filter(pa.compute.equal(table.column("resets"), -1)).to_pylist()))
        table = table.filter(pa.compute.greater_equal(table.column("resets"), 0)).sort_by([("at", "ascending"), ("packet_id", "ascending")])
        rows = list(zip(*[table.column(c).to_pylist() for c in ("resets", "tcp_seq", "size")]))
        fields = ("entry", "lo", "hi", "floor", "shift", "leave")
        cases = [dict(zip(fields, case)) for case in block_cases(rows, entries, threshold)]
        struct = pa.struct([(f, pa.int64()) for f in fields])
        return pa.table({"conn": pa.array([key[0].as_py()]), "block": pa.array([key[1].as_py()], pa.int64()),
                         "cases": pa.array([cases], pa.list_(struct))})
    return block


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks sorted by (conn, block) in; the state each but a connection's first starts from."""
    current, counter, expected = None, 0, None
    for batch in batches:
        starts = []
        for conn, block, cases in zip(*[batch.column(c).to_pylist() for c in ("conn", "block", "cases")]):
            if conn != current:  # its first row establishes it, so no case depends on the number before
                current, counter, expected = conn, 0, None
            else:
                starts.append((conn, block, expected, counter))
            entry = expected if any(c["entry"] == expected for c in cases) else None
            case = next(c for c in cases if c["entry"] == entry and c["lo"] <= counter <= c["hi"])
            counter = max(counter + case["shift"], case["floor"])
            expected = expected if case["leave"] is None else case["leave"]
        yield pa.RecordBatch.from_arrays(
            [pa.array([s[0] for s in starts], pa.string()), *[pa.array([s[i] for s in starts], pa.int64()) for i in (1, 2, 3)]],
            names=["conn", "block", "tcp_seq", "size"])


def _block_starts(rows: DataFrame, threshold: int) -> DataFrame:
    """(conn, block, tcp_seq, size) with the expected number and the counter that each later block of a connection starts from."""
    # a number is a case of a block that tests it, if a row of an earlier block sets it
    setters = rows.where("sets IS NOT NULL").groupBy("conn", F.col("sets").alias("tcp_seq")).agg(F.min("block").alias("first"))
    tested = rows.where("resets = 0").select("conn", "block", "tcp_seq").distinct()
    entries = tested.join(setters, ["conn", "tcp_seq"]).where("first < block").select(
        "conn", "block", "tcp_seq", F.lit(-1).alias("resets"))
    summed = (rows.drop("sets").unionByName(entries, allowMissingColumns=True).groupBy("conn", "block")
              .applyInArrow(_summaries(threshold), f"conn string, block long, {CASES}"))
    return (summed.repartition("conn").sortWithinPartitions("conn", "block")
            .mapInArrow(_walk, "conn string, block long, tcp_seq long, size long"))


def sequence_rows(packets: DataFrame, keys: Sequence[str] = CONNECTION, strict_synack: bool = False,
                  size: Column | None = None) -> DataFrame:
    """conn, at, packet_id, tcp_seq, size and resets of TCP rows with a sequence number."""
    mask = X.SYN | X.ACK
    bits = F.col("tcp_flags").bitwiseAND(F.lit(mask))
    resets = (bits == mask if strict_synack else bits != 0)
    return packets.where(X.is_tcp() & F.col("tcp_seq").isNotNull()).select(
        F.to_json(F.struct(*keys)).alias("conn"), X.micros().alias("at"), "packet_id", "tcp_seq",
        (X.payload_size() if size is None else size).alias("size"), X.flag(resets).alias("resets"))


def sequence_alerts(packets: DataFrame, threshold: int = 5, keys: Sequence[str] = CONNECTION,
                    strict_synack: bool = False, slice_s: float = DEFAULT_SLICE_S,
                    block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(packet_id, anomalies, expected, got) of each alert. ``strict_synack`` wants both SYN and ACK to establish.

    Rows without a sequence number say nothing and are left out.
    """
    return judged_alerts(sequence_rows(packets, keys, strict_synack), threshold, slice_s, block_rows)


def judged_alerts(rows: DataFrame, threshold: int = 5, slice_s: float = DEFAULT_SLICE_S, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The alerts among ``sequence_rows``. Rows of connections that can alert are written to the shared folder first."""
    # a row that neither judges nor establishes for a judged row cannot matter: connections without judged rows go first
    judged = rows.where("resets = 0").select("conn").groupBy("conn").agg(F.count("*").alias("n")).where(F.col("n") > threshold)
    rows = rows.join(judged.select("conn"), "conn", "left_semi")
    sets = (F.when(F.col("resets") == 1, F.col("tcp_seq") + 1)
            .when(F.col("size") > 0, F.col("tcp_seq") + F.col("size")))
    state = _with_state_before(rows.withColumn("sets", sets), slice_s)
    wrong = (F.col("resets") == 0) & F.col("established") & (F.col("tcp_seq") != F.col("expected"))
    suspects = (state.where(wrong).groupBy("conn").agg(F.count("*").alias("n"))
                .where(F.col("n") > threshold).select("conn"))
    heard = state.where(F.when(F.col("resets") == 0, F.col("established"))
                        .otherwise(~F.col("next_resets").eqNullSafe(F.lit(1))))
    block = X.floor_div(F.col("place") - 1, block_rows).alias("block")
    needed = written(heard.join(suspects, "conn", "left_semi").select(
        "conn", block, "at", "packet_id", F.col("tcp_seq").cast("long").alias("tcp_seq"), F.col("size").cast("long").alias("size"),
        F.col("resets").cast("int").alias("resets"), F.col("sets").cast("long").alias("sets")), "connections")
    parted = needed.groupBy("conn").agg(F.max("block").alias("last"), F.min("block").alias("first")).where("first < last").select("conn")
    starts = _block_starts(needed.join(parted, "conn", "left_semi"), threshold)
    both = needed.drop("sets").unionByName(starts.withColumn("resets", F.lit(-1)), allowMissingColumns=True)
    ordered = (both.repartition("conn", "block").withColumn("later", F.col("resets") >= 0)
               .sortWithinPartitions("conn", "block", "later", "at", "packet_id"))
    return ordered.mapInArrow(_judge(threshold), "packet_id long, anomalies long, expected long, got long")
