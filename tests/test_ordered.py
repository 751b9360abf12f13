"""Ordered operators against brute force on small random inputs with ties and one hot key."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from skywarden.operators import ordered, suppress
from skywarden.operators.sequence import sequence_alerts
from skywarden.operators.suppress import greedy_suppress


def sample(seed: int, n: int = 300, span: int = 60) -> list[dict]:
    rng = random.Random(seed)
    rows = [{"at": rng.randrange(span * 4) / 4, "src_ip": rng.choice(["a", "a", "a", "b", "c"]), "ip_proto": 6,
             "dport": rng.randrange(6), "tcp_flags": rng.choice([0, 0, 0, 1, 2, 16]), "tcp_seq": rng.randrange(4),
             "payload": b"x" * rng.randrange(3)} for _ in range(n)]
    return rows


def in_order(rows):
    return sorted(enumerate(rows), key=lambda r: (r[1]["at"], r[0]))


def by_id(df, *columns):
    return {r.packet_id: tuple(r[c] for c in columns) for r in df.collect()}


@pytest.mark.parametrize("slice_s", [None, 1, 7])
def test_rate_counts_the_trailing_window(frames, slice_s):
    rows = sample(1)
    want, seen = {}, {}
    for i, r in in_order(rows):
        times = seen.setdefault(r["src_ip"], [])
        times.append(r["at"])
        want[i] = (sum(1 for t in times if r["at"] - t <= 5),)
    got = ordered.rate_over(frames(rows), ["src_ip"], 5, slice_s=slice_s)
    assert by_id(got, "rate") == want
    over = ordered.exceeds(frames(rows).select("packet_id", "ts", "src_ip"), ["src_ip"], 6, 5)
    assert by_id(over, "exceeds") == {i: (n > 6,) for i, (n,) in want.items()}


def test_short_slices_for_a_whole_session(spark, frames):
    rows = frames(sample(8))
    plain = by_id(ordered.rate_over(rows, ["src_ip"], 5), "rate")
    spark.conf.set(ordered.RATE_SLICE, "0.5")
    try:
        assert by_id(ordered.rate_over(rows, ["src_ip"], 5), "rate") == plain
    finally:
        spark.conf.unset(ordered.RATE_SLICE)


@pytest.mark.parametrize("slice_s", [1, 13])
def test_distinct_counts(frames, slice_s):
    rows = sample(2)
    window, ever, past, values = {}, {}, {}, {}
    for i, r in in_order(rows):
        past.setdefault(r["src_ip"], []).append((r["at"], r["dport"]))
        values.setdefault(r["src_ip"], set()).add(r["dport"])
        window[i] = (len({p for t, p in past[r["src_ip"]] if r["at"] - t <= 2}),)
        ever[i] = (len(values[r["src_ip"]]), len(values[r["src_ip"]] & {1, 2}))
    df = frames(rows)
    assert by_id(ordered.distinct_over(df, ["src_ip"], "dport", 2, slice_s=slice_s), "n_distinct") == window
    got = ordered.seen_distinct(df, ["src_ip"], "dport", also=F.col("value").isin(1, 2), slice_s=slice_s)
    assert by_id(got, "n_distinct", "n_also") == ever


def test_first_binding_takes_the_first_row(frames):
    rows = sample(3)
    first = {}
    for _, r in in_order(rows):
        first.setdefault(r["src_ip"], r["dport"])
    got = ordered.first_binding(frames(rows), ["src_ip"], ["dport"])
    assert by_id(got, "first_dport") == {i: (first[r["src_ip"]],) for i, r in enumerate(rows)}


def kept_and_flagged(rows, gap, inclusive):
    anchor, out = {}, {}
    for i, r in in_order(rows):
        last = anchor.get(r["src_ip"])
        flagged = last is not None and (r["at"] - last <= gap if inclusive else r["at"] - last < gap)
        if not flagged:
            anchor[r["src_ip"]] = r["at"]
        out[i] = (flagged, anchor[r["src_ip"]])
    return out


@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("fold_rows, fanout, levels", [(1000, 256, 2), (0, 2, 2), (0, 3, 3), (0, 256, 0)])
def test_greedy_suppress(frames, monkeypatch, inclusive, fold_rows, fanout, levels):
    monkeypatch.setattr(suppress, "FOLD_ROWS", fold_rows)
    monkeypatch.setattr(suppress, "FANOUT", fanout)
    rows = sample(4, n=150)
    got = greedy_suppress(frames(rows).select("packet_id", "ts", "src_ip"), ["src_ip"], 1, inclusive, levels)
    start = (F.unix_micros("anchor_ts") - F.lit(1_704_067_200_000_000)) / 1e6
    assert by_id(got.withColumn("anchor", start), "flagged", "anchor") == kept_and_flagged(rows, 1, inclusive)


def test_chain_is_not_a_lag(frames):
    got = greedy_suppress(frames([{"at": t, "src_ip": "a"} for t in (0, 0.6, 1.2)]), ["src_ip"], 1, inclusive=False)
    assert by_id(got, "flagged") == {0: (False,), 1: (True,), 2: (False,)}


def machine(rows, threshold, keys=("src_ip",)):
    state, alerts = {}, {}
    for i, r in in_order(rows):
        key = tuple(r[k] for k in keys)
        c = state.setdefault(key, {"exp": r["tcp_seq"] + 1, "n": 0, "est": False})
        if r["tcp_flags"] & 0x12:
            c["est"], c["exp"] = True, r["tcp_seq"] + 1
            continue
        if not c["est"]:
            continue
        if r["tcp_seq"] != c["exp"]:
            c["n"] += 1
            if c["n"] > threshold:
                alerts[i] = (c["n"], c["exp"], r["tcp_seq"])
                continue
        else:
            c["n"] = max(0, c["n"] - 1)
        if r["payload"]:
            c["exp"] = r["tcp_seq"] + len(r["payload"])
    return alerts


@pytest.mark.parametrize("seed", [5, 6, 7])
def test_sequence_machine(frames, seed):
    rows = sample(seed, n=200)
    got = sequence_alerts(frames(rows), 3, ["src_ip", "dport"], slice_s=5)
    want = machine(rows, 3, ("src_ip", "dport"))
    assert want
    assert by_id(got, "anomalies", "expected", "got") == want


def test_sequence_counter_floor_and_limit(frames):
    opening = {"at": 0, "src_ip": "a", "ip_proto": 6, "tcp_flags": 2, "tcp_seq": 0}
    wrong = [{"at": i + 1, "src_ip": "a", "ip_proto": 6, "tcp_flags": 0, "tcp_seq": 50} for i in range(7)]
    assert by_id(sequence_alerts(frames([opening, *wrong[:5]]), keys=["src_ip"])) == {}
    got = by_id(sequence_alerts(frames([opening, *wrong]), keys=["src_ip"]), "anomalies", "expected")
    assert got == {6: (6, 1), 7: (7, 1)}
    assert by_id(sequence_alerts(frames(wrong), keys=["src_ip"])) == {}


def test_suppression_keeps_rows_with_null_keys(frames):
    rows = [{"at": t, "src_ip": ip} for t, ip in ((0, None), (0.5, None), (1.2, None), (0, "a"), (0.4, "a"))]
    got = by_id(greedy_suppress(frames(rows), ["src_ip", "ssid"], 1), "flagged")
    assert [got[i] for i in range(5)] == [(False,), (True,), (False,), (False,), (True,)]


def test_sequence_rows_without_a_number_are_left_out(frames):
    opening = {"at": 0, "src_ip": "a", "ip_proto": 6, "tcp_flags": 2, "tcp_seq": 0}
    wrong = [{"at": i + 1, "src_ip": "a", "ip_proto": 6, "tcp_flags": 0, "tcp_seq": None if i == 2 else 50} for i in range(7)]
    assert by_id(sequence_alerts(frames([opening, *wrong]), keys=["src_ip"]), "anomalies", "expected") == {7: (6, 1)}


def test_first_binding_keeps_null_keys_and_does_not_depend_on_slices(frames):
    rows = [{"at": t, "src_ip": ip, "dport": p} for t, ip, p in ((5, None, 1), (70, None, 2), (3, "a", None), (200, "a", 4))]
    for slice_s in (1, 60, 1000):
        got = by_id(ordered.first_binding(frames(rows), ["src_ip"], ["dport"], slice_s), "first_dport")
        assert got == {0: (1,), 1: (1,), 2: (None,), 3: (None,)}


def test_sequence_machine_over_many_slices(frames):
    rows = sample(9, n=200)
    want = machine(rows, 2, ("src_ip",))
    for slice_s in (0.5, 10_000):
        assert by_id(sequence_alerts(frames(rows), 2, ["src_ip"], slice_s=slice_s), "anomalies", "expected", "got") == want


def test_rows_without_a_value_count_no_distinct_value(frames):
    rows = [{"at": t, "src_ip": "a", "dport": port} for t, port in ((0, None), (1, 5), (2, None), (3, 6), (9, None))]
    so_far = by_id(ordered.seen_distinct(frames(rows), ["src_ip"], "dport"), "n_distinct")
    assert [so_far[i] for i in range(5)] == [(0,), (1,), (1,), (2,), (2,)]
    inside = by_id(ordered.distinct_over(frames(rows), ["src_ip"], "dport", 2), "n_distinct")
    assert [inside[i] for i in range(5)] == [(0,), (1,), (1,), (2,), (0,)]


def test_three_keys_null_and_empty_keys_count_apart(spark, frames):
    rows = [{"at": i / 10, "src_ip": ip, "dst_ip": "d", "dport": port} for i, (ip, port) in enumerate(
        [("a", 1), ("a", 2), ("a", 1), (None, 1), ("", 1), (None, 1), ("a", None), ("a", 1), ("", 1), ("a", None)])]
    rates = ordered.rate_over(frames(rows), ["src_ip", "dst_ip", F.col("dport")], 10)
    assert [r.rate for r in rates.orderBy("packet_id").collect()] == [1, 1, 2, 1, 1, 2, 1, 3, 2, 2]
    short = ordered.rate_over(frames(rows), ["src_ip", "dst_ip", "dport"], 10, slice_s=0.3)
    assert [r.rate for r in short.orderBy("packet_id").collect()] == [1, 1, 2, 1, 1, 2, 1, 3, 2, 2]


def test_no_gap_flags_equal_times_only(spark, frames):
    rows = frames([{"at": t, "src_ip": "a"} for t in (0, 0, 1, 1, 1, 2)]).select("packet_id", "ts", "src_ip")
    kept = greedy_suppress(rows, ["src_ip"], 0).orderBy("packet_id").collect()
    assert [r.flagged for r in kept] == [False, True, False, True, True, False]
    assert not any(r.flagged for r in greedy_suppress(rows, ["src_ip"], 0, inclusive=False).collect())
