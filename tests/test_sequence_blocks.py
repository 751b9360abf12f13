"""The sequence machine cut into blocks: what a block does to any state, and connections of many blocks."""

from __future__ import annotations

import random

import pytest
from hypothesis import given, settings, strategies as st

from skywarden.operators import sequence
from skywarden.operators.sequence import block_cases, sequence_alerts

ROW = st.tuples(st.sampled_from([0, 0, 0, 0, 1]), st.integers(0, 4), st.integers(0, 2))


def walked(rows, threshold, counter, expected):
    for resets, seq, size in rows:
        if resets:
            expected = seq + 1
            continue
        if seq != expected:
            counter += 1
            if counter > threshold:
                continue
        else:
            counter = max(0, counter - 1)
        if size:
            expected = seq + size
    return counter, expected


@settings(max_examples=400, deadline=None)
@given(st.lists(ROW, max_size=25), st.integers(0, 4))
def test_cases_say_what_every_state_becomes(rows, threshold):
    entries = sorted({seq for resets, seq, _ in rows if not resets})
    cases = block_cases(rows, entries, threshold)
    for expected in [*entries, 99]:
        own = [c for c in cases if c[0] == (expected if expected in entries else None)]
        for counter in range(threshold + len(rows) + 3):
            fits = [c for c in own if c[1] <= counter <= c[2]]
            assert len(fits) == 1
            _, _, _, floor, shift, leave = fits[0]
            assert (max(counter + shift, floor), expected if leave is None else leave) == walked(rows, threshold, counter, expected)


def test_ordinary_traffic_has_few_cases():
    rows, seq = [], 0
    for i in range(5000):
        rows.append((0, seq, 10))
        seq += 10
        if i % 50 == 0:
            rows.append((0, 7, 0))
    assert len(block_cases(rows, [0], 5)) < 20


def traffic(seed, n):
    """Runs in order, injected rows and openings of two connections; ``hot`` has most rows."""
    rng, rows, seq = random.Random(seed), [], {"hot": 0, "cold": 0}
    for i in range(n):
        conn = "hot" if rng.random() < 0.9 else "cold"
        size, kind = rng.randrange(3), rng.random()
        row = {"at": i // 3, "src_ip": conn, "ip_proto": 6, "tcp_flags": 0, "tcp_seq": seq[conn], "payload": b"x" * size}
        if kind < 0.03:
            row["tcp_flags"] = 2
            seq[conn] += 1
        elif kind < 0.3:
            row["tcp_seq"] = rng.randrange(40)
        else:
            seq[conn] = (seq[conn] + size) % 40
        rows.append(row)
    return rows


def outcome(df):
    return sorted(tuple(r) for r in df.select("packet_id", "anomalies", "expected", "got").collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_blocks_change_nothing(frames, seed):
    packets = frames(traffic(seed, 600))
    want = outcome(sequence_alerts(packets, 3, ["src_ip"]))
    assert len(want) > 20
    for block_rows in (7, 100):
        assert outcome(sequence_alerts(packets, 3, ["src_ip"], block_rows=block_rows)) == want


def test_one_connection_is_read_in_many_groups(spark, frames, monkeypatch):
    """No group of one connection holds more than ``block_rows`` rows, and blocks of it lie in several partitions."""
    taken = []
    starts = sequence._block_starts

    def spied(rows, threshold):
        taken.append(rows.groupBy("conn", "block").count().collect())
        return starts(rows, threshold)
    monkeypatch.setattr(sequence, "_block_starts", spied)
    sequence_alerts(frames(traffic(3, 600)), 3, ["src_ip"], block_rows=20).collect()
    groups = taken[0]
    assert max(r["count"] for r in groups) <= 20
    assert len({r["block"] for r in groups}) > 20
