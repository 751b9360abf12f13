"""Greedy suppression where a gap holds many rows: pointers instead of blocks, and the size of every block."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from skywarden.operators import suppress
from skywarden.operators.suppress import greedy_suppress


def times(seed, n, span):
    rng = random.Random(seed)
    return [{"at": round(rng.random() ** 2 * span, 3), "src_ip": rng.choice(["a", "a", "a", "b", None])} for _ in range(n)]


def expected(rows, gap, inclusive):
    anchor, out = {}, {}
    for i, r in sorted(enumerate(rows), key=lambda e: (e[1]["at"], e[0])):
        now, last = round(r["at"] * 1e6), anchor.get(r["src_ip"])
        flagged = last is not None and (now - last <= gap if inclusive else now - last < gap)
        if not flagged:
            anchor[r["src_ip"]] = now
        out[i] = (flagged, anchor[r["src_ip"]])
    return out


def outcome(frames, rows, gap_s, inclusive=True):
    got = greedy_suppress(frames(rows).select("packet_id", "ts", "src_ip"), ["src_ip"], gap_s, inclusive)
    start = F.unix_micros("anchor_ts") - F.lit(1_704_067_200_000_000)
    return {r.packet_id: (r.flagged, r.anchor) for r in got.withColumn("anchor", start).collect()}


@pytest.mark.parametrize("inclusive", [True, False])
def test_pointers_find_the_same_anchors(frames, monkeypatch, inclusive):
    monkeypatch.setattr(suppress, "FOLD_ROWS", 0)
    monkeypatch.setattr(suppress, "GROUP_ROWS", 0)
    rows = times(1, 400, 30)
    assert outcome(frames, rows, 1, inclusive) == expected(rows, 1_000_000, inclusive)


def test_a_regular_beat_has_no_rows_to_drop(frames, monkeypatch):
    """Every time is somebody's next one, so no pointer is ever dropped before its chain ends."""
    monkeypatch.setattr(suppress, "FOLD_ROWS", 0)
    monkeypatch.setattr(suppress, "GROUP_ROWS", 0)
    rows = [{"at": i / 10, "src_ip": "a"} for i in range(300)]
    assert outcome(frames, rows, 1) == expected(rows, 1_000_000, True)


def test_no_block_of_one_payload_is_larger_than_stated(frames, monkeypatch):
    """A dense and a sparse session of one key: blocks stay under the bound, and the dense rows reach none of them."""
    monkeypatch.setattr(suppress, "FOLD_ROWS", 0)
    monkeypatch.setattr(suppress, "FANOUT", 4)
    monkeypatch.setattr(suppress, "GROUP_ROWS", 300)
    seen = []
    compose, hand_down = suppress._compose, suppress._hand_down

    def sizes(entries, length):
        block = F.lit(0) if length is None else F.floor(F.col("at") / length)
        seen.extend(r["count"] for r in entries.groupBy("gid", block.alias("block")).count().collect())

    def composed(entries, gap, length):
        sizes(entries, length)
        return compose(entries, gap, length)

    def handed(entries, starts, gap, length):
        sizes(entries, length)
        return hand_down(entries, starts, gap, length)
    monkeypatch.setattr(suppress, "_compose", composed)
    monkeypatch.setattr(suppress, "_hand_down", handed)
    rng = random.Random(7)
    rows = ([{"at": round(rng.random() * 8, 4), "src_ip": "a"} for _ in range(1500)]
            + [{"at": 100 + i * 0.4, "src_ip": "a"} for i in range(100)])
    assert outcome(frames, rows, 1) == expected(rows, 1_000_000, True)
    assert 0 < max(seen) <= 300 and sum(seen) < 1500
