from __future__ import annotations

import hashlib
import random
from collections import Counter

import brute
import numpy as np
import pytest

from skywarden.llm import suffix
from test_documents import rows_of


def plain(rows, length=suffix.LENGTH):
    texts = [(doc, (text or "").encode()) for doc, text in rows]
    seen = Counter(t[i:i + length] for _, t in texts for i in range(len(t) - length + 1))
    out = []
    for doc, t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] >= 2:
                gone[i:i + length] = [True] * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return brute.order(out)


NAMES = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def test_messy_texts(messy, messy_rows):
    assert rows_of(suffix.remove_repeated_strings(messy), *NAMES) == plain(messy_rows)


def test_repeats_of_all_lengths_and_overlaps(spark):
    rng = random.Random(8)

    def noise(n: int) -> str:
        return "".join(rng.choice("abcdefgh é") for _ in range(n))
    base = noise(900)
    rows = []
    for i in range(60):
        a, n = rng.randrange(600), rng.choice([198, 199, 200, 201, 202, 230, 300, 400])
        piece = base[a:a + n]
        if rng.random() < .3:
            at = rng.randrange(len(piece))
            piece = piece[:at] + "#" + piece[at + 1:]
        rows.append((i, noise(rng.randrange(120)) + piece + noise(rng.randrange(120))))
    rows += [(100, "a" * 450), (101, "ab" * 150 + noise(5)), (102, noise(210) * 2), (103, base[:250] + base[100:350])]
    rows += [(104, "x" * 199), (105, "x" * 199), (106, "y" * 200), (107, "z" * 201)]
    assert rows_of(suffix.remove_repeated_strings(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)), *NAMES) == plain(rows)


def test_nothing(nothing):
    assert suffix.remove_repeated_strings(nothing).count() == 0


@pytest.mark.parametrize("k", [1, 2, 3, 5, 8])
def test_merge_gives_sorted_suffixes_with_shared_prefixes(k):
    rng = random.Random(k)
    runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randrange(12))) for _ in range(rng.randrange(30))) for _ in range(k)]
    found = list(suffix.merged([suffix.front_coded(r) for r in runs]))
    assert [s for _, _, s, _ in found] == sorted(s for r in runs for s in r)
    assert all(runs[r][i] == s for r, i, s, _ in found)
    assert all(n == suffix.common(a[2], b[2], 0) for a, b, n in zip(found, found[1:], [x[3] for x in found[1:]]))


def test_merge_never_looks_at_known_prefixes(monkeypatch):
    looked = []
    real = suffix.common
    monkeypatch.setattr(suffix, "common", lambda a, b, at: looked.append(real(a, b, at) - at) or real(a, b, at))
    runs = [suffix.front_coded(sorted(b"p" * 150 + bytes([a, b]) for b in range(40))) for a in range(8)]
    looked.clear()
    assert len(list(suffix.merged(runs))) == 320
    assert sum(looked) <= 8 * 200  # the shared prefix is read once for each run, not for each suffix


def test_hashes_and_minima():
    data = np.frombuffer(random.Random(0).randbytes(500) * 2, np.uint8)
    h = suffix.Hashes(data)
    assert (h.of(np.arange(300), 200) == h.of(np.arange(300) + 500, 200)).all()
    assert len(set(h.of(np.arange(500), 200).tolist())) == 500
    x = np.random.default_rng(1).integers(0, 1 << 62, 1003).astype(np.uint64)
    for w in (1, 7, 100):
        assert suffix.sliding_minima(x, w).tolist() == [int(x[i:i + w].min()) for i in range(len(x) - w + 1)]


def test_rows_that_repeat_an_identifier_and_kept_bytes(spark):
    rng = random.Random(5)
    shared = "".join(rng.choice("abcdefgh") for _ in range(260))
    rows = [(i % 3 if i % 4 else None, "".join(rng.choice("xyz ") for _ in range(rng.randrange(90))) + shared[:200 + i] + "é" * (i % 5)) for i in range(40)]
    found = suffix.remove_repeated_strings(spark.createDataFrame(rows, "doc_id long, text string").repartition(7))
    assert rows_of(found, *NAMES) == plain(rows)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in found.collect())


def test_stretches_of_a_reply():
    flags = [True, True, False, True, True, True, False]  # two suffixes of four and three strings
    reply = [np.packbits(np.array(flags)).tobytes(), *(suffix.B.packed(np.array(x)) for x in ([4, 3], [2, 1], [500, 10, 90]))]
    begin, strings = suffix._stretches(*reply)
    assert sorted(zip(begin.tolist(), strings.tolist())) == [(10, 2), (13, 1), (90, 2), (500, 2), (503, 1)]


def test_sketches_of_one_row_never_estimate_too_low():
    rng = np.random.default_rng(3)
    plan, truth, asked = suffix.B.Layout(3, 2, 64), Counter(), []
    for block in range(3):
        h = suffix.W.mix(rng.integers(0, 300, 400).astype(np.uint64))
        truth.update(h.tolist())
        sketch = suffix.B.Sketch(plan, h)
        asked.append((h, sketch, sketch.question(1, block, np.ones(len(h)))))
    sent = suffix.pa.concat_tables([t for _, _, t in asked])
    for block, (h, sketch, _) in enumerate(asked):
        answers = {}
        for bucket in range(2):
            reply = suffix.B.merge_sketches(1, plan.width)(sent.filter(suffix.pa.compute.equal(sent["bucket"], bucket)))
            answers |= suffix.B.received(reply.filter(suffix.pa.compute.equal(reply["block"], block)), 1)
        assert all(n >= truth[x] for x, n in zip(h.tolist(), sketch.estimates(answers).tolist()))
