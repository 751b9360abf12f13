"""Substring dedup by sorted suffixes: a distributed merge sort that knows common prefixes.

Every ``LENGTH``-byte string that starts at two places or more is repeated; bytes that repeated strings cover are removed.
Sorting all suffixes would exchange many times the input, so only suffixes that can decide something take part:

1. Anchors. Of the ``SPAN`` first positions of each string, the one with the smallest hash of its 8 bytes is the string's
   anchor. Equal strings have their anchor at the same offset, so they share the ``SPAN`` bytes that follow it. Anchors
   whose ``SPAN`` bytes occur once, by a count-min sketch that never estimates too low, are dropped.
2. Strings at the remaining anchors that occur once, by a second sketch, are dropped too.
3. What remains are runs of strings at anchors. Their suffixes, from the anchor on and with the bytes to its left, are sorted in
   each block and sent as front-coded runs to the bucket of the anchor's ``SPAN`` bytes. The bucket merges runs with a loser tree
   that compares two suffixes only behind the prefix they are known to share. Neighbours that share enough bytes form groups,
   in which equal strings are found by comparing their bytes. A run takes its places in the block along and brings them back
   with the verdict, so the block that removes bytes need not look for anchors again.

Sketches only ever drop strings that occur once; what is removed was compared byte by byte. Equal suffixes of a block travel
once with their number, so a passage that a third of all documents hold reaches its bucket once for each block.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from skywarden.llm import blocks as B
from skywarden.llm import words as W

LENGTH = 200
SPAN = 100
GRAM = 8
BYTES_PER_STRING = 4  # at repeated anchors only
CELLS = 32  # for each item of a sketch; they are one row, as what passes by chance is compared later anyway
BLOCK_BYTES = 2 << 20  # a block's arrays take some hundred bytes for each byte of text
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
TABLE = np.array([xxhash.xxh3_64_intdigest(bytes([b]), 11) for b in range(256)], np.uint64)
BASE = 0x9E3779B97F4A7C15


def inverse(odd: int) -> int:
    """The number whose product with ``odd`` is 1 modulo 2**64."""
    x = odd
    for _ in range(6):
        x = x * (2 - odd * x) & W.MASK
    return x


class Hashes:
    """Hashes of any byte ranges of a buffer, from prefix sums of a polynomial."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        power = np.full(n, np.uint64(BASE))
        power[:1] = 1
        power = np.cumprod(power, dtype=np.uint64)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(TABLE[data] * power, out=self.sums[1:])
        back = np.full(n + 1, np.uint64(inverse(BASE)))
        back[:1] = 1
        self.back = np.cumprod(back, dtype=np.uint64)

    def of(self, start: np.ndarray, length: int) -> np.ndarray:
        return W.mix((self.sums[start + length] - self.sums[start]) * self.back[start])


def sliding_minima(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of each run of ``width`` consecutive values."""
    n = len(x) - width + 1
    pad = -len(x) % width
    grid = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


class Texts:
    """Texts of a block as one buffer, in an order that does not depend on how rows arrive: by identifier, then by text."""

    def __init__(self, table: pa.Table):
        ids = W.ids_of(table["doc_id"])
        texts = [text or b"" for text in W.column_bytes(table["text"])]
        order = sorted(range(len(ids)), key=list(zip(ids.tolist(), texts)).__getitem__)
        self.ids = ids[order]
        self.texts = [texts[i] for i in order]
        self.lengths = np.array([len(t) for t in self.texts], np.int64)
        self.ends = np.cumsum(self.lengths)
        self.data = b"".join(self.texts)


class Strings(Texts):
    """Strings of a block: where they start, the anchor of each, and hashes."""

    def __init__(self, table: pa.Table):
        super().__init__(table)
        raw = np.frombuffer(self.data, np.uint8)
        n = len(raw)
        self.starts = np.flatnonzero(np.arange(n) + LENGTH <= np.repeat(self.ends, self.lengths))
        self.hashes = Hashes(raw)
        if not len(self.starts):
            self.anchor_of, self.anchors = np.zeros(0, np.int64), np.zeros(0, np.int64)
            return
        grams = np.empty(n - GRAM + 1, np.uint64)
        for o in range(GRAM):
            some = np.frombuffer(self.data, "<u8", (n - o) // GRAM, o)
            grams[o::GRAM] = some[:len(grams[o::GRAM])]
        key = (W.mix(grams) & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
        least = sliding_minima(key, SPAN)
        at = (least[self.starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.ones(len(at), bool)
        first[1:] = at[1:] != at[:-1]
        self.anchors = at[first]
        self.anchor_of = np.cumsum(first) - 1  # for each string

    def anchor_hashes(self) -> np.ndarray:
        return self.hashes.of(self.anchors, SPAN)


class Found:
    """What a block knows after the answers so far."""

    def __init__(self, plans: tuple[B.Layout, B.Layout], table: pa.Table, answers: pa.Table | None, steps: int):
        self.strings = s = Strings(table)
        self.anchor_hash = s.anchor_hashes()
        self.first = B.Sketch(plans[0], self.anchor_hash)
        if steps < 1:
            return
        hot = self.first.estimates(B.received(answers, 1)) >= 2 if len(s.anchors) else np.zeros(0, bool)
        some = np.flatnonzero(hot[s.anchor_of]) if len(s.starts) else np.zeros(0, np.int64)
        self.starts, self.anchor_of = s.starts[some], s.anchor_of[some]
        self.second = B.Sketch(plans[1], s.hashes.of(self.starts, LENGTH))
        if steps < 2:
            return
        if len(some):
            hot = self.second.estimates(B.received(answers, 2)) >= 2
            self.starts, self.anchor_of = self.starts[hot], self.anchor_of[hot]
        # runs of consecutive strings with one anchor
        new = np.ones(len(self.starts), bool)
        new[1:] = (np.diff(self.starts) != 1) | (np.diff(self.anchor_of) != 0)
        self.run_at = np.flatnonzero(new)
        self.run_length = np.diff(np.append(self.run_at, len(self.starts)))
        buckets = (self.anchor_hash[self.anchor_of[self.run_at]] % np.uint64(plans[0].buckets)).astype(np.int64)
        # (bucket, suffix, left bytes) -> runs with it
        self.runs: dict[int, dict[tuple[bytes, bytes], list[int]]] = defaultdict(dict)
        places = s.anchors[self.anchor_of[self.run_at]].tolist()
        for i, (bucket, start, n, p) in enumerate(zip(buckets.tolist(), self.starts[self.run_at].tolist(), self.run_length.tolist(), places)):
            self.runs[bucket].setdefault((s.data[p:start + n - 1 + LENGTH], s.data[start:p]), []).append(i)


def common(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of ``a`` and ``b``, known to be at least ``at``."""
    most = min(len(a), len(b))
    while at + 16 <= most and a[at:at + 16] == b[at:at + 16]:
        at += 16
    while at < most and a[at] == b[at]:
        at += 1
    return at


def front_coded(suffixes: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Of sorted suffixes: the length of the prefix shared with the one before, and the rest."""
    shared = [common(a, b, 0) for a, b in zip([b"", *suffixes], suffixes)]
    return shared, [s[n:] for s, n in zip(suffixes, shared)]


def _body(parts: list[bytes]) -> list[bytes]:
    sizes = np.array([len(p) for p in parts], np.uint16).tobytes()
    return [zstandard.compress(sizes, 1), zstandard.compress(b"".join(parts), 1)]


def _split(sizes: bytes, body: bytes) -> list[bytes]:
    edges = np.concatenate([[0], np.cumsum(np.frombuffer(zstandard.decompress(sizes), np.uint16), dtype=np.int64)]).tolist()
    whole = zstandard.decompress(body)
    return [whole[a:b] for a, b in zip(edges, edges[1:])]


def merged(runs: list[tuple[list[int], list[bytes]]]) -> Iterator[tuple[int, int, bytes, int]]:
    """(run, place in it, suffix, prefix shared with the suffix before) of all suffixes of front-coded sorted runs, in order.

    A loser tree; a loser remembers how long a prefix it shares with the suffix that beat it. A longer shared prefix with the last
    winner decides alone; only at equal lengths are bytes compared, from there on.
    """
    width = 1
    while width < len(runs):
        width *= 2
    current: list[bytes | None] = [runs[i][1][0] if i < len(runs) and runs[i][1] else None for i in range(width)]
    shared, place, losers = [0] * width, [0] * width, [0] * width

    def play(a: int, b: int) -> tuple[int, int]:
        x, y = current[a], current[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)
        h = common(x, y, shared[a])
        if x[h:h + 1] <= y[h:h + 1]:
            shared[b] = h
            return a, b
        shared[a] = h
        return b, a
    winners = list(range(width))
    level = width
    while level > 1:
        level //= 2
        winners_up = []
        for i in range(level):
            win, lose = play(winners[2 * i], winners[2 * i + 1])
            losers[level + i] = lose
            winners_up.append(win)
        winners = winners_up
    champion = winners[0]
    while current[champion] is not None:
        suffix = current[champion]
        yield champion, place[champion], suffix, shared[champion]
        lengths, rests = runs[champion]
        place[champion] += 1
        at = place[champion]
        if at < len(rests):
            shared[champion] = lengths[at]
            current[champion] = suffix[:lengths[at]] + rests[at]
        else:
            current[champion] = None
        node = (width + champion) // 2
        while node:
            champion, losers[node] = play(champion, losers[node])
            node //= 2


def repeated_strings(group: list[tuple[bytes, bytes, int]]) -> list[list[bool]]:
    """For each (suffix, left bytes, number) of a group, and each of its strings from the leftmost on: does it occur again?"""
    number: dict[tuple[bytes, bytes], int] = defaultdict(int)
    for suffix, left, n in group:
        number[suffix, left] += n
    if min(number.values()) >= 2:
        return [[True] * (len(suffix) + len(left) - LENGTH + 1) for suffix, left, _ in group]
    seen: dict[tuple[int, bytes], int] = defaultdict(int)
    for (suffix, left), n in number.items():
        text = left + suffix
        for i in range(len(text) - LENGTH + 1):
            seen[len(left) - i, text[i:i + LENGTH]] += n
    return [[seen[len(left) - i, (left + suffix)[i:i + LENGTH]] >= 2 for i in range(len(suffix) + len(left) - LENGTH + 1)]
            for suffix, left, _ in group]


def _decide(table: pa.Table) -> pa.Table:
    """Merge the runs of a bucket and tell each block which of its strings are repeated."""
    asked = list(zip(table["block"].to_pylist(), table["bucket"].to_pylist(), table["parts"].to_pylist()))
    runs, lefts, numbers, verdicts = [], [], [], []
    for _, _, parts in asked:
        runs.append((np.frombuffer(parts[0], np.uint16).tolist(), _split(parts[1], parts[2])))
        lefts.append(_split(parts[3], parts[4]))
        numbers.append(B.unpacked(parts[5]).tolist())
        verdicts.append([None] * len(lefts[-1]))
    group: list[tuple[int, int, bytes]] = []

    def close() -> None:
        found = repeated_strings([(suffix, lefts[run][i], numbers[run][i]) for run, i, suffix in group])
        for (run, i, _), flags in zip(group, found):
            verdicts[run][i] = flags
        group.clear()
    for run, i, suffix, shared in merged(runs):
        if group and shared < LENGTH - SPAN + 1:
            close()
        group.append((run, i, suffix))
    if group:
        close()
    return B.messages([(3, block, bucket, [np.packbits(np.array([f for flags in own for f in flags], bool)).tobytes(),
                                           B.packed(np.array([len(flags) for flags in own])), *parts[5:]])
                       for (block, bucket, parts), own in zip(asked, verdicts)])


def _ask(plans: tuple[B.Layout, B.Layout], step: int):
    def ask(table: pa.Table, answers: pa.Table | None = None) -> pa.Table:
        if not table.num_rows:
            return B.messages([])
        found, block = Found(plans, table, answers, step - 1), table["block"][0].as_py()
        if step == 1:
            return found.first.question(1, block, np.ones(len(found.anchor_hash)))
        if step == 2:
            return found.second.question(2, block, np.ones(len(found.starts)))
        rows, first = [], found.starts[found.run_at].tolist()
        for bucket, runs in found.runs.items():
            keys = sorted(runs)
            shared, rests = front_coded([k[0] for k in keys])
            rows.append((3, block, bucket, [np.array(shared, np.uint16).tobytes(), *_body(rests), *_body([k[1] for k in keys]),
                                            B.packed(np.array([len(runs[k]) for k in keys])),
                                            B.packed(np.array([first[i] for k in keys for i in runs[k]]))]))
        return B.messages(rows)
    return (lambda table: ask(table)) if step == 1 else ask


def _stretches(flags: bytes, sizes: bytes, counts: bytes, places: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where stretches of repeated strings begin in the block, and their numbers of strings, from a bucket's reply.

    Suffix k has ``sizes[k]`` flags, and ``counts[k]`` places where its first string starts.
    """
    size, count, place = (B.unpacked(x).astype(np.int64) for x in (sizes, counts, places))
    flag = np.unpackbits(np.frombuffer(flags, np.uint8), count=size.sum()).astype(bool)
    start = np.cumsum(size) - size
    edge = np.zeros(len(flag) + 1, bool)  # a suffix begins here
    edge[start] = edge[-1] = True
    begin = np.flatnonzero(flag & (edge[:-1] | ~np.append(False, flag[:-1])))
    end = np.flatnonzero(flag & (edge[1:] | ~np.append(flag[1:], False))) + 1
    suffix = np.repeat(np.arange(len(size)), size)[begin]
    times = count[suffix]
    at = np.repeat((np.cumsum(count) - count)[suffix], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    return place[at] + np.repeat(begin - start[suffix], times), np.repeat(end - begin, times)


def _remove(with_kept: bool):
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())[:5 + with_kept]
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][:5 + with_kept]

    def remove(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names)
        s = Texts(table)
        n = len(s.data)
        edge = np.zeros(n + 1, np.int32)
        for parts in B.received(answers, 3).values():
            begin, strings = _stretches(*parts)
            np.add.at(edge, begin, 1)
            np.add.at(edge, begin + strings - 1 + LENGTH, -1)
        gone = np.cumsum(edge[:-1]) > 0
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        heads = (s.ends - s.lengths)[s.lengths > 0]
        begins[heads] = gone[heads]
        rows = []
        raw = np.frombuffer(s.data, np.uint8)
        for text, end, size in zip(s.texts, s.ends.tolist(), s.lengths.tolist()):
            mine = gone[end - size:end]
            removed = int(mine.sum())
            kept = text if not removed else raw[end - size:end][~mine].tobytes()
            rows.append((size, removed, int(begins[end - size:end].sum()), hashlib.sha256(kept).hexdigest(), kept)[:4 + with_kept])
        cols = [W.nullable(s.ids), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds[1:]))]
        return pa.table(cols, names)
    return remove


def remove_repeated_strings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", with_kept: bool = True) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and, if wanted, kept (the
    remaining bytes).

    A null text counts as empty. Texts shorter than ``LENGTH`` bytes stay whole. Rows that repeat an identifier repeat
    each other's strings. Strings are judged on the input, not on what is left. Other columns are not looked at. A document's
    text must fit in a task's memory several times over.
    """
    first = B.layout(docs, text, SPAN / 2, BLOCK_BYTES, 1, CELLS)
    plans = (first, B.layout(docs, text, BYTES_PER_STRING, BLOCK_BYTES, 1, CELLS))
    texts = docs.select(B.block_of(F.col(doc_id), first), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    one = B.answered(texts.groupBy("block").applyInArrow(_ask(plans, 1), B.MESSAGE), B.merge_sketches(1, plans[0].width))
    two = B.answered(B.with_messages(texts, one, _ask(plans, 2), B.MESSAGE), B.merge_sketches(2, plans[1].width))
    both = one.unionByName(two)
    three = B.answered(B.with_messages(texts, both, _ask(plans, 3), B.MESSAGE), _decide)
    return B.with_messages(texts, three, _remove(with_kept), f"{RESULT}, kept binary" if with_kept else RESULT)
