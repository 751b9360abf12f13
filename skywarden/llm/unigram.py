"""SentencePiece encoding by unigram Viterbi over a double-array trie of pieces, and decoding.

A text gets a leading white-space marker and a marker for each space. The best segmentation has the largest sum of piece
scores; among equal sums the one found first, from the left. A character without a piece of its own costs the lowest score
less 10 and is written as its UTF-8 bytes. As no piece holds a marker or a line feed behind another character (checked when
the model is read), texts are cut there and each distinct chunk is segmented once in a worker's bounded memory. Chunks
are segmented side by side as NumPy arrays; long ones by a plain loop over the same trie.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from skywarden.llm import words

MARKER = "\u2581"
PENALTY = 10.0
LONG = 96
CACHED_CHUNKS = 600_000  # some 150 bytes each
CHUNK = re.compile(f"\n|{MARKER}+[^{MARKER}\n]*|[^{MARKER}\n]+")


@dataclass
class DoubleArray:
    """Trie over bytes: child c of node s is t = base[s] + c + 1, if check[t] == s; value[t] is a piece's id or -1."""
    base: np.ndarray
    check: np.ndarray
    value: np.ndarray

    @classmethod
    def build(cls, keys: list[tuple[bytes, int]]) -> DoubleArray:
        """From distinct keys with their values. Nodes are placed breadth first: a single child in the first gap, several behind all others."""
        keys = sorted(keys)
        used, place = bytearray(1 << 10), []  # place: (node, its base, the bytes of its children)
        used[0] = 1
        gap, frontier = 257, 257  # first free slot that any byte can reach; all slots from the frontier on are free
        values: list[tuple[int, int]] = []
        todo = [(0, 0, len(keys), 0)]  # node, range of keys below it, depth
        for node, lo, hi, depth in todo:
            if len(keys[lo][0]) == depth:
                values.append((node, keys[lo][1]))
                lo += 1
            children, at = [], lo
            while at < hi:
                c, end = keys[at][0][depth], at + 1
                while end < hi and keys[end][0][depth] == c:
                    end += 1
                children.append((c, at, end))
                at = end
            if not children:
                continue
            labels = [c + 1 for c, _, _ in children]
            used.extend(bytes(max(0, frontier + 1024 - len(used))))
            gap = used.find(0, gap)
            b = (gap if len(labels) == 1 else frontier) - labels[0]
            frontier = max(frontier, b + labels[-1] + 1)
            for c in labels:
                used[b + c] = 1
            place.append((node, b, labels))
            todo += [(b + c + 1, lo_, hi_, depth + 1) for c, lo_, hi_ in children]
        base, check, value = np.zeros(len(used) + 257, np.int32), np.full(len(used) + 257, -1, np.int32), np.full(len(used) + 257, -1, np.int32)
        for node, b, labels in place:
            base[node] = b
            check[b + np.array(labels)] = node
        for node, i in values:
            value[node] = i
        return cls(base, check, value)


@dataclass
class Model:
    trie: DoubleArray
    pieces: list[str]
    scores: np.ndarray
    bytes_: list[int]  # id of each byte's piece
    kinds: dict[int, int]  # byte of a byte piece's id
    unknown: float
    longest: int


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    """Pieces and scores of a SentencePiece model file with byte fallback."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    pieces = [sp.id_to_piece(i) for i in range(n)]
    scores = np.array([sp.get_score(i) for i in range(n)])
    byte = {i: int(pieces[i][3:5], 16) for i in range(n) if sp.is_byte(i)}
    plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    return from_pieces(pieces, scores, byte, plain)


def from_pieces(pieces: list[str], scores: np.ndarray, byte: dict[int, int], plain: list[int]) -> Model:
    if any(MARKER in pieces[i].lstrip(MARKER) or "\n" in pieces[i][1:] or pieces[i].startswith("\n") and len(pieces[i]) > 1 for i in plain):
        raise ValueError("a piece reaches over a place where texts are cut")
    if len(byte) != 256:
        raise ValueError("the model has no byte fallback")
    keys = [(pieces[i].encode(), i) for i in plain]
    of = dict((b, i) for i, b in byte.items())
    return Model(DoubleArray.build(keys), pieces, scores, [of[b] for b in range(256)], byte,
                 float(scores[plain].min()) - PENALTY, max(len(k) for k, _ in keys))


def _width(lead: int) -> int:
    return 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


def viterbi(m: Model, text: bytes) -> list[int]:
    """Ids of one chunk, by a loop over its characters."""
    base, check, value = m.trie.base, m.trie.check, m.trie.value
    n = len(text)
    best, back = [float("-inf")] * (n + 1), [(0, -1)] * (n + 1)
    best[0] = 0.0
    at = 0
    while at < n:
        width, node, single = _width(text[at]), 0, False
        for end in range(at, min(n, at + m.longest)):
            t = int(base[node]) + text[end] + 1
            if check[t] != node:
                break
            node = t
            if value[node] >= 0:
                score = best[at] + m.scores[value[node]]
                single |= end + 1 - at == width
                if score > best[end + 1]:
                    best[end + 1], back[end + 1] = score, (at, int(value[node]))
        if not single and best[at] + m.unknown > best[at + width]:
            best[at + width], back[at + width] = best[at] + m.unknown, (at, -1)
        at += width
    return _ids(m, text, [s for s, _ in back], [p for _, p in back])


def _ids(m: Model, text: bytes, starts: list[int], pieces: list[int]) -> list[int]:
    out, at = [], len(text)
    while at:
        start = starts[at]
        if pieces[at] >= 0:
            out.append(pieces[at])
        else:
            out += [m.bytes_[b] for b in reversed(text[start:at])]
        at = start
    out.reverse()
    return out


def viterbi_all(m: Model, texts: list[bytes]) -> list[list[int]]:
    """Ids of many short chunks, as ``viterbi`` finds them for each."""
    return [np.frombuffer(ids, "<u4").tolist() for ids in packed_ids(m, texts)]


def packed_ids(m: Model, texts: list[bytes]) -> list[bytes]:
    """Ids of many short chunks as little-endian 32-bit integers, all walked through the trie together."""
    sizes = np.array([len(t) for t in texts])
    width = int(sizes.max())
    text = np.zeros((len(texts), width), np.int32)
    flat = np.frombuffer(b"".join(texts), np.uint8)
    text[np.arange(width) < sizes[:, None]] = flat
    best = np.full((len(texts), width + 1), -np.inf)
    best[:, 0] = 0
    start, piece = np.zeros((len(texts), width + 1), np.int32), np.full((len(texts), width + 1), -1, np.int32)
    base, check, value = m.trie.base, m.trie.check, m.trie.value
    for at in range(width):
        here = np.flatnonzero((sizes > at) & (best[:, at] > -np.inf))
        if not len(here):
            continue
        lead = text[here, at]
        chars = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
        single = np.zeros(len(here), bool)
        index, rows, node = np.arange(len(here)), here, np.zeros(len(here), np.int32)
        for end in range(at, min(width, at + m.longest)):
            t = base[node] + text[rows, end] + 1
            good = (check[t] == node) & (sizes[rows] > end)
            index, rows, node = index[good], rows[good], t[good]
            if not len(rows):
                break
            found = value[node]
            some = found >= 0
            r, f, i = rows[some], found[some], index[some]
            single[i] |= end + 1 - at == chars[i]
            score = best[r, at] + m.scores[f]
            better = score > best[r, end + 1]
            r = r[better]
            best[r, end + 1], start[r, end + 1], piece[r, end + 1] = score[better], at, f[better]
        none = np.flatnonzero(~single)
        r, to = here[none], at + chars[none]
        score = best[r, at] + m.unknown
        better = score > best[r, to]
        r, to = r[better], to[better]
        best[r, to], start[r, to], piece[r, to] = score[better], at, -1
    return _traced(m, texts, sizes, start, piece)


def _traced(m: Model, texts: list[bytes], sizes: np.ndarray, start: np.ndarray, piece: np.ndarray) -> list[bytes]:
    """All chunks read back from their ends together; those with a character that has no piece one by one."""
    every, at = np.arange(len(texts)), sizes.copy()
    columns, odd = [], np.zeros(len(texts), bool)
    while at.any():
        found = np.where(at > 0, piece[every, at], -2)
        odd |= found == -1
        columns.append(found)
        at = np.where(at > 0, start[every, at], 0)
    ids = np.stack(columns[::-1], 1) if columns else np.zeros((len(texts), 0), np.int32)
    ends = np.cumsum((ids > -2).sum(1)) * 4
    flat = ids[ids > -2].astype("<u4").tobytes()
    out = [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
    for i in np.flatnonzero(odd):
        out[i] = np.array(_ids(m, texts[i], start[i].tolist(), piece[i].tolist()), "<u4").tobytes()
    return out


MEMORY: dict[str, dict[str, bytes]] = {}  # ids of a chunk as little-endian 32-bit integers


def encode(path: str, texts: list[str | None]) -> list[np.ndarray]:
    """Ids of each text; none for a null or empty one."""
    m, kept = model(path), MEMORY.setdefault(path, {})
    cut = [CHUNK.findall(MARKER + text.replace(" ", MARKER)) if text else [] for text in texts]
    if len(kept) >= CACHED_CHUNKS:
        kept.clear()
    missing = sorted(set().union(*cut) - kept.keys(), key=len)
    short = [(c, b) for c in missing if len(b := c.encode("utf-8", "replace")) <= LONG]
    for c in missing:
        if len(b := c.encode("utf-8", "replace")) > LONG:
            kept[c] = np.array(viterbi(m, b), "<u4").tobytes()
    for at in range(0, len(short), 8192):
        some = short[at:at + 8192]
        for (c, _), ids in zip(some, packed_ids(m, [b for _, b in some])):
            kept[c] = ids
    return [np.frombuffer(b"".join(map(kept.__getitem__, chunks)), "<u4") for chunks in cut]


@lru_cache(maxsize=2)
def _spelled(path: str) -> list[bytes]:
    """The bytes of each id."""
    m = model(path)
    return [bytes([m.kinds[i]]) if i in m.kinds else piece.encode() for i, piece in enumerate(m.pieces)]


def decode(path: str, ids: list[int]) -> str:
    """Text of ids: bytes of pieces and of byte pieces, markers as spaces, without the leading one."""
    body = b"".join(map(_spelled(path).__getitem__, ids))
    return body.decode("utf-8", "replace").replace(MARKER, " ")[1:]


RESULT = "doc_id long, n_tokens long, n_byte_tokens long, ids_crc32 long, round_trip boolean"


def _encoder(path: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        byte = np.zeros(len(model(path).pieces), bool)
        byte[list(model(path).kinds)] = True
        for batch in batches:
            for some in words.slices(batch, "text"):
                texts = some["text"].to_pylist()
                ids = encode(path, texts)
                same = [decode(path, i.tolist()) == (t or "").replace(MARKER, " ") for i, t in zip(ids, texts)]
                out = {"doc_id": some["doc_id"], "n_tokens": pa.array([len(i) for i in ids], pa.int64()),
                       "n_byte_tokens": pa.array([int(byte[i].sum()) for i in ids], pa.int64()),
                       "ids_crc32": pa.array([zlib.crc32(i.tobytes()) for i in ids], pa.int64()), "round_trip": pa.array(same, pa.bool_())}
                if with_ids:
                    whole = np.concatenate([np.zeros(0, np.uint32), *ids])
                    edges = np.concatenate([[0], np.cumsum([len(i) for i in ids], dtype=np.int64)]).astype(np.int32)
                    out["ids"] = pa.ListArray.from_arrays(edges, pa.array(whole.astype(np.int32)))
                yield pa.RecordBatch.from_pydict(out)
    return run


def encode_documents(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per input row: doc_id, n_tokens, n_byte_tokens, ids_crc32, round_trip (do the ids decode to the text?), ids if wanted.

    A null or empty text has no ids. A marker character in a text decodes to a space. Rows are handled each for itself; other
    columns are not looked at.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_encoder(path, with_ids), RESULT + (", ids array<int>" if with_ids else ""))
