"""Vector bin packing of examples into sequences by the dot-product heuristic.

A piece asks for tokens, one segment and loss-bearing tokens; a sequence has a limit on each. A sequence is filled by taking,
again and again, the fitting piece whose demand has the largest dot product with what is left of the sequence, each
dimension as a share of its limit. Longer examples are cut into whole sequences first. If nothing fits any more, a piece is cut
to fill the gap. What remains at the end of a task's examples, and what another limit closed early, goes into sequences whose
lengths are powers of two.

Each task packs its own rows, so there is no shuffle and no group to grow; only a task's pieces are held, ``PIECES`` at a time.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from skywarden.llm import words
from skywarden.llm.tokens import Encoder, space_chunks

TOKENS = 2048
SEGMENTS = 128
END = 1
PIECES = 20_000
RESULT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


def dot_product_fill(tokens: np.ndarray, loss: np.ndarray, limits: tuple[int, int, int]) -> Iterator[list[tuple[int, int]]]:
    """Sequences as lists of (piece, tokens taken from it); a piece may be cut, its rest is packed on.

    ``tokens`` and ``loss`` give each piece's demand, ``limits`` the most tokens, segments and loss-bearing tokens of a sequence.
    A piece's loss-bearing tokens are its last ones, so the front part of a cut piece bears less. The last sequence may be short. Equal pieces are taken in order.
    """
    most = np.array(limits, float)
    stock: dict[tuple[int, int], list[int]] = {}
    for i, demand in reversed(list(enumerate(zip(tokens.tolist(), loss.tolist())))):
        stock.setdefault(demand, []).append(i)
    kinds = np.array(sorted(stock, reverse=True), np.int64).reshape(-1, 2)
    count = np.array([len(stock[tuple(k)]) for k in kinds.tolist()], np.int64)
    rest: list[tuple[int, int, int]] = []  # (tokens, loss, piece) of pieces that were cut
    alike = bool((kinds[:, 0] == kinds[:, 1]).all())  # then the largest piece that fits has the largest product
    size = -kinds[:, 0]
    while count.any() or rest:
        left, sequence = np.array(limits, np.int64), []
        while rest and left[1]:
            t, bearing, piece = rest.pop()
            take = min(t, int(left[0]), t - bearing + int(left[2]))
            if not take:
                rest.append((t, bearing, piece))
                break
            sequence.append((piece, take))
            left -= (take, 1, max(0, take - (t - bearing)))
            if take < t:
                rest.append((t - take, min(bearing, t - take), piece))
                break
        while left[0] and left[1] and count.any():
            if alike:
                start = int(size.searchsorted(-min(left[0], left[2])))
                best = start + int((count[start:] > 0).argmax()) if start < len(count) else 0
                found = start < len(count) and count[best] > 0
            else:
                fits = (count > 0) & (kinds[:, 0] <= left[0]) & (kinds[:, 1] <= left[2])
                share = left / most / most
                score = np.where(fits, kinds[:, 0] * share[0] + share[1] + kinds[:, 1] * share[2], -1)
                best = int(score.argmax())
                found = fits[best]
            if found:
                piece, (t, bearing) = stock[tuple(kinds[best].tolist())].pop(), kinds[best].tolist()
                count[best] -= 1
                sequence.append((piece, t))
                left -= (t, 1, bearing)
                continue
            best = int(np.flatnonzero(count)[-1])  # the smallest that is left; none fits whole
            t, bearing = kinds[best].tolist()
            take = min(int(left[0]), t - bearing + int(left[2]))
            if take <= 0:
                break
            piece = stock[tuple(kinds[best].tolist())].pop()
            count[best] -= 1
            sequence.append((piece, take))
            left -= (take, 1, max(0, take - (t - bearing)))
            rest.append((t - take, min(bearing, t - take), piece))
        yield sequence


def powers_of_two(sequence: list[tuple[int, int]]) -> Iterator[list[tuple[int, int]]]:
    """Cut a short sequence into sequences whose lengths are powers of two, longest first."""
    left = sum(n for _, n in sequence)
    parts = [list(p) for p in reversed(sequence)]
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        out = []
        while room:
            piece, n = parts[-1]
            take = min(n, room)
            out.append((piece, take))
            room -= take
            parts[-1][1] -= take
            if not parts[-1][1]:
                parts.pop()
        yield out


def pack(ids: list[np.ndarray], loss: list[int], limits: tuple[int, int, int] = (TOKENS, SEGMENTS, TOKENS)
         ) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences as lists of (example, start in it, length); together they hold each token of each example once.

    ``loss`` counts the loss-bearing tokens at the end of each example. A sequence that is short in tokens is cut into powers of
    two, whatever limit closed it.
    """
    pieces: list[tuple[int, int, int, int]] = []  # example, start, length, loss
    chunk = min(limits[0], limits[2])
    for i, (own, bearing) in enumerate(zip(ids, loss)):
        n = len(own)
        for at in range(0, n, chunk):
            end = min(at + chunk, n)
            pieces.append((i, at, end - at, max(0, end - max(at, n - bearing))))
    used = [0] * len(pieces)
    for sequence in dot_product_fill(np.array([p[2] for p in pieces], np.int64), np.array([p[3] for p in pieces], np.int64), limits):
        full = sum(n for _, n in sequence) == limits[0]
        for part in [sequence] if full else powers_of_two(sequence):
            out = []
            for piece, n in part:
                out.append((pieces[piece][0], pieces[piece][1] + used[piece], n))
                used[piece] += n
            yield out


def _packer(path: str, limits: tuple[int, int, int], with_ids: bool):
    def packer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, number = Encoder(path, space_chunks), TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        pieces = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number
            held.sort(key=lambda row: (row[0] is None, row[0] or 0))
            ids = [row[1] for row in held]
            rows: list[tuple] = []
            for sequence in pack(ids, [row[2] for row in held], limits):
                offset = 0
                for example, start, n in sequence:
                    own = ids[example][start:start + n]
                    borne = max(0, start + n - max(start, len(ids[example]) - held[example][2]))
                    rows.append((held[example][0], start, n, zlib.crc32(own.astype("<u4").tobytes()), len(ids[example]), number,
                                 offset, borne, own))
                    offset += n
                number += 1
                if len(rows) >= 2000:
                    yield _batch(rows, with_ids)
                    rows = []
            if rows:
                yield _batch(rows, with_ids)
            held.clear()

        for batch in batches:
            for some in words.slices(batch, "text"):
                loss = some["loss_tokens"].to_pylist()
                for doc, ids, bearing in zip(some["doc_id"].to_pylist(), encoder.encode(some["text"].to_pylist()), loss):
                    ids = np.append(ids, np.uint32(END))
                    held.append((doc, ids.astype(np.uint16) if ids.max() < 1 << 16 else ids,
                                 len(ids) if bearing is None else max(0, min(bearing, len(ids)))))
                    pieces += -(-len(ids) // limits[0])
                if pieces >= PIECES:
                    yield from flush()
                    pieces = 0
        yield from flush()
    return packer


def _batch(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    *cols, ids = zip(*rows)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"]
    arrays = [pa.array(c, pa.int64()) for c in cols]
    if with_ids:
        edges = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        arrays.append(pa.ListArray.from_arrays(edges, pa.array(np.concatenate(ids).astype(np.int32))))
    return pa.RecordBatch.from_arrays(arrays, [*names, "ids"] if with_ids else names)


def pack_documents(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", loss_tokens: str | None = None,
                   limits: tuple[int, int, int] = (TOKENS, SEGMENTS, TOKENS), with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens and, if wanted, ids.

    Every token of every row, with the end id, lies in exactly one piece. A null text counts as empty: its only token is the
    end id. ``loss_tokens`` names a column with the number of loss-bearing tokens at an example's end (null: all).
    Rows that repeat an identifier, and rows without one, are packed each for itself. Other columns are not looked at.
    """
    loss = F.col(loss_tokens).cast("long") if loss_tokens else F.lit(None).cast("long")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), loss.alias("loss_tokens"))
    return rows.mapInArrow(_packer(path, limits, with_ids), f"{RESULT}, ids array<int>" if with_ids else RESULT)
