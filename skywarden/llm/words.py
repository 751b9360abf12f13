"""Words and 64-bit hashes of words and word windows, as NumPy arrays over many texts at once.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and carriage return: what
``bytes.split()`` yields.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
import xxhash

CACHED_WORDS = 300_000
MASK = (1 << 64) - 1


class Cache(dict):
    """Bounded memory of a function of a word; it starts anew when full, so a worker's memory does not grow."""

    def __init__(self, function, size: int = CACHED_WORDS):
        super().__init__()
        self.function, self.size = function, size

    def __missing__(self, word):
        if len(self) >= self.size:
            self.clear()
        value = self[word] = self.function(word)
        return value


HASHES = Cache(xxhash.xxh3_64_intdigest)
DIGESTS = Cache(xxhash.xxh3_128_digest)


def split(texts: list[bytes | None]) -> tuple[list[bytes], np.ndarray]:
    """All words of the texts in order, and the number of words of each text; a null text has none."""
    each = [text.split() if text else [] for text in texts]
    return list(chain.from_iterable(each)), np.fromiter(map(len, each), np.int64, len(each))


def distinct(words: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The distinct words, and the place among them of each word."""
    place = pa.array(words, pa.large_binary()).dictionary_encode().indices.to_numpy()
    first = np.flatnonzero(np.diff(np.maximum.accumulate(place), prepend=-1))  # places count up as new words appear
    return [words[i] for i in first.tolist()], place


def hashes(words: list[bytes]) -> np.ndarray:
    some, place = distinct(words)
    return np.fromiter(map(HASHES.__getitem__, some), np.uint64, len(some))[place]


def hash_pairs(words: list[bytes]) -> np.ndarray:
    """The two halves of a 128-bit hash of each word, as two arrays."""
    some, place = distinct(words)
    pairs = np.frombuffer(b"".join(map(DIGESTS.__getitem__, some)), np.uint64).reshape(-1, 2)
    return np.stack([pairs[:, 0][place], pairs[:, 1][place]])


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits of a 64-bit value over all bits (in place)."""
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xA3B195354A39B70D)
    x ^= x >> np.uint64(32)
    return x


def multipliers(seed: int, n: int) -> list[np.uint64]:
    """Odd 64-bit numbers that depend on the seed only."""
    return [np.uint64(xxhash.xxh3_64_intdigest(b"%d" % i, seed) | 1) for i in range(n)]


def window_hashes(h: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive values (multilinear, then mixed)."""
    n = max(len(h) - size + 1, 0)
    out = np.zeros(n, np.uint64)
    for j, a in enumerate(multipliers(seed, size)):
        out += h[j:j + n] * a
    return mix(out)


def slices(batch: pa.RecordBatch, column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``limit`` bytes of text each, or one longer text; at least one part, also of an empty batch."""
    sizes = np.array([x or 0 for x in pa.compute.binary_length(batch[column]).to_pylist()], np.int64)
    part = (np.cumsum(sizes) - sizes) // limit
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        yield batch.slice(a, b - a)


def column_bytes(column: pa.ChunkedArray) -> list[bytes | None]:
    """UTF-8 bytes of a string column."""
    return column.cast(pa.large_binary()).to_pylist()


def ids_of(column: pa.ChunkedArray) -> np.ndarray:
    """Identifiers as integers; a null identifier counts as the largest."""
    return np.fromiter((np.iinfo(np.int64).max if x is None else x for x in column.to_pylist()), np.int64, len(column))


def nullable(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == np.iinfo(np.int64).max)
