"""Spelling variants: words one edit apart, by dense tiles that compare common prefixes and suffixes.

Two words are near if they differ by exactly one inserted, deleted or replaced code point: the length of their common
prefix plus that of their common suffix reaches the longer length minus one (``q``).

* **Candidates.** ``0..q`` is cut into parts; if the common prefix ends within part ``[lo, hi)``, the words share their first ``lo`` and
  their last ``q - hi`` code points. Each word is sent to one bucket for each part, once as the longer or equal word and once as the
  word one shorter. A pair is counted only in the bucket of the part its common prefix ends in: once, whatever buckets it shares.
* **Tiles.** Words of a bucket are rows of padded code-point matrices, aligned left and right. Buckets of a similar size are stacked
  and compared at once; a larger one is compared block by block.
* **Large buckets** are streamed on as rows, their part is cut again, and they are dealt anew, until a part is one place wide:
  then only words that differ in this place meet, at most one for each letter. Nothing is capped.
* **Out of a tile** come a word's number of near words and its best one, never pairs. A word's form is followed to its root by
  pointer doubling; occurrences grow tenfold with each step, so a chain is short.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from skywarden.llm import words as W
from skywarden.session import written

MIN_POINTS, MIN_COUNT, TIMES, THIN = 7, 2, 10, 31
PARTS = 8  # at most so many parts; of two places where the word is short enough
BUCKET = 2048  # words of a bucket compared in one task; a larger one is cut further
BLOCK = 256
HELD_WORDS = 300_000  # of a task, counted together before they are sent
TILE = 4 << 20  # compared code points held at once
SENT_DDL = "key long, size int, lo int, hi int, word string, n long"
SENT = pa.schema([("key", pa.int64()), ("size", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32()), ("word", pa.string()), ("n", pa.int64())])
FOUND_DDL = f"{SENT_DDL}, n_near long, best_n long, best string"
FOUND = pa.schema([*SENT, ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


# --- words ------------------------------------------------------------------------------------------------------------

def _count(points: int, thin: int):
    runs = re.compile("[A-Za-zÀ-ÿ]{%d,}" % points)

    def flushed(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for part in W.slices(batch, "text"):
                for doc, text in zip(part["doc"].to_pylist(), part["text"].cast(pa.large_binary()).to_pylist()):
                    mine = Counter(runs.findall(text.lower().decode())) if text else {}
                    start = zlib.crc32(b"%s:" % (b"" if doc is None else str(doc).encode()))
                    for run, n in mine.items():
                        h = zlib.crc32(run.encode(), start)
                        if h % thin == 0:
                            at = h % len(run)
                            run = run[:at] + run[at + 1:]
                            if len(run) < points:
                                continue
                        seen[run] += n
                if len(seen) >= HELD_WORDS:
                    yield flushed(seen)
                    seen.clear()
        yield flushed(seen)
    return count


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", points: int = MIN_POINTS, least: int = MIN_COUNT,
               thin: int = THIN) -> DataFrame:
    """(word, n): maximal runs of letters of at least ``points`` code points with at least ``least`` occurrences, A-Z in lower case.

    A run whose crc32 with its document's identifier is divisible by ``thin`` loses the code point that the hash points at. Null texts
    have no words; a null identifier is empty text before the colon. Counts are added up map-side.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
    counts = rows.mapInArrow(_count(points, thin), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


# --- buckets ----------------------------------------------------------------------------------------------------------

def cuts(lo: int, hi: int, parts: int = PARTS) -> list[int]:
    """Borders of the parts of ``[lo, hi)``: two places wide, or wider if there would be more than ``parts``."""
    step = max(2, -(-(hi - lo) // parts)) if hi - lo > 2 else 1
    return [*range(lo, max(hi, lo + 1), step), hi]


def code_points(words: list[str], width: int | None = None, right: bool = False) -> np.ndarray:
    """Words as rows of a matrix, padded with zeros; all of one length if no width is given."""
    raw = "".join(words).encode("utf-32-le")
    flat, lengths = np.frombuffer(raw, np.uint32), np.fromiter(map(len, words), np.int64, len(words))
    if width is None:
        return flat.reshape(len(words), -1)
    out = np.zeros((len(words), width), np.uint32)
    row = np.repeat(np.arange(len(words)), lengths)
    column = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[row, column + np.repeat(width - lengths, lengths) if right else column] = flat
    return out


def _powers(seed: int, n: int) -> np.ndarray:
    base = np.full(n, xxhash.xxh3_64_intdigest(b"base", seed) | 1, np.uint64)
    return np.cumprod(base)


def keys(words: list[str], lo: int, hi: int, size: int) -> np.ndarray:
    """Hash of the first ``lo`` and last ``size - 1 - hi`` code points of words of one length, for pairs whose longer word has ``size``."""
    codes = code_points(words).astype(np.uint64)
    head = (codes[:, :lo] * _powers(1, lo)).sum(axis=1, dtype=np.uint64)
    tail = size - 1 - hi
    end = (codes[:, codes.shape[1] - tail:] * _powers(2, tail)).sum(axis=1, dtype=np.uint64) if tail else np.zeros(len(words), np.uint64)
    place = xxhash.xxh3_64_intdigest(b"%d %d %d" % (size, lo, hi))
    return W.mix(head * np.uint64(0x9E3779B97F4A7C15) + W.mix(end + np.uint64(place))).view(np.int64)


def _sent(words: list[str], n: np.ndarray, size: int, borders: list[int]) -> Iterator[pa.RecordBatch]:
    """Rows of words of one length for each part between the borders."""
    for lo, hi in zip(borders, borders[1:]):
        m = len(words)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys(words, lo, hi, size)), *(pa.array(np.full(m, x, np.int32)) for x in (size, lo, hi)), pa.array(words, pa.string()),
             pa.array(n, pa.int64())], schema=SENT)


def _first_deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, n = batch["word"].to_pylist(), batch["n"].to_numpy()
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for length in np.unique(lengths).tolist():
            some = np.flatnonzero(lengths == length)
            mine = [words[i] for i in some]
            for size in (length, length + 1):
                yield from _sent(mine, n[some], size, cuts(0, size - 1))


def _next_deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, n = batch["word"].to_pylist(), batch["n"].to_numpy()
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        shape = np.stack([batch["size"].to_numpy(), batch["lo"].to_numpy(), batch["hi"].to_numpy(), lengths], axis=1)
        for size, lo, hi, length in np.unique(shape, axis=0).tolist():
            some = np.flatnonzero((shape == (size, lo, hi, length)).all(axis=1))
            yield from _sent([words[i] for i in some], n[some], size, cuts(lo, hi))


# --- tiles ------------------------------------------------------------------------------------------------------------

def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of equal columns before the first that differs, for rows of ``a`` against rows of ``b`` in each stacked bucket."""
    out = np.zeros((a.shape[0], a.shape[1], b.shape[1]), np.int16 if a.shape[2] < 2 ** 15 else np.int64)
    equal = np.ones(out.shape, bool)
    for column in range(a.shape[2]):
        equal &= a[:, :, None, column] == b[:, None, :, column]
        if not equal.any():
            break
        out += equal
    return out


def near(left: np.ndarray, right: np.ndarray, length: np.ndarray, size: np.ndarray, lo: np.ndarray, hi: np.ndarray,
         rows: slice, columns: slice) -> np.ndarray:
    """Which words of the buckets are one edit apart, counted in this part. ``left`` and ``right`` are the words aligned either way."""
    a, b = length[:, rows, None], length[:, None, columns]
    shorter = np.minimum(a, b)
    q = (size - 1)[:, None, None]
    prefix = np.minimum(common(left[:, rows], left[:, columns]), shorter)
    suffix = np.minimum(common(right[:, rows, ::-1], right[:, columns, ::-1]), shorter)
    lo, hi = lo[:, None, None], hi[:, None, None]
    within = (prefix >= lo) & ((prefix < hi) | (hi == q))
    different = (a != b) | (prefix < a)
    return (prefix + suffix >= q) & within & different & (np.maximum(a, b) == q + 1) & (shorter > 0)


def compare(words: list[list[str]], n: list[np.ndarray], size: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
    """(bucket, word, near words, largest n of these, its word) for words with near words. Buckets hold their words in order."""
    buckets, most, width = len(words), max(map(len, words)), int(size.max())
    left, right = (np.zeros((buckets, most, width), np.uint32) for _ in range(2))
    length, count = np.zeros((buckets, most), np.int64), np.zeros((buckets, most), np.int64)
    for i, (mine, times) in enumerate(zip(words, n)):
        left[i, :len(mine)], right[i, :len(mine)] = code_points(mine, width), code_points(mine, width, right=True)
        length[i, :len(mine)], count[i, :len(mine)] = list(map(len, mine)), times
    total, best_n, best = (np.zeros((buckets, most), np.int64) for _ in range(3))
    for i in range(0, most, BLOCK):
        for j in range(0, most, BLOCK):  # in word order, so the first of equal counts is the smallest word
            rows, columns = slice(i, i + BLOCK), slice(j, j + BLOCK)
            close = near(left, right, length, size, lo, hi, rows, columns)
            total[:, rows] += close.sum(axis=2)
            counted = np.where(close, count[:, None, columns], 0)
            at = counted.argmax(axis=2)
            value = np.take_along_axis(counted, at[:, :, None], 2)[:, :, 0]
            better = value > best_n[:, rows]
            best[:, rows] = np.where(better, at + j, best[:, rows])
            best_n[:, rows] = np.where(better, value, best_n[:, rows])
    for i, j in np.argwhere(total):
        yield int(i), int(j), int(total[i, j]), int(best_n[i, j]), int(best[i, j])


class _Tiles:
    """Complete buckets, gathered by size and length until a stack of them is worth comparing."""

    def __init__(self) -> None:
        self.stacks: dict[tuple[int, int], list[tuple[list[str], np.ndarray, int, int, int]]] = {}

    def add(self, words: list[str], n: np.ndarray, size: int, lo: int, hi: int) -> Iterator[pa.RecordBatch]:
        if len(words) < 2:
            return
        kind = (1 << (len(words) - 1).bit_length(), -(-size // 4) * 4)
        stack = self.stacks.setdefault(kind, [])
        stack.append((words, n, size, lo, hi))
        if len(stack) * min(kind[0], BLOCK) ** 2 * kind[1] >= TILE:
            yield self.flush(kind)

    def flush(self, kind: tuple[int, int]) -> pa.RecordBatch:
        stack = self.stacks.pop(kind)
        words, n, *places = zip(*stack)
        found = list(compare(list(words), list(n), *(np.array(x, np.int64) for x in places)))
        rows = [(words[i][j], total, most, words[i][k]) for i, j, total, most, k in found]
        word, total, most, best = zip(*rows) if rows else ((), (), (), ())
        empty = {name: pa.nulls(len(word), SENT.field(name).type) for name in ("key", "size", "lo", "hi", "n")}
        columns = {**empty, "word": pa.array(word, pa.string()), "n_near": pa.array(total, pa.int64()), "best_n": pa.array(most, pa.int64()),
                   "best": pa.array(best, pa.string())}
        return pa.RecordBatch.from_arrays([columns[f.name] for f in FOUND], schema=FOUND)

    def rest(self) -> Iterator[pa.RecordBatch]:
        for kind in list(self.stacks):
            yield self.flush(kind)


def _on(part: pa.RecordBatch) -> pa.RecordBatch:
    """Rows of a large bucket, to be dealt again."""
    return pa.RecordBatch.from_arrays([*part.columns, *(pa.nulls(part.num_rows, FOUND.field(i).type) for i in (6, 7, 8))], schema=FOUND)


def _stream(limit: int):
    """Rows sorted by bucket and word in; what tiles found, and the rows of buckets over the limit, out."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles, held, rows, current, over = _Tiles(), [], 0, None, False

        def close() -> Iterator[pa.RecordBatch]:
            if held and not over:
                words = [word for part in held for word in part["word"].to_pylist()]
                n = np.concatenate([part["n"].to_numpy() for part in held])
                yield from tiles.add(words, n, current[1], held[0]["lo"][0].as_py(), current[2])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, size, hi = (batch[c].to_numpy() for c in ("key", "size", "hi"))
            wide = hi - batch["lo"].to_numpy() > 1
            edges = np.flatnonzero((np.diff(key) != 0) | (np.diff(size) != 0) | (np.diff(hi) != 0)) + 1
            edges = np.concatenate([[0], edges, [len(key)]])
            more = np.diff(edges) > 1
            more[[0, -1]] = True  # a bucket may go on beyond the batch; other single words meet nobody
            for a, b in zip(edges[:-1][more].tolist(), edges[1:][more].tolist()):
                bucket = (int(key[a]), int(size[a]), int(hi[a]))
                if bucket != current:
                    yield from close()
                    held, rows, current, over = [], 0, bucket, False
                part = batch.slice(a, b - a)
                rows += b - a
                if over or rows > limit and wide[a]:
                    yield from map(_on, [*held, part])
                    held, over = [], True
                else:
                    held.append(part)
        yield from close()
        yield from tiles.rest()
    return stream


def near_words(words: DataFrame, limit: int = BUCKET) -> DataFrame:
    """(word, n_near, best_n, best) of words with near words: how many, and of these the one of largest n (ties: the smallest)."""
    sent, found = words.select("word", "n").mapInArrow(_first_deal, SENT_DDL), None
    while True:
        dealt = sent.repartition("key").sortWithinPartitions("key", "size", "hi", "word")
        out = written(dealt.mapInArrow(_stream(limit), FOUND_DDL), "near")
        mine = out.where("n_near IS NOT NULL").select("word", "n_near", "best_n", "best")
        found = mine if found is None else found.unionByName(mine)
        large = out.where("n_near IS NULL").select("key", "size", "lo", "hi", "word", "n")
        if large.isEmpty():
            break
        sent = large.mapInArrow(_next_deal, SENT_DDL)
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select(
        "word", "n_near", (-F.col("best.n")).alias("best_n"), F.col("best.word").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word that has a form (word, form): the end of its chain, by pointer doubling."""
    links = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = written(links.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if further.where("moved").isEmpty():
            return further.select("word", "root")
        links = further.select("word", "root")


def spelling_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", points: int = MIN_POINTS, least: int = MIN_COUNT,
                    times: int = TIMES, thin: int = THIN, limit: int = BUCKET) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    ``form`` is the near word of largest n (ties: the smallest in code-point order) if that is at least ``times`` the word's own n;
    ``root`` follows forms to the last, and is the word itself without one. Null and empty texts and an empty table have no
    words; repeated rows count as often as they are there; columns other than the two named are not looked at. A text must fit
    in a task's memory. Words of any length are compared whole.
    """
    words = written(vocabulary(docs, doc_id, text, points, least, thin), "vocabulary")
    best = near_words(words, limit)
    judged = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(F.col("best_n") >= times * F.col("n"), F.struct(F.col("best").alias("form"), F.col("best_n").alias("form_n"))).alias("f"))
    judged = written(judged.select("word", "n", "n_near", "f.form", "f.form_n"), "judged")
    chains = roots(judged.where("form IS NOT NULL"))
    return judged.join(chains, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
