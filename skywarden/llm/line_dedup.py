"""Line dedup: hashes of lines are range-partitioned, sorted by document and streamed; the result is a keep bitmap per document.

A line's key is the line without white space at both ends, A-Z in lower case. A key of at least ``MIN_POINTS`` code points
that is found in at least ``MIN_DOCS`` documents loses all its lines except those of the largest document holding it.

* One pass over the texts gives a row for each (document, key): the key's 128-bit hash and the places of its lines. Texts are not
  shuffled for it.
* Rows are dealt by ranges of (hash, document descending) and sorted within, so a key that a third of all documents hold
  is spread over as many tasks as it needs. Each task streams its rows: the first document of a key stays, rows of further
  ones go once a third document is met; no key is held in memory.
* A key cut by a range border is only known in part to each task. Its rows are marked, and each task adds two summary rows,
  those of its first and its last key; a join with the summaries (at most two rows a task) decides them.
* What goes becomes a compressed bitmap for each document. Texts meet their bitmap once, by document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from skywarden.llm import words as W
from skywarden.session import written

MIN_POINTS, MIN_DOCS = 20, 3
NO_ID = np.iinfo(np.int64).min
LINES = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("tag", pa.int64()), ("n_lines", pa.int64()), ("at", pa.binary())])
LINES_DDL = "h1 long, h2 long, doc long, tag long, n_lines long, at binary"
GOES, OPEN, SUMMARY = 0, 1, 2
FOUND_DDL = "kind int, h1 long, h2 long, doc long, tag long, at binary, docs long"
FOUND = pa.schema([("kind", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("tag", pa.int64()),
                   ("at", pa.binary()), ("docs", pa.int64())])


def key_of(line: bytes) -> bytes:
    """The line without white space at both ends, A-Z in lower case (bytes know only those)."""
    return line.strip(b" \t\n\v\f\r").lower()


def is_long(key: bytes, points: int) -> bool:
    """At least ``points`` code points; a code point has one to four bytes."""
    return len(key) >= points and (len(key) >= 4 * points or len(key.decode()) >= points)


def _keys(points: int):
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text"):
                texts = part["text"].cast(pa.large_binary()).to_pylist()
                hashes, owner, places, n_lines = [], [], [], []
                for i, text in enumerate(texts):
                    lines = (text or b"").split(b"\n")
                    n_lines.append(len(lines))
                    mine: dict[bytes, list[int]] = {}
                    for at, line in enumerate(lines):
                        if len(line) >= points and is_long(key := key_of(line), points):
                            mine.setdefault(xxhash.xxh3_128_digest(key), []).append(at)
                    hashes.extend(mine)
                    places.extend(np.array(at, np.uint32).tobytes() for at in mine.values())
                    owner.extend([i] * len(mine))
                both = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
                of = pa.array(owner, pa.int64())
                doc, tag, none = part["doc"], part["tag"], pa.nulls(part.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1])), doc.take(of), tag.take(of),
                     pa.nulls(len(owner), pa.int64()), pa.array(places, pa.binary())], schema=LINES)
                yield pa.RecordBatch.from_arrays(
                    [none, none, doc, tag, pa.array(n_lines, pa.int64()), pa.nulls(part.num_rows, pa.binary())], schema=LINES)
    return keys


def _rows(kind: int, table: pa.RecordBatch, which: np.ndarray) -> pa.RecordBatch:
    rows = table.take(pa.array(which, pa.int64()))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(which), kind, np.int32)), rows["h1"], rows["h2"], rows["doc"], rows["tag"], rows["at"],
         pa.nulls(len(which), pa.int64())], schema=FOUND)


def _summary(key: tuple[int, int], docs: int, top: int) -> pa.RecordBatch:
    top = None if top == NO_ID else top
    return pa.RecordBatch.from_arrays(
        [pa.array([value], field.type) for value, field in zip((SUMMARY, *key, top, None, None, docs), FOUND)], schema=FOUND)


def _stream(min_docs: int):
    """Sorted rows in; rows that go, rows of keys cut by the partition's borders, and summaries of these keys out."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, top, last, docs = None, NO_ID, None, 0  # the current key, its first (largest) document, its last one, documents so far
        leading = True  # the current key is the partition's first
        waiting: list[pa.RecordBatch] = []  # rows of the current key that go if further documents follow
        for batch in batches:
            if not batch.num_rows:
                continue
            h1, h2 = batch["h1"].to_numpy(), batch["h2"].to_numpy()
            doc = batch["doc"].fill_null(NO_ID).to_numpy()
            opens = np.ones(len(doc), bool)
            opens[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            opens[0] = key != (int(h1[0]), int(h2[0]))
            new = opens.copy()
            new[1:] |= doc[1:] != doc[:-1]
            new[0] |= last is None or doc[0] != last
            starts = np.flatnonzero(opens)
            run = np.cumsum(opens)  # 0: still the key of the batch before
            count = np.cumsum(new)
            before = np.concatenate([[-docs], count[starts] - 1])  # documents counted before each run
            place = count - before[run]
            ends = np.append(starts - 1, len(doc) - 1)
            total = np.where(ends >= 0, place[ends], docs)  # documents of each run as far as seen (run 0 may have no row here)
            if leading and docs:
                inner = run > 0
                yield _rows(OPEN, batch, np.flatnonzero(~inner))
            elif leading:
                inner = run > 1
                yield _rows(OPEN, batch, np.flatnonzero(~inner))
            else:
                inner = np.ones(len(doc), bool)
            if leading and len(starts) > (0 if docs else 1):  # the first key ends here
                n, first = (int(total[0]), top) if docs else (int(total[1]), int(doc[0]))
                yield _summary(key or (int(h1[0]), int(h2[0])), n, first)
                leading = False
            if total[0] >= min_docs:
                yield from waiting
            if len(starts) or total[0] >= min_docs:
                waiting = []
            enough = total[run] >= min_docs
            yield _rows(GOES, batch, np.flatnonzero(inner & enough & (place >= 2)))
            waits = inner & ~enough & (place >= 2) & (run == run[-1])
            if waits.any():
                waiting.append(_rows(GOES, batch, np.flatnonzero(waits)))
            if len(starts):
                top = int(doc[starts[-1]])
            key, last, docs = (int(h1[-1]), int(h2[-1])), int(doc[-1]), int(place[-1])
        if key is not None:
            for rows in waiting:
                yield rows.set_column(0, FOUND.field("kind"), pa.array(np.full(rows.num_rows, OPEN, np.int32)))
            yield _summary(key, docs, top)
    return stream


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        dropped, keep = [], []
        for n, parts in zip(batch["n_lines"].to_pylist(), batch["parts"].to_pylist()):
            gone = np.unique(np.concatenate([np.frombuffer(p, np.uint32) for p in parts])) if parts else []
            dropped.append(len(gone))
            if len(gone):
                bits = np.ones(n, bool)
                bits[gone] = False
                keep.append(pack.compress(np.packbits(bits).tobytes()))
            else:
                keep.append(None)
        yield pa.RecordBatch.from_arrays(
            [batch["doc"], batch["tag"], batch["n_lines"], pa.array(dropped, pa.int64()), pa.array(keep, pa.binary())],
            names=["doc", "tag", "n_lines", "n_dropped", "keep"])


def _document(doc_id: str, text: str) -> list[Column]:
    """What tells documents apart: the identifier and, for rows that share one, a hash of the text."""
    return [F.col(doc_id).cast("long").alias("doc"), F.xxhash64(F.col(text)).alias("tag")]


def keep_bitmaps(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", points: int = MIN_POINTS,
                 min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc, tag, n_lines, n_dropped, keep) for every different document; ``keep`` is null where all lines stay.

    ``tag`` is the hash of the text, as rows may share an identifier; ``keep`` has a bit for each line, compressed by zstd. Rows
    with one identifier are one document: they are counted once, and a key stays in all or none of them. A null
    identifier is smaller than all others. A null or empty text is one empty line. An empty table gives no rows. Columns other than
    the two named are not looked at. A text must fit in a task's memory a few times over, however long its lines.
    """
    rows = docs.select(*_document(doc_id, text), F.col(text).alias("text"))
    lines = written(rows.mapInArrow(_keys(points), LINES_DDL), "lines")
    hashed = lines.where("h1 IS NOT NULL").select("h1", "h2", "doc", "tag", "at")
    order = [F.col("h1"), F.col("h2"), F.col("doc").desc_nulls_last()]
    ranges = hashed.repartitionByRange(*order).sortWithinPartitions(*order, "tag")
    found = written(ranges.mapInArrow(_stream(min_docs), FOUND_DDL), "line-runs")
    cut = (found.where(F.col("kind") == SUMMARY).groupBy("h1", "h2").agg(F.sum("docs").alias("docs"), F.max("doc").alias("top"))
           .where(F.col("docs") >= min_docs).select("h1", "h2", "top"))
    # at most two summaries a task, so the table is bounded by the number of tasks
    later = (found.where(F.col("kind") == OPEN).join(F.broadcast(cut), ["h1", "h2"])
             .where(~F.col("doc").eqNullSafe(F.col("top"))))
    goes = found.where(F.col("kind") == GOES).select("doc", "tag", "at").unionByName(later.select("doc", "tag", "at"))
    parts = goes.groupBy(F.col("doc").alias("doc2"), F.col("tag").alias("tag2")).agg(F.collect_list("at").alias("parts"))
    every = lines.where("h1 IS NULL").select("doc", "tag", "n_lines").dropDuplicates(["doc", "tag"])
    marked = every.join(parts, F.col("doc").eqNullSafe(F.col("doc2")) & (F.col("tag") == F.col("tag2")), "left")
    return marked.select("doc", "tag", "n_lines", "parts").mapInArrow(
        _bitmaps, "doc long, tag long, n_lines long, n_dropped long, keep binary")


def _kept(with_text: bool):
    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for part in W.slices(batch, "text"):
                texts = part["text"].cast(pa.large_binary()).to_pylist()
                out = []
                for text, n, keep in zip(texts, part["n_lines"].to_pylist(), part["keep"].to_pylist()):
                    if keep is not None:
                        stays = np.unpackbits(np.frombuffer(unpack.decompress(keep), np.uint8), count=n).tolist()
                        text = b"\n".join([line for line, stay in zip(text.split(b"\n"), stays) if stay])
                    out.append(text)
                sha = pa.array([hashlib.sha256(text or b"").hexdigest() for text in out], pa.string())
                columns = [part["doc"], part["n_lines"], part["n_dropped"], sha]
                names = ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
                if with_text:
                    columns, names = [*columns, pa.array(out, pa.binary()).cast(pa.string())], [*names, "kept_text"]
                yield pa.RecordBatch.from_arrays(columns, names=names)
    return kept


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", points: int = MIN_POINTS, min_docs: int = MIN_DOCS,
                with_text: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_lines (before dropping), n_dropped, kept_sha256 of the lines left joined by \\n, and the
    text left if asked for. Nulls, repeated rows and empty tables as in ``keep_bitmaps``; a null text stays null and has the
    hash of an empty one, a text without any line left is empty.
    """
    maps = keep_bitmaps(docs, doc_id, text, points, min_docs).withColumnsRenamed({"doc": "doc2", "tag": "tag2"})
    rows = docs.select(*_document(doc_id, text), F.col(text).alias("text"))
    joined = rows.join(maps, F.col("doc").eqNullSafe(F.col("doc2")) & (F.col("tag") == F.col("tag2")))
    schema = "doc_id long, n_lines long, n_dropped long, kept_sha256 string" + (", kept_text string" if with_text else "")
    return joined.select("doc", "text", "n_lines", "n_dropped", "keep").mapInArrow(_kept(with_text), schema)
