"""Ranked lexical search over a sharded inverted index by Block-Max MaxScore.

* **Index.** Each task turns its own documents into segments of a few MB of text (no shuffle). A segment row holds its terms and, for
  each, postings in blocks of 128: document steps and counts in one, two or four bytes. A block keeps its last document and
  its *impacts*: pairs (count, document length) that no other pair of the block beats in both. Scores depend on corpus totals, known
  only once all segments are there; the impacts give a block's largest score for any totals.
* **Statistics.** Number of documents and terms, and of documents for each query term, are sums over the written segments.
* **Search.** A query's lists are ordered by their largest score. Lists whose bounds together stay below the query's current
  20th score are non-essential. The essential ones give candidates; non-essential lists are then met from the largest down,
  and a candidate whose score, block maximum and remaining bounds stay below is dropped before the block is unpacked.
  A task keeps a heap for each query over all its segments, and heaps of tasks are merged by rank.
* **Queries** are handled in groups of a bounded size, one pass over the index each; a group is what tasks are given.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from skywarden.llm import words as W
from skywarden.session import written

TOP = 20
SEGMENT_BYTES = 4 << 20
BLOCK = 128
GROUP_BYTES = 4 << 20  # of query texts handled in one pass over the index
NO_ID = np.iinfo(np.int64).max
#: letters, digits and all bytes of longer code points stay, A-Z in lower case; all else is a space
FOLD = bytes(c if c >= 128 else ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(256))
#: stored arrays: of documents, of terms, of blocks, of impacts, of packed postings
KINDS = {"ids": np.int64, "sizes": np.int64, "counts": np.int32, "last": np.int32, "widths": np.uint8, "impact_counts": np.uint8,
         "impact_tf": np.int32, "impact_n": np.int32, "body": np.uint8}
SEGMENT = pa.schema([("n_docs", pa.int64()), ("n_terms", pa.int64()), ("terms", pa.binary()), *((name, pa.binary()) for name in KINDS)])
SEGMENT_DDL = "n_docs long, n_terms long, terms binary, " + ", ".join(f"{name} binary" for name in KINDS)


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


# --- index ------------------------------------------------------------------------------------------------------------

def widths_of(values: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Bytes (1, 2, 4) that hold all values of each block."""
    most = np.maximum.reduceat(values, start) if len(start) else values[:0]
    return np.where(most < 1 << 8, 1, np.where(most < 1 << 16, 2, 4)).astype(np.int64)


def _place(size: np.ndarray, width: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value of blocks of the given sizes: where its bytes begin, and their number."""
    within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    wide = np.repeat(width, size)
    return np.repeat(offset, size) + within * wide, wide


def _store(body: np.ndarray, values: np.ndarray, at: np.ndarray, wide: np.ndarray) -> None:
    for byte in range(4):
        some = wide > byte
        body[at[some] + byte] = (values[some] >> (8 * byte)) & 255


def _load(body: np.ndarray, at: np.ndarray, wide: np.ndarray) -> np.ndarray:
    out = body[at].astype(np.int64)
    for byte in range(1, int(wide.max())):
        some = wide > byte
        out[some] |= body[at[some] + byte].astype(np.int64) << (8 * byte)
    return out


def layout(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First block of each term and first posting of each block, each with one more entry for the end."""
    blocks = -(-counts.astype(np.int64) // BLOCK)
    first = np.concatenate([[0], np.cumsum(blocks)])
    begins = np.cumsum(counts, dtype=np.int64) - counts
    start = np.repeat(begins - BLOCK * first[:-1], blocks) + BLOCK * np.arange(first[-1])
    return first, np.append(start, counts.sum(dtype=np.int64))


def impacts(tf: np.ndarray, n: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Positions, block by block, of the pairs that no other pair of the block beats in count and shortness."""
    order = np.lexsort((n, -tf, block))
    most = int(n.max()) + 2 if len(n) else 1
    value = n[order] - block[order] * most  # every block starts below all values of the one before
    least = np.minimum.accumulate(value)
    keep = np.ones(len(order), bool)
    keep[1:] = value[1:] < least[:-1]
    return order[keep]


def segment(ids: list[int | None], texts: list[bytes | None]) -> pa.RecordBatch:
    """The index of some documents, as one row."""
    number: defaultdict[bytes, int] = defaultdict(count().__next__)
    each = [np.fromiter(map(number.__getitem__, terms_of(text)), np.int32) for text in texts]
    sizes = np.fromiter(map(len, each), np.int64, len(each))
    pairs = np.concatenate(each).astype(np.int64)
    del each
    pairs *= len(texts)
    pairs += np.repeat(np.arange(len(texts)), sizes)
    pairs, tf = np.unique(pairs, return_counts=True)
    term, doc = np.divmod(pairs, len(texts))
    counts = np.bincount(term, minlength=len(number))
    _, start = layout(counts)
    size = np.diff(start)
    block = np.repeat(np.arange(len(size)), size)
    step = np.diff(doc, prepend=0)
    step[start[:-1]] = doc[start[:-1]]  # a block's first document is kept whole, so a block can be read alone
    wide = np.stack([widths_of(step, start[:-1]), widths_of(tf, start[:-1])])
    length = size * wide.sum(axis=0)
    offset = np.cumsum(length) - length
    body = np.zeros(int(length.sum()), np.uint8)
    _store(body, step, *_place(size, wide[0], offset))
    _store(body, tf, *_place(size, wide[1], offset + size * wide[0]))
    best = impacts(tf, sizes[doc], block)
    arrays = {"ids": np.array([NO_ID if i is None else i for i in ids]), "sizes": sizes, "counts": counts, "last": doc[start[1:] - 1],
              "widths": wide[0] | wide[1] << 4, "impact_counts": np.bincount(block[best], minlength=len(size)), "impact_tf": tf[best],
              "impact_n": sizes[doc[best]], "body": body}
    return pa.RecordBatch.from_arrays(
        [pa.array([int((sizes > 0).sum())]), pa.array([int(sizes.sum())]), pa.array([b" ".join(number)], pa.binary()),
         *(pa.array([arrays[name].astype(kind).tobytes()], pa.binary()) for name, kind in KINDS.items())], schema=SEGMENT)


def _segments(segment_bytes: int):
    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held = [], [], 0
        for batch in batches:
            for part in W.slices(batch, "text"):
                ids += part["doc"].to_pylist()
                texts += part["text"].cast(pa.large_binary()).to_pylist()
                held += part["text"].nbytes
                if held >= segment_bytes:
                    yield segment(ids, texts)
                    ids, texts, held = [], [], 0
        if ids:
            yield segment(ids, texts)
    return segments


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Segments of all documents, written to the shared folder. Null texts and texts without a term have no postings."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
    return written(rows.mapInArrow(_segments(segment_bytes), SEGMENT_DDL), "index")


# --- search -----------------------------------------------------------------------------------------------------------

def places(asked: list[bytes], terms: bytes) -> pa.Array:
    """Where the terms asked for stand among a segment's terms; null for others."""
    return pc.index_in(pa.array(asked, pa.binary()), value_set=pa.array(terms.split(), pa.binary()))


def stored(batch: pa.RecordBatch, at: int) -> dict[str, memoryview]:
    """A row's columns, not copied."""
    return {name: memoryview(batch[name][at].as_buffer()) for name in ("terms", *KINDS)}


class Segment:
    """One row of the index, with the corpus totals and the terms that are asked for."""

    def __init__(self, row: dict[str, memoryview], asked: list[bytes], documents: int, total: int):
        self.a = {name: np.frombuffer(row[name], kind) for name, kind in KINDS.items()}
        self.first, self.start = layout(self.a["counts"])
        widths = self.a["widths"].astype(np.int64)
        self.wide = widths & 15, widths >> 4  # bytes of a document step and of a count
        length = np.diff(self.start) * (self.wide[0] + self.wide[1])
        self.offset = np.cumsum(length) - length
        self.impact_end = np.cumsum(self.a["impact_counts"], dtype=np.int64)
        found = places(asked, bytes(row["terms"]))
        self.place = {term: at for term, at in zip(asked, found.to_pylist()) if at is not None}
        self.m = 12 * (75 + (25 * self.a["sizes"] * documents) // max(total, 1))  # 12 m of each document
        self.documents, self.total = documents, total
        self.lists: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        self.maxima: dict[bytes, np.ndarray] = {}

    def blocks(self, term: bytes) -> tuple[int, int]:
        at = self.place[term]
        return int(self.first[at]), int(self.first[at + 1])

    def block_maxima(self, term: bytes) -> np.ndarray:
        """Largest score part of each of the term's blocks, from the blocks' impacts."""
        if term not in self.maxima:
            a, b = self.blocks(term)
            start = np.append(self.impact_end[a - 1] if a else 0, self.impact_end[a:b])
            tf, n = (self.a[name][start[0]:start[-1]].astype(np.int64) for name in ("impact_tf", "impact_n"))
            parts = (1_000_000_000 * tf) // (1000 * tf + 12 * (75 + (25 * n * self.documents) // self.total))
            self.maxima[term] = np.maximum.reduceat(parts, start[:-1] - start[0])
        return self.maxima[term]

    def unpacked(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and score parts of some blocks."""
        size = self.start[blocks + 1] - self.start[blocks]
        offset, wide = self.offset[blocks], [w[blocks] for w in self.wide]
        step = _load(self.a["body"], *_place(size, wide[0], offset))
        tf = _load(self.a["body"], *_place(size, wide[1], offset + size * wide[0]))
        doc = np.cumsum(step)
        ends = np.cumsum(size)
        before = np.concatenate([[0], doc[ends[:-1] - 1]])
        doc -= np.repeat(before, size)
        return doc, (1_000_000_000 * tf) // (1000 * tf + self.m[doc])

    def whole(self, term: bytes) -> tuple[np.ndarray, np.ndarray]:
        if term not in self.lists:
            self.lists[term] = self.unpacked(np.arange(*self.blocks(term)))
        return self.lists[term]


    def some(self, term: bytes, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for some of a term's blocks; a list that most of is needed is unpacked once for all queries."""
        a, b = self.blocks(term)
        return self.whole(term) if term in self.lists or 2 * len(blocks) > b - a else self.unpacked(a + blocks)


def kth(scores: np.ndarray, k: int) -> int:
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0


def search_segment(shard: Segment, query: dict[bytes, int], threshold: int, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents (places in the segment) and whole scores of all that can be among the ``top`` above ``threshold`` or equal to it."""
    mine = [(weight * int(shard.block_maxima(term).max()), weight, term) for term, weight in query.items() if weight and term in shard.place]
    mine.sort()
    threshold = max(threshold, 1)
    bounds = np.cumsum([b for b, _, _ in mine])  # of all lists up to each
    lesser = int(np.searchsorted(bounds, threshold))  # so many lists stay below the threshold together
    score = np.zeros(len(shard.a["ids"]), np.int64)
    for _, weight, term in mine[lesser:]:
        doc, part = shard.whole(term)
        score[doc] += weight * part
    candidates = np.flatnonzero(score)
    for i in range(lesser - 1, -1, -1):
        _, weight, term = mine[i]
        threshold = max(threshold, kth(score[candidates], top))
        rest = int(bounds[i - 1]) if i else 0
        a, b = shard.blocks(term)
        block = np.searchsorted(shard.a["last"][a:b], candidates)
        there = block < b - a
        largest = np.where(there, weight * shard.block_maxima(term)[np.minimum(block, b - a - 1)], 0)
        possible = score[candidates] + largest + rest >= threshold
        candidates, block = candidates[possible], block[possible & there]
        if not len(block):
            continue
        doc, part = shard.some(term, np.unique(block))
        place = np.searchsorted(doc, candidates)
        hit = place < len(doc)
        hit[hit] = doc[place[hit]] == candidates[hit]
        score[candidates[hit]] += weight * part[place[hit]]
    return candidates, score[candidates]


def best(ids: np.ndarray, scores: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The highest scores, equal ones by identifier."""
    some = scores >= kth(scores, top)
    ids, scores = ids[some], scores[some]
    order = np.lexsort((ids, -scores))[:top]
    return ids[order], scores[order]


def _search(queries: list[tuple[int, dict[bytes, int]]], documents: int, total: int, top: int):
    asked = sorted({term for _, query in queries for term in query})

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = {number: (np.zeros(0, np.int64), np.zeros(0, np.int64)) for number, _ in queries}
        for batch in batches:
            for at in range(batch.num_rows):
                shard = Segment(stored(batch, at), asked, documents, total)
                for number, query in queries:
                    ids, scores = heaps[number]
                    doc, score = search_segment(shard, query, kth(scores, top), top)
                    if len(doc):
                        heaps[number] = best(np.concatenate([ids, shard.a["ids"][doc]]), np.concatenate([scores, score]), top)
        rows = [(number, ids, scores) for number, (ids, scores) in heaps.items() if len(ids)]
        if rows:
            found = np.concatenate([ids for _, ids, _ in rows])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat([number for number, _, _ in rows], [len(ids) for _, ids, _ in rows])), W.nullable(found),
                 pa.array(np.concatenate([scores for _, _, scores in rows]))], names=["number", "doc_id", "score"])
    return search


def _document_counts(asked: list[bytes]):
    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(asked), np.int64)
        for batch in batches:
            for at in range(batch.num_rows):
                place = places(asked, batch["terms"][at].as_py())
                here = np.frombuffer(batch["counts"][at].as_py(), KINDS["counts"])
                there = np.flatnonzero(place.is_valid().to_numpy(zero_copy_only=False))
                total[there] += here[place.drop_null().to_numpy()]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "n"])
    return counts


def weight_of(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def search(index: DataFrame, queries: DataFrame, item: str = "item_id", text: str = "text", top: int = TOP,
           group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of each query by score above 0, equal scores by ascending doc_id.

    Queries that are equal in item and text count once; of one item with several texts each text is ranked by itself. A query
    without terms, or an empty index, gives no rows. Documents with a null identifier come last among equals; repeated rows are
    documents of their own.
    """
    spark = index.sparkSession
    asked = queries.select(F.col(item).alias("item_id"), F.col(text).alias("text")).where("text IS NOT NULL").distinct()
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    documents, total = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    groups = max(1, math.ceil(size / group_bytes))
    schema = "number long, doc_id long, score long"
    found = None
    for group in range(groups):
        # a group of queries is some group_bytes long, whatever the number of queries
        mine = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == group).collect()
        words = [Counter(terms_of(row.text.encode())) for row in mine]
        terms = sorted({term for counter in words for term in counter})
        held = dict(index.select("terms", "counts").mapInArrow(_document_counts(terms), "term long, n long")
                    .groupBy("term").agg(F.sum("n")).collect()) if terms else {}
        weight = {term: weight_of(documents, held[i]) for i, term in enumerate(terms) if i in held}
        numbered = [(i, {t: weight[t] * n for t, n in counter.items() if t in weight}) for i, counter in enumerate(words)]
        hits = index.select("terms", *KINDS).mapInArrow(_search(numbered, documents, total, top), schema)
        order = Window.partitionBy("number").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        names = spark.createDataFrame([(i, row.item_id) for i, row in enumerate(mine)], f"number long, item_id {asked.schema['item_id'].dataType.simpleString()}")
        part = ranked.join(names, "number").select("item_id", "rank", "doc_id", "score")
        found = part if found is None else found.unionByName(part)
    return found


def rank_documents(docs: DataFrame, queries: DataFrame, doc_id: str = "doc_id", text: str = "text", item: str = "item_id",
                   query: str = "text", top: int = TOP, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Index all documents and search them for every query; see ``build_index`` and ``search``.

    A text, however long, is one document of one segment and must fit in a task's memory. Other columns are not looked at.
    """
    return search(build_index(docs, doc_id, text, segment_bytes), queries, item, query, top)
