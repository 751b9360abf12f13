"""Substring dedup with a count-min prefilter.

Every run of ``size`` consecutive words of a document is a window. A first pass sends a sketch of each block's windows;
the merged sketch overestimates in how many documents a window occurs. A second pass exactly groups only windows
estimated to occur at least twice, by 128 bits from two independent hashes of each word, and finds the smallest document
that holds each; the sketch loses none. Words covered by a window that also starts in a document with a smaller identifier
are removed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from skywarden.llm import blocks as B
from skywarden.llm import words as W

SIZE = 13
BYTES_PER_WORD = 6
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())


class Windows:
    """Windows of a block's documents: distinct ones with their smallest document, and where each occurs."""

    def __init__(self, table: pa.Table, size: int):
        ids = W.ids_of(table["doc_id"])
        order = np.argsort(ids, kind="stable")
        texts = W.column_bytes(table["text"])
        self.ids, self.order, self.texts = ids[order], order, [texts[i] for i in order]
        self.words, self.lengths = W.split(self.texts)
        pair = W.hash_pairs(self.words)
        self.doc = np.repeat(np.arange(len(self.ids)), self.lengths)
        n = max(len(self.words) - size + 1, 0)
        self.at = np.flatnonzero(self.doc[:n] == self.doc[len(self.words) - n:]) if n else np.zeros(0, np.int64)
        h1, h2 = (W.window_hashes(h, size, seed)[self.at] for seed, h in enumerate(pair, 1))
        by = np.argsort(h1, kind="stable")
        h1, h2, owner = h1[by], h2[by], self.ids[self.doc[self.at[by]]]
        first = np.ones(len(by), bool)
        first[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        change = first.copy()
        change[1:] |= owner[1:] != owner[:-1]
        start = np.flatnonzero(first)
        self.h1, self.h2, self.least = h1[start], h2[start], owner[start]
        self.owners = np.add.reduceat(change, start, dtype=np.int64) if len(start) else np.zeros(0, np.int64)
        self.distinct = np.empty(len(by), np.int64)
        self.distinct[by] = np.cumsum(first) - 1


def _ask(plan: B.Layout, size: int):
    def ask(table: pa.Table) -> pa.Table:
        found = Windows(table, size)
        return B.Sketch(plan, found.h1, found.h2).question(1, table["block"][0].as_py(), found.owners)
    return ask


def _suspects(plan: B.Layout, found: Windows, answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Distinct windows estimated in two documents or more, ordered by bucket, and their buckets."""
    sketch = B.Sketch(plan, found.h1, found.h2)
    some = np.flatnonzero(sketch.estimates(B.received(answers, 1)) >= 2) if len(found.h1) else np.zeros(0, np.int64)
    some = some[np.argsort(sketch.bucket[some], kind="stable")]
    return some, sketch.bucket[some]


def _send(plan: B.Layout, size: int):
    def send(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return B.messages([])
        found = Windows(table, size)
        some, bucket = _suspects(plan, found, answers)
        return B.messages([(2, table["block"][0].as_py(), b, [x[some[i:j]].tobytes() for x in (found.h1, found.h2, found.least)])
                           for b, i, j in B.cuts(bucket)])
    return send


def _smallest(table: pa.Table) -> pa.Table:
    """For each window sent: does a smaller document of another block hold it?"""
    asked = list(zip(table["block"].to_pylist(), table["bucket"].to_pylist(), table["parts"].to_pylist()))
    h1, h2, doc = (np.concatenate([np.frombuffer(p[i], kind) for _, _, p in asked])
                   for i, kind in enumerate((np.uint64, np.uint64, np.int64)))
    order = np.lexsort((h2, h1))
    a, b = h1[order], h2[order]
    first = np.ones(len(order), bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    least = np.minimum.reduceat(doc[order], np.flatnonzero(first))[np.cumsum(first) - 1]
    smaller = np.empty(len(order), bool)
    smaller[order] = least < doc[order]
    rows, at = [], 0
    for block, bucket, parts in asked:
        n = len(parts[2]) // 8
        rows.append((2, block, bucket, [np.packbits(smaller[at:at + n]).tobytes()]))
        at += n
    return B.messages(rows)


def _remove(plan: B.Layout, size: int):
    def remove(table: pa.Table, answers: pa.Table) -> pa.Table:
        names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"]
        if not table.num_rows:
            return pa.table([*(pa.array([], kind) for kind in KINDS), table["carry"]], [*names, "carry"])
        found = Windows(table, size)
        some, bucket = _suspects(plan, found, answers)
        replies = B.received(answers, 2)
        elsewhere, suspect = np.zeros(len(found.h1), bool), np.zeros(len(found.h1), bool)
        suspect[some] = True
        for b, i, j in B.cuts(bucket):
            elsewhere[some[i:j]] = np.unpackbits(np.frombuffer(replies[b][0], np.uint8), count=j - i).astype(bool)
        which, owner = found.distinct, found.ids[found.doc[found.at]]
        gone = suspect[which] & (elsewhere[which] | (owner > found.least[which]))
        edge = np.zeros(len(found.words) + 1, np.int32)
        edge[found.at[gone]] += 1  # a window starts at a place once
        edge[found.at[gone] + size] -= 1
        keep = np.cumsum(edge[:-1]) == 0
        removed, sha, texts, at = [], [], [], 0
        for text, n in zip(found.texts, found.lengths.tolist()):
            mine = keep[at:at + n]
            words = found.words[at:at + n]
            at += n
            kept = words if mine.all() else [words[i] for i in np.flatnonzero(mine)]
            joined = b" ".join(kept)
            removed.append(n - len(kept))
            sha.append(hashlib.sha256(joined).hexdigest())
            texts.append((text if len(kept) == n else joined))
        texts = pa.array(texts, pa.binary()).cast(pa.string())
        values = [W.nullable(found.ids), pa.array(found.lengths), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), texts]
        return pa.table([*values, table["carry"].take(pa.array(found.order))], [*names, "carry"])
    return remove


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE,
                   carry: list[str] | None = None) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space), kept_text and a
    struct ``carry`` with the columns named.

    kept_text is the text itself if nothing was removed, else the kept words joined by one space. A null or empty text has
    no words and stays as it is. Documents shorter than a window keep all words. Rows with one identifier count as
    one owner: none of them makes the other's windows repeated. A null identifier counts as larger than all others. Columns
    not carried are not looked at. A document's text must fit in a task's memory.
    """
    plan = B.layout(docs, text, BYTES_PER_WORD)
    key = [B.block_of(F.col(doc_id), plan), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")]
    texts = docs.select(*key, F.struct(*(F.col(c) for c in carry or []), F.lit(0).alias("_none")).alias("carry"))
    totals = B.answered(texts.groupBy("block").applyInArrow(_ask(plan, size), B.MESSAGE), B.merge_sketches(1, plan.width))
    owners = B.answered(B.with_messages(texts, totals, _send(plan, size), B.MESSAGE), _smallest)
    schema = T.StructType([*T.StructType.fromDDL(RESULT), texts.schema["carry"]])
    return B.with_messages(texts, totals.unionByName(owners), _remove(plan, size), schema)


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """The documents with repeated windows cut out of their text; all rows stay, with their own columns."""
    rows = remove_repeats(docs, doc_id, text, size, docs.columns)
    return rows.select(*(F.col("kept_text" if c == text else f"carry.`{c}`").alias(c) for c in docs.columns))
