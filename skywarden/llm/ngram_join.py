"""N-gram Jaccard join by size: subsets of small sets, inverted lists for large ones.

A document's set holds its distinct word shingles as 64-bit hashes; equal sets are one representative. Sets that reach
similarity t share at least ceil(t * n) shingles, so under any common order of shingles, here rarest first, their first
n - ceil(t * n) + k shingles have k in common. First all sets look up the inverted lists of their prefix (k = 1); shingles
known to be in one set only open no list. Where members of a list are still apart after that, small sets enumerate the
2-subsets of their prefix (k = 2) and meet in equal subsets, and large sets meet in the lists. The boundary between small
and large is the size with the least cost, subsets written below it plus pairs of list members still apart above it; these
pairs are counted, as a list's length says nothing about them: near copies fill long lists and link to the first of them.

Counts come from a count-min sketch of all sets (``blocks``); they order shingles and skip those of a single set. An
estimate is the same for all sets that hold the shingle and never too low, so no link is lost.

Links are not expanded inside a group: members of a list are first compared with the list's smallest member; then, after
these links were merged into components, only members of one list that are still in different components are compared.
Every pair that can link is thus compared or already connected. In the list of a pair's first common shingles, what lies before them
bounds the overlap; members whose bound is too small for both sizes are not compared there.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from skywarden.llm import blocks as B
from skywarden.llm import words as W
from skywarden.llm.components import components
from skywarden.llm.exact import without
from skywarden.session import written

PERCENT = 90  # contract of op3
SHINGLE = 3
STAGE_PERCENT = 80  # near duplicates elsewhere
STAGE_SHINGLE = 5
BYTES_PER_SHINGLE = 6
ROWS = 50_000  # written at once by a task
PAIR = np.uint64(0x9E3779B97F4A7C15)
CLASSES = 4  # size classes per doubling, for the cost histogram


def shingle_sets(texts: list[bytes | None], size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words is one shingle, an empty one has none."""
    words, lengths = W.split([text.lower() if text else text for text in texts])
    h = W.hashes(words)
    shingles = W.window_hashes(h, size, 3)
    out, at = [], 0
    for n in lengths.tolist():
        if n >= size:
            out.append(np.unique(shingles[at:at + n - size + 1]))
        else:
            out.append(W.window_hashes(h[at:at + n], n, 3 + n) if n else np.zeros(0, np.uint64))
        at += n
    return out


def _digests(size: int):
    def digests(batches):
        for batch in (part for whole in batches for part in W.slices(whole, "text")):
            sets = shingle_sets(W.column_bytes(pa.chunked_array([batch["text"]])), size)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())], ["doc_id", "n_shingles", "digest"])
    return digests


class Sets:
    """Sets of the representatives of a block."""

    def __init__(self, table: pa.Table, chosen: pa.Table, size: int):
        keep = set(chosen["rep"].to_pylist())
        rows = dict(zip(table["doc_id"].to_pylist(), W.column_bytes(table["text"])))
        self.reps = sorted(r for r in keep if r in rows)
        self.sets = shingle_sets([rows[r] for r in self.reps], size)
        every = np.concatenate([np.zeros(0, np.uint64), *self.sets])
        self.values, self.place, self.counts = np.unique(every, return_inverse=True, return_counts=True)


def _halves(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return h, W.mix(h.copy())


def _ask(plan: B.Layout, size: int):
    def ask(table: pa.Table, chosen: pa.Table) -> pa.Table:
        if not table.num_rows or not chosen.num_rows:
            return B.messages([])
        found = Sets(table, chosen, size)
        return B.Sketch(plan, *_halves(found.values)).question(1, table["block"][0].as_py(), found.counts)
    return ask


def _prefixes(plan: B.Layout, size: int, percent: int):
    """Prefixes with counts, for sets whose prefix holds a shingle of another set, and their whole sets."""

    def prefixes(table: pa.Table, other: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        chosen = other.filter(pa.compute.is_valid(other["rep"])) if other.num_rows else other
        if table.num_rows and chosen.num_rows:
            found = Sets(table, chosen, size)
            counts = B.Sketch(plan, *_halves(found.values)).estimates(B.received(other.filter(pa.compute.is_null(other["rep"])), 1))
            at = 0
            for rep, own in zip(found.reps, found.sets):
                n = len(own)
                mine = counts[found.place[at:at + n]]
                at += n
                spare = n - -(-percent * n // 100)
                some = np.flatnonzero(mine >= 2)
                rank = some[np.lexsort((own[some], mine[some]))]
                single = n - len(some)
                # rarest first: the shingles of a single set come before all others
                one, two = rank[:max(spare + 1 - single, 0)], rank[:max(spare + 2 - single, 0)]
                if not len(one) and len(two) < 2:
                    continue
                rows.append((rep, n, single, own[one].tobytes(), own[two].tobytes(), float(len(two) * (len(two) - 1) / 2), own.tobytes()))
        cols = list(zip(*rows)) if rows else [[] for _ in range(7)]
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.float64(), pa.binary())
        names = ("rep", "n", "single", "one", "two", "subset_cost", "body")
        return pa.table({name: pa.array(col, kind) for name, col, kind in zip(names, cols, kinds)})
    return prefixes


def boundary(costs: DataFrame) -> int:
    """Largest size of a small set: the cut of the size histogram (n, scan_cost, subset_cost of each set) with the least total cost."""
    size_class = F.floor(CLASSES * F.log2("n")).cast("int").alias("size_class")
    rows = (costs.groupBy(size_class).agg(F.max("n").alias("n"), F.sum("scan_cost").alias("scan"), F.sum("subset_cost").alias("subset"))
            .orderBy("size_class").collect())  # at most CLASSES rows for each doubling of a set's size
    best, cut = sum(r.scan for r in rows), 0
    for i, row in enumerate(rows):
        cost = sum(r.subset for r in rows[:i + 1]) + sum(r.scan for r in rows[i + 1:])
        if cost < best:
            best, cut = cost, row.n
    return cut


def _entries(rep: int, n: int, single: int, one: bytes):
    """A row for each shingle of the prefix."""
    key = np.frombuffer(one, np.int64)
    yield key, rep, n, n - single - np.arange(len(key))


def _subsets(rep: int, n: int, single: int, two: bytes):
    """Rows of all pairs of the prefix, a bounded number at once."""
    h = np.frombuffer(two, np.uint64)
    step = max(1, ROWS // max(len(h), 1))
    for start in range(0, len(h) - 1, step):
        i = np.arange(start, min(start + step, len(h) - 1))
        times = len(h) - 1 - i
        first = np.repeat(i, times)
        j = np.arange(len(first)) - np.repeat(np.cumsum(times) - times, times) + first + 1
        low, high = np.minimum(h[first], h[j]), np.maximum(h[first], h[j])
        yield W.mix(W.mix(low.copy()) + high * PAIR).view(np.int64), rep, n, n - single - j + 1


def _keys(rows_of, prefix: str):
    """(key, rep, n, r) from the prefix column of that name.

    ``r`` bounds the overlap of two sets whose first common shingles are the key: what lies before them is not common.
    """

    def flushed(parts: list[tuple]) -> pa.RecordBatch:
        size = [len(part[0]) for part in parts]
        rep, n = (np.repeat([part[at] for part in parts], size) for at in (1, 2))
        key, r = (np.concatenate([part[at] for part in parts]) for at in (0, 3))
        return pa.RecordBatch.from_arrays(
            [pa.array(x, k) for x, k in zip((key, rep, n, r), (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["key", "rep", "n", "r"])

    def keys(batches):
        for batch in batches:
            parts, rows = [], 0
            for row in zip(*(batch[c].to_pylist() for c in ("rep", "n", "single", prefix))):
                for part in rows_of(*row):
                    parts.append(part)
                    rows += len(part[0])
                    if rows >= ROWS:
                        yield flushed(parts)
                        parts, rows = [], 0
            if parts:
                yield flushed(parts)
    return keys


def _listed(prefixes: DataFrame, rows_of, prefix: str) -> DataFrame:
    return written(prefixes.select("rep", "n", "single", prefix).mapInArrow(
        _keys(rows_of, prefix), "key long, rep long, n int, r int"), "entries")


def _stars(entries: DataFrame, fits: Column) -> DataFrame:
    """Pairs of a list's smallest member and another one."""
    heads = entries.groupBy("key").agg(F.min("rep").alias("a"), F.max("rep").alias("last"), F.min_by("n", "rep").alias("n_a"),
                                       F.min_by("r", "rep").alias("r_a"))
    heads = written(heads.where("a <> last").select("key", "a", "n_a", "r_a"), "heads")
    return (entries.select("key", F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("r").alias("r_b")).join(heads, "key")
            .where((F.col("a") != F.col("b")) & fits).select("a", "b").distinct())


def _named(entries: DataFrame, labels: DataFrame) -> DataFrame:
    return written(entries.join(labels, entries.rep == labels.node, "left")
                   .select("key", "rep", "n", "r", F.coalesce("component", "rep").alias("component")), "named")


def _fitting(entries: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Entries of lists with members in different components: key, rep, n, r, component; without those whose bound is too small
    even for the list's smallest set, as no pair of theirs can fit."""
    named = _named(entries, labels)
    lists = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("n").alias("least"))
    lists = written(lists.where("low <> high").select(F.col("key").alias("list"), "least"), "apart")
    return written(named.join(lists, F.expr(f"key = list AND {100 + percent} * r >= {percent} * (n + least)"))
                   .select("key", "rep", "n", "r", "component"), "members")


def _apart(entries: DataFrame, labels: DataFrame) -> DataFrame:
    """Entries of lists with members in different components: key, rep, n, r, component, others (entries of the list in other components)."""
    named = _named(entries, labels)
    own = written(named.groupBy("key", "component").agg(F.count(F.lit(1)).alias("own")), "own")
    lists = own.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.sum("own").alias("listed"))
    own = written(own.join(written(lists.where("low <> high").select("key", "listed"), "apart"), "key"), "own")
    return written(named.join(own.select("key", "component", (F.col("listed") - F.col("own")).alias("others")), ["key", "component"]), "members")


def _rest(members: DataFrame, fits: Column) -> DataFrame:
    """Pairs of members of one list in different components."""
    left, right = (members.select("key", *(F.col(c).alias(f"{c}_{s}") for c in ("rep", "n", "r", "component"))) for s in "ab")
    return (left.join(right, "key").where((F.col("component_a") < F.col("component_b")) & fits)
            .select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b")).distinct())


def _verify(percent: int):
    def verify(batches):
        for batch in batches:
            a = [np.frombuffer(x, np.uint64) for x in batch["body_a"].to_pylist()]
            b = [np.frombuffer(x, np.uint64) for x in batch["body_b"].to_pylist()]
            common = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(a, b)]
            good = pa.array([100 * c >= percent * (len(x) + len(y) - c) for c, x, y in zip(common, a, b)], pa.bool_())
            yield batch.select(["a", "b"]).filter(good)
    return verify


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sets reach the similarity, compared whole."""
    a = sets.select(F.col("rep").alias("a"), F.col("body").alias("body_a"))
    b = sets.select(F.col("rep").alias("b"), F.col("body").alias("body_b"))
    return pairs.join(a, "a").join(b, "b").mapInArrow(_verify(percent), "a long, b long")


def representatives(docs: DataFrame, doc_id: str, text: str, size: int) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, n_shingles, digest) and, for each distinct set that is not empty, (digest, rep, n)."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    every = written(rows.mapInArrow(_digests(size), "doc_id long, n_shingles long, digest binary"), "sets")
    reps = every.where("n_shingles > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"))
    return every, written(reps, "representatives")


def link_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest identifier reachable by links, itself included).

    Two documents link when 100 * intersection >= percent * union of their sets. A null or empty text has no shingles and
    links with nothing; a text shorter than a shingle is one shingle. Rows that repeat an identifier must repeat
    the text. A null identifier links with nothing and has a null component. Other columns are not looked at.
    """
    every, reps = representatives(docs, doc_id, text, size)
    plan = B.layout(docs, text, BYTES_PER_SHINGLE)
    texts = docs.select(B.block_of(F.col(doc_id), plan), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    chosen = reps.select(B.block_of(F.col("rep"), plan), "rep")
    totals = B.answered(texts.groupBy("block").cogroup(chosen.groupBy("block")).applyInArrow(_ask(plan, size), B.MESSAGE),
                        B.merge_sketches(1, plan.width))
    told = totals.unionByName(chosen, allowMissingColumns=True)
    prefixes = written(texts.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(
        _prefixes(plan, size, percent), "rep long, n int, single int, one binary, two binary, subset_cost double, body binary"), "prefixes")
    sets = prefixes.select("rep", "body")
    fits = F.expr(f"{100 + percent} * least(r_a, r_b) >= {percent} * (n_a + n_b)")

    entries = _listed(prefixes, _entries, "one")
    links = written(_linked(_stars(entries, fits), sets, percent), "links")
    members = _apart(entries, components(links))
    scan = members.groupBy("rep").agg((F.sum("others") / 2).alias("scan_cost"))  # a pair is made once
    cut = boundary(prefixes.select("rep", "n", "subset_cost").join(written(scan, "scan"), "rep"))
    if cut:  # sets up to the cut meet in subsets; in the lists only pairs with a larger set are left
        small = prefixes.where(F.col("n") <= cut).join(members.select("rep").distinct(), "rep", "left_semi")
        subsets = _listed(small, _subsets, "two")
        links = written(links.unionByName(_linked(_stars(subsets, fits), sets, percent)), "links")
        labels = components(links)
        members = _fitting(entries.where(100 * F.col("n") >= percent * cut), labels, percent)
        rest = _rest(_fitting(subsets, labels, percent), fits).union(_rest(members, fits & (F.greatest("n_a", "n_b") > cut))).distinct()
    else:
        rest = _rest(members, fits)
    more = written(_linked(rest, sets, percent), "links")
    final = written(components(links.unionByName(more)), "components")

    smallest = reps.join(final, reps.rep == final.node, "left").select("digest", F.coalesce("component", "rep").alias("component"))
    joined = every.join(written(smallest, "smallest"), "digest", "left")
    none = F.col("n_shingles").eqNullSafe(F.lit(0)) | F.col("doc_id").isNull()
    return joined.select("doc_id", "n_shingles", F.when(none, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))


def one_per_component(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = STAGE_SHINGLE,
                      percent: int = STAGE_PERCENT) -> DataFrame:
    """The documents without those that link to a smaller one; columns as they were."""
    found = link_components(docs, doc_id, text, size, percent)
    return without(docs, doc_id, found.select("doc_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")))
