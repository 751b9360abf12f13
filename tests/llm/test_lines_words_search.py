"""Line dedup, spelling variants and ranked search against plain statements of their results."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pyarrow as pa
import pytest

from skywarden.llm import line_dedup, search, spelling
from test_documents import rows_of


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


# --- lines ------------------------------------------------------------------------------------------------------------

def plain_lines(rows, points=20, least=3):
    low = float("-inf")
    holders = defaultdict(set)

    def key(line):
        k = lower(re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\Z", "", line))
        return k if len(k) >= points else None
    for doc, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(low if doc is None else doc)
    holders.pop(None, None)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(holders.get(key(x), ())) >= least and max(holders[key(x)]) != (low if doc is None else doc))]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def line_rows():
    rng = random.Random(11)
    shared = [f"shared line number {i} of many documents" for i in range(30)] + ["é" * 20, "é" * 19, "x" * 19, "x" * 20, "  \t" + "y" * 20, "Y" * 20 + "\r"]
    rows = []
    for doc in range(150):
        lines = [rng.choice(shared) if rng.random() < .3 else f"own line {rng.random()} of this document" for _ in range(rng.randrange(12))]
        if doc % 3 == 0:
            lines.insert(rng.randrange(len(lines) + 1), "A line that a third of all documents hold" if doc % 2 else "  a LINE that a third of all documents hold ")
        rows.append((doc, "\n".join(lines)))
    rows += [(1000, "\n".join(["repeated inside one document only"] * 500)), (1001, None), (1002, ""), (1003, "\n\n"), (1004, shared[0])]
    rows += [(1005, shared[1]), (1005, shared[1]), (1005, shared[1] + "\n" + shared[2]), (None, shared[1]), (None, "held by rows without an identifier")]
    rows += [(2000, "held by two documents at most\nheld by rows without an identifier"), (2001, "held by two documents at most\nheld by rows without an identifier")]
    rng.shuffle(rows)
    return rows


LINE_COLUMNS = ("doc_id", "n_lines", "n_dropped", "kept_sha256")


def test_lines_kept_are_those_of_brute_force(spark, messy, messy_rows):
    rows = line_rows()
    found = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))
    assert rows_of(found, *LINE_COLUMNS) == brute.order(plain_lines(rows))
    assert rows_of(line_dedup.dedup_lines(messy), *LINE_COLUMNS) == brute.order(plain_lines(messy_rows))


def test_line_texts_and_empty_tables(spark, nothing):
    rows = line_rows()
    texts = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True).collect()
    assert all(hashlib.sha256((r.kept_text or "").encode()).hexdigest() == r.kept_sha256 for r in texts)
    assert line_dedup.dedup_lines(nothing).count() == 0
    assert line_dedup.keep_bitmaps(nothing).count() == 0


@pytest.mark.parametrize("seed", range(60))
def test_any_cut_into_partitions_and_batches(seed):
    """Sorted rows are cut at random into partitions (never inside one document's rows of a key) and batches."""
    rng = random.Random(seed)
    rows = sorted({(rng.randrange(3), rng.randrange(2), rng.choice([None, *range(9)]), tag) for tag in range(rng.randrange(1, 60))},
                  key=lambda r: (r[0], r[1], -r[2] if r[2] is not None else 99, r[3]))
    docs = defaultdict(set)
    for h1, h2, doc, _ in rows:
        docs[h1, h2].add(doc)
    top = {k: max((d for d in v if d is not None), default=None) for k, v in docs.items()}
    expected = sorted(tag for h1, h2, doc, tag in rows if len(docs[h1, h2]) >= 3 and doc != top[h1, h2])
    parts = [[]]
    for before, row in zip([None, *rows], rows):
        if before and before[:3] != row[:3] and rng.random() < .2:
            parts.append([])
        parts[-1].append(row)

    def batches(part):
        while part:
            n = rng.randrange(1, 8)
            h1, h2, doc, tag = zip(*part[:n])
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in (h1, h2, doc, tag)), pa.array([b""] * len(tag))], names=["h1", "h2", "doc", "tag", "at"])
            part = part[n:]
    out = [r for part in parts for b in line_dedup._stream(3)(batches(part)) for r in b.to_pylist()]
    total, largest = Counter(), {}
    for r in out:
        if r["kind"] == line_dedup.SUMMARY:
            total[r["h1"], r["h2"]] += r["docs"]
            largest[r["h1"], r["h2"]] = max((d for d in (r["doc"], largest.get((r["h1"], r["h2"]))) if d is not None), default=None)
    gone = [r["tag"] for r in out if r["kind"] == line_dedup.GOES or r["kind"] == line_dedup.OPEN
            and total[r["h1"], r["h2"]] >= 3 and r["doc"] != largest[r["h1"], r["h2"]]]
    assert sorted(gone) == expected


# --- spelling ---------------------------------------------------------------------------------------------------------

def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_words(rows, points=7, least=2, thin=31):
    seen = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % thin == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= points:
                seen[run] += 1
    return {w: n for w, n in seen.items() if n >= least}


def plain_groups(words, times=10):
    form, n_near = {}, {}
    for w, n in words.items():
        close = [x for x in words if one_edit(w, x)]
        n_near[w] = len(close)
        best = min(close, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= times * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, n_near[w], words.get(form[w])))
    return brute.order(out)


WORD_COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def word_texts():
    rng = random.Random(3)
    stems = ["retention", "éléphant", "Naïveté", "aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "conference", "öffentlich", "ÀÉÎÕÜab", "m" * 300]

    def typo(word):
        at, letter = rng.randrange(len(word)), rng.choice("abcdeïéà")
        return rng.choice([word[:at] + word[at + 1:], word[:at] + letter + word[at:], word[:at] + letter + word[at + 1:]])
    rows = []
    for doc in range(120):
        words = []
        for _ in range(60):
            word = rng.choice(stems[:4] * 4 + stems)
            for _ in range(rng.choice([0, 0, 0, 0, 0, 1, 2])):
                word = typo(word)
            words.append(word)
        rows.append((doc, " ".join(words)))
    rows += [(900, None), (901, ""), (902, "short words only a1b2c3"), (None, "without identifier identifier"), (903, "q" * 5000 + " " + "q" * 5000)]
    rows += [(904, "q" * 4999 + "r " + "q" * 4999 + "r")] * 2
    return rows


@pytest.mark.parametrize("limit", [2, 5, 2048])
def test_spelling_groups_are_those_of_all_pairs(spark, limit):
    """Also where all buckets are over the limit and are cut to single places."""
    rows = word_texts()
    found = spelling.spelling_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), limit=limit)
    expected = plain_groups(plain_words(rows))
    assert rows_of(found, *WORD_COLUMNS) == expected
    assert any(f is not None and r != f for _, f, r, *_ in expected) and max(r[4] for r in expected) > 20


def test_spelling_of_messy_texts_and_of_nothing(spark, messy, messy_rows, nothing):
    assert rows_of(spelling.spelling_groups(messy), *WORD_COLUMNS) == plain_groups(plain_words(messy_rows))
    assert spelling.spelling_groups(nothing).count() == 0


def test_one_full_bucket_is_cut_on(spark):
    """All words share their ends: one bucket holds thousands, far over the limit."""
    rng = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = {"prefix" + "".join(rng.choice(letters) for _ in range(3)) + "suffix" for _ in range(3000)}
    words |= {w[:7] + w[8:] for w in list(words)[:300]}
    df = spark.createDataFrame([(w, 1 + i % 50) for i, w in enumerate(sorted(words))], "word string, n long")
    found = {r.word: r.n_near for r in spelling.near_words(df, 64).collect()}
    by_gap = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            by_gap[w[:i] + "*" + w[i + 1:]].add(w)
            if w[:i] + w[i + 1:] in words:
                by_gap["-", w[:i] + w[i + 1:]] |= {w}
    close = defaultdict(set)
    for gap, members in by_gap.items():
        if isinstance(gap, tuple):
            for w in members:
                close[w].add(gap[1])
                close[gap[1]].add(w)
        else:
            for w in members:
                close[w] |= members - {w}
    assert found == {w: len(x) for w, x in close.items() if x}


# --- search -----------------------------------------------------------------------------------------------------------

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_search(rows, queries, top=20):
    docs = [(doc, Counter(TERM.findall(lower(text or "")))) for doc, text in rows]
    docs = [(doc, c, sum(c.values())) for doc, c in docs if c]
    n_docs, total = len(docs), sum(n for _, _, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in queries:
        scored = []
        for doc, c, n in docs:
            m = 75 + (25 * n * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m))
                        for t in TERM.findall(lower(text or "")) if t in c)
            if score > 0:
                scored.append((-score, math.inf if doc is None else doc, doc))
        scored.sort(key=lambda s: s[:2])
        out += [(item, i + 1, doc, -s) for i, (s, _, doc) in enumerate(scored[:top])]
    return brute.order(out)


SEARCH_COLUMNS = ("item_id", "rank", "doc_id", "score")
QUERIES = [(1, "w1 w2 w3 w1"), (2, "W7, w8; naïve CAFÉ"), (3, ""), (4, None), (5, "nowhere at all"), (6, " ".join(f"w{i}" for i in range(0, 400, 3))),
           (7, "x1 w5"), (8, "one line two")]


@pytest.mark.parametrize("segment_bytes", [1, 3000, 8 << 20])
def test_search_ranks_as_brute_force(spark, messy, messy_rows, segment_bytes):
    queries = spark.createDataFrame(QUERIES, "item_id long, text string")
    found = search.rank_documents(messy, queries, segment_bytes=segment_bytes)
    assert rows_of(found, *SEARCH_COLUMNS) == plain_search(messy_rows, QUERIES)


def test_search_in_groups_of_queries_and_without_anything(spark, messy, messy_rows, nothing):
    queries = spark.createDataFrame(QUERIES + QUERIES[:2], "item_id long, text string").selectExpr("*", "'x' AS rank", "'y' AS doc_id")
    index = search.build_index(messy)
    assert rows_of(search.search(index, queries, group_bytes=40), *SEARCH_COLUMNS) == plain_search(messy_rows, QUERIES)
    assert search.search(index, queries.limit(0)).count() == 0
    assert search.rank_documents(nothing, queries).count() == 0


def test_postings_come_back_and_maxima_hold():
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["a"] * 300 + [f"t{i}" for i in range(200)]) for _ in range(rng.choice([1, 30, 400]))).encode() for _ in range(1500)]
    texts += [b"a " * 70_000, b"", None]
    row = search.segment(list(range(len(texts))), texts)
    counts = [Counter(search.terms_of(t)) for t in texts]
    terms = sorted(set().union(*counts))
    shard = search.Segment(search.stored(row, 0), terms, 1501, 10 ** 6)
    for term in terms:
        doc, part = shard.whole(term)
        want = [i for i, c in enumerate(counts) if c[term]]
        assert doc.tolist() == want
        assert part.tolist() == [(10 ** 9 * counts[i][term]) // (1000 * counts[i][term] + int(shard.m[i])) for i in want]
        maxima = [max(part[i:i + search.BLOCK]) for i in range(0, len(part), search.BLOCK)]
        assert shard.block_maxima(term).tolist() == maxima


def test_few_blocks_are_unpacked(monkeypatch):
    """With a full heap, lists of frequent words are looked up for few documents only."""
    rng = random.Random(4)
    texts = [(" ".join(rng.choice(["the", "of", "and"]) for _ in range(30)) + (" rare" * 5 if i % 400 == 0 else "")).encode() for i in range(20_000)]
    row = search.segment(list(range(len(texts))), texts)
    weight = {b"rare": 9000, b"the": 30, b"of": 30, b"and": 30}
    shard = search.Segment(search.stored(row, 0), list(weight), 20_000, 600_000)
    seen = []
    real = search.Segment.unpacked
    monkeypatch.setattr(search.Segment, "unpacked", lambda self, blocks: seen.append(len(blocks)) or real(self, blocks))
    full = np.zeros(len(texts), np.int64)
    for term, w in weight.items():
        doc, part = real(shard, np.arange(*shard.blocks(term)))
        full[doc] += w * part
    ids, scores = search.best(np.arange(len(texts)), full, 20)
    got = search.best(*search.search_segment(shard, weight, int(scores[-1]), 20), 20)
    assert got[0].tolist() == ids.tolist() and got[1].tolist() == scores.tolist()
    assert sum(seen) < 20_000 / search.BLOCK * 3 / 2
