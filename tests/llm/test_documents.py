from __future__ import annotations

import random
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skywarden.llm import blocks, exact, ngram_join, packing, quality, substring, tokens, words
from skywarden.llm.queries import BYTE_BPE


def rows_of(df, *columns):
    return brute.order(tuple(r) for r in df.select(*columns).collect())


def test_substring_removes_what_brute_force_removes(messy, messy_rows):
    found = substring.remove_repeats(messy)
    assert rows_of(found, "doc_id", "n_words", "n_removed", "kept_sha256") == brute.order(brute.substring(messy_rows))


@pytest.mark.parametrize("half", [0, 1])
def test_words_whose_hashes_agree_in_one_half_are_different(monkeypatch, half):
    digest = words.DIGESTS.function
    monkeypatch.setattr(words, "DIGESTS", words.Cache(lambda w: bytes(8) + digest(w)[8:] if half == 0 else digest(w)[:8] + bytes(8)))
    table = pa.table({"doc_id": [1, 2, 3], "text": [" ".join(f"{c}{i % 40}" for i in range(60)) for c in "aba"]})
    found = substring.Windows(table, 13)
    content: dict = {}
    for which, at in zip(found.distinct.tolist(), found.at.tolist()):
        content.setdefault(which, set()).add(tuple(found.words[at:at + 13]))
    assert all(len(same) == 1 for same in content.values())
    assert len(set().union(*content.values())) == 80


def test_substring_keeps_columns_and_untouched_texts(messy, messy_rows):
    rows = substring.without_repeats(messy)
    assert rows.columns == messy.columns
    texts = {r.doc_id: r.text for r in rows.collect()}
    removed = {d: n for d, _, n, _ in brute.substring(messy_rows)}
    assert all(texts[d] == t for d, t in messy_rows if not removed[d])


def test_components_are_those_of_all_pairs(messy, messy_rows):
    found = ngram_join.link_components(messy)
    assert rows_of(found, "doc_id", "n_shingles", "component_id") == brute.order(brute.components(messy_rows))


@pytest.mark.parametrize("cut", [0, 20, 10_000])
def test_any_boundary_between_small_and_large_loses_no_link(spark, monkeypatch, cut):
    rng = random.Random(cut)
    rows = []
    for g in range(12):
        base = [f"t{rng.randrange(500)}" for _ in range(rng.choice([12, 22, 25, 60, 150]))]
        for _ in range(6):
            words = list(base)
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(words))
                words[at:at + 1] = rng.choice([[], ["new", f"n{rng.randrange(9)}"], [f"n{rng.randrange(9)}"]])
            rows.append((len(rows), " ".join(words)))
    rng.shuffle(rows)
    monkeypatch.setattr(ngram_join, "boundary", lambda prefixes: cut)
    found = ngram_join.link_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert rows_of(found, "doc_id", "n_shingles", "component_id") == brute.order(brute.components(rows))


def test_chain_without_its_middle_as_smallest(spark):
    """Links only reach all members through a member that is not the smallest of any list."""
    words = [f"c{i}" for i in range(200)]
    rows = []
    for i, doc in enumerate((7, 3, 9, 1, 5)):
        own = list(words)
        for j in range(i):
            own[20 * j] = f"changed{j}"
        rows.append((doc, " ".join(own)))
    found = ngram_join.link_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert rows_of(found, "doc_id", "n_shingles", "component_id") == brute.order(brute.components(rows))
    assert {r.component_id for r in found.collect()} == {1}


def test_measures_and_verdicts(messy, messy_rows):
    found = quality.verdicts(messy)
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert rows_of(found, *names) == brute.order(brute.measures(messy_rows))


def test_order_of_rules_changes_no_verdict(messy, messy_rows):
    good = sorted(str(r[0]) for r in brute.measures(messy_rows) if r[-1])
    for order in (list(quality.text_rules()), list(reversed(quality.text_rules()))):
        rows = quality.keep_good(messy, order=order)
        assert rows.columns == messy.columns
        assert sorted(str(r.doc_id) for r in rows.collect()) == good


def test_estimated_order_puts_rejecting_rules_first(spark):
    docs = spark.createDataFrame([(i, "# $ % & * " * 30 + " ".join(f"word{j}" for j in range(200))) for i in range(200)], "doc_id long, text string")
    assert quality.estimated_order(docs)[0] in ("symbols", "word_length", "repeated_words")


def test_exact_copies(messy, messy_rows):
    found = exact.mark_copies(messy)
    assert rows_of(found, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == brute.order(brute.copies(messy_rows))
    kept = exact.without_copies(messy)
    assert kept.columns == messy.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in brute.copies(messy_rows) if r[3])


def test_texts_with_one_hash_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(exact.F, "md5", lambda c: F.lit("00" * 16))
    rows = [(1, "a"), (2, "b"), (3, "a")]
    found = exact.mark_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert rows_of(found, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == brute.order(brute.copies(rows))


def test_documents_without_copies_need_one_written_table(spark, monkeypatch):
    """Only the list of what goes is written, and texts are grouped once, with no second pass for digests."""
    tables, hashed = [], []
    monkeypatch.setattr(exact, "written", lambda df, name, put=exact.written: tables.append(name) or put(df, name))
    monkeypatch.setattr(exact.F, "sha2", lambda c, n, put=F.sha2: hashed.append(n) or put(c, n))
    monkeypatch.setattr(exact.F, "md5", lambda c: F.lit("00" * 16))
    rows = [(3, "a  b"), (1, "a b"), (2, "c"), (2, "a b"), (4, "c"), (None, "c"), (None, "only"), (None, "only"), (5, None), (6, "")]
    found = exact.without_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert brute.order([tuple(r) for r in found.collect()]) == brute.order(
        [row for row in rows if row[0] in {m[0] for m in brute.copies(rows) if m[3]}])
    assert (tables, hashed) == (["gone"], [])


def test_chunks_give_the_ids_of_the_whole_text():
    rng = random.Random(1)
    alphabet = [" ", " ", "\n", "\t", "\x1c", " ", " ", "a", "b", "Z", "é", "1", "'s", "'", ".", "<|endoftext|>", "漢", "́", "\r\n", "_", "Σ"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    whole = Tokenizer.from_file(BYTE_BPE)
    for text, ids in zip(texts, tokens.Encoder(BYTE_BPE, tokens.space_chunks).encode(texts)):
        assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


def check_packing(rows, texts, limit=2048, segments=128):
    whole = Tokenizer.from_file(BYTE_BPE)
    ids = {d: np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for d, t in texts}
    places, sequences = {}, {}
    for r in rows:
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own)
        assert r.ids_crc32 == zlib.crc32(own[r.start:r.start + r.length].tobytes())
        places.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc, own in ids.items():
        at = 0
        for start, n in sorted(places[doc]):
            assert start == at and n > 0
            at += n
        assert at == len(own)
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= limit and len(parts) <= segments
        padding += 0 if at & (at - 1) == 0 else limit - at
    return padding, sum(map(len, ids.values()))


def test_packing_holds_each_token_once(messy, messy_rows):
    texts = dict(messy_rows)
    rows = packing.pack_documents(messy.where("doc_id is null or doc_id <> 600"), BYTE_BPE).collect()
    padding, total = check_packing(rows, [(d, t) for d, t in texts.items() if d != 600])
    assert padding <= 0.02 * total


def test_packing_keeps_all_limits():
    rng = random.Random(3)
    ids = [np.zeros(rng.randint(1, 300), np.uint32) for _ in range(400)]
    loss = [rng.randint(0, len(x)) for x in ids]
    seen = [[] for _ in ids]
    for sequence in packing.pack(ids, loss, (256, 4, 100)):
        assert sum(n for _, _, n in sequence) <= 256 and len(sequence) <= 4
        assert sum(max(0, s + n - max(s, len(ids[e]) - loss[e])) for e, s, n in sequence) <= 100
        for e, s, n in sequence:
            seen[e] += range(s, s + n)
    assert all(sorted(places) == list(range(len(x))) for places, x in zip(seen, ids))


def test_many_short_texts_need_little_padding():
    ids = [np.zeros(n, np.uint32) for n in [3] * 3000 + [700] * 5]
    padding = total = 0
    for sequence in packing.pack(ids, [len(x) for x in ids]):
        n = sum(n for _, _, n in sequence)
        assert len(sequence) <= packing.SEGMENTS
        total += n
        padding += 0 if n & (n - 1) == 0 else packing.TOKENS - n
    assert total == sum(map(len, ids)) and padding <= 0.02 * total


def test_empty_tables(nothing):
    assert substring.remove_repeats(nothing).count() == 0
    assert ngram_join.link_components(nothing).count() == 0
    assert quality.verdicts(nothing).count() == 0
    assert exact.mark_copies(nothing).count() == 0
    assert packing.pack_documents(nothing, BYTE_BPE).count() == 0


def test_packed_cells_come_back():
    cells = np.unique(np.random.default_rng(0).integers(0, 1 << 32, 1000, dtype=np.uint32))
    assert (blocks.unpacked(blocks.packed(cells)) == cells).all()
    assert len(blocks.unpacked(blocks.packed(cells[:0]))) == 0


def test_grouped_chunks_have_the_ids_of_whole_texts(monkeypatch):
    rng = random.Random(1)
    bits = ["a", "foo", " ", " ", "  ", "\n", "\t", "<|endoftext|>", "'s", "\u0120", "\xa0", "\x1c", "123", "!!", "\u6f22", "\0"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(30))) for _ in range(300)]
    for group in (1, 3, 512):
        monkeypatch.setattr(tokens, "GROUP", group)
        monkeypatch.setattr(tokens.Encoder, "memories", {})
        for text, ids in zip(texts, tokens.Encoder(BYTE_BPE, tokens.space_chunks).encode(texts)):
            assert ids.tolist() == tokens.tokenizer(BYTE_BPE).encode(text, add_special_tokens=False).ids


def test_near_copies_write_no_more_than_their_prefixes(spark, monkeypatch):
    """Long lists of near copies link to their first member: they are no reason to write subsets, whose number is a square."""
    rng = random.Random(3)
    base = [f"b{i}" for i in range(300)]
    rows = []
    for doc in range(60):
        own = list(base)
        for at in rng.sample(range(300), 2):
            own[at] = f"own{doc}x{at}"
        rows.append((doc, " ".join(own)))
    sizes = []
    monkeypatch.setattr(ngram_join, "written", lambda df, name, put=ngram_join.written: _counted(put(df, name), name, sizes))
    found = ngram_join.link_components(spark.createDataFrame(rows, "doc_id long, text string"), size=5, percent=80)
    assert rows_of(found, "doc_id", "n_shingles", "component_id") == brute.order(brute.components(rows, 80, 5))
    assert 0 < sum(sizes) <= 60 * 61


def _counted(df, name, sizes):
    if name == "entries":
        sizes.append(df.count())
    return df


def test_lists_whose_members_stay_apart_bring_subsets(spark, monkeypatch):
    """One long phrase in many texts that do not link: pairs of list members outnumber subsets, so small sets meet in subsets."""
    phrase = [f"p{i}" for i in range(12)]
    rows = [(doc, " ".join([f"a{doc}", *phrase, f"z{doc}"])) for doc in range(80)]
    rows += [(100 + doc, " ".join([f"a{doc}", *phrase, f"z{doc}", f"end{doc}"])) for doc in range(0, 80, 7)]
    rows += [(200 + doc, " ".join([*phrase, *(f"long{i}" for i in range(60)), f"z{doc}", f"y{doc}"])) for doc in range(5)]
    cuts = []
    monkeypatch.setattr(ngram_join, "boundary", lambda costs, take=ngram_join.boundary: cuts.append(take(costs)) or cuts[-1])
    found = ngram_join.link_components(spark.createDataFrame(rows, "doc_id long, text string"), size=5, percent=80)
    assert rows_of(found, "doc_id", "n_shingles", "component_id") == brute.order(brute.components(rows, 80, 5))
    assert cuts[0] > 0


def test_a_repeated_word_is_hashed_once(monkeypatch):
    asked = []

    class Asked(words.Cache):
        def __getitem__(self, word):
            asked.append(word)
            return super().__getitem__(word)

    plain = words.hash_pairs([b"a", b"b", b"a", b"c", b"b"] * 50)
    monkeypatch.setattr(words, "DIGESTS", Asked(words.DIGESTS.function))
    assert (words.hash_pairs([b"a", b"b", b"a", b"c", b"b"] * 50) == plain).all()
    assert sorted(asked) == [b"a", b"b", b"c"]


def test_members_that_fit_no_set_of_their_list_are_not_written(spark, monkeypatch):
    """A phrase shared by texts that cannot link: behind the boundary, only entries whose bound allows the list's smallest set stay."""
    phrase = [f"p{i}" for i in range(12)]
    rows = [(doc, " ".join([f"a{doc}", *phrase, f"z{doc}"])) for doc in range(80)]
    rows += [(100 + doc, " ".join([f"a{doc}", *phrase, f"z{doc}", f"end{doc}"])) for doc in range(0, 80, 7)]
    rows += [(200 + doc, " ".join([*phrase, "long", f"y{doc}"])) for doc in range(5)]
    tables, cuts = [], []
    monkeypatch.setattr(ngram_join, "written", lambda df, name, put=ngram_join.written: tables.append((name, put(df, name))) or tables[-1][1])
    monkeypatch.setattr(ngram_join, "boundary", lambda costs, take=ngram_join.boundary: cuts.append(take(costs)) or cuts[-1])
    found = ngram_join.link_components(spark.createDataFrame(rows, "doc_id long, text string"), size=5, percent=80)
    assert rows_of(found, "doc_id", "n_shingles", "component_id") == brute.order(brute.components(rows, 80, 5))
    members = [table for name, table in tables if name == "members"][1:]
    assert cuts[0] > 0 and len(members) == 2
    lists = [table for name, table in tables if name == "named"][1:]
    for kept, named in zip(members, lists):
        least = named.groupBy("key").agg(F.min("n").alias("least"))
        assert kept.join(least, "key").where("180 * r < 80 * (n + least)").isEmpty()
        assert kept.count() < named.count()
