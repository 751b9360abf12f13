from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skywarden.llm import html, store, tokenfile, tokens, unigram, warc
from skywarden.llm.queries import BYTE_BPE, PIECES, WORD_BPE
from test_documents import rows_of


def test_word_chunks_give_the_ids_of_the_whole_text():
    rng = random.Random(2)
    alphabet = [" ", "\n", "\t", "\x1c", " ", "a", "B", "é", "É", "é", "1", "'s", "'", ".", "<|endoftext|>", "漢", "Σ", "ΑΣ", "_", "ß"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    whole = Tokenizer.from_file(WORD_BPE)
    for text, ids in zip(texts, tokens.Encoder(WORD_BPE, tokens.word_chunks).encode(texts)):
        assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("path, chunks", [(WORD_BPE, tokens.word_chunks), (BYTE_BPE, tokens.space_chunks)])
def test_plain_words_have_the_ids_of_the_whole_text(path, chunks):
    rng = random.Random(12)
    letters = "abcXYZ" + "".join(map(chr, range(0xa0, 0x100)))
    endings = ["", "", ".", ",", "&&&", "'s", "'", "~]", "_", "<|endoftext|>", "1", ".a", "\u0301", "\u00ad"]
    texts = [" ".join("".join(rng.choices(letters, k=rng.randint(0, 6))) + rng.choice(endings) for _ in range(30)) for _ in range(400)]
    whole = Tokenizer.from_file(path)
    for text, ids in zip(texts, tokens.Encoder(path, chunks).encode(texts)):
        assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("path, chunks", [(WORD_BPE, tokens.word_chunks), (BYTE_BPE, tokens.space_chunks)])
def test_a_full_memory_keeps_frequent_chunks(path, chunks, monkeypatch):
    """A frequent word goes to the model once, with whatever punctuation behind it, however many rare words pass."""
    monkeypatch.setattr(tokens, "CACHED_CHUNKS", 200)
    monkeypatch.setattr(tokens.Encoder, "memories", {})
    rng, learnt = random.Random(3), Counter()
    own = tokens.Encoder._word
    monkeypatch.setattr(tokens.Encoder, "_word", lambda self, word: learnt.update([word.strip()]) or own(self, word))
    encoder, whole = tokens.Encoder(path, chunks), Tokenizer.from_file(path)
    for _ in range(60):
        rare = ["".join(rng.choices("abc\u00e9", k=12)) for _ in range(30)]
        texts = [None, "", "1 often, " + " ".join(rare) + " often often. often!!", " ".join(rare)]
        for text, ids in zip(texts, encoder.encode(texts)):
            assert ids.tolist() == whole.encode(text or "", add_special_tokens=False).ids
    assert learnt["often"] == 1
    assert len(encoder.kept) + len(encoder.older) < 400


def test_token_files_hold_the_stream(messy, messy_rows, tmp_path):
    index = tokenfile.write_tokens(messy, f"file://{tmp_path}/t", WORD_BPE)
    found = rows_of(tokenfile.read_tokens(index), "doc_id", "start", "n_tokens", "ids_crc32")
    whole, at, expected = Tokenizer.from_file(WORD_BPE), 0, []
    for doc, text in sorted(messy_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, tokenfile.END], "<u4")
        expected.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert found == brute.order(expected)


def test_any_sequence_is_a_view_of_its_file(messy, tmp_path):
    index = tokenfile.write_tokens(messy, str(tmp_path / "t"), WORD_BPE).orderBy("part").collect()
    for row in index:
        file = tokenfile.opened(row.path)
        assert file.schema.equals(tokenfile.schema_for(49_408))
        total = 0
        for b in range(file.num_record_batches):
            before = pa.total_allocated_bytes()
            for i in range(file.get_batch(b).num_rows):
                ids, bits = tokenfile.sequence(file, b, i)
                mask = np.unpackbits(bits, bitorder="little")
                assert len(ids) == len(mask) == tokenfile.LENGTH and not ids[mask == 0].any()
                total += int(mask.sum())
            assert pa.total_allocated_bytes() - before < 100_000
        assert total == row.n_tokens


def test_a_file_that_is_not_finished_is_not_seen(tmp_path):
    with pytest.raises(RuntimeError):
        with store.committed(f"file://{tmp_path}/a/x", 3) as out:
            out.write(b"half")
            raise RuntimeError
    assert not (tmp_path / "a" / "x").exists()
    for attempt in (4, 5):
        with store.committed(f"file://{tmp_path}/a/x", attempt) as out:
            out.write(b"whole")
    assert (tmp_path / "a" / "x").read_bytes() == b"whole"


PAGES = [(1, "http://a", "short"), (2, "http://b", "short"), (3, "http://c", "x" * 100), (9, "http://d\r\nX: y", "x" * 100), (4, None, None),
         (5, "http://e", ""), (6, "http://f", "\r\n\r\nWARC/1.1\r\n" * 40), (7, "u", "é☃" * 100_000), (8, "v", "é☃" * 100_000),
         (None, "n", "x" * 100), (10, "w", "z" * 65536), (11, "w", "z" * 131072)]


def test_archives_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("first", F.lit(1))
    archives = warc.write_archives(warc.record_table(pages), f"file://{tmp_path}/w")
    expected = []
    for page, _, text in PAGES:
        body = (text or "").encode()
        same = [p for p, _, t in PAGES if p is not None and (t or "").encode() == body]
        again = len(body) >= 100 and page != min(same)
        expected.append((page, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", min(same) if again else None))
    found = warc.records(archives)
    assert rows_of(found, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == brute.order(expected)
    chunks = warc.read_archives(archives).collect()
    assert max(len(c.bytes) for c in chunks) <= warc.CHUNK
    bodies = {p: (t or "").encode() for p, _, t in PAGES}
    for page in (1, 3, 5, 6, 7, 10, 11):
        own = sorted((c for c in chunks if c.page_id == page), key=lambda c: c.chunk_no)
        assert b"".join(c.bytes for c in own) == bodies[page]
        assert [c.chunk_no for c in own] == list(range(len(own))) and [c.last for c in own] == [False] * (len(own) - 1) + [True]
        for i, c in enumerate(own):
            body = b"".join(x.bytes for x in own[:i + 1])
            assert (c.payload_bytes, c.payload_digest) == (len(body), hashlib.sha256(body).hexdigest())
        assert own[-1].payload_digest == own[-1].stated_digest


def test_reader_needs_no_whole_record():
    head = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nContent-Length: %d\r\n\r\nHTTP/1.1 200 OK\r\n\r\n"
    body = b"a" * (40 << 20)
    data = head % (len(body) + 19) + body + b"\r\n\r\n"
    before = pa.total_allocated_bytes()
    sizes = [len(row[-1]) for row in warc.chunks_of(pa.BufferReader(data))]
    assert sum(sizes) == len(body) and max(sizes) == warc.CHUNK
    assert pa.total_allocated_bytes() - before < 4 << 20


def test_archives_of_nothing(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.records(warc.write_archives(warc.record_table(pages), f"file://{tmp_path}/w")).count() == 0


MARKED_PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x:"</p>"}</style><script>var t="</p><p>no";</script></head><body>
<header><p>Top, of. the page.</p></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="ad banner">Buy, now!</div>
<article class="post"><h1>The  title</h1><p><b>Bold</b>ed text &amp; more&nbsp;text.<br>Next <i>line</i>
<p>Second p<a href='x>y'>ara</a>graph.<div id="cookie-notice">We use cookies.</div><aside>Side.</aside><ul><li>one<li>two</ul>
<form><label>Name</label><button>Go</button></form><section id="comments"><p>A reader says, hello.</p></section>
<pre>a
 b</pre></article><footer>&copy; Foot.</footer></body></html>"""


def test_article_text():
    assert html.main_text(MARKED_PAGE) == "The title Bolded text & more text. Next line Second paragraph. one two a b"


def test_paths_decide_where_no_article_is_marked():
    long = "This is a long sentence of the article, with commas, and it goes on for a while. " * 4
    page = (f"<html><body><div><span>Home</span> <span>News</span></div><div class=c><p>{long}</p><p>{long}</p><p>Short.</p></div>"
            "<table><tr><td>a</td><td>b</td></tr></table><div id='comments'><p>" + long + "</p></div></body></html>")
    text = html.main_text(page)
    assert text == " ".join([long.strip(), long.strip(), "Short."])


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "<!-- never closed", "<script>x", "</p></div>", "<b>" * 3000, "plain"])
def test_odd_pages(page):
    assert html.main_text(page) == ("plain" if page == "plain" else html.main_text(page))


@pytest.mark.parametrize("body", ['for(var i=0;i<n;i++){s+="x"}', "<!-- hidden", 'if(a<b&&c>d)x="<p>"', "x='</scripts>'"])
def test_script_bodies_are_not_read_as_tags(body):
    page = f"<script>{body}</script><article><p>Hello.</p></article><SCRIPT>{body}</Script ><style>a<b{{}}</style><article><p>You.</p></article>"
    assert html.main_text(page) == "Hello. You."


@pytest.mark.parametrize("head, tail", [
    ("<body class='has-sidebar'>", "</body>"), ("<body class='single-post right-sidebar'><main class=menu>", "</main>"),
    ("<div class='no-comments'>", "</div>"), ("<div class='entry-content share-enabled'>", "</div>"),
    ("<div class=header>", "</div>"), ("<html id=nav><div class='menu-open' data-id=ad>", "</div>")])
def test_names_of_wrappers_take_no_text(head, tail):
    long = "A sentence of the article, with commas, that goes on for a while. " * 3
    advert = "<div class='ad-box'>Buy.</div><div id=comments><p>So it is.</p></div><div class='x SHARE_buttons'>Tell, all.</div>"
    for inner in (f"<p>{long}</p><p>{long}</p>", f"<article><p>{long}</p><p>{long}</p></article>"):
        assert html.main_text(f"{head}{advert}{inner}{tail}") == f"{long}{long}".strip()


def test_inline_words_headings_and_short_blocks_stay_with_their_content():
    half = "Words of a paragraph that go on for a while, and then some more of the same, so that it is long. And it has no end yet "
    p = f"<p>{half}<a href=x>link</a> and <b>bold <i>words</i></b>, {half}</p>"
    whole = f"{half}link and bold words, {half}".strip()
    page = (f"<body><div class=top><a href=a>Home</a> <a href=b>News</a></div><div class=t><h1>Title</h1></div><div class=c>{p}<h2>Part</h2>"
            f"<ul><li>one<li><a href=x>two</a></ul>{p}<figure><figcaption>Caption</figcaption></figure></div><div>About</div></body>")
    assert html.main_text(page) == f"Title {whole} Part one two {whole} Caption"
    flat = f"<div>Home</div><h1>Title</h1>{p}<ul><li>one</li></ul><h2>Part</h2>{p}<p><b>{half}<p>{half}"
    assert html.main_text(flat) == f"Title {whole} one Part {whole} {half}{half}".strip()
    deep = f"<div class=c><div><p>{half}</p></div><ul><li>one</li></ul><div><p>{half}</p></div></div><ul><li>Legal</li></ul>"
    assert html.main_text(deep) == f"{half}one {half}".strip()


def test_ratios_decide_beside_empty_and_small_marks():
    long = "A sentence of the article, with commas, that goes on for a while, as they do. " * 4
    body = f"<div class=text><h1>Title</h1><p>{long}</p><p>{long}</p><ul><li>one</ul></div>"
    cards = "<article class=card><h2>Card</h2><p>Read on.</p></article>" * 3
    expected = f"Title {long}{long}one"
    for page in (f"<main> </main>{body}", f"<main>\n<article>\n</article></main>{body}", f"{cards}{body}", f"{body}{cards}",
                 f"<main>{body}{cards}</main>", f"<main><div>{cards}</div></main>{body}", f"<article>{body}<ul><li>two</ul>{cards}</article>"):
        assert html.main_text(f"<body>{page}</body>") == (expected + " two" if "two" in page else expected)


def test_extract_returns_every_row(spark):
    rows = [(1, "u", MARKED_PAGE), (None, None, None), (2, "u", ""), (2, "u", "")]
    found = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)))
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    assert rows_of(found, "page_id", "n_chars") == brute.order([(1, len(html.main_text(MARKED_PAGE))), (None, 0), (2, 0), (2, 0)])


def plain_viterbi(m, text: str) -> list[int]:
    """Best segmentation by looking every substring up."""
    own = {p: i for i, p in enumerate(m.pieces) if i not in m.kinds and i > 2}
    best, back = [0.0] + [float("-inf")] * len(text), [(0, -1)] * (len(text) + 1)
    for at in range(len(text)):
        for end in range(at + 1, min(len(text), at + m.longest) + 1):
            i = own.get(text[at:end])
            if i is not None and best[at] + m.scores[i] > best[end]:
                best[end], back[end] = best[at] + m.scores[i], (at, i)
        if text[at] not in own and best[at] + m.unknown > best[at + 1]:
            best[at + 1], back[at + 1] = best[at] + m.unknown, (at, -1)
    out, at = [], len(text)
    while at:
        start, i = back[at]
        out = ([i] if i >= 0 else [m.bytes_[b] for b in text[start:at].encode()]) + out
        at = start
    return out


def odd_texts() -> list[str]:
    rng = random.Random(4)
    alphabet = [" ", " ", "  ", "\n", "\t", "a", "th", "ing", "é", "漢", "𝒳", "☃", ".", "1", "the ", "tion", "É", "\x00"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(800)] + ["x" * 5000, "<0x41> </s>"]


def test_segmentation_is_the_best_one():
    m, texts = unigram.model(PIECES), odd_texts()
    for text, ids in zip(texts, unigram.encode(PIECES, texts)):
        assert ids.tolist() == (plain_viterbi(m, unigram.MARKER + text.replace(" ", unigram.MARKER)) if text else []), repr(text)
        assert unigram.decode(PIECES, ids.tolist()) == text


def test_long_and_short_chunks_agree():
    m = unigram.model(PIECES)
    texts = [t.encode() for t in odd_texts() if t and len(t) < 100]
    assert unigram.viterbi_all(m, texts) == [unigram.viterbi(m, t) for t in texts]


def test_library_agrees_on_pieces_with_unigram_scores(tmp_path):
    """The library runs the same vocabulary as a unigram model when the model kind in the file says so."""
    from sentencepiece import sentencepiece_model_pb2 as proto
    found = proto.ModelProto()
    found.ParseFromString(open(PIECES, "rb").read())
    found.trainer_spec.model_type = 1
    found.normalizer_spec.remove_extra_whitespaces = False
    sp = sentencepiece.SentencePieceProcessor(model_proto=found.SerializeToString())
    # the library adds scores in 32 bits, too few for the scores of runs of markers and of unknown characters
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choice(["a", "th", "ing", "re", ".", "tion", "s"]) for _ in range(rng.randint(1, 6))) for _ in range(8))
             for _ in range(300)]
    for text, ids in zip(texts, unigram.encode(PIECES, texts)):
        assert sp.encode(text) == ids.tolist(), text


def test_encode_documents(messy, messy_rows):
    found = {r.doc_id: r for r in unigram.encode_documents(messy, PIECES).collect()}
    for doc, text in messy_rows:
        assert found[doc].round_trip and found[doc].n_tokens == len(found[doc].ids)
        assert (found[doc].n_tokens == 0) == (not text)


def test_nothing(nothing, tmp_path):
    assert unigram.encode_documents(nothing, PIECES).count() == 0
    assert tokenfile.read_tokens(tokenfile.write_tokens(nothing, f"file://{tmp_path}/t", WORD_BPE)).count() == 0
