"""Main texts of all test pages against another parser's reading of their article, and hand-made pages."""

from __future__ import annotations

from html.parser import HTMLParser

import pytest

from skywarden.llm import html

SKIPPED = {"script", "style", "nav", "aside", "form", "footer", "button", "noscript", "svg"}
VOID = {"br", "hr", "img", "input", "meta", "link", "wbr"}


class Article(HTMLParser):
    """Words inside ``article``, but for elements that are never content and marked ones."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool]] = []
        self.words: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag not in VOID:
            names = " ".join(v or "" for k, v in attrs if k in ("class", "id", "role"))
            self.open.append((tag, tag in SKIPPED or tag != "article" and html.marked(names)))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        tags = [t for t, _ in self.open]
        if "article" in tags and not any(skip for _, skip in self.open[tags.index("article"):]):
            self.words += data.split()


def test_all_pages_give_their_article(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    texts = {r.page_id: r.text for r in html.extract(pages).collect()}
    wrong = []
    for page in pages.collect():
        parser = Article()
        parser.feed(page.html or "")
        if "".join(parser.words) != "".join((texts[page.page_id] or "").split()):
            wrong.append(page.page_id)
    assert not wrong


COMMENTS = "".join(f"<div class='c'><p>Reader {i} says, at some length, that all of this is quite untrue, and more.</p></div>" for i in range(20))


@pytest.mark.parametrize("mark", ["class='comments'", "id='reader-comments'", "class='comment-list'", "role='comments'"])
def test_comments_never_stand_for_a_short_article(mark):
    page = f"<body><article><h1>T</h1><p>A short article, of few words.</p></article><div {mark}>{COMMENTS}</div></body>"
    assert html.main_text(page) == "T A short article, of few words."


@pytest.mark.parametrize("page, text", [
    ("<body><article><header><h1>The title</h1></header><p>The body text, here it is.</p></article></body>", "The title The body text, here it is."),
    ("<body><header><h1>The site</h1></header><article><p>The body text, here it is.</p></article></body>", "The body text, here it is."),
    ("<body><article><svg><svg><text>a</text></svg><text>leak</text></svg><p>The body text, here it is.</p></article></body>", "The body text, here it is."),
    ("<body><div class='side'><p>All there is, on this page.</p></div></body>", "All there is, on this page."),
    ("<body><div class='menu-container'><main><p>Real text, here.</p></main></div></body>", "Real text, here."),
    ("<body><div class='ad'>Buy this, buy that, it is long and has, many, marks. And more.</div><article><p>Few words.</p></article></body>", "Few words."),
    ("<body class='no-comments'><article><p>Few words.</p></article></body>", "Few words."),
    ("<body><div class='has-comments'><article><p>Few words.</p></article></div></body>", "Few words."),
])
def test_hand_made_pages(page, text):
    assert html.main_text(page) == text


def test_a_very_long_page_and_an_empty_table(spark):
    words = "Word, " * 300_000
    page = f"<body><article><p>{words}</p></article><div class='comments'>{COMMENTS}</div></body>"
    rows = spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")
    assert html.extract(rows).first().text == words.strip()
    assert html.extract(rows.limit(0)).count() == 0
