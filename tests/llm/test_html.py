import os
import random
import time
from html.parser import HTMLParser

import pytest

from tidegraph.llm import html

PAGE = """<!DOCTYPE html><html lang=en><head><title>T</title><style>p{}</style><script>var x="<p>no</p>";</script></head><body>
<header class="site-header"><a href=/>Home</a> Site name</header><nav><ul><li><a href=a>A</a><li><a href=b>B</a></ul></nav>
<div class="cookie-notice">We use cookies &amp; more</div><div class=wrap><div class="post-1234 content"><h1>Head &amp; line</h1>
<p>First   para&shy;graph with <b>bold</b>\n text &lt;here&gt;.<p>Second one, long enough to matter, with <a href=x>a link</a>.</p>
<div class="ad-slot">Buy!</div><ul><li>one<li>two</ul><form><p>Your mail</p><input></form>{extra}</div><aside class=sidebar><p>Side text that is long, really very long indeed.</p></aside></div>
<section id="comments"><p>A reader says a great many things here, much longer than the article itself, again and again and again and again.</p></section>
<footer>&copy; me</footer></body></html>"""
TEXT = "Head & line\nFirst para\xadgraph with bold text <here>.\nSecond one, long enough to matter, with a link.\none\ntwo"


def test_main_text_of_one_page():
    assert html.extract(PAGE.replace("{extra}", ""), None)[0] == TEXT


def test_paths_are_generalised():
    path = html.extract(PAGE.replace("{extra}", ""), None)[1]
    assert path.endswith(">div.wrap>div.content.post-#")


@pytest.mark.parametrize("page", ["", "plain words", "<p>open <b>never closed", "<div", "a < b & c", "<!-- unfinished", "<script>x", "<p class='a>b'>q</p>", "</div></p>", "<table><tr><td>a<td>b<tr><td>c</table>"])
def test_broken_markup_does_not_fail(page):
    text, _ = html.extract(page, None)
    assert html.votes(page) is not None and "<p" not in text


def test_references_and_spaces():
    assert html.extract("<p>a&nbsp;&nbsp;b &#x41;&#66; &amp;lt; &unknown;\t\nc</p>", None)[0] == "a b AB &lt; &unknown; c"


def test_host_votes_decide(spark):
    other = '<html><body><div class="main-2"><p>short</p></div><div class="extra"><p>a text that is longer than the main part of this page</p></div></body></html>'
    usual = '<html><body><div class="main-{}"><p>a long main text, longer than the rest of the page by far</p></div><div class="extra"><p>tiny</p></div></body></html>'
    rows = [(k, "http://h.example/x", usual.format(k)) for k in range(5)] + [(9, "http://h.example/y", other), (10, None, None), (None, "odd url", ""), (11, "http://solo.example/", other), (9, "http://h.example/y", other)]
    pages = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, html string, path string, host string")
    got = html.extract_pages(spark, pages).collect()
    texts = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and texts[9] == "short" and texts[11].startswith("a text that is longer") and texts[10] == "" and texts[None] == ""
    assert all(r.n_chars == len(r.text) for r in got)


def test_empty_table(spark):
    assert html.extract_pages(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


class _Article(HTMLParser):
    """Plain text of the blocks inside <article>, read with the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.parts, self.blocks = 0, [], []

    def _end(self):
        text = " ".join("".join(self.parts).split())
        self.blocks += [text] if text else []
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag in ("article", "p", "h1", "h2", "ul", "li", "div"):
            self._end()
        self.depth += tag == "article"
        if tag == "br":
            self.parts.append(" ")

    def handle_endtag(self, tag):
        if tag in ("article", "p", "h1", "h2", "ul", "li", "div"):
            self._end()
        self.depth -= tag == "article"

    def handle_data(self, data):
        if self.depth:
            self.parts.append(data)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables here")
def test_against_another_parser_over_a_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in html.extract_pages(spark, pages).collect()}
    for r in pages.collect():
        other = _Article()
        other.feed(r.html or "")
        other.close()
        assert got[r.page_id] == "\n".join(other.blocks), r.page_id


def _site(rng, host, n):
    """Pages of a host with the text that each should give; templates differ in tags, classes and clutter."""
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    line = lambda k: " ".join(word() for _ in range(k))
    kind = rng.choice(["article", "main", "div", "td"])
    name = f"{word()}x{word()}"
    out = []
    for k in range(n):
        blocks = [line(rng.randint(1, 60)) for _ in range(rng.randint(2, 9))]
        body = f"<h1>{blocks[0]}</h1>"
        for b in blocks[1:]:
            odd = rng.choice(["", "", f"<script>{line(9)}</script>", f'<div class="ad">{line(12)}</div>', f"<!-- {line(5)} -->", f"<form><p>{line(6)}</p></form>", f"<nav><a href=x>{line(3)}</a></nav>"])
            cut = rng.randint(0, len(b))
            body += odd + rng.choice([f"<p>{b}</p>", f"<p>{b}", f"<p>{b[:cut]}<b>{b[cut:]}</b></p>", f"<ul><li>{b}</ul>", f"<blockquote>  {b.replace(' ', '  ')}\n</blockquote>"])
        inner = f'<{kind} class="{name}-{k}">{body}</{kind}>'
        inner = f"<table><tr>{inner}</tr></table>" if kind == "td" else inner
        clutter = [f"<header><p>{line(15)}</p></header>", f'<div class="cookie-notice">{line(20)}</div>', f"<aside>{line(30)}</aside>", f"<footer>{line(12)}</footer>", f'<section id="comments"><p>{line(90)}</p></section>', "<ul>" + f"<li><a href=q>{line(2)}</a></li>" * 6 + "</ul>"]
        rng.shuffle(clutter)
        at = rng.randint(0, len(clutter))
        out.append((f"http://{host}/{k}", f"<html><head><title>{line(4)}</title></head><body>{''.join(clutter[:at])}{inner}{''.join(clutter[at:])}</body></html>", "\n".join(blocks)))
    return out


def test_labelled_pages(spark):
    rng = random.Random(3)
    rows = [(k, *r) for k, r in enumerate(x for h in range(12) for x in _site(rng, f"h{h}.example", 15))]
    got = {r.page_id: r.text for r in html.extract_pages(spark, spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")).collect()}
    assert {k for k, _, _, want in rows if got[k] != want} == set()


def test_time_grows_with_the_page_only():
    """Open quotes, unmatched tags, deep nesting and unfinished declarations, each in a large page."""
    for page in ('<a title="x <b ' * 200_000, "<div>" * 200_000 + "<p>x</p>" * 2000 + "</b>" * 100_000, "<b>" * 200_000 + "<p>x</p>" * 20_000 + "</i>" * 100_000, "<!" * 500_000 + "<li>" * 10_000, "<a x='" * 100_000 + '<a x="' * 100_000 + ">" * 10, "<ul>" * 100_000 + "<tr><li>" * 20_000):
        began = time.time()
        html.extract(page, None)
        assert time.time() - began < 20


def test_headers_inside_an_article():
    page = "<body><header><h1>Site</h1></header><article><header><h1>Title</h1><p>by me</p><div class=share><h2>Share</h2></div></header><p>Body text here <a title=don't>x</a> rest.</p></article></body>"
    assert html.extract(page, None)[0] == "Title\nBody text here x rest."
