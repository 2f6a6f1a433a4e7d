import os
import time
from html.parser import HTMLParser

import numpy as np
import pytest

from treeql.llm import html_extraction as H

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script><style>p{{}}</style></head><body>
<header class="site-header"><a href="/">Home</a></header><nav><ul><li><a href="/a">A link</a></li><li><a href="/b">Another</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies on this site.</p></div>
<{open}><h1>The title &amp; more</h1><p>First  paragraph with <b>bold</b> text,
and a second line of it. It goes on for some time, as articles do.</p><p>Second one &#233;.<br>After a break, it ends here.<p>Third without an end tag. It has two sentences.
<div class="advert">Buy now, cheap and good.</div><ul><li>One item that is long enough to be read.</li><li>Two items are better than one, they say.</li></ul></{close}>
<section id="comments"><h3>Comments</h3><div class="comment"><p>I liked it. Very much so.</p></div></section>
<aside class="sidebar"><h3>Related</h3><ul><li><a href="/x">See this</a></li></ul></aside>
<form class="search"><input name="q"><label>Search</label></form><footer>Copyright by us.</footer></body></html>"""
WANT = "The title & more\nFirst paragraph with bold text, and a second line of it. It goes on for some time, as articles do.\nSecond one é. After a break, it ends here.\nThird without an end tag. It has two sentences.\nOne item that is long enough to be read.\nTwo items are better than one, they say."


@pytest.mark.parametrize("kind", ["article", "main", 'div class="post-content"'])
def test_a_page(kind):
    page = PAGE.format(open=kind, close=kind.split()[0])
    assert H.extract_many([page], H.model()) == [WANT]


def test_unseen_generated_pages():
    pages = [H.Page(x) for x in H.training_pages(150, seed=99)]
    right = 0
    for page in pages:
        keep = H.decode(page, H.model().probability(H.features(page)))
        right += [t for n, t, _ in page.blocks if keep[n]] == [t for n, t, _ in page.blocks if page.label[n]]
    assert right >= 140


def test_decoding_is_consistent_and_likeliest():
    page = H.Page("<div><p>a</p><div><p>b</p></div></div>")
    rng = np.random.default_rng(1)
    n = len(page.tag)
    for _ in range(200):
        p = rng.uniform(0.02, 0.98, n)
        best, states = -1e9, None
        for code in range(3**n):
            s = [code // 3**i % 3 for i in range(n)]
            legal = s[0] != 2 and all((s[i] == 2) if s[page.parent[i]] == 2 else (s[i] in (0, 1) if s[page.parent[i]] == 0 else s[i] in (1, 2)) for i in range(1, n))
            if legal:
                value = sum(np.log(p[i]) if s[i] == 1 else np.log(1 - p[i]) for i in range(n))
                if value > best:
                    best, states = value, [x == 1 for x in s]
        assert list(H.decode(page, p)) == states


def test_awkward_pages(spark):
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    rows = [(1, "u", None), (2, None, ""), (3, "u", "just text &lt;b&gt;"), (4, "u", "<p"), (5, "u", "</p></div>stray"), (6, "u", deep), (7, "u", "<!-- never closed"), (7, "u", "<script>x")]
    got = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'clash' as text", "'clash' as n_chars")).collect()
    assert len(got) == 8 and all(r.n_chars == len(r.text) for r in got)
    by_id = {r.page_id: r.text for r in got}
    assert by_id[1] == by_id[2] == by_id[7] == "" and by_id[3] == "just text <b>"
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_punctuation_is_counted_at_every_length():
    from treeql.llm import html_extraction as module

    stops = lambda text: module.features(module.Page(f"<div><p>{text}</p></div>"))[2, -14]
    assert stops("word " * 1000) == 0 and stops("word. " * 1000) == stops("word. " * 100 + "word. " * 900) > 10


@pytest.mark.parametrize("piece", ["<a b ", "<a '", "<button>", "<svg>", "<x></y>", "<!-- ", "</div>", "<a<", "<p><table><span></div>", "<p class='a\" "])
def test_a_megabyte_of_broken_markup(piece):
    from treeql.grammar.html import parse_html

    page = piece * (1_000_000 // len(piece))
    H.model()
    for f in (lambda: H.extract_many([page], H.model()), lambda: parse_html(page[:100_000].encode())):
        began = time.process_time()
        f()
        assert time.process_time() - began < 5


def test_what_is_text():
    texts = lambda source: [t for _, t, _ in H.Page(source).blocks]
    assert texts("<p>Let <math><mi>x</mi></math> be <object>fallback</object> 5 <noscript>still</noscript></p>") == ["Let x be fallback 5 still"]
    assert texts('x<p title="y>rest<b>bold</b>') == ["x", "restbold"]
    assert texts("<p>if a < b and c <d") == ["if a < b and c <d"]
    assert H.Page("<div/><p>in it</p>").parent == [-1, 0, 1]


class _Article(HTMLParser):
    """The article's blocks as the standard library's parser reads them, without the boxes in it that have a class."""

    def __init__(self):
        super().__init__()
        self.inside, self.boxed, self.blocks = False, 0, [""]

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.inside = True
        elif self.boxed or (self.inside and tag in ("div", "section", "aside", "form") and dict(attrs).get("class")):
            self.boxed += tag in ("div", "section", "aside", "form")
        if tag == "br":
            self.blocks[-1] += " "
        elif tag in ("p", "li", "ul", "h1", "h2", "h3", "div", "section", "article", "blockquote"):
            self.blocks.append("")

    def handle_endtag(self, tag):
        if tag == "article":
            self.inside = False
        self.boxed -= bool(self.boxed and tag in ("div", "section", "aside", "form"))
        if tag in ("p", "li", "ul", "h1", "h2", "h3", "div", "section", "article", "blockquote"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside and not self.boxed:
            self.blocks[-1] += data


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables")
def test_articles_of_the_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in H.extract(pages).collect()}
    for page in pages.collect():
        plain = _Article()
        plain.feed(page.html)
        plain.close()
        assert got[page.page_id] == "\n".join(t for t in (" ".join(b.split()) for b in plain.blocks) if t), page.page_id
