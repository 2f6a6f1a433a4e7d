"""Main text of web pages: boosted trees over DOM-node features, decoded along the tree.

A lenient parser makes a tree of the block elements of each page. Every node has features: its tag and those above it, words of
its class, id and role by group, depth, text and links of its subtree, its place among its siblings and what these hold. Gradient-boosted trees, fitted to
generated pages whose nodes are labelled (`training_pages`, a fixed number of them), give the probability that a node belongs to the main text. The
labelling of a page is the likeliest one in which a node inside the main text that is left out takes everything below it along, and a kept
node stands either in another kept one or outside any that was left out: so no ancestor contradicts a descendant. Blocks of kept
nodes are joined in page order.

Pages are read in one forward scan (`..grammar.markup`), so that no markup takes quadratic time. Scripts, styles, comments in markup, controls of forms and
embedded media hold no blocks; formulas, the fallback of `object` and the text of `noscript` are text like any other. A line break counts as white space.

Defined cases: a null or empty page has the empty text; text without any tag is one block in an otherwise empty page and is kept; unclosed and stray tags are
repaired as browsers mostly do; a slash doesn't close an HTML block; where a quote in a tag is never closed, quotes mean nothing from there on; repeated rows give the same text; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import random
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..grammar.markup import OpenElements, Scan
from . import gbt
from .common import bound_batches, read_table

# HTML's element kinds.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SKIPPED = frozenset("script style template svg iframe head title select textarea button canvas audio video datalist".split())
BLOCK = frozenset(
    "html body address article aside blockquote center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption label".split()
)
CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
#: An opening tag ends an open one of these, unless one of the second stands between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody"}, {"table"}),
}
#: Groups of words in class, id and role.
TOKENS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs skip",
    "head": "header masthead topbar logo banner branding",
    "foot": "footer foot bottom copyright colophon legal contentinfo",
    "side": "sidebar side aside widget related recommended recommendations trending popular more rail complementary",
    "ad": "ad ads advert adverts advertisement advertising adsense promo promotion sponsor sponsored dfp outbrain taboola",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay subscribe newsletter signup paywall dialog",
    "form": "form search login register contact input",
    "comment": "comment comments reply replies respond disqus discussion reader",
    "share": "share sharing social follow tags meta tools toolbar",
    "main": "article content main post entry story body text hentry prose page",
}
_GROUP = {w: 1 << i for i, words in enumerate(TOKENS.values()) for w in words.split()}
_TAGS = {t: i for i, g in enumerate(["article", "main", "section", "div center", "p", "h1", "h2 h3 h4 h5 h6", "ul ol menu dl", "li dt dd", "table tbody thead tfoot tr", "td th caption", "nav", "header hgroup", "footer", "aside", "form fieldset label legend search", "figure figcaption", "blockquote pre address", "html body"]) for t in g.split()}
_N_TAGS = 20
_ATTRIBUTE = re.compile(r"""\b(class|id|role|data-y)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Page:
    """Block nodes in page order (0 is the root) and the text blocks that stand in them."""

    def __init__(self, source: str):
        self.tag, self.parent, self.marks, self.label = ["html"], [-1], [0], [0]
        self.blocks: list[tuple[int, str, int]] = []  # node, text, characters in links
        self._held: list[str] = []
        self._linked = 0
        self._stack: list[tuple[str, int]] = [("", 0)]
        self._open = OpenElements()
        self._read(source)
        self._flush()

    def _flush(self) -> None:
        if self._held:
            text = " ".join("".join(self._held).split())
            if text:
                self.blocks.append((self._stack[-1][1], text, min(self._linked, len(text))))
            self._held, self._linked = [], 0

    def _text(self, raw: str) -> None:
        text = html.unescape(raw) if "&" in raw else raw
        self._held.append(text)
        if self._open.nearest(("a",)) > 0:
            self._linked += len(text.strip())

    def _pop(self, wanted: set, bounds: frozenset | set = frozenset()) -> None:
        """Close up to the nearest open element of `wanted`, unless one of `bounds` stands above it."""
        k = self._open.nearest(wanted)
        if k < 0 or self._open.nearest(bounds) > k:
            return
        if any(t in BLOCK for t, _ in self._stack[k:]):
            self._flush()
        for t, _ in self._stack[k:]:
            self._open.pop(t)
        del self._stack[k:]

    def _read(self, source: str) -> None:
        at, scan = 0, Scan(source)
        for _, m, start, end in scan:
            if start > at:
                self._text(source[at:start])
            at = end
            if m is None:
                continue
            tag = m[2].lower()
            if m[1]:
                if tag in BLOCK or tag not in VOID:
                    self._pop({tag}, {"table"} if tag not in ("table", "body", "html") and tag in BLOCK and tag not in ("tr", "td", "th", "tbody", "thead", "tfoot", "caption") else frozenset())
                continue
            if tag in SKIPPED:
                # a slash closes foreign elements only
                if not (tag == "svg" and m[3].endswith("/")):
                    closing = scan.closing(tag)
                    if closing:
                        at = scan.at = closing.end()
                    elif tag in ("script", "style", "title", "textarea"):
                        at = scan.at = len(source)
                continue
            if tag in VOID:
                self._held.append(" ")
                if tag == "hr":
                    self._pop({"p"})
                    self._flush()
                continue
            if tag in CLOSES_P:
                self._pop({"p"}, {"table"})
            if tag in ENDS:
                self._pop(*ENDS[tag])
            node = self._stack[-1][1]
            if tag in BLOCK:
                self._flush()
                marks, label = self._attributes(m[3])
                self.tag.append(tag)
                self.parent.append(node)
                self.marks.append(marks)
                self.label.append(label)
                node = len(self.tag) - 1
            if tag in BLOCK or not m[3].endswith("/"):
                self._stack.append((tag, node))
                self._open.push(tag, len(self._stack) - 1)
        if at < len(source):
            self._text(source[at:])

    def _attributes(self, raw: str) -> tuple[int, int]:
        marks = label = 0
        for name, value in _ATTRIBUTE.findall(raw):
            if name == "data-y":
                label = int(value.strip("\"'") == "1")
                continue
            for word in _WORD.findall(value):
                marks |= _GROUP.get(word.lower(), 0)
        return marks, label


_PUNCTUATION = re.compile(r"[.!?,;:]")
WIDTH = _N_TAGS + 3 * len(TOKENS) + 9 + 22


def features(page: Page) -> np.ndarray:
    """(nodes, WIDTH): one row for each block node."""
    n = len(page.tag)
    parent = np.array(page.parent)
    own, link, marks_n, blocks = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    before = np.zeros(n)
    seen = 0
    first = np.full(n, -1.0)
    for node, text, linked in page.blocks:
        own[node] += len(text)
        link[node] += linked
        marks_n[node] += len(_PUNCTUATION.findall(text))
        blocks[node] += 1
        if first[node] < 0:
            first[node] = seen
        seen += len(text)
    text, links, stops, count, kids, paragraphs, longest = own.copy(), link.copy(), marks_n.copy(), blocks.copy(), np.ones(n), np.array([float(t == "p") for t in page.tag]), own.copy()
    children, depth = np.zeros(n), np.zeros(n)
    order, last = np.zeros(n), {}
    below = list(page.marks)
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        text[p] += text[i]
        links[p] += links[i]
        stops[p] += stops[i]
        count[p] += count[i]
        kids[p] += kids[i]
        paragraphs[p] += paragraphs[i]
        longest[p] = max(longest[p], longest[i])
        if first[i] >= 0 and (first[p] < 0 or first[i] < first[p]):
            first[p] = first[i]
        below[p] |= below[i]
    above, tags_above = [0] * n, np.zeros((n, 9))
    previous = np.zeros(n, np.int64)
    following = np.zeros(n, np.int64)
    wanted = {"article": 0, "main": 1, "nav": 2, "header": 3, "footer": 4, "aside": 5, "form": 6, "section": 7, "td": 8}
    for i in range(1, n):
        p = page.parent[i]
        depth[i] = depth[p] + 1
        order[i] = children[p]
        children[p] += 1
        above[i] = above[p] | page.marks[p]
        tags_above[i] = tags_above[p]
        if page.tag[p] in wanted:
            tags_above[i, wanted[page.tag[p]]] = 1
        if p in last:
            previous[i] = last[p]
            following[last[p]] = i
        last[p] = i
    siblings = children[np.maximum(parent, 0)]
    tag = np.zeros((n, _N_TAGS))
    tag[np.arange(n), [_TAGS.get(t, _N_TAGS - 1) for t in page.tag]] = 1
    bits = np.arange(len(TOKENS))
    flags = [(np.array(m)[:, None] >> bits & 1).astype(float) for m in (page.marks, above, below)]
    total = max(seen, 1)
    up = np.maximum(parent, 0)
    rate = lambda a, b: a / np.maximum(b, 1)
    side = lambda k: (np.where(k > 0, np.log1p(text[k]), -1), np.where(k > 0, rate(links[k], text[k]), -1))
    more = [
        depth, order, siblings, children, np.log1p(own), np.log1p(text), rate(link, own), rate(links, text), rate(stops, text) * 100, rate(text, kids),
        rate(text, count), np.log1p(paragraphs), np.log1p(longest), text / total, np.maximum(first, 0) / total, rate(text, text[up]),
        np.log1p(text[up]), rate(links[up], text[up]), *side(previous), *side(following),
    ]
    return np.hstack([tag, *flags, tags_above, np.stack(more, 1)]).astype(np.float32)


def decode(page: Page, p: np.ndarray) -> np.ndarray:
    """Whether each node is kept, in the likeliest labelling that holds together.

    A node is outside the main text (nodes in it may be inside), inside, or left out of it (all nodes in it are too).
    """
    yes, no = np.log(np.clip(p, 1e-4, 1)), np.log(np.clip(1 - p, 1e-4, 1))
    outside, inside, out = no.copy(), yes.copy(), no.copy()
    for i in range(len(p) - 1, 0, -1):
        up = page.parent[i]
        outside[up] += max(outside[i], inside[i])
        inside[up] += max(inside[i], out[i])
        out[up] += out[i]
    state = np.zeros(len(p), np.int8)
    state[0] = int(inside[0] > outside[0])
    for i in range(1, len(p)):
        above = state[page.parent[i]]
        state[i] = 2 if above == 2 else int(inside[i] > outside[i]) if above == 0 else (1 if inside[i] >= out[i] else 2)
    return state == 1


def main_text(page: Page, p: np.ndarray) -> str:
    if len(page.tag) == 1:
        return "\n".join(text for _, text, _ in page.blocks)
    keep = decode(page, p)
    return "\n".join(text for node, text, _ in page.blocks if keep[node])


# Generated pages with labelled nodes.


def _words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("bcdfghlmnprstvw") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(n))


def _sentences(rng: random.Random, n: int) -> str:
    return " ".join(_words(rng, rng.randint(3, 18)).capitalize() + rng.choice(".....!?") for _ in range(n))


def _links(rng: random.Random, n: int, y: int = 0) -> str:
    item = rng.choice(["li", "li", "div", ""])
    inner = [f'<a href="/x">{_words(rng, rng.randint(1, 5))}</a>' for _ in range(n)]
    if item == "li":
        return f'<ul data-y="{y}">' + "".join(f'<li data-y="{y}">{x}</li>' for x in inner) + "</ul>"
    return "".join(f'<div data-y="{y}">{x}</div>' for x in inner) if item else " | ".join(inner)


def _named(rng: random.Random, *groups: str, often: float = 0.85) -> str:
    if rng.random() > often:
        return ""
    word = rng.choice(TOKENS[rng.choice(groups)].split())
    return f' {rng.choice(["class", "class", "id"])}="{word}{rng.choice(["", "", "-box", " wide", "_1", "-block"])}"'


def _paragraph(rng: random.Random, y: int, n: int | None = None) -> str:
    body = _sentences(rng, n or rng.choice([1, 1, 2, 3, 5, 8]))
    if rng.random() < 0.2:
        words = body.split(" ")
        words[0] = f"<a href='#'>{words[0]}</a>"
        body = " ".join(words)
    if rng.random() < 0.15:
        body = f"<b>{body}</b>"
    return f'<p data-y="{y}">{body}</p>'


def _boilerplate(rng: random.Random) -> str:
    """Something that is no main text, inside or outside an article."""
    kind = rng.choice(["menu", "ad", "side", "notice", "form", "comment", "share", "ad", "comment"])
    if kind == "menu":
        t = rng.choice(["nav", "div", "ul"])
        return f'<{t}{_named(rng, "menu", often=0.3 if t == "nav" else 0.9)} data-y="0">{_links(rng, rng.randint(2, 12))}</{t}>'
    if kind == "form":
        return f'<form data-y="0"{_named(rng, "form", "notice", often=0.5)}><label data-y="0">{_words(rng, 2)}</label><input><p data-y="0">{_sentences(rng, 1)}</p></form>'
    if kind == "comment":
        t = rng.choice(["section", "div", "ol"])
        each = "li" if t == "ol" else "div"
        body = "".join(f'<{each} data-y="0"{_named(rng, "comment", often=0.7)}><p data-y="0">{_sentences(rng, rng.randint(1, 4))}</p></{each}>' for _ in range(rng.randint(1, 6)))
        head = f'<h3 data-y="0">{_words(rng, 2)}</h3>' if rng.random() < 0.6 else ""
        return f'<{t}{_named(rng, "comment", often=1)} data-y="0">{head}{body}</{t}>'
    if kind == "side":
        t = rng.choice(["aside", "div", "section"])
        body = _links(rng, rng.randint(2, 6)) if rng.random() < 0.6 else _paragraph(rng, 0, rng.randint(1, 3))
        return f'<{t}{_named(rng, "side", often=0.4 if t == "aside" else 1)} data-y="0"><h3 data-y="0">{_words(rng, 2)}</h3>{body}</{t}>'
    t = rng.choice(["div", "div", "aside", "section"])
    body = _sentences(rng, rng.randint(1, 3))
    body = body if rng.random() < 0.5 else f'<p data-y="0">{body}</p>'
    return f'<{t}{_named(rng, kind, often=1)} data-y="0">{body}</{t}>'


def _article(rng: random.Random) -> str:
    title = f'<h1 data-y="1">{_words(rng, rng.randint(1, 9)).capitalize()}</h1>'
    parts = [f'<header data-y="1">{title}</header>' if rng.random() < 0.15 else title if rng.random() < 0.85 else ""]
    for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 12])):
        k = rng.random()
        if k < 0.72:
            parts.append(_paragraph(rng, 1))
        elif k < 0.8:
            parts.append(f'<h2 data-y="1">{_words(rng, rng.randint(1, 6)).capitalize()}</h2>' + _paragraph(rng, 1))
        elif k < 0.87:
            parts.append('<ul data-y="1">' + "".join(f'<li data-y="1">{_sentences(rng, 1)}</li>' for _ in range(rng.randint(2, 6))) + "</ul>")
        elif k < 0.9:
            parts.append(f'<blockquote data-y="1"><p data-y="1">{_sentences(rng, 2)}</p></blockquote>')
        elif k < 0.93:
            parts.append('<table data-y="1"><tbody data-y="1">' + "".join(f'<tr data-y="1"><td data-y="1">{_words(rng, 2)}</td><td data-y="1">{_words(rng, 3)}</td></tr>' for _ in range(3)) + "</tbody></table>")
        elif k < 0.96:
            parts.append(f'<figure data-y="1"><img src="x"><figcaption data-y="1">{_sentences(rng, 1)}</figcaption></figure>')
        else:
            parts.append(f'<pre data-y="1">{_words(rng, 12)}</pre>')
    if rng.random() < 0.35:
        parts.insert(rng.randint(0, len(parts)), _boilerplate(rng))
    if rng.random() < 0.1:
        parts.append(f'<footer data-y="0">{_links(rng, 3)}</footer>')
    body = "".join(parts)
    if rng.random() < 0.3:
        body = f'<div data-y="1"{_named(rng, "main", often=0.6)}>{body}</div>'
    t = rng.choice(["article", "article", "article", "main", "div", "div", "section", "td"])
    name = _named(rng, "main", often=0.3 if t in ("article", "main") else 0.9)
    if t == "td":
        return f'<table data-y="0"><tr data-y="0"><td data-y="0">{_links(rng, 5)}</td><td data-y="1"{name}>{body}</td></tr></table>'
    return f'<{t}{name} data-y="1">{body}</{t}>'


def training_pages(n: int, seed: int = 5) -> list[str]:
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        head = f'<header data-y="0"{_named(rng, "head", often=0.5)}><div data-y="0">{_words(rng, 2)}</div>{_links(rng, rng.randint(0, 6))}</header>' if rng.random() < 0.5 else f'<div data-y="0"{_named(rng, "head", often=1)}>{_words(rng, 3)}</div>' if rng.random() < 0.3 else ""
        nav = f'<nav data-y="0">{_links(rng, rng.randint(2, 9))}</nav>' if rng.random() < 0.7 else ""
        foot = f'<footer data-y="0"{_named(rng, "foot", often=0.4)}>{_sentences(rng, 1) if rng.random() < 0.6 else _links(rng, 5)}</footer>' if rng.random() < 0.7 else f'<div data-y="0"{_named(rng, "foot", often=1)}><p data-y="0">{_sentences(rng, 1)}</p></div>'
        before = "".join(_boilerplate(rng) for _ in range(rng.choice([0, 0, 1, 1, 2])))
        after = "".join(_boilerplate(rng) for _ in range(rng.choice([0, 0, 1, 1, 2])))
        body = _article(rng)
        if rng.random() < 0.3:
            outer = rng.choice(["div", "main", "section"])
            body, before, after = f'<{outer} data-y="0"{_named(rng, "main", "side", often=0.4)}>{before}{body}{after}</{outer}>', "", ""
        out.append(f'<html data-y="0"><body data-y="0">{head}{nav}{before}{body}{after}{foot}</body></html>')
    return out


@cache
def model(pages: int = 900, trees: int = 60, depth: int = 5) -> gbt.Trees:
    read = [Page(x) for x in training_pages(pages)]
    x = np.vstack([features(p) for p in read]).astype(np.float64)
    return gbt.fit(x, np.concatenate([p.label for p in read]).astype(np.float64), trees, depth)


def extract_many(sources: list[str], trees: gbt.Trees) -> list[str]:
    pages = [Page(s) for s in sources]
    if not pages:
        return []
    x = [features(p) for p in pages]
    p = trees.probability(np.vstack(x))
    edges = np.cumsum([0] + [len(f) for f in x])
    return [main_text(page, p[a:b]) for page, a, b in zip(pages, edges, edges[1:])]


def _run(trees: gbt.Trees, most: int = 4 << 20):
    def run(batches):
        for batch in batches:
            held, size, start = [], 0, 0
            sources = [s or "" for s in batch.column("html").to_pylist()]
            for i, s in enumerate(sources):
                held.append(s)
                size += len(s)
                if size >= most or i == len(sources) - 1:
                    texts = extract_many(held, trees)
                    piece = batch.slice(start, i + 1 - start)
                    yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in piece.schema.names if c != "html"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*(c for c in piece.schema.names if c != "html"), "text", "n_chars"])
                    held, size, start = [], 0, i + 1

    return run


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Rows (the columns `keep`, text, n_chars) of all pages."""
    bound_batches(pages)
    rows = pages.select(*keep, F.col(html_col).alias("html"))
    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(_run(model()), f"{kinds}, text string, n_chars long")


def op7_html_extraction(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(read_table(spark, sf_dir, "pages"))


QUERIES = {"op7_html_extraction": op7_html_extraction}
ORACLES: dict[str, str] = {}
