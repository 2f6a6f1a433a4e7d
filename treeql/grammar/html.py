"""A front end for HTML: elements, attributes, text, comments, and the raw text of scripts and styles, as a `Tree`."""

from __future__ import annotations

import re

from ..tree import Node, Tree
from .markup import COMMENT, OpenElements, Scan

# Elements without content, and those whose content is raw text.
VOID = frozenset(b"area base br col embed hr img input link meta source track wbr".split())
RAW = {b"script": "script_element", b"style": "style_element"}
#: An element that a new one of the second kind ends.
_IMPLIED = {b"p": frozenset(b"p div ul ol table section article h1 h2 h3 h4 h5 h6 form pre blockquote nav header footer aside main".split()), b"li": frozenset([b"li"]), b"td": frozenset(b"td th tr".split()), b"th": frozenset(b"td th tr".split()), b"tr": frozenset([b"tr"]), b"option": frozenset([b"option"])}
_ATTRIBUTE = re.compile(rb"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")


def _attributes(source: bytes, start: int, end: int) -> list[Node]:
    out = []
    for m in _ATTRIBUTE.finditer(source, start, end):
        inside = [Node("attribute_name", True, m.start(1), m.end(1), field="name")]
        if m[2] is not None:
            inside.append(Node("attribute_value", True, m.start(2), m.end(2), field="value"))
        out.append(Node("attribute", True, m.start(), m.end(), inside))
    return out


def parse_html(source: bytes) -> Tree:
    """Every text has a tree: stray end tags become errors, open elements end with their parents."""
    root = Node("document", True, 0, len(source))
    stack: list[tuple[bytes, Node]] = [(b"", root)]
    opened, scan = OpenElements(), Scan(source)
    at = 0

    def text(a: int, b: int) -> None:
        body = source[a:b]
        if body.strip():
            lead = len(body) - len(body.lstrip())
            stack[-1][1].children.append(Node("text", True, a + lead, a + len(body.rstrip())))

    def close(at: int) -> None:
        name, node = stack.pop()
        opened.pop(name)
        node.end = at

    for kind, m, start, end in scan:
        text(at, start)
        at = end
        if m is None:
            stack[-1][1].children.append(Node("comment" if kind == COMMENT else "doctype", True, start, end))
            continue
        name = m[2].lower()
        tag_name = Node("tag_name", True, m.start(2), m.end(2), field="name")
        if m[1]:
            place = opened.nearest((name,))
            end_tag = Node("end_tag", True, start, end, [tag_name])
            if place < 0:
                stack[-1][1].children.append(Node("ERROR", True, start, end, [end_tag], error=True))
                continue
            while len(stack) - 1 > place:
                close(start)
            stack[-1][1].children.append(end_tag)
            close(end)
            continue
        while len(stack) > 1 and name in _IMPLIED.get(stack[-1][0], ()):
            close(start)
        start_tag = Node("start_tag", True, start, end, [tag_name, *_attributes(source, m.start(3), m.end(3))])
        node = Node(RAW.get(name, "element"), True, start, end, [start_tag])
        stack[-1][1].children.append(node)
        if name in VOID or m[3].endswith(b"/"):
            continue
        stack.append((name, node))
        opened.push(name, len(stack) - 1)
        if name in RAW:
            found = scan.closing(name)
            stop = found.start() if found else len(source)
            if source[at:stop].strip():
                node.children.append(Node("raw_text", True, at, stop))
            at = scan.at = stop
    text(at, len(source))
    while len(stack) > 1:
        close(len(source))
    return Tree(root, source)
