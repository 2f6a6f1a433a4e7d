"""A forward scan of markup: comments, declarations and tags in order, in time in proportion to the text.

A tag ends at the first `>` outside of quotes. Once a tag has none, which a quote that is never closed may cause, quotes mean nothing in the rest of the text, so
that no stretch is tried again and again; once there is no `>` left, what looks like a tag is text. An unclosed comment or declaration takes the rest.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

COMMENT, DECLARATION, TAG = "comment", "declaration", "tag"
_START = r"<(?:(?P<comment>!--)|(?P<cdata>!\[CDATA\[)|(?P<declaration>[!?])|(?P<tag>/?[a-zA-Z]))"
_QUOTED = r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
_PLAIN = r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>"


@cache
def _patterns(kind: type) -> tuple:
    """The patterns and the ends of comments, CDATA and declarations, for str or bytes."""
    shaped = (lambda x: x.encode()) if kind is bytes else str
    return *(re.compile(shaped(p)) for p in (_START, _QUOTED, _PLAIN)), {k: shaped(v) for k, v in (("comment", "-->"), ("cdata", "]]>"), ("declaration", ">"))}


@cache
def _closing(name) -> re.Pattern:
    if isinstance(name, bytes):
        return re.compile(rb"</" + re.escape(name) + rb"(?![\w-])[^>]*+>?", re.I)
    return re.compile(rf"</{re.escape(name)}(?![\w-])[^>]*+>?", re.I)


class Scan:
    """Iterates over (kind, match or None, start, end); a tag's match has the groups: slash, name, attributes. `at` may be moved on while iterating."""

    def __init__(self, source: str | bytes):
        self.source, self.at = source, 0
        self._gone: set = set()

    def __iter__(self) -> Iterator[tuple[str, re.Match | None, int, int]]:
        source = self.source
        start, quoted, plain, ends = _patterns(type(source))
        tag, left = quoted, True
        while m := start.search(source, self.at):
            kind, a = m.lastgroup, m.start()
            if kind == "tag":
                found = tag.match(source, a) if left else None
                if left and not found and tag is quoted:
                    tag = plain
                    found = tag.match(source, a)
                left = left and found is not None
                self.at = found.end() if found else m.end()
                if found:
                    yield TAG, found, a, self.at
                continue
            # a comment may end with the dashes that began it
            stop = source.find(ends[kind], a + 2 if kind == "comment" else m.end())
            self.at = len(source) if stop < 0 else stop + len(ends[kind])
            yield COMMENT if kind == "comment" else DECLARATION, None, a, self.at

    def closing(self, name) -> re.Match | None:
        """The next end tag `name` from here on; where none is left, that is remembered."""
        if name in self._gone:
            return None
        found = _closing(name).search(self.source, self.at)
        if not found:
            self._gone.add(name)
        return found


class OpenElements:
    """Where each kind of element is open in a stack, so that the nearest one is found without a walk."""

    def __init__(self):
        self._places: dict = {}

    def push(self, name, place: int) -> None:
        self._places.setdefault(name, []).append(place)

    def pop(self, name) -> None:
        self._places[name].pop()

    def nearest(self, names) -> int:
        """The topmost place of any of `names`, -1 if none is open."""
        return max((p[-1] for n in names if (p := self._places.get(n))), default=-1)
