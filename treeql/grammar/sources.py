"""Token sources: tokens for a parser that come from elsewhere than its grammar's own terminals.

A source is a function of the text, which returns a function of a place: the next token there or behind it as (name, start, end) in bytes, or None at the end. It is asked
again for a place where a parse forks or recovers, so it must answer alike each time.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable

import regex

from .parser import TokenSource


def pattern_tokens(patterns: dict[str, str], skip: str = r"\s+") -> TokenSource:
    """Tokens by regular expressions over the text's bytes: what `skip` matches lies between tokens; the longest match wins, of equal ones the first. A byte that none fits is a token
    of its own without a name, which a parser takes as an error."""
    compiled = [(name, regex.compile(p.encode())) for name, p in patterns.items()]
    between = regex.compile(skip.encode())

    def over(source: bytes):
        def next_token(at: int):
            if (m := between.match(source, at)) is not None:
                at = m.end()
            if at >= len(source):
                return None
            best, end = "", at
            for name, pattern in compiled:
                m = pattern.match(source, at)
                if m is not None and m.end() > end:
                    best, end = name, m.end()
            return best, at, max(end, at + 1)

        return next_token

    return over


def listed_tokens(tokens: Iterable[tuple[str, int, int]]) -> TokenSource:
    """Tokens (name, start, end) that are known already, in any order; they must not overlap."""
    ordered = sorted(tokens, key=lambda t: (t[1], t[2]))
    if any(a[2] > b[1] for a, b in zip(ordered, ordered[1:])):
        raise ValueError("tokens overlap")
    starts = [t[1] for t in ordered]

    def over(source: bytes):
        def next_token(at: int):
            k = bisect_left(starts, at)
            return ordered[k] if k < len(ordered) else None

        return next_token

    return over


#: Sources by name, for `parse_tokens`.
TOKEN_SOURCES: dict[str, TokenSource] = {}


def register_tokens(name: str, source: TokenSource) -> None:
    TOKEN_SOURCES[name] = source


class Renamed:
    """A scanner whose external tokens have other names in the grammar that uses it: `names` is own name -> name there."""

    def __init__(self, scanner, names: dict[str, str]):
        self._scanner, self._to, self._from = scanner, dict(names), {v: k for k, v in names.items()}

    def scan(self, source: bytes, at: int, names: list[str], state: bytes):
        found = self._scanner.scan(source, at, [self._from[n] for n in names if n in self._from], state)
        return found and (self._to[found[0]], *found[1:])


def by_order(language, externals: list[str]) -> Renamed:
    """A language's scanner for a grammar that lists the same external tokens, in the same order, by other names."""
    if language.scanner is None or len(language.externals) != len(externals):
        raise ValueError(f"{len(language.externals)} external tokens of {language.name} for {len(externals)}")
    return Renamed(language.scanner, dict(zip(language.externals, externals)))
