"""Statements, metavariables, where clauses and templates."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


class GrepError(ValueError):
    pass


@dataclass
class Statement:
    pattern: str
    lang: str = ""
    where: str = ""
    replace: str = ""

    def __str__(self) -> str:
        head = f"find {self.lang}::{self.pattern}" if self.lang else f"find {self.pattern}"
        return head + (f" where {{ {self.where} }}" if self.where else "") + (f" replace {{ {self.replace} }}" if self.replace else "")


def _keyword(text: str, word: str, start: int = 0) -> tuple[int, int] | None:
    """Place of a block keyword: white space before it, a brace after it."""
    m = re.compile(rf"(?<=\s){word}\s*\{{").search(text, start)
    return (m.start(), m.end()) if m else None


def _block(text: str, at: int) -> tuple[str, int]:
    """The text up to the brace that closes the one before `at`, and where it ends."""
    depth = 1
    for i in range(at, len(text)):
        depth += (text[i] == "{") - (text[i] == "}")
        if depth == 0:
            return text[at:i].strip(), i + 1
    raise GrepError("block without end")


def parse_statement(text: str) -> Statement:
    body = text.strip()
    if not body:
        raise GrepError("empty statement")
    if re.match(r"find\s", body):
        body = body[4:].strip()
    where = replace = ""
    w, r = _keyword(body, "where"), _keyword(body, "replace")
    if w and r and r[0] < w[0]:
        raise GrepError("replace stands before where")
    pattern = body
    if w:
        where, end = _block(body, w[1])
        pattern, rest = body[: w[0]], body[end:]
        if rest.strip():
            r2 = _keyword(" " + rest.lstrip(), "replace")
            if not r2:
                raise GrepError(f"unexpected {rest.strip()!r}")
            replace, end = _block(" " + rest.lstrip(), r2[1])
    elif r:
        replace, end = _block(body, r[1])
        pattern = body[: r[0]]
    pattern = pattern.strip()
    m = re.match(r"([A-Za-z0-9_-]+)::", pattern)
    lang = m[1] if m else ""
    pattern = pattern[m.end() :].strip() if m else pattern
    if not pattern:
        raise GrepError("statement without pattern")
    return Statement(pattern, lang, where, replace)


@dataclass
class MetaVariable:
    name: str
    placeholder: str
    many: bool = False
    wildcard: bool = False
    type: str = ""


RESERVED = "__GREP_"
_META = re.compile(r"\$\$\$([A-Z_][A-Z0-9_]*)|\$(_)(?![A-Za-z0-9_])|\$([A-Z][A-Z0-9_]*)(?::([a-z_]+))?")


def preprocess(pattern: str) -> tuple[str, dict[str, MetaVariable]]:
    """The pattern with identifiers for its metavariables, and what they stand for."""
    if RESERVED in pattern:
        raise GrepError(f"patterns can't hold {RESERVED}")
    found: dict[str, MetaVariable] = {}
    wild = 0

    def put(m: re.Match) -> str:
        nonlocal wild
        if m[1]:
            v = MetaVariable(m[1], f"{RESERVED}VAR_{m[1]}__", many=True)
        elif m[2]:
            wild += 1
            v = MetaVariable("_", f"{RESERVED}WILD_{wild}__", wildcard=True)
        elif m[4]:
            v = MetaVariable(m[3], f"{RESERVED}TYPED_{m[3]}__T__{m[4]}__", type=m[4])
        else:
            v = MetaVariable(m[3], f"{RESERVED}CAP_{m[3]}__")
        return found.setdefault(v.placeholder, v).placeholder

    return _META.sub(put, pattern), found


_CLAUSE = re.compile(r"(not\s+)?(contains|matches)\(\s*\$([A-Za-z_][A-Za-z0-9_]*)\s*,(.*)\)\s*", re.S)


def where_clauses(where: str) -> list[tuple[bool, str, str, str]]:
    """(negated, function, capture, argument) of clauses between semicolons and line ends, all of which must hold."""
    out = []
    for clause in re.split(r"[;\n]", where):
        clause = clause.strip()
        if not clause:
            continue
        m = _CLAUSE.fullmatch(clause)
        if not m:
            raise GrepError(f"unknown clause {clause!r}")
        value = m[4].strip()
        value = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value
        if m[2] == "matches":
            try:
                re.compile(value)
            except re.error as e:
                raise GrepError(str(e)) from e
        out.append((bool(m[1]), m[2], m[3], value))
    return out


def compile_where(where: str) -> Callable[[dict[str, str]], bool]:
    clauses = where_clauses(where)

    def holds(captures: dict[str, str]) -> bool:
        return all(((v in captures.get(c, "")) if f == "contains" else re.search(v, captures.get(c, "")) is not None) != no for no, f, c, v in clauses)

    return holds


def where_column(where: str, captures: Column) -> Column:
    """The same over a map column of capture texts."""

    def one(no: bool, f: str, c: str, v: str) -> Column:
        text = F.coalesce(F.try_element_at(captures, F.lit(c)), F.lit(""))
        hit = text.contains(v) if f == "contains" else text.rlike(v)
        return ~hit if no else hit

    return reduce(Column.__and__, [one(*x) for x in where_clauses(where)], F.lit(True))


def substitute(template: str, captures: dict[str, str], marks: bool = True) -> str:
    """`$$$NAME` and `$NAME` (or `@name`) by capture texts, longer names first, one after the other."""
    for name in sorted(captures, key=len, reverse=True):
        if marks:
            template = template.replace(f"$$${name}", captures[name]).replace(f"${name}", captures[name])
        else:
            template = re.sub(rf"@{re.escape(name)}(?![A-Za-z0-9_.\-])", lambda _, n=name: captures[n], template)
    return template


def substitute_column(template: Column, names: list[str], captures: Column) -> Column:
    for name in sorted(names, key=len, reverse=True):
        text = F.coalesce(F.try_element_at(captures, F.lit(name)), F.lit(""))
        for mark in (f"$$${name}", f"${name}"):
            template = F.replace(template, F.lit(mark), text)
    return template
