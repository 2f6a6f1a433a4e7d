"""Patterns in a language's own syntax as tree queries, their matches, and replacements."""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..grammar.samples import parser
from ..partitions import Once, spread
from ..query.compiler import Query, compile_query
from ..query.matcher import run
from ..tree import Node, Tree
from .statement import GrepError, MetaVariable, Statement, compile_where, parse_statement, preprocess, substitute


@dataclass
class CompiledPattern:
    lang: str
    sexpr: str
    query: Query
    variables: dict[str, MetaVariable]


@dataclass
class Result:
    start: int
    end: int
    captures: dict[str, tuple[int, int, str]] = field(default_factory=dict)

    def texts(self) -> dict[str, str]:
        return {k: v[2] for k, v in self.captures.items()}


def _interesting(tree: Tree) -> Node:
    """The node that a pattern is about: past single-child roots and statement wrappers."""
    node = tree.root
    while node.parent is None or node.type == "expression_statement":
        inner = [c for c in node.children if c.named and not c.missing]
        if len(inner) != 1:
            break
        node = inner[0]
    return node


class _Translator:
    def __init__(self, tree: Tree, variables: dict[str, MetaVariable]):
        self.tree, self.variables, self.literals, self.predicates = tree, variables, 0, []

    def sole(self, node: Node) -> MetaVariable | None:
        """The metavariable that is all of a node's named content."""
        while True:
            if not node.children:
                return self.variables.get(self.tree.text(node))
            named = node.named_children()
            if len(named) != 1:
                return None
            node = named[0]

    def step(self, node: Node) -> str:
        v = self.variables.get(self.tree.text(node)) if not node.children else None
        if v is None and node.children and (inner := self.sole(node)) and inner.many:
            v = inner
        if v is not None:
            kind = f"({v.type})" if v.type else "(_)" if not (v.many and node.children) else f"({node.type})"
            return kind if v.wildcard else f"{kind} @{v.name}"
        if not node.children:
            name = f"_lit_{self.literals}"
            self.literals += 1
            text = self.tree.text(node).replace("\\", "\\\\").replace('"', '\\"')
            self.predicates.append(f'(#eq? @{name} "{text}")')
            return f"({node.type}) @{name}"
        parts = []
        for c in node.children:
            if c.named and not c.extra:
                parts.append((f"{c.field}: " if c.field else "") + self.step(c))
            elif not c.named and c.field:
                parts.append(f'{c.field}: "{c.type}"')
        return f"({node.type}{''.join(' ' + p for p in parts)})"


def compile_pattern(lang: str, pattern: str) -> CompiledPattern:
    """A code pattern as a query; it is tried as it stands and as a statement."""
    text, variables = preprocess(pattern)
    p = parser(lang)
    for attempt in (text, text + ";"):
        tree = p.parse(attempt.encode())
        if not tree.root.has_error:
            break
    else:
        raise GrepError(f"{pattern!r} doesn't parse as {lang}")
    t = _Translator(tree, variables)
    body = t.step(_interesting(tree))
    sexpr = f"({body} {' '.join(t.predicates)})" if t.predicates else body
    return CompiledPattern(lang, sexpr, compile_query(sexpr), variables)


def results(tree: Tree, query: Query) -> list[Result]:
    """Matches with the span of all their captures; of captures of one name the last counts, and those of literals are hidden."""
    out = []
    for m in run(query, tree):
        r = Result(min((c.node.start for c in m.captures), default=0), max((c.node.end for c in m.captures), default=0))
        for c in m.captures:
            if not c.name.startswith("_lit_"):
                r.captures[c.name] = c.node.start, c.node.end, c.override or tree.text(c.node)
        out.append(r)
    return out


def match_root(tree: Tree, start: int, end: int) -> Node:
    """The smallest node that encloses a span, the outermost of equals."""
    best = tree.root
    for n in tree.nodes:
        if n.start <= start and n.end >= end and n.end - n.start < best.end - best.start:
            best = n
    return best


def compute_edits(tree: Tree, found: list[Result], template: str, marks: bool = True) -> tuple[list[tuple[int, int, str]], list[str]]:
    """Edits (start, end, text) of the nodes around matches, and notes on those left out since they overlap an earlier one."""
    spans = []
    for r in found:
        root = match_root(tree, r.start, r.end)
        spans.append((root.start, root.end, substitute(template, r.texts(), marks)))
    edits, notes, reached = [], [], -1
    for start, end, text in sorted(spans, key=lambda x: (x[0], -x[1])):
        if start < reached:
            notes.append(f"edit at {start} overlaps an earlier one and was left out")
            continue
        edits.append((start, end, text))
        reached = end
    return edits, notes


def apply(source: bytes, edits: list[tuple[int, int, str]]) -> bytes:
    for start, end, text in sorted(edits, reverse=True):
        if start <= end:
            source = source[:start] + text.encode() + source[min(end, len(source)) :]
    return source


def error_count(tree: Tree) -> int:
    """Errors that aren't inside others."""
    count, stack = 0, [tree.root]
    while stack:
        n = stack.pop()
        if n.error:
            count += 1
        else:
            stack.extend(n.children)
    return count


def replace(lang: str, pattern: str, template: str, source: bytes) -> tuple[bytes, list[str]]:
    """The source with all matches replaced, and notes; a result with more errors than before is noted too."""
    compiled = compile_pattern(lang, pattern)
    tree = parser(lang).parse(source)
    edits, notes = compute_edits(tree, results(tree, compiled.query), template)
    new = apply(source, edits)
    if error_count(parser(lang).parse(new)) > error_count(tree):
        notes.append("the result has more syntax errors than the source")
    return new, notes


_RESULT = "doc_id bigint, match_seq int, start_byte int, end_byte int, captures map<string,string>"
_ARROW = pa.schema([("doc_id", pa.int64()), ("match_seq", pa.int32()), ("start_byte", pa.int32()), ("end_byte", pa.int32()), ("captures", pa.map_(pa.string(), pa.string()))])


def _prepared(statement: str | Statement, lang: str = "") -> tuple[Statement, str, Query]:
    s = parse_statement(statement) if isinstance(statement, str) else statement
    if s.lang == "sexp":
        if not lang:
            raise GrepError("an S-expression needs a language")
        return s, lang, compile_query(s.pattern)
    if not (s.lang or lang):
        raise GrepError("a statement needs a language")
    return s, s.lang or lang, compile_pattern(s.lang or lang, s.pattern).query


def grep(docs: DataFrame, statement: str, lang: str = "", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Matches (doc_id, match_seq, start_byte, end_byte, captures) of a statement that hold its where block. The statement is compiled once, on the driver."""
    s, language, query = _prepared(statement, lang)
    holds = compile_where(s.where)

    def search(batches):
        def find(text: bytes) -> list[tuple]:
            found = [r for r in results(parser(language).parse(text), query) if holds(r.texts())]
            return [(i, r.start, r.end, list(r.texts().items())) for i, r in enumerate(found)]

        once = Once(find, len)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text:
                    rows.extend((doc, *row) for row in once(text.encode()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)

    return spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))).mapInArrow(search, _RESULT)


def grep_replace(docs: DataFrame, statement: str, lang: str = "", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_edits, notes): every text after a statement with a replace block."""
    s, language, query = _prepared(statement, lang)
    holds = compile_where(s.where)

    def rewrite(batches):
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    rows.append((doc, text, 0, []))
                    continue
                source = text.encode()
                tree = parser(language).parse(source)
                edits, notes = compute_edits(tree, [r for r in results(tree, query) if holds(r.texts())], s.replace)
                rows.append((doc, apply(source, edits).decode("utf-8", "replace"), len(edits), notes))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int32(), pa.list_(pa.string())))], names=["doc_id", "text", "n_edits", "notes"])

    return spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))).mapInArrow(rewrite, "doc_id bigint, text string, n_edits int, notes array<string>")

