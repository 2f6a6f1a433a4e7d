"""Languages inside languages: regions that a query of each language finds, parsed in turn, down to a depth.

All of a document's trees are made in one pass over its text, in one task without a shuffle: a region's text is a part of the document's, and each level reads less than the one above.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..grammar.html import parse_html
from ..grammar.samples import GRAMMARS, parser
from ..partitions import spread
from ..query.compiler import Query, compile_query
from ..query.matcher import run
from ..tree import ARROW, DDL, Tree, record_batch
from .spans import flatten

MAX_DEPTH = 10
#: name -> function that parses, or None for a language that isn't known
Resolver = Callable[[str], Callable[[bytes], Tree] | None]


def resolve(name: str) -> Callable[[bytes], Tree] | None:
    """The parser of a language that the engine has."""
    return parser(name).parse if name in GRAMMARS else parse_html if name == "html" else None


@dataclass
class Region:
    language: str
    start: int
    end: int
    level: int  # 0: the document itself
    tree: Tree | None  # of the region's own text; None for an unknown language or at the greatest depth


def detect(tree: Tree, query: Query) -> Iterator[tuple[str, int, int]]:
    """(language, start, end): the last `injection.content` capture of each match, its language set by the pattern or else the trimmed text of the last `injection.language` capture."""
    for m in run(query, tree):
        content = [c.node for c in m.captures if c.name == "injection.content"]
        hints = [c.override or tree.text(c.node) for c in m.captures if c.name == "injection.language"]
        fixed = query.set_values(m.pattern, "injection.language")
        language = fixed[0] if fixed else hints[-1].strip() if hints else ""
        if content and language:
            yield language, content[-1].start, content[-1].end


def regions(source: bytes, lang: str, queries: dict[str, Query], find: Resolver = resolve, max_depth: int = MAX_DEPTH) -> list[Region]:
    """The document and its regions, each before those inside it, in the document's bytes. Regions more than `max_depth` levels down are not looked for."""
    read = find(lang)
    if read is None:
        raise ValueError(f"no grammar of {lang}")
    out, stack = [], [Region(lang, 0, len(source), 0, read(source))]
    while stack:
        at = stack.pop()
        out.append(at)
        if at.tree is None or at.language not in queries or at.level >= max_depth:
            continue
        inner = []
        for language, start, end in detect(at.tree, queries[at.language]):
            read = find(language)
            text = source[at.start + start : at.start + end]
            inner.append(Region(language, at.start + start, at.start + end, at.level + 1, read(text) if read else None))
        stack += reversed(inner)
    return out


def _compiled(queries: dict[str, str]) -> dict[str, Query]:
    return {k: compile_query(q) if isinstance(q, str) else q for k, q in queries.items()}


def _texts(batches) -> Iterator[tuple[int, bytes]]:
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if text:
                yield doc, text.encode()


def embedded_nodes(docs: DataFrame, lang: str, queries: dict[str, str], find: Resolver = resolve, max_depth: int = MAX_DEPTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`nodes` of every document and of the regions in it, all in the document's bytes, rows and columns, with inj_id (0: the document, then in order, each region before those inside it),
    lang and level. A region of an unknown language counts but has no nodes; null and empty texts give none."""
    compiled = _compiled(queries)
    schema = ARROW.append(pa.field("inj_id", pa.int32())).append(pa.field("lang", pa.string())).append(pa.field("level", pa.int32()))

    def move(row: tuple, doc: int, base: int, r: int, c: int) -> tuple:
        shift = lambda k: row[k] + (c if row[k - 1] == 0 else 0)
        return doc, *row[1:14], row[14] + base, row[15] + base, row[16] + r, shift(17), row[18] + r, shift(19), *row[20:]

    def make(batches):
        rows = []
        for doc, source in _texts(batches):
            found = regions(source, lang, compiled, find, max_depth)
            lines = found[0].tree.line_starts()
            for k, x in enumerate(found):
                if x.tree is not None:
                    r = bisect_right(lines, x.start) - 1
                    rows.extend((*move(row, doc, x.start, r, x.start - lines[r]), k, x.language, x.level) for row in x.tree.rows(doc))
                if len(rows) > 50_000:
                    yield record_batch(rows, schema)
                    rows = []
        if rows:
            yield record_batch(rows, schema)

    return spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))).mapInArrow(make, f"{DDL}, inj_id int, lang string, level int")


def embedded_highlights(docs: DataFrame, lang: str, highlights: dict[str, str], queries: dict[str, str], find: Resolver = resolve, max_depth: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start_byte, end_byte, capture, pattern_index) without overlap: highlights of each document and, inside of its regions, those of the regions' own languages, which win where
    both have the same range. Languages without a highlight query give none."""
    marks, compiled = _compiled(highlights), _compiled(queries)
    schema = pa.schema([("doc_id", pa.int64()), ("start_byte", pa.int32()), ("end_byte", pa.int32()), ("capture", pa.string()), ("pattern_index", pa.int32())])
    first, upto = {}, 0  # patterns are numbered on from the document's language to the others
    for name in sorted(marks, key=lambda k: (k != lang, k)):
        first[name], upto = upto, upto + len(marks[name].patterns)

    def make(batches):
        rows = []
        for doc, source in _texts(batches):
            ranges = []
            for x in regions(source, lang, compiled, find, max_depth):
                if x.tree is not None and x.language in marks:
                    for m in run(marks[x.language], x.tree):
                        ranges.extend((x.start + c.node.start, x.start + c.node.end, c.name, first[x.language] + m.pattern, len(ranges)) for c in m.captures)
            rows.extend((doc, s, e, c, 0) for s, e, c in flatten(ranges))
            if len(rows) > 50_000:
                yield record_batch(rows, schema)
                rows = []
        if rows:
            yield record_batch(rows, schema)

    return spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))).mapInArrow(make, "doc_id bigint, start_byte int, end_byte int, capture string, pattern_index int")
