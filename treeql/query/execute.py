"""Queries over `nodes` or over source texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..grammar.samples import parser
from ..partitions import Once, spread
from ..tree import Tree, collected_by_hand, from_columns
from .compiler import Query, compile_query
from .matcher import run
from .relational import definite, query_matches

CAPTURES = "array<struct<name:string,node_id:int,start_byte:int,end_byte:int,text:string>>"
MATCHES = f"doc_id bigint, match_seq int, pattern_index int, root_id int, captures {CAPTURES}"
_CAPTURE = pa.struct([("name", pa.string()), ("node_id", pa.int32()), ("start_byte", pa.int32()), ("end_byte", pa.int32()), ("text", pa.string())])
_ARROW = pa.schema([("doc_id", pa.int64()), ("match_seq", pa.int32()), ("pattern_index", pa.int32()), ("root_id", pa.int32()), ("captures", pa.list_(_CAPTURE))])
_USED = ("doc_id", "node_id", "parent_id", "type", "is_named", "is_error", "is_missing", "field", "start_byte", "end_byte", "text")


def match_rows(doc_id: int, tree: Tree, query: Query, **options) -> list[tuple]:
    """Rows of `MATCHES`, a capture as a tuple."""
    out = []
    for seq, m in enumerate(run(query, tree, **options)):
        captures = [(c.name, c.node.id, c.node.start, c.node.end, c.override or tree.text(c.node)) for c in m.captures]
        first = m.captures[0].node.id if m.captures else 0
        out.append((doc_id, seq, m.pattern, first, captures))
    return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    *plain, captures = zip(*rows)
    flat = [c for held in captures for c in held]
    parts = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*flat) if flat else [()] * len(_CAPTURE), _CAPTURE)], fields=list(_CAPTURE))
    listed = pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, captures))], pa.int32()), parts)
    return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(plain, _ARROW.types)), listed.cast(_ARROW.field("captures").type)], schema=_ARROW)


def _weight(rows: list[tuple]) -> int:
    """How much of a task's memory rows of matches take, in rows of one capture."""
    return sum(max(1, len(row[4])) for row in rows)


def by_document(batches) -> Iterator[tuple[int, list[dict]]]:
    """(doc_id, rows) of sorted batches; holds one document at a time."""
    doc, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["doc_id"] != doc and held:
                yield doc, held
                held = []
            doc = row["doc_id"]
            held.append(row)
    if held:
        yield doc, held


def columns_by_document(batches) -> Iterator[tuple[int, list[list]]]:
    """(doc_id, the other columns as lists) of batches sorted by their first column, doc_id; holds one document and one batch at a time."""
    doc, held = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        docs = batch.column(0).to_numpy(zero_copy_only=False)
        columns = [batch.column(k).to_pylist() for k in range(1, batch.num_columns)]
        edges = [0, *(np.flatnonzero(docs[1:] != docs[:-1]) + 1).tolist(), len(docs)]
        for a, b in zip(edges, edges[1:]):
            part = [c[a:b] for c in columns]
            if held is not None and docs[a] == doc:
                for have, more in zip(held, part):
                    have += more
            else:
                if held is not None:
                    yield doc, held
                doc, held = int(docs[a]), part
    if held is not None:
        yield doc, held


def run_query(nodes: DataFrame, query: str | Query, **options) -> DataFrame:
    """Matches (doc_id, match_seq, pattern_index, root_id, captures) of any query, document by document.

    Columns that matching doesn't need are dropped before the shuffle by document.
    """
    query = compile_query(query) if isinstance(query, str) else query

    def match(batches):
        rows = []
        with collected_by_hand() as tell:
            for doc, columns in columns_by_document(batches):
                rows.extend(match_rows(doc, from_columns(*columns), query, **options))
                tell(len(columns[0]))
                if len(rows) > 20_000:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    # by a hash of its own: Spark may drop an exchange by the bare key above a union that seems to have that partitioning, and then read the union's
    # inputs as they lie
    return nodes.select(*_USED).repartition(F.xxhash64("doc_id")).sortWithinPartitions("doc_id", "node_id").mapInArrow(match, MATCHES)


def query_sources(docs: DataFrame, lang: str | Callable[[bytes], Tree], query: str | Query, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Parse and match in one pass over texts, without a shuffle and without materialising trees: the way to run one query over many sources."""
    query = compile_query(query) if isinstance(query, str) else query

    def match(batches):
        parse = parser(lang).parse if isinstance(lang, str) else lang

        def found(text: bytes) -> list[tuple]:
            tree = parse(text)
            rows = match_rows(0, tree, query, **options)
            tell(len(tree.nodes))
            return rows

        once = Once(found, _weight)
        with collected_by_hand() as tell:
            for batch in batches:
                rows = []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if text:
                        rows.extend((doc, *row[1:]) for row in once(text.encode() if isinstance(text, str) else text))
                    if len(rows) > 20_000:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    return spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col)).mapInArrow(match, MATCHES)


#: Queries of more patterns go document by document: each pattern as joins would read `nodes` anew.
JOINED_PATTERNS = 4


def execute(nodes: DataFrame, query: str | Query) -> DataFrame:
    """Definite queries as joins, others by document: rows (doc_id, match_seq, pattern_index, root_id, captures)."""
    query = compile_query(query) if isinstance(query, str) else query
    if len(query.patterns) > JOINED_PATTERNS or not all(definite(p) for p in query.patterns):
        return run_query(nodes, query)
    found = query_matches(nodes, query)
    order = Window.partitionBy("doc_id").orderBy("root_id", "pattern_index", "order")
    return found.select("doc_id", (F.row_number().over(order) - 1).alias("match_seq"), "pattern_index", "root_id", "captures")


def limited(matches: DataFrame, n: int) -> DataFrame:
    """The first `n` matches of each document, with `exceeded`: whether there were more."""
    counted = matches.withColumn("exceeded", F.max("match_seq").over(Window.partitionBy("doc_id")) >= n)
    return counted.where(F.col("match_seq") < n)


def capture_rows(matches: DataFrame) -> DataFrame:
    """One row for each capture, in order: (doc_id, match_seq, pattern_index, capture_seq, name, node_id, start_byte, end_byte, text)."""
    return matches.select("doc_id", "match_seq", "pattern_index", F.posexplode("captures").alias("capture_seq", "c")).select("doc_id", "match_seq", "pattern_index", "capture_seq", "c.*")


def typed(matches: DataFrame, query: str | Query, pattern: int = 0) -> DataFrame:
    """Matches of one pattern with a column for each of its captures: (node_id, start_byte, end_byte, text), or an array of them where the
    capture may hold several nodes."""
    query = compile_query(query) if isinstance(query, str) else query
    rows = matches.where(F.col("pattern_index") == pattern)

    def column(name: str, many: bool):
        own = F.transform(F.filter("captures", lambda c: c["name"] == name), lambda c: c.dropFields("name"))
        return (own if many else F.try_element_at(own, F.lit(1))).alias(name)

    return rows.select("doc_id", "match_seq", *[column(n, many) for n, many in query.quantified_captures(pattern).items()])


def byte_range_for_points(tree: Tree, start: tuple[int, int], end: tuple[int, int]) -> tuple[int, int]:
    """The byte range between two points (row, column), for `run_query`."""
    lines = tree.line_starts()
    at = lambda p: min(lines[p[0]] + p[1], len(tree.source)) if p[0] < len(lines) else len(tree.source)
    return at(start), at(end)


def in_utf16_range(source: bytes, start: int, end: int) -> tuple[int, int] | None:
    """The byte range of UTF-16 units of a text, for `run_query`; None if it cuts a character in two or leaves the text."""
    units = source.decode().encode("utf-16-le")
    if not 0 <= start <= end <= len(units) // 2:
        return None
    try:
        first = len(units[: start * 2].decode("utf-16-le").encode())
        return first, first + len(units[start * 2 : end * 2].decode("utf-16-le").encode())
    except UnicodeDecodeError:
        return None
