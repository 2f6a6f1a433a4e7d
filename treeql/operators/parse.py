"""Texts to `nodes`."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..grammar.artifact import load_language
from ..grammar.parser import Parser, TokenSource
from ..grammar.samples import parser
from ..grammar.sources import TOKEN_SOURCES, listed_tokens
from ..partitions import Once, shuffled, spread
from ..tree import ARROW, DDL, Tree, record_batch
from .spans import byte_for_utf16


def parse(docs: DataFrame, lang: str | Callable[[bytes], Tree], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The `nodes` of every text; empty and null texts give none.

    Only the two columns reach Python, in Arrow batches; each worker compiles a grammar once, and each task parses equal texts once.
    """

    def run(batches):
        read = parser(lang).parse if isinstance(lang, str) else lang
        once = Once(lambda text: read(text).rows(None), len)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text:
                    rows.extend((doc, *row[1:]) for row in once(text.encode() if isinstance(text, str) else text))
                if len(rows) > 50_000:
                    yield record_batch(rows)
                    rows = []
            if rows:
                yield record_batch(rows, ARROW)

    return spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))).mapInArrow(run, DDL)


def parse_utf16(docs: DataFrame, lang: str, order: str = "LE", id_col: str = "doc_id", content_col: str = "content") -> DataFrame:
    """As `parse` for binary UTF-16 texts; a text of odd length is an error."""
    content = F.when(F.octet_length(content_col) % 2 == 0, F.decode(F.col(content_col), f"UTF-16{order}")).otherwise(F.raise_error(F.lit("UTF-16 text of odd length")))
    return parse(docs.select(id_col, content.alias("text")), lang, id_col, "text")


def parse_ranges(docs: DataFrame, lang: str, id_col: str = "doc_id", text_col: str = "text", ranges_col: str = "ranges") -> DataFrame:
    """As `parse`, reading only the byte ranges (array of (s, e)) of each text."""

    def run(batches):
        once = Once(lambda at: parser(lang).parse(at[0], ranges=at[1]).rows(None), len)
        for batch in batches:
            rows = []
            for doc, text, ranges in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if text:
                    rows.extend((doc, *row[1:]) for row in once((text.encode(), tuple((r["s"], r["e"]) for r in ranges or []))))
                if len(rows) > 50_000:
                    yield record_batch(rows)
                    rows = []
            if rows:
                yield record_batch(rows, ARROW)

    return spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(ranges_col).alias("ranges"))).mapInArrow(run, DDL)


def parse_tokens(docs: DataFrame, lang: str, tokens: str | TokenSource, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As `parse`, with the tokens of a source, or of one registered under a name, in place of the grammar's own."""
    source = TOKEN_SOURCES[tokens] if isinstance(tokens, str) else tokens
    return parse(docs, lambda text: parser(lang).parse(text, tokens=source), id_col, text_col)


def parse_listed(docs: DataFrame, lang: str, id_col: str = "doc_id", text_col: str = "text", tokens_col: str = "tokens") -> DataFrame:
    """As `parse`, with each text's tokens in a column: array of (name, s, e) in bytes; null counts as no tokens."""

    def run(batches):
        for batch in batches:
            rows = []
            for doc, text, tokens in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if text:
                    rows.extend(parser(lang).parse(text.encode(), tokens=listed_tokens((t["name"], t["s"], t["e"]) for t in tokens or [])).rows(doc))
                if len(rows) > 50_000:
                    yield record_batch(rows)
                    rows = []
            if rows:
                yield record_batch(rows, ARROW)

    return spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(tokens_col).alias("tokens"))).mapInArrow(run, DDL)


def parse_with(docs: DataFrame, language: bytes, scanner=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As `parse`, in a language that `dump_language` saved: its bytes travel with the task, and each task loads the tables once."""
    made: list[Parser] = []

    def read(text: bytes):
        if not made:
            made.append(Parser(load_language(language, scanner)))
        return made[0].parse(text)

    return parse(docs, read, id_col, text_col)


def parse_ranges_utf16(docs: DataFrame, lang: str, id_col: str = "doc_id", text_col: str = "text", ranges_col: str = "ranges") -> DataFrame:
    """As `parse_ranges`, with ranges in UTF-16 units; one that cuts a character in two is left out."""
    at = lambda r, edge: byte_for_utf16(F.col(text_col), r[edge])
    moved = F.transform(ranges_col, lambda r: F.struct(at(r, "s").cast("int").alias("s"), at(r, "e").cast("int").alias("e")))
    return parse_ranges(docs.withColumn("__ranges", F.filter(moved, lambda r: r["s"].isNotNull() & r["e"].isNotNull())), lang, id_col, text_col, "__ranges")


def parse_runtime(docs: DataFrame, lang: str, id_col: str = "doc_id", text_col: str = "text", seconds: float | None = None, max_nodes: int | None = None, max_depth: int | None = None) -> DataFrame:
    """(doc_id, stop_reason, n_nodes, n_errors, n_bytes): how each parse ended, under limits if given."""

    def ended(source: bytes) -> tuple:
        tree = parser(lang).parse(source, seconds=seconds, max_nodes=max_nodes, max_depth=max_depth)
        return tree.stop_reason, len(tree.nodes), sum(n.error or n.missing for n in tree.nodes), len(source)

    def run(batches):
        # how a parse ends under a limit of time is not the text's alone
        once = Once(ended) if seconds is None else ended
        for batch in batches:
            out = [(doc, *once((text or "").encode())) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "stop_reason", "n_nodes", "n_errors", "n_bytes"])

    return spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))).mapInArrow(run, "doc_id bigint, stop_reason string, n_nodes bigint, n_errors bigint, n_bytes bigint")


def update_rows(old_rows: DataFrame, old: DataFrame, new: DataFrame, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`run` of the texts `new` (doc_id, text), given its rows for those of `old`: it only sees texts that differ, the others keep their rows. For trees, matches, highlights and tags alike."""
    digest = lambda df, name: df.select("doc_id", F.sha2("text", 256).alias(name))
    same = digest(old, "a").join(shuffled(digest(new, "b")), "doc_id").where("a = b").select("doc_id")
    # hashed, so that rows and texts pass by without being sorted
    same = same.hint("shuffle_hash")
    return old_rows.join(same, "doc_id", "left_semi").unionByName(run(new.join(same, "doc_id", "left_anti")))


def update_nodes(old_nodes: DataFrame, old: DataFrame, new: DataFrame, lang: str) -> DataFrame:
    """`nodes` of the texts `new` (doc_id, text), given those of `old`: only texts that differ are parsed, the others keep their nodes."""
    return update_rows(old_nodes, old, new, lambda texts: parse(texts, lang))
