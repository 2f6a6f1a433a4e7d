"""SQL table functions."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..grammar.samples import parser
from ..operators.imports import EXTRACTORS
from ..partitions import Once
from ..query.compiler import compile_query
from ..query.matcher import run
from ..tree import DDL


class ParseNodes:
    """parse_nodes(doc_id, text, lang): a row for each node."""

    def __init__(self):
        self.once = Once(lambda at: parser(at[1]).parse(at[0]).rows(None), len)

    def eval(self, doc_id: int, text: str, lang: str):
        if text:
            for row in self.once((text.encode(), lang)):
                yield doc_id, *row[1:]


class Tokenize:
    """tokenize(text, lang): a row for each leaf of the tree, in order."""

    def __init__(self):
        self.once = Once(self.tokens, len)

    @staticmethod
    def tokens(at: tuple) -> list[tuple]:
        tree = parser(at[1]).parse(at[0])
        return [(i, n.type, n.named, n.start, n.end, tree.text(n)) for i, n in enumerate(n for n in tree.nodes if not n.children)]

    def eval(self, text: str, lang: str):
        if text:
            yield from self.once((text.encode(), lang))


class RunQuery:
    """run_query(text, lang, query): a row for each capture of each match. A task compiles a query once."""

    def __init__(self):
        self.once, self.compiled = Once(self.found, len), lru_cache(64)(compile_query)

    def found(self, at: tuple) -> list[tuple]:
        text, lang, query = at
        tree = parser(lang).parse(text)
        return [(i, m.pattern, k, c.name, c.node.type, c.node.start, c.node.end, c.override or tree.text(c.node)) for i, m in enumerate(run(self.compiled(query), tree)) for k, c in enumerate(m.captures)]

    def eval(self, text: str, lang: str, query: str):
        if text:
            yield from self.once((text.encode(), lang, query))


class ExtractImports:
    """extract_imports(text, lang): a row for each import."""

    def eval(self, text: str, lang: str):
        if text and lang in EXTRACTORS:
            for i, r in enumerate(EXTRACTORS[lang](text.encode())):
                yield i, *r[:5]


def register(spark: SparkSession) -> None:
    """Make the table functions known to SQL, for use as `FROM t, LATERAL parse_nodes(t.id, t.text, 'json')`."""
    spark.udtf.register("parse_nodes", udtf(ParseNodes, returnType=DDL))
    spark.udtf.register("tokenize", udtf(Tokenize, returnType="seq int, type string, is_named boolean, start_byte int, end_byte int, text string"))
    spark.udtf.register("run_query", udtf(RunQuery, returnType="match_seq int, pattern_index int, capture_seq int, capture string, type string, start_byte int, end_byte int, text string"))
    spark.udtf.register("extract_imports", udtf(ExtractImports, returnType="seq int, kind string, path string, from string, name string, alias string"))
