import pytest
from pyspark.sql import functions as F

from treeql.grep import statement as st
from treeql.grep.search import compile_pattern, grep, replace, results
from treeql.grammar.samples import parser
from treeql.operators import code, edits, imports, spans
from treeql.operators import navigation as nav
from treeql.operators.parse import parse, parse_utf16
from treeql.query.execute import execute, query_sources, run_query
from treeql.tree import from_rows

LOX = 'import "m" as q;\nfun myFunc(x, y) { print g(x); } // note\nvar v = myFunc(1, 2);\nclass A { run(a) { return a; } }\n'


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


@pytest.fixture(scope="module")
def nodes(spark):
    return parse(spark.createDataFrame([(1, LOX), (2, ""), (3, None), (4, "var x = ;")], "doc_id long, text string"), "lox").cache()


def test_nodes(nodes):
    assert {r.doc_id for r in nodes.select("doc_id").distinct().collect()} == {1, 4}
    held = [r.asDict() for r in nodes.where("doc_id = 1").collect()]
    tree = parser("lox").parse(LOX.encode())
    assert from_rows(held).root.sexpr() == tree.root.sexpr() == nav.sexprs(nodes.where("doc_id = 1")).first().sexpr
    assert nav.count_errors(nodes).where("doc_id = 1").count() == 0
    assert nav.syntax_errors(nodes).first().message.startswith("1:")
    assert nav.dot(nodes).first().dot.startswith("digraph")


def test_lookups(spark, nodes):
    ranges = spark.createDataFrame([(1, 0, LOX.index("g(x)"), LOX.index("g(x)") + 1), (1, 1, LOX.index("g(x)"), LOX.index("g(x)") + 4)], "doc_id long, range_id int, s int, e int")
    assert [t[3] for t in rows(nav.smallest_containing(nodes, ranges), "range_id")] == ["identifier", "call_expression"]
    assert [t[3] for t in rows(nav.match_root(nodes, ranges), "range_id")] == ["identifier", "call_expression"]


@pytest.mark.parametrize("pattern", ["(call_expression function: (identifier) @f arguments: (arguments . (_) @first))", '(function_declaration name: (identifier) @n (#match? @n "^my"))', "(class_declaration !superclass) @c", "(block (_) @x .)", '"fun" @k', "((identifier) @i (#not-has-parent? @i parameters))", "((parameters (identifier) @a . (identifier) @b) (#not-eq? @a @b))"])
def test_joins_equal_the_matcher(spark, nodes, pattern):
    shape = lambda df: sorted((r.doc_id, r.match_seq, [(c.name, c.start_byte, c.end_byte) for c in r.captures]) for r in df.collect())
    docs = spark.createDataFrame([(1, LOX), (4, "var x = ;")], "doc_id long, text string")
    assert shape(execute(nodes, pattern)) == shape(run_query(nodes, pattern)) == shape(query_sources(docs, "lox", pattern))


def test_coalesce(spark):
    r = spark.createDataFrame([(1, 0, 3), (1, 3, 5), (1, 7, 9), (1, 8, 8), (1, 8, 20), (2, 1, 1)], "doc_id long, s int, e int")
    assert rows(spans.coalesce_ranges(r), "doc_id", "s") == [(1, 0, 5), (1, 7, 20)]


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ([(0, 20, "function"), (5, 9, "keyword")], [(0, 5, "function"), (5, 9, "keyword"), (9, 20, "function")]),
        ([(0, 30, "function"), (5, 25, "type"), (10, 15, "keyword")], [(0, 5, "function"), (5, 10, "type"), (10, 15, "keyword"), (15, 25, "type"), (25, 30, "function")]),
        ([(0, 20, "function"), (0, 5, "keyword")], [(0, 5, "keyword"), (5, 20, "function")]),
        ([(0, 10, "outer"), (0, 10, "inner")], [(0, 10, "inner")]),
    ],
)
def test_highlight_overlaps(spark, given, want):
    df = spark.createDataFrame([(1, s, e, c, i, i) for i, (s, e, c) in enumerate(given)], "doc_id long, start_byte int, end_byte int, capture string, pattern_index int, seq int")
    assert [(r.start_byte, r.end_byte, r.capture) for r in spans.resolve_highlights(df).orderBy("start_byte").collect()] == want


def test_utf16(spark):
    text = "aß😀b"
    df = spark.createDataFrame([(text, b) for b in range(-1, 10)], "text string, b int")
    got = [r[0] for r in df.select(spans.utf16_for_byte(F.col("text"), F.col("b"))).collect()]
    want = [None] + [len(text.encode()[:b].decode().encode("utf-16-le")) // 2 if b in (0, 1, 3, 7, 8) else None for b in range(9)] + [None]
    assert got == want
    back = [r[0] for r in df.select(spans.byte_for_utf16(F.col("text"), F.col("b"))).collect()]
    assert back == [None, 0, 1, 3, None, 7, 8, None, None, None, None]
    docs = spark.createDataFrame([(1, bytearray("[1]".encode("utf-16-le")))], "doc_id long, content binary")
    assert parse_utf16(docs, "json").where("type = 'number'").count() == 1


def test_rewrite(spark):
    src = spark.createDataFrame([(1, "a\nb\nc\n"), (2, "é")], "doc_id long, text string")
    made = spark.createDataFrame([(1, 0, 1, "A\nA"), (1, 4, 5, "C")], "doc_id long, start_byte int, end_byte int, new_text string")
    texts, coords = edits.rewrite(src, made)
    assert rows(texts, "doc_id") == [(1, "A\nA\nb\nC\n"), (2, "é")]
    last = coords.orderBy("edit_seq").collect()[-1]
    assert (last.start_byte, last.old_end_byte, last.new_end_byte) == (6, 7, 7)
    assert (last.start_row, last.start_col, last.old_end_row, last.old_end_col) == (3, 0, 3, 1)
    for bad in ([(1, 0, 3, ""), (1, 2, 4, "")], [(1, 1, 1, "x"), (1, 1, 1, "y")]):
        with pytest.raises(Exception, match="overlap"):
            edits.rewrite(src, spark.createDataFrame(bad, "doc_id long, start_byte int, end_byte int, new_text string"))[0].collect()
    listed = src.select(edits.apply_edits(F.col("text"), F.expr("array(named_struct('start_byte', 0, 'end_byte', 99, 'new_text', 'z'), named_struct('start_byte', 5, 'end_byte', 2, 'new_text', 'no'))")))
    assert [r[0] for r in listed.collect()] == ["z", "z"]


def test_diff(spark, nodes):
    new = parse(spark.createDataFrame([(1, LOX.replace("g(x)", "g(z)"))], "doc_id long, text string"), "lox")
    at = LOX.index("g(x)") + 2
    assert rows(edits.diff_trees(nodes.where("doc_id = 1"), new), "s") == [(1, at, at + 1)]
    assert edits.diff_trees(nodes, nodes).count() == 0


def test_tags_and_highlights(spark):
    docs = spark.createDataFrame([(1, LOX)], "doc_id long, text string")
    from treeql.grammar.samples import language, lox_grammar

    found = code.tags(query_sources(docs, "lox", code.infer_tags_query(language("lox"))))
    assert {(r.kind, r.name) for r in found.collect()} == {("definition.function", "myFunc"), ("definition.variable", "v"), ("definition.class", "A"), ("definition.method", "run"), ("reference.call", "g"), ("reference.call", "myFunc")}
    flat = code.highlight(query_sources(docs, "lox", code.infer_highlight_query(lox_grammar()))).orderBy("start_byte").collect()
    assert LOX[flat[0].start_byte : flat[0].end_byte] == "import" and flat[0].capture == "keyword"
    assert all(a.end_byte <= b.start_byte for a, b in zip(flat, flat[1:]))


def test_injections(spark):
    docs = spark.createDataFrame([(1, '{"lang": "calc", "code": "1+2"}')], "doc_id long, text string")
    regions = code.injection_query(docs, "json", '((pair key: (string (string_content) @k) value: (string (string_content) @injection.content)) (#eq? @k "code") (#set! injection.language "calc"))')
    (r,) = regions.collect()
    assert (r.language, r.text) == ("calc", "1+2")
    inner = code.parse_injections(regions, ("calc",))
    assert {(n.start_byte, n.end_byte) for n in inner.where("type = 'number'").collect()} == {(26, 27), (28, 29)}
    hints = spark.createDataFrame([("{.go}",), ("language-js x",), ("Python",)], "t string").select(code.injection_hint(F.col("t"))).collect()
    assert [h[0] for h in hints] == ["go", "js", "python"]


def test_diagnostics(spark):
    df = spark.createDataFrame([("ab\ncd", "E1", "error", 2, 2, "bad", "fix it")], "s string, c string, v string, l int, k int, m string, h string")
    assert df.select(code.render_diagnostic(*[F.col(x) for x in "scvlkmh"])).first()[0] == "E1 error: 2:2 bad\n  cd\n   ^\n  hint: fix it"


PY = b'"""import no"""\nimport os, a.b as c\nfrom . import x\nfrom ..p import (q as r,\n  s)\nfrom m import *\n# import not\n'


def test_imports(spark):
    assert [r[:8] for r in imports.python_imports(PY)] == [
        ("import", "os", "", "os", "", False, False, 0), ("import", "a.b", "", "b", "c", False, False, 0), ("from", "x", "", "x", "", False, False, 1),
        ("from", "p.q", "p", "q", "r", False, False, 2), ("from", "p.s", "p", "s", "", False, False, 2), ("from", "m", "m", "*", "", False, True, 0),
    ]
    java = list(imports.java_imports(b"package a.b; /* import x.Y; */ import static a.b.C.*; import java.util.List;"))
    assert [(r[1], r[3], r[5], r[6]) for r in java] == [("a.b", "a.b", False, False), ("a.b.C", "*", True, True), ("java.util.List", "List", False, False)]
    go = list(imports.go_imports(b'package main\nimport (\n "fmt" // "no"\n x "a/b"\n . "c"\n)\n'))
    assert [(r[1], r[4]) for r in go] == [("main", ""), ("fmt", ""), ("a/b", "x"), ("c", ".")]
    assert imports.status("starlark", b'load(x, "y")') == ("fallback", "load of something other than a literal")
    docs = spark.createDataFrame([(1, "python", PY.decode()), (2, "cobol", "x"), (3, "go", None)], "doc_id long, lang string, text string")
    assert imports.extract_imports(docs).count() == 6


def test_statements():
    s = st.parse_statement('find lox::f($X) where { contains($X, "a") } replace { g($X, {}) }')
    assert (s.lang, s.pattern, s.where, s.replace) == ("lox", "f($X)", 'contains($X, "a")', "g($X, {})")
    assert st.parse_statement("f(1)").pattern == "f(1)" and st.parse_statement("a::b").lang == "a"
    for bad in ("", "x replace { a } where { b }", "x where { a"):
        with pytest.raises(st.GrepError):
            st.parse_statement(bad)
    text, found = st.preprocess("f($A, $_, $$$REST, $T:number, $A) $$$")
    assert text.endswith(" $$$") and len(found) == 4 and sum(v.many for v in found.values()) == 1
    holds = st.compile_where('contains($NAME, "Test")')
    assert holds({"NAME": "TestFunction"}) and not holds({"NAME": "myFunction"}) and st.compile_where("")({})
    assert st.compile_where('not matches($N, "^a"); contains($N, b)')({"N": "cb"})
    assert st.substitute("$NAMES and $NAME", {"NAME": "foo", "NAMES": "bar"}) == "bar and foo"
    assert st.substitute("@func(@args)", {"func": "myFunc", "args": "x, y"}, marks=False) == "myFunc(x, y)"


def test_search(spark):
    tree = parser("lox").parse(LOX.encode())
    assert [r.texts() for r in results(tree, compile_pattern("lox", "$F($$$ARGS)").query)] == [{"F": "g", "ARGS": "(x)"}, {"F": "myFunc", "ARGS": "(1, 2)"}]
    assert [r.texts() for r in results(tree, compile_pattern("lox", "myFunc(1, $N:number)").query)] == [{"N": "2"}]
    new, notes = replace("lox", "g($X)", "log($X)", LOX.encode())
    assert b"print log(x);" in new and not notes
    docs = spark.createDataFrame([(1, LOX), (2, None)], "doc_id long, text string")
    assert [r.captures for r in grep(docs, 'find lox::$F($A, $B) where { matches($F, "^my") }').collect()] == [{"F": "myFunc", "A": "1", "B": "2"}]
    assert grep(docs, "find sexp::(class_declaration) @c", "lox").count() == 1


def test_included_ranges_and_runtime(spark):
    from treeql.operators.parse import parse_ranges, parse_runtime, update_nodes

    docs = spark.createDataFrame([(1, "x [1, 2] y [3]", [(2, 8), (11, 14), (5, 5)])], "doc_id long, text string, ranges array<struct<s:int,e:int>>")
    found = parse_ranges(docs, "json")
    assert rows(found.where("type = 'number'").select("start_byte", "text"), "start_byte") == [(3, "1"), (6, "2"), (12, "3")]
    assert found.where("is_error or is_missing").count() == 0
    texts = spark.createDataFrame([(1, "[1]"), (2, "[1"), (3, None)], "doc_id long, text string")
    assert [(r.stop_reason, r.n_errors > 0) for r in parse_runtime(texts, "json").orderBy("doc_id").collect()] == [("accepted", False), ("accepted", True), ("accepted", False)]
    assert parser("json").parse(b"[1," * 2000, seconds=0.0).stop_reason == "timeout"
    new = spark.createDataFrame([(1, "[1]"), (2, "[1, 2]"), (4, "7")], "doc_id long, text string")
    assert rows(update_nodes(parse(texts, "json"), texts, new, "json"), "doc_id", "node_id") == rows(parse(new, "json"), "doc_id", "node_id")


def test_typed_and_disabled(spark, nodes):
    from treeql.query.compiler import compile_query
    from treeql.query.execute import typed

    q = compile_query("(function_declaration name: (identifier) @name parameters: (parameters (identifier)* @ps))")
    (r,) = typed(run_query(nodes, q), q).collect()
    assert r.name.text == "myFunc" and [p.text for p in r.ps] == ["x"]  # a comma ends the run
    assert q.quantified_captures(0) == {"name": False, "ps": True} and not q.pattern_info()[0]["is_definite"]
    assert [c.name for c in run_query(nodes, q.without_capture("ps")).first().captures] == ["name"]
    assert run_query(nodes, q.without_pattern(0)).count() == 0


def test_shifted_spans(spark):
    made = spark.createDataFrame([(1, 0, 0, 10), (1, 1, 2, 4), (1, 2, 5, 9)], "doc_id long, node_id int, start_byte int, end_byte int")
    edit = spark.createDataFrame([(1, 3, 4, 6)], "doc_id long, start_byte int, old_end_byte int, new_end_byte int")
    got = edits.shift_nodes(made, edit).orderBy("node_id").collect()
    assert [(r.start_byte, r.end_byte, r.dirty) for r in got] == [(0, 12, True), (2, 6, True), (7, 11, False)]
    assert rows(edits.changed_ranges(edit), "s") == [(1, 3, 6)]


def test_smaller_operators(spark, nodes):
    from treeql.sources.languages import conflicts, next_symbols

    found = nav.child_by_type(nodes.where("doc_id = 1"), "parameters").collect()
    assert sorted((r.line, r.column) for r in found) == [(2, 11), (4, 14)]
    texts = spark.createDataFrame([(1, "a😀b")], "doc_id long, text string")
    units = spark.createDataFrame([(1, 1, 3), (1, 2, 3)], "doc_id long, start_unit int, end_unit int")
    assert [(r.start_byte, r.end_byte) for r in spans.from_utf16_ranges(units, texts).collect()] == [(1, 5)]
    edit = spark.createDataFrame([(1, 1, 3, 2)], "doc_id long, start_unit int, old_end_unit int, new_end_unit int")
    new = spark.createDataFrame([(1, "aéb")], "doc_id long, text string")
    assert [tuple(r)[-3:] for r in spans.edits_from_utf16(edit, texts, new).collect()] == [(1, 5, 3)]
    region = "doc_id long, language string, start_byte int, end_byte int"
    old = spark.createDataFrame([(1, "js", 0, 5), (1, "js", 9, 12)], region)
    kept = code.reusable_injections(old, old, spark.createDataFrame([(1, 4, 6)], "doc_id long, s int, e int"))
    assert [r.start_byte for r in kept.collect()] == [9]
    assert conflicts(spark, "json").count() == 0 and next_symbols(spark, "calc").where("symbol = 'number'").count() > 0


def test_extension_highlights():
    from treeql.grammar import dsl
    from treeql.grammar.samples import calc_grammar

    more = calc_grammar().extended("more").append_choice("expression", dsl.seq("let", dsl.sym("number")))
    assert code.extension_highlights(calc_grammar(), more) == '"let" @keyword'


def test_a_deep_and_a_wide_document(spark):
    """300,000 nodes in one document: no operator compares them all with each other."""
    import time

    from pyspark.sql import functions as F

    from treeql.operators.edits import diff_trees

    n = 300_000
    wide = spark.range(n).select(
        F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("int").alias("node_id"), F.when(F.col("id") > 0, F.lit(0)).alias("parent_id"), F.greatest(F.col("id") - 1, F.lit(0)).cast("int").alias("child_index"),
        F.when(F.col("id") > 0, 1).otherwise(0).alias("depth"), F.when(F.col("id") > 0, F.col("id")).otherwise(n - 1).cast("int").alias("last_desc"),
        F.when(F.col("id") > 0, F.lit("leaf")).otherwise(F.lit("top")).alias("type"), F.lit(True).alias("is_named"), F.lit(False).alias("is_missing"), (F.col("id") % 3 == 0).alias("is_error"),
        F.when(F.col("id") > 0, 0).otherwise(n - 1).alias("child_count"), (F.col("id") * 2).cast("int").alias("start_byte"), (F.col("id") * 2 + 1).cast("int").alias("end_byte"), F.col("id").cast("string").alias("text"),
    )
    # one chain of nodes, each the only child of the one before
    deep = wide.withColumns({"parent_id": F.expr("nullif(node_id - 1, -1)"), "child_index": F.lit(0), "depth": F.col("node_id"), "last_desc": F.lit(n - 1), "child_count": F.when(F.col("node_id") < n - 1, 1).otherwise(0), "doc_id": F.lit(2).cast("long")})
    both = wide.unionByName(deep)
    began = time.time()
    assert nav.walk(both, skip_below=F.col("node_id") == 5).groupBy("doc_id").count().orderBy("doc_id").collect() == [(1, n), (2, 6)]
    assert nav.ancestor_types(both).groupBy("doc_id").count().orderBy("doc_id").collect() == [(1, n - 1), (2, n - 1)]
    assert {r.doc_id: r.n_errors for r in nav.count_errors(both).collect()} == {1: 1, 2: 1}
    assert {r.doc_id: len(r.sexpr) > n for r in nav.sexprs(wide).collect()} == {1: True}
    changed = both.withColumn("text", F.when(F.col("node_id") % 1000 == 7, F.lit("x")).otherwise(F.col("text")))
    spans = {r.doc_id: r["count"] for r in diff_trees(both, changed).groupBy("doc_id").count().collect()}
    assert spans == {1: 300, 2: 1}
    assert time.time() - began < 120


@pytest.mark.parametrize("named", [False, True])
def test_smallest_containing_equals_a_walk_down(spark, named):
    texts = ['[1, [2, {"a": [3]}], "x"]', '{"k":[[],[[]],""]}', "7"]
    nodes = parse(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "json")
    ranges, want = [], {}
    for doc, text in enumerate(texts):
        tree = parser("json").parse(text.encode())
        for s in range(len(text) + 1):
            for e in range(s, len(text) + 1):
                ranges.append((doc, len(ranges), s, e))
                node, best = tree.root, None
                while node is not None and node.start <= s and node.end >= e:
                    best = node if node.named or not named else best
                    node = next((c for c in reversed(node.children) if c.start <= s and c.end >= e), None)
                if best is not None:
                    want[len(ranges) - 1] = best.id
    got = nav.smallest_containing(nodes, spark.createDataFrame(ranges, "doc_id long, range_id long, s int, e int"), named)
    assert {r.range_id: r.node_id for r in got.collect()} == want
