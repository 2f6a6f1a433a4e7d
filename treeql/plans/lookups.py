"""More queries of the catalogue: lookups, coordinates, edits, diagnostics, imports and table functions, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..grammar.html import parse_html
from ..operators import code, edits
from ..operators import navigation as nav
from ..operators import spans as sp
from ..operators.imports import extract_imports
from ..operators.embedded import embedded_highlights, embedded_nodes as nested_nodes
from ..operators.parse import parse, parse_listed, parse_ranges, parse_ranges_utf16, parse_runtime, parse_tokens, parse_utf16, parse_with, update_nodes, update_rows
from ..partitions import shuffled, spread
from ..query.execute import execute, query_sources, typed
from ..sources.languages import detect_by_name, detect_by_shebang, interpreter, support
from .catalogue import query, table

# navigation and diagnostics

query("dot_graph", "SELECT doc_id, 'digraph tree {' || chr(10) || string_agg('  n' || node_id || ' [label=\"' || type || '\"];' || CASE WHEN parent_id IS NULL THEN '' ELSE chr(10) || '  n' || parent_id || ' -> n' || node_id || ';' END, chr(10) ORDER BY node_id) || chr(10) || '}' AS dot FROM nodes GROUP BY 1")(nav.dot)
query("named_counts", "SELECT doc_id, node_id, TRUE AS is_named, child_count AS named_child_count FROM nodes")(lambda n: n.select("doc_id", "node_id", "is_named", "named_child_count"))
query("child_by_type", "SELECT doc_id, parent_id, min(node_id) AS node_id, 1 AS line, CAST(min(node_id) * 2 + 1 AS INTEGER) AS \"column\" FROM nodes WHERE type = 'item' GROUP BY 1, 2")(lambda n: nav.child_by_type(n, "item"))
_BAD = "(type = 'order' and text = 'F') or (type = 'item' and text = 'R')"
query("error_counts", "SELECT n.doc_id, count(*) AS n_errors FROM nodes n LEFT JOIN nodes p ON p.doc_id = n.doc_id AND p.node_id = n.parent_id WHERE (n.type = 'order' AND n.text = 'F') OR (n.type = 'item' AND n.text = 'R' AND p.text <> 'F') GROUP BY 1")(
    lambda n: nav.count_errors(n.withColumn("is_error", F.expr(_BAD)))
)
query("syntax_errors", "SELECT doc_id, '1:' || (2 * coalesce(max(CASE WHEN type = 'item' THEN node_id END), max(node_id)) + 1) || ': syntax error: ' || CASE WHEN bool_or(type = 'item') THEN 'expected item' ELSE 'near \"F\"' END AS message FROM nodes WHERE (type = 'order' AND text = 'F') OR (type = 'item' AND text = 'R') GROUP BY 1")(
    lambda n: nav.syntax_errors(n.withColumns({"is_error": (F.col("type") == "order") & (F.col("text") == "F"), "is_missing": (F.col("type") == "item") & (F.col("text") == "R")}))
)
query("typed_captures", "SELECT p.doc_id, p.node_id AS parent, p.start AS parent_start, c.node_id AS child, c.text AS child_text FROM (SELECT *, node_id * 2 AS start FROM nodes) p JOIN nodes c ON c.doc_id = p.doc_id AND c.parent_id = p.node_id WHERE p.type = 'order'")(
    lambda n: typed(execute(n, "(order (item) @c) @p"), "(order (item) @c) @p").select("doc_id", F.col("p.node_id").alias("parent"), F.col("p.start_byte").alias("parent_start"), F.col("c.node_id").alias("child"), F.col("c.text").alias("child_text"))
)


def _spread_range():
    """(which nodes have one, its start, its end)."""
    return F.col("type") == "item", F.col("start_byte"), F.col("start_byte") + 1 + F.col("node_id") % 3 * 2


def _spread_ranges(n):
    """A range for each item, over up to two of the nodes that follow it."""
    of, s, e = _spread_range()
    return n.where(of).select("doc_id", F.col("node_id").alias("range_id"), s.alias("s"), e.alias("e"))


_HOLDS = "SELECT r.doc_id, r.node_id AS range_id, arg_max(a.node_id, a.depth) AS node_id, arg_max(a.type, a.depth) AS type FROM nodes r JOIN nodes a ON a.doc_id = r.doc_id AND a.node_id <= r.node_id AND a.last_desc >= r.node_id + r.node_id % 3 WHERE r.type = 'item'"
query("descendant_for_range", f"{_HOLDS} GROUP BY 1, 2")(lambda n: nav.smallest_containing_own(n, *_spread_range()))
query("named_descendant_for_range", f"{_HOLDS} AND a.type <> 'item' GROUP BY 1, 2")(lambda n: nav.smallest_containing_own(n.withColumn("is_named", F.col("type") != "item"), *_spread_range(), named=True))
query("match_root", f"{_HOLDS} GROUP BY 1, 2")(lambda n: nav.match_root(n, _spread_ranges(n)))

# coordinates

_UNITS = "CAST(length({0}) + len(regexp_extract_all({0}, '[\\x{{10000}}-\\x{{10FFFF}}]')) AS BIGINT)"


@query("utf16_offsets", f"SELECT doc_id, CAST(strlen(x) AS INTEGER) AS byte, {_UNITS.format('x')} AS unit, CAST(strlen(x) AS BIGINT) AS back FROM (SELECT doc_id, substring(text, 1, 1 + CAST(doc_id % 40 AS INTEGER)) AS x FROM documents)", forest=False)
def utf16_offsets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("byte", F.octet_length(F.substring("text", F.lit(1), (F.col("doc_id") % 40 + 1).cast("int"))))
    docs = docs.withColumn("unit", sp.utf16_for_byte(F.col("text"), F.col("byte")))
    return docs.select("doc_id", "byte", "unit", sp.byte_for_utf16(F.col("text"), F.col("unit")).alias("back"))


@query("utf16_ranges", f"SELECT doc_id, {_UNITS.format('a')} AS start_unit, {_UNITS.format('b')} AS end_unit, CAST(strlen(a) AS BIGINT) AS start_byte, CAST(strlen(b) AS BIGINT) AS end_byte FROM (SELECT doc_id, substring(text, 1, 3) AS a, substring(text, 1, 9) AS b FROM documents)", forest=False)
def utf16_ranges(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranges = docs.select("doc_id", F.octet_length(F.substring("text", 1, 3)).alias("start_byte"), F.octet_length(F.substring("text", 1, 9)).alias("end_byte"))
    units = sp.to_utf16_ranges(ranges, docs).select("doc_id", "start_unit", "end_unit")
    return sp.from_utf16_ranges(units, docs)


@query("utf16_edits", "SELECT doc_id, CAST(strlen(substring(text, 1, 2)) AS BIGINT) AS start_byte, CAST(strlen(substring(text, 1, 5)) AS BIGINT) AS old_end_byte, CAST(strlen(substring(text, 1, 2)) + 2 AS BIGINT) AS new_end_byte FROM documents WHERE length(text) >= 5 AND NOT regexp_matches(text, '[\\x{10000}-\\x{10FFFF}]')", forest=False)
def utf16_edits(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("length(text) >= 5 and octet_length(encode(text, 'UTF-16LE')) = 2 * length(text)").select("doc_id", "text")
    new = docs.select("doc_id", F.expr("concat(substring(text, 1, 2), 'é', substring(text, 6))").alias("text"))
    made = docs.select("doc_id", F.lit(2).alias("start_unit"), F.lit(5).alias("old_end_unit"), F.lit(3).alias("new_end_unit"))
    return sp.edits_from_utf16(made, docs, new).select("doc_id", "start_byte", "old_end_byte", "new_end_byte")


@query("points", "SELECT doc_id, CAST(len(parts) - 1 AS INTEGER) AS \"row\", CAST(strlen(parts[-1]) AS INTEGER) AS \"column\" FROM (SELECT doc_id, string_split(substring(text, 1, 300), chr(10)) AS parts FROM documents)", forest=False)
def points(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", sp.point_for_byte(F.col("text"), F.octet_length(F.substring("text", 1, 300))).alias("p")).select("doc_id", "p.row", "p.column")


query("tokens_in_ranges", "SELECT doc_id, node_id FROM nodes WHERE node_id * 2 < 9 AND last_desc * 2 + 2 > 4")(
    lambda n: sp.overlapping(n, nav.roots(n).select("doc_id", F.lit(4).alias("s"), F.lit(9).alias("e"))).select("doc_id", "node_id")
)

# edits


@query("shifted_by_edit", "SELECT doc_id, node_id, CAST(CASE WHEN s >= 12 THEN s + 3 ELSE s END AS INTEGER) AS start_byte, CAST(CASE WHEN e >= 12 THEN e + 3 WHEN e > 10 THEN 15 ELSE e END AS INTEGER) AS end_byte, s < 12 AND e > 10 AS dirty FROM (SELECT *, node_id * 2 AS s, last_desc * 2 + 2 AS e FROM nodes)")
def shifted_by_edit(n):
    edit = nav.roots(n).select("doc_id", F.lit(10).alias("start_byte"), F.lit(12).alias("old_end_byte"), F.lit(15).alias("new_end_byte"))
    return edits.shift_nodes(n, edit).select("doc_id", "node_id", "start_byte", "end_byte", "dirty")


@query("changed_ranges", "SELECT doc_id, min(s) AS s, max(e) AS e FROM (SELECT *, sum(CASE WHEN r IS NULL OR s > r THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM (SELECT l_orderkey AS doc_id, CAST(l_partkey AS BIGINT) AS s, greatest(CAST(l_partkey + l_quantity - 30 AS BIGINT), l_partkey + 1) AS e FROM lineitem))) GROUP BY doc_id, g", forest=False)
def changed_ranges(spark, sf_dir):
    made = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").cast("long").alias("start_byte"), (F.col("l_partkey") + F.col("l_quantity") - 30).cast("long").alias("new_end_byte"))
    return edits.changed_ranges(made)


@query("edits_applied", "SELECT p_partkey, 'X' || substr(p_name, 3, 2) || 'yz' || p_brand AS text FROM part", forest=False)
def edits_applied(spark, sf_dir):
    made = F.expr("array(named_struct('start_byte', 4, 'end_byte', 999, 'new_text', concat('yz', p_brand)), named_struct('start_byte', 3, 'end_byte', 1, 'new_text', 'never'), named_struct('start_byte', 0, 'end_byte', 2, 'new_text', 'X'))")
    return table(spark, sf_dir, "part").select("p_partkey", edits.apply_edits(F.col("p_name"), made).alias("text"))


@query("updated_nodes", "SELECT event_id AS doc_id, CASE WHEN event_id % 2 = 0 THEN 2 ELSE CAST(len(json_keys(props)) AS BIGINT) END AS pairs FROM events", forest=False)
def updated_nodes(spark, sf_dir):
    old = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.col("props").alias("text"))
    new = old.withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.lit('{"a": 1, "b": [2]}')).otherwise(F.col("text")))
    return update_nodes(parse(old, "json"), old, new, "json").groupBy("doc_id").agg(F.count_if(F.col("type") == "pair").alias("pairs"))


# parsing


@query("parse_utf16", "SELECT event_id AS doc_id, CAST(len(json_keys(props)) AS BIGINT) AS pairs FROM events", forest=False)
def utf16_parse(spark, sf_dir):
    nodes = parse_utf16(table(spark, sf_dir, "events").select("event_id", F.encode("props", "UTF-16BE").alias("content")), "json", "BE", "event_id")
    return nodes.groupBy("doc_id").agg(F.count_if(F.col("type") == "pair").alias("pairs"))


@query("parse_ranges", "SELECT p_partkey AS doc_id, CAST(3 AS BIGINT) AS numbers, CAST(0 AS BIGINT) AS errors FROM part", forest=False)
def ranges_parse(spark, sf_dir):
    text = F.concat(F.lit("<<"), "p_size", F.lit(">>*3 - "), "p_partkey")
    size = F.octet_length(F.col("p_size").cast("string"))
    read = F.array(F.struct((size + 4).alias("s"), F.lit(999).alias("e")), F.struct(F.lit(2).alias("s"), (size + 1).alias("e")), F.struct((size + 1).alias("s"), (size + 2).alias("e")))
    nodes = parse_ranges(table(spark, sf_dir, "part").select("p_partkey", text.alias("text"), read.alias("ranges")), "calc", "p_partkey")
    return nodes.groupBy("doc_id").agg(F.count_if(F.col("type") == "number").alias("numbers"), F.count_if("is_error").alias("errors"))


@query("parse_runtime", "SELECT p_partkey AS doc_id, 'accepted' AS stop_reason, CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 0 END > 0 AS has_errors, CAST(strlen(CAST(p_size AS VARCHAR)) + 4 AS BIGINT) AS n_bytes FROM part", forest=False)
def runtime(spark, sf_dir):
    text = F.when(F.col("p_partkey") % 4 == 0, F.concat("p_size", F.lit("*(3 "))).otherwise(F.concat("p_size", F.lit("*3  ")))
    out = parse_runtime(table(spark, sf_dir, "part").select("p_partkey", text.alias("text")), "calc", "p_partkey")
    return out.select("doc_id", "stop_reason", (F.col("n_errors") > 0).alias("has_errors"), "n_bytes")


@query("table_functions", "SELECT event_id AS doc_id, 'key' AS capture, k AS text FROM (SELECT event_id, unnest(json_keys(props)) AS k FROM events) UNION ALL SELECT event_id, 'pairs', CAST(len(json_keys(props)) AS VARCHAR) FROM events", forest=False)
def table_functions(spark, sf_dir):
    from ..functions import register

    register(spark)
    spread(table(spark, sf_dir, "events").select("event_id", "props")).createOrReplaceTempView("treeql_events")
    keys = spark.sql("SELECT event_id AS doc_id, q.capture, q.text FROM treeql_events, LATERAL run_query(props, 'json', '(pair key: (string (string_content) @key))') q")
    return keys.unionByName(spark.sql("SELECT event_id AS doc_id, 'pairs' AS capture, CAST(count(*) AS STRING) AS text FROM treeql_events, LATERAL parse_nodes(event_id, props, 'json') n WHERE n.type = 'pair' GROUP BY event_id"))


@query("tokens", "SELECT p_partkey AS doc_id, unnest(range(0, 5))::INTEGER AS seq, unnest(['number', '*', 'number', '-', 'number']) AS type, unnest([CAST(p_size AS VARCHAR), '*', '3', '-', CAST(p_partkey AS VARCHAR)]) AS text FROM part", forest=False)
def tokens(spark, sf_dir):
    from ..functions import register

    register(spark)
    table(spark, sf_dir, "part").select("p_partkey", F.concat("p_size", F.lit("*3 - "), "p_partkey").alias("formula")).transform(spread).createOrReplaceTempView("treeql_formulas")
    return spark.sql("SELECT p_partkey AS doc_id, t.seq, t.type, t.text FROM treeql_formulas, LATERAL tokenize(formula, 'calc') t")


def _programs(spark, sf_dir):
    """Old and new programs of each part; every second one is edited."""
    old = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.format_string('fun f%d() { return "%s"; } // é', "p_partkey", "p_brand").alias("text"))
    return old, old.withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("fun new() { }\n"), "text")).otherwise(F.col("text")))


@query("updated_tags", "SELECT p_partkey AS doc_id, 'f' || p_partkey AS name, CASE WHEN p_partkey % 2 = 0 THEN 18 ELSE 4 END AS name_start FROM part UNION ALL SELECT p_partkey, 'new', 4 FROM part WHERE p_partkey % 2 = 0", forest=False)
def updated_tags(spark, sf_dir):
    from ..grammar.samples import language

    old, new = _programs(spark, sf_dir)
    run = lambda texts: code.tags(query_sources(texts, "lox", code.infer_tags_query(language("lox"))))
    return update_rows(run(old), old, new, run).where("kind = 'definition.function'").select("doc_id", "name", "name_start")


@query("updated_highlights_utf16", "SELECT p_partkey AS doc_id, capture, CAST(place + CASE WHEN p_partkey % 2 = 0 THEN 14 ELSE 0 END AS BIGINT) AS start_unit, CAST(n AS BIGINT) AS units FROM (SELECT p_partkey, length(CAST(p_partkey AS VARCHAR)) AS k, length(p_brand) AS b FROM part), LATERAL (SELECT 'string' AS capture, 17 + k AS place, b + 2 AS n UNION ALL SELECT 'comment', 17 + k + b + 2 + 4, 4)", forest=False)
def updated_highlights(spark, sf_dir):
    from ..grammar.samples import lox_grammar

    old, new = _programs(spark, sf_dir)
    run = lambda texts: code.highlight_sources(texts, "lox", code.infer_highlight_query(lox_grammar()))
    found = update_rows(run(old), old, new, run).where("capture in ('string', 'comment')")
    return sp.to_utf16_ranges(found, new).select("doc_id", "capture", "start_unit", (F.col("end_unit") - F.col("start_unit")).alias("units"))


# languages, imports, diagnostics


@query("shebangs", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'python3.11' WHEN 1 THEN 'zsh' WHEN 2 THEN 'perl' END AS interpreter, CASE p_partkey % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'bash' WHEN 2 THEN 'perl' END AS lang, CASE p_partkey % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'cpp' END AS named FROM part", forest=False)
def shebangs(spark, sf_dir):
    pick = lambda n, *xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("p_partkey") % n + 1).cast("int"))
    line = pick(4, "#!/usr/bin/env -S LANG=C python3.11 -u", "#! /bin/zsh -e", "#!/usr/local/bin/perl", "no shebang")
    return table(spark, sf_dir, "part").select("p_partkey", interpreter(line).alias("interpreter"), detect_by_shebang(line).alias("lang"), detect_by_name(pick(3, " PY ", "C++", "klingon")).alias("named"))


@query("import_rows_go_java_starlark", """
SELECT p_partkey AS doc_id, kind, replace(path, '#', CAST(p_size AS VARCHAR)) AS path, name, alias, is_static, wildcard
FROM part JOIN (VALUES (0, 'package', 'p', 'p', '', FALSE, FALSE), (0, 'import', 'a/b#', 'b#', 'm', FALSE, FALSE), (0, 'import', 'fmt', 'fmt', '.', FALSE, TRUE), (1, 'package', 'a.p#', 'a.p#', '', FALSE, FALSE),
  (1, 'import', 'x.Y#.z', 'z', '', TRUE, FALSE), (1, 'import', 'u', '*', '', FALSE, TRUE), (2, 'load', '//p#:d.bzl', 'r', '', FALSE, FALSE), (2, 'load', '//p#:d.bzl', 's', 'b', FALSE, FALSE)) v(k, kind, path, n, alias, is_static, wildcard) ON p_partkey % 3 = k,
  LATERAL (SELECT replace(n, '#', CAST(p_size AS VARCHAR)) AS name)
""", forest=False)  # fmt: skip
def import_rows_more(spark, sf_dir):
    texts = ('package p // not\nimport (\n  m "a/b%1$d"\n  . "fmt" /* "no" */\n)\n', "package a.p%1$d;\n// import no;\nimport static x.Y%1$d.z;\nimport u.*;\n", 'load("//p%1$d:d.bzl", "r", b = "s")  # load("no")\n')
    part = table(spark, sf_dir, "part")
    pick = lambda xs: F.element_at(F.array(*xs), (F.col("p_partkey") % 3 + 1).cast("int"))
    docs = part.select(F.col("p_partkey").alias("doc_id"), pick([F.lit(x) for x in ("go", "java", "starlark")]).alias("lang"), pick([F.format_string(t, "p_size") for t in texts]).alias("text"))
    return extract_imports(docs).select("doc_id", "kind", "path", "name", "alias", "is_static", "wildcard")


@query("diagnostics", "SELECT p_partkey, 'E7 error: 2:' || (1 + p_partkey % 3) || ' bad name' || chr(10) || '  ' || p_name || chr(10) || '  ' || repeat(' ', CAST(p_partkey % 3 AS INTEGER)) || '^' || chr(10) || '  hint: ' || p_brand AS text FROM part", forest=False)
def diagnostics(spark, sf_dir):
    source = F.concat("p_type", F.lit("\n"), "p_name")
    text = code.render_diagnostic(source, F.lit("E7"), F.lit("error"), F.lit(2), (F.col("p_partkey") % 3 + 1).cast("int"), F.lit("bad name"), F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", text.alias("text"))


@query("embedded_nodes", "SELECT p_partkey AS doc_id, CAST(strlen(p_name) + 20 AS INTEGER) AS start_byte, 1 AS start_row, 12 AS start_col, CAST(p_size AS VARCHAR) AS text FROM part UNION ALL SELECT p_partkey, CAST(strlen(p_name) + 20 + strlen(CAST(p_size AS VARCHAR)) + 2 AS INTEGER), 2, 0, CAST(p_partkey AS VARCHAR) FROM part", forest=False)
def embedded_nodes(spark, sf_dir):
    docs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("<p>"), "p_name", F.lit("</p>\n<b><script>["), "p_size", F.lit(",\n"), "p_partkey", F.lit("]</script></b>")).alias("text"))
    regions = code.injection_query(docs, parse_html, '((script_element (raw_text) @injection.content) (#set! injection.language "json"))')
    return code.parse_injections(regions, ("json",), docs).where("type = 'number'").select("doc_id", "start_byte", "start_row", "start_col", "text")


@query("tags_of_methods", "SELECT p_partkey AS doc_id, kind, name FROM part, (VALUES ('definition.class', 'C'), ('definition.function', 'top')) v(kind, name)", forest=False)
def tags_of_methods(spark, sf_dir):
    from ..grammar.samples import language

    docs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.format_string("class C { }\nfun top() { return %d; }", "p_size").alias("text"))
    return code.tags(query_sources(docs, "lox", code.infer_tags_query(language("lox")))).select("doc_id", "kind", "name")


# tokens from elsewhere, saved languages, limits

_SUMS = "SELECT p_partkey AS doc_id, '+' AS operator, CAST(p_size AS VARCHAR) AS left_text, CAST(p_partkey % 9 AS VARCHAR) || ' ' || '* 3' AS right_text FROM part"


def _sums(n):
    """Each sum's operator, with the texts on its sides, of trees of `p_size + k * 3` in any spelling."""
    leaf = n.where("text is not null").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("node_id", "type", "text"))).alias("x"))
    return leaf.select("doc_id", F.col("x")[1]["type"].alias("operator"), F.col("x")[0]["text"].alias("left_text"), F.concat(F.col("x")[2]["text"], F.lit(" "), F.col("x")[3]["type"], F.lit(" "), F.col("x")[4]["text"]).alias("right_text"))


@query("token_source", _SUMS, forest=False)
def token_source(spark, sf_dir):
    from ..grammar.sources import pattern_tokens

    docs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.format_string("%d plus %d times 3", "p_size", F.col("p_partkey") % 9).alias("text"))
    return _sums(parse_tokens(docs, "calc", pattern_tokens({"number": "[0-9]+", "+": "plus", "*": "times"})))


@query("token_lists", _SUMS, forest=False)
def token_lists(spark, sf_dir):
    size = F.length(F.col("p_size").cast("string"))
    tokens = F.array(*[F.struct(F.lit(n).alias("name"), (size + a).cast("int").alias("s"), (size + b).cast("int").alias("e")) for n, a, b in (("+", 0, 1), ("number", 1, 2), ("*", 2, 3), ("number", 3, 4))])
    tokens = F.concat(F.array(F.struct(F.lit("number").alias("name"), F.lit(0).alias("s"), size.cast("int").alias("e"))), tokens)
    docs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.format_string("%da%dm3", "p_size", F.col("p_partkey") % 9).alias("text"), tokens.alias("tokens"))
    return _sums(parse_listed(docs, "calc"))


@query("saved_language", _SUMS, forest=False)
def saved_language(spark, sf_dir):
    from ..grammar.artifact import dump_language
    from ..grammar.samples import language

    docs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.format_string("%d + %d * 3", "p_size", F.col("p_partkey") % 9).alias("text"))
    return _sums(parse_with(docs, dump_language(language("calc"))))


_CALC_JS = """
const LEVELS = { sum: 1, product: 2 };
const side = ($, op, level) => prec.left(level, seq(field('left', $.expression), field('operator', op), field('right', $.expression)));
module.exports = grammar({
  name: 'calc_js',
  rules: {
    program: $ => $.expression,
    expression: $ => choice(...['+', '-'].map(op => side($, op, LEVELS.sum)), side($, '*', LEVELS.product), seq('(', $.expression, ')'), $.number),
    number: $ => /[0-9]+/,
  },
});
"""


@query("javascript_grammar", _SUMS, forest=False)
def javascript_grammar(spark, sf_dir):
    from ..grammar.artifact import dump_language
    from ..grammar.compiler import compile_grammar
    from ..grammar.javascript import from_javascript

    docs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.format_string("%d + %d * 3", "p_size", F.col("p_partkey") % 9).alias("text"))
    return _sums(parse_with(docs, dump_language(compile_grammar(from_javascript(_CALC_JS)))))


@query("parse_limits", "SELECT p_partkey AS doc_id, CASE WHEN p_size + 1 > 20 THEN 'stack_depth_limit' ELSE 'accepted' END AS stop_reason FROM part", forest=False)
def parse_limits(spark, sf_dir):
    docs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.concat(F.repeat(F.lit("["), F.col("p_size").cast("int")), F.repeat(F.lit("]"), F.col("p_size").cast("int"))).alias("text"))
    return parse_runtime(docs, "json", max_depth=20).select("doc_id", "stop_reason")


@query("parse_ranges_utf16", "SELECT p_partkey AS doc_id, CAST(strlen(p_name) + 8 AS INTEGER) AS start_byte, CAST(p_size AS VARCHAR) AS text FROM part", forest=False)
def ranges_utf16(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    name = F.length("p_name")
    docs = part.select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("\U0001f600"), "p_name", F.lit("é \t"), "p_size", F.lit("!")).alias("text"), F.array(F.struct((name + 5).cast("int").alias("s"), (name + 5 + F.length(F.col("p_size").cast("string"))).cast("int").alias("e"))).alias("ranges"))
    return parse_ranges_utf16(docs, "json").where("type = 'number'").select("doc_id", "start_byte", "text")


@query("descendant_utf16", "SELECT p_partkey AS doc_id, 'string_content' AS type, '\U0001F600x' || p_brand AS text FROM part".replace("\\U0001F600", "\U0001f600"), forest=False)
def descendant_utf16(spark, sf_dir):
    docs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit('["é", "\U0001f600x'), "p_brand", F.lit('"]')).alias("text"))
    ranges = docs.select("doc_id", F.lit(1).alias("range_id"), F.lit(7).alias("start_unit"), F.lit(10).alias("end_unit"))
    nodes = parse(docs, "json")
    found = nav.smallest_containing_utf16(nodes, ranges, docs)
    return found.select("doc_id", "node_id").join(shuffled(nodes), ["doc_id", "node_id"]).select("doc_id", "type", "text")


# languages inside languages

_INSIDE = {"html": '((script_element (raw_text) @injection.content) (#set! injection.language "json"))', "json": '((pair key: (string (string_content) @injection.language) value: (string (string_content) @injection.content)))'}


def _pages(spark, sf_dir):
    """Pages with JSON in a script, which holds a sum in a string."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("<p>"), "p_name", F.lit('</p>\n<script>{"calc": "'), "p_size", F.lit('+1", "no": "x"}</script>')).alias("text"))


@query("nested_languages", """
SELECT p_partkey AS doc_id, v.level, v.lang, v.type, CAST(strlen(p_name) + 8 + v.place AS INTEGER) AS start_byte, 1 AS start_row, CAST(v.place AS INTEGER) AS start_col, coalesce(v.text, CAST(p_size AS VARCHAR)) AS text
FROM part, LATERAL (SELECT 18 + strlen(CAST(p_size AS VARCHAR)) + 1 AS one) l, LATERAL (VALUES (2, 'calc', 'number', 18, NULL), (2, 'calc', 'number', l.one, '1')) v(level, lang, type, place, text)
""", forest=False)  # fmt: skip
def nested_languages(spark, sf_dir):
    found = nested_nodes(_pages(spark, sf_dir), "html", _INSIDE)
    return found.where("type = 'number'").select("doc_id", "level", "lang", "type", "start_byte", "start_row", "start_col", "text")


@query("nested_highlights", "SELECT p_partkey AS doc_id, 'number' AS capture, CAST(strlen(CAST(p_size AS VARCHAR)) + 1 AS BIGINT) AS bytes FROM part UNION ALL SELECT p_partkey, 'string', CAST(15 AS BIGINT) FROM part UNION ALL SELECT p_partkey, 'operator', CAST(1 AS BIGINT) FROM part", forest=False)
def nested_highlights(spark, sf_dir):
    marks = {"json": "(string) @string", "calc": '(number) @number "+" @operator'}
    flat = embedded_highlights(_pages(spark, sf_dir), "html", marks, _INSIDE, max_depth=2)
    return flat.groupBy("doc_id", "capture").agg(F.sum(F.col("end_byte") - F.col("start_byte")).cast("long").alias("bytes"))


#: How each language of the registry is parsed: by tables of a sample grammar, by its imports only, or not at all.
_SUPPORT = "'calc', 'lr', 17), ('ini', 'lr', 24), ('json', 'lr', 40), ('lox', 'lr', 139), ('outline', 'lr', 11"
query("language_support", f"SELECT name, backend, CAST(states AS INTEGER) AS n_states, CAST(0 AS INTEGER) AS n_conflicts FROM (VALUES ({_SUPPORT})) v(name, backend, states) UNION ALL SELECT unnest(['go', 'java', 'python', 'starlark']), 'imports', 0, 0 UNION ALL SELECT unnest(['bash', 'c', 'cpp', 'css', 'html', 'javascript', 'make', 'markdown', 'perl', 'ruby', 'rust', 'toml', 'typescript', 'yaml']), 'unsupported', 0, 0", forest=False)(
    lambda spark, sf_dir: support(spark)
)
