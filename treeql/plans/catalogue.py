"""Queries over the driver's tables, each with the SQL that gives the same rows.

Trees are those of `customer_forest`: customer > order > item. The SQL builds them anew from the tables (`FOREST`), so that both sides share nothing but the
definition. Its CTEs are inlined, since DuckDB 2.0 never ends on a limit over a materialised one that is joined with itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..grammar.html import parse_html
from ..grep.statement import substitute_column, where_column
from ..operators import navigation as nav
from ..operators import spans as sp
from ..operators.edits import diff_trees, rewrite
from ..operators.forest import customer_forest
from ..operators.parse import parse
from ..query.compiler import compile_query
from ..query.execute import capture_rows, execute, limited, query_sources, run_query
from ..query.relational import query_matches
from ..sources.languages import detect_language

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

FOREST = """
WITH per_order AS NOT MATERIALIZED (
  SELECT l_orderkey AS okey, count(*) AS n_items FROM lineitem GROUP BY 1
), o AS NOT MATERIALIZED (
  SELECT o_custkey AS doc_id, o_orderkey AS okey, o_orderstatus AS status, o_orderpriority AS priority, coalesce(n_items, 0) AS n_items,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS k,
         coalesce(sum(coalesce(n_items, 0) + 1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS node_id,
         sum(coalesce(n_items, 0) + 1) OVER (PARTITION BY o_custkey) AS total, count(*) OVER (PARTITION BY o_custkey) AS n_orders
  FROM orders LEFT JOIN per_order ON o_orderkey = per_order.okey
), i AS NOT MATERIALIZED (
  SELECT doc_id, node_id AS order_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag, l_linestatus) - 1 AS k,
         l_returnflag, l_linestatus
  FROM lineitem JOIN o ON l_orderkey = o.okey
), c AS NOT MATERIALIZED (
  SELECT c_custkey AS doc_id, c_mktsegment, coalesce(max(total), 0) AS total, coalesce(max(n_orders), 0) AS n_orders FROM customer LEFT JOIN o ON c_custkey = o.doc_id GROUP BY 1, 2
), nodes AS NOT MATERIALIZED (
  SELECT doc_id, CAST(0 AS INTEGER) AS node_id, CAST(NULL AS INTEGER) AS parent_id, CAST(0 AS INTEGER) AS child_index, 0 AS depth, CAST(total AS INTEGER) AS last_desc, 'customer' AS type, CAST(NULL AS VARCHAR) AS field, CAST(n_orders AS INTEGER) AS child_count, c_mktsegment AS text FROM c
  UNION ALL SELECT doc_id, CAST(node_id AS INTEGER), 0, CAST(k AS INTEGER), 1, CAST(node_id + n_items AS INTEGER), 'order', 'p' || substr(priority, 1, 1), CAST(n_items AS INTEGER), status FROM o
  UNION ALL SELECT doc_id, CAST(order_id + 1 + k AS INTEGER), CAST(order_id AS INTEGER), CAST(k AS INTEGER), 2, CAST(order_id + 1 + k AS INTEGER), 'item', 's' || l_linestatus, 0, l_returnflag FROM i
)
"""


def query(name: str, sql: str | None = None, forest: bool = True):
    """Register a function of (spark, sf_dir), or of the forest if `forest`."""

    def add(f):
        QUERIES[name] = (lambda spark, sf_dir: f(customer_forest(spark, sf_dir))) if forest else f
        if sql:
            ORACLES[name] = FOREST + sql if forest else sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# navigation

query("forest_nodes", "SELECT doc_id, node_id, parent_id, child_index, depth, last_desc, type, field, child_count, text FROM nodes")(
    lambda n: n.select("doc_id", "node_id", "parent_id", "child_index", "depth", "last_desc", "type", "field", "child_count", "text")
)
query("axis_root", "SELECT doc_id, node_id, child_count FROM nodes WHERE parent_id IS NULL")(lambda n: nav.roots(n).select("doc_id", "node_id", "child_count"))
query("axis_parent", "SELECT n.doc_id, n.parent_id, n.node_id, p.type AS parent_type, p.text AS parent_text FROM nodes n JOIN nodes p ON n.doc_id = p.doc_id AND n.parent_id = p.node_id")(lambda n: nav.parents(n, ("type", "text")))
query("axis_child", "SELECT doc_id, parent_id, node_id FROM nodes WHERE parent_id IS NOT NULL AND child_index = 1")(lambda n: nav.child(n, 1).select("doc_id", "parent_id", "node_id"))
query("axis_named_child", "SELECT doc_id, parent_id, node_id FROM nodes WHERE parent_id IS NOT NULL AND child_index = 0")(lambda n: nav.child(n, 0, named=True).select("doc_id", "parent_id", "node_id"))
query("axis_child_by_field", "SELECT doc_id, parent_id, arg_min(node_id, child_index) AS node_id FROM nodes WHERE field = 'sF' GROUP BY 1, 2")(lambda n: nav.child_by_field(n, "sF"))
query(
    "axis_siblings",
    "SELECT doc_id, node_id, lead(node_id) OVER w AS next_id, lag(node_id) OVER w AS prev_id FROM nodes WHERE parent_id IS NOT NULL WINDOW w AS (PARTITION BY doc_id, parent_id ORDER BY child_index) UNION ALL SELECT doc_id, node_id, NULL, NULL FROM nodes WHERE parent_id IS NULL",
)(lambda n: nav.siblings(n).select("doc_id", "node_id", "next_id", "prev_id"))
query("axis_children", "SELECT doc_id, parent_id, string_agg(CAST(node_id AS VARCHAR), ',' ORDER BY child_index) AS children FROM nodes WHERE parent_id IS NOT NULL GROUP BY 1, 2")(
    lambda n: nav.children(n).withColumn("children", F.array_join("children", ","))
)
query("axis_descendant_count", "SELECT a.doc_id, a.node_id AS top_id, count(*) AS n FROM nodes a JOIN nodes d ON a.doc_id = d.doc_id AND d.node_id BETWEEN a.node_id AND a.last_desc WHERE a.type = 'order' AND d.type = 'item' GROUP BY 1, 2")(
    lambda n: nav.descendants(n, n.where("type = 'order'"), ("item",)).groupBy("doc_id", "top_id").agg(F.count("*").alias("n"))
)
query("axis_ancestor_types", "SELECT d.doc_id, d.node_id, string_agg(DISTINCT a.type, ',' ORDER BY a.type) AS ancestor_types FROM nodes d JOIN nodes a ON a.doc_id = d.doc_id AND d.node_id > a.node_id AND d.node_id <= a.last_desc GROUP BY 1, 2")(
    lambda n: nav.ancestor_types(n).withColumn("ancestor_types", F.array_join("ancestor_types", ","))
)
query("walk_preorder", "SELECT doc_id, node_id, row_number() OVER (PARTITION BY doc_id ORDER BY node_id) - 1 AS step FROM nodes")(lambda n: nav.walk(n).select("doc_id", "node_id", F.col("step").cast("long").alias("step")))
query("walk_skip_children", "SELECT doc_id, node_id, row_number() OVER (PARTITION BY doc_id ORDER BY node_id) - 1 AS step FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM nodes a WHERE a.doc_id = n.doc_id AND a.type = 'order' AND a.text = 'F' AND n.node_id > a.node_id AND n.node_id <= a.last_desc)")(
    lambda n: nav.walk(n, skip_below=(F.col("type") == "order") & (F.col("text") == "F")).select("doc_id", "node_id", F.col("step").cast("long").alias("step"))
)
query("walk_stop", "SELECT doc_id, node_id FROM nodes n WHERE node_id <= coalesce((SELECT min(node_id) FROM nodes s WHERE s.doc_id = n.doc_id AND s.text = 'R'), 2147483647)")(
    lambda n: nav.walk(n, stop_at=F.col("text") == "R").select("doc_id", "node_id")
)
query(
    "sexpr",
    "SELECT doc_id, string_agg(CASE WHEN node_id > 0 THEN ' (' ELSE '(' END || type || repeat(')', depth - nd + 1), '' ORDER BY node_id) AS sexpr FROM (SELECT *, CAST(coalesce(lead(depth) OVER (PARTITION BY doc_id ORDER BY node_id), 0) AS INTEGER) AS nd FROM nodes) GROUP BY 1",
)(nav.sexprs)
query("shifted_nodes", "SELECT doc_id, node_id, node_id * 2 + 7 AS start_byte, last_desc * 2 + 9 AS end_byte, node_id * 2 + 3 AS start_col, 1 AS start_row FROM nodes")(
    lambda n: nav.shifted(n, 7, 1, 3).select("doc_id", "node_id", "start_byte", "end_byte", "start_col", "start_row")
)

query("first_child_for_byte", "SELECT doc_id, parent_id, min(child_index) AS child_index FROM nodes WHERE parent_id IS NOT NULL AND last_desc * 2 + 2 > 40 GROUP BY 1, 2")(lambda n: nav.first_child_for_byte(n, 40))

# queries



def _listed():
    return F.array_join(F.transform("captures", lambda c: F.concat(c["name"], F.lit("="), c["node_id"].cast("string"))), ",").alias("found")



def tree_query(name: str, pattern: str, sql: str, by_document: bool = False):
    run = run_query if by_document else execute
    query(name, sql)(lambda n: run(n, pattern).select("doc_id", _listed()))


_ONE = "SELECT doc_id, 'x=' || node_id AS found FROM nodes"
_PAIR = "SELECT p.doc_id, 'p=' || p.node_id || ',c=' || c.node_id AS found FROM nodes p JOIN nodes c ON c.doc_id = p.doc_id AND c.parent_id = p.node_id"
_TWO = "SELECT p.doc_id, 'a=' || a.node_id || ',b=' || b.node_id AS found FROM nodes p JOIN nodes a ON a.doc_id = p.doc_id AND a.parent_id = p.node_id JOIN nodes b ON b.doc_id = p.doc_id AND b.parent_id = p.node_id AND b.child_index > a.child_index"
tree_query("query_single", "(order) @x", f"{_ONE} WHERE type = 'order'")
tree_query("query_wildcard", "(_) @x", _ONE)
tree_query("query_alternation", "[(order) (customer)] @x", f"{_ONE} WHERE type IN ('order', 'customer')")
tree_query("query_typed_child", "(order (item) @c) @p", f"{_PAIR} WHERE p.type = 'order' AND c.type = 'item'")
tree_query("query_field", "(order sF: (item) @c) @p", f"{_PAIR} WHERE p.type = 'order' AND c.field = 'sF'")
tree_query("query_negated_field", "(order !sF) @x", f"{_ONE} n WHERE type = 'order' AND NOT EXISTS (SELECT 1 FROM nodes c WHERE c.doc_id = n.doc_id AND c.parent_id = n.node_id AND c.field = 'sF')")
tree_query("query_two_children", "(order (item) @a (item) @b)", f"{_TWO} WHERE p.type = 'order'")
tree_query("query_anchor_first", "(order . (item) @c) @p", f"{_PAIR} WHERE p.type = 'order' AND c.child_index = 0")
tree_query("query_anchor_last", "(order (item) @c .) @p", f"{_PAIR} WHERE p.type = 'order' AND c.child_index = p.child_count - 1")
tree_query("query_anchor_adjacent", "(order (item) @a . (item) @b)", f"{_TWO} WHERE p.type = 'order' AND b.child_index = a.child_index + 1")
tree_query("query_three_levels", "(customer (order (item) @b) @a)", "SELECT o.doc_id, 'a=' || o.node_id || ',b=' || i.node_id AS found FROM nodes o JOIN nodes i ON i.doc_id = o.doc_id AND i.parent_id = o.node_id WHERE o.type = 'order'")
tree_query(
    "query_plus_run", "(order sF: (item)+ @x)",
    ", f AS (SELECT *, child_index - row_number() OVER (PARTITION BY doc_id, parent_id ORDER BY child_index) AS g FROM nodes WHERE type = 'item' AND field = 'sF'), r AS (SELECT doc_id, parent_id, g, min(child_index) AS s, string_agg('x=' || node_id, ',' ORDER BY child_index) AS found FROM f GROUP BY 1, 2, 3) SELECT doc_id, arg_min(found, s) AS found FROM r GROUP BY doc_id, parent_id",
    by_document=True,
)
tree_query("query_root_plus", "(order)+ @x", "SELECT doc_id, string_agg('x=' || node_id, ',' ORDER BY node_id) AS found FROM nodes WHERE type = 'order' GROUP BY 1", by_document=True)
tree_query("query_star", "(order (item)* @x)", "SELECT o.doc_id, coalesce(string_agg('x=' || i.node_id, ',' ORDER BY i.node_id), '') AS found FROM nodes o LEFT JOIN nodes i ON i.doc_id = o.doc_id AND i.parent_id = o.node_id WHERE o.type = 'order' GROUP BY o.doc_id, o.node_id", by_document=True)
tree_query("query_by_document", "(order (item) @a . (item) @b)", f"{_TWO} WHERE p.type = 'order' AND b.child_index = a.child_index + 1", by_document=True)
tree_query("pred_eq", '((item) @x (#eq? @x "R"))', f"{_ONE} WHERE type = 'item' AND text = 'R'")
tree_query("pred_not_eq", '((item) @x (#not-eq? @x "R"))', f"{_ONE} WHERE type = 'item' AND text <> 'R'")
tree_query("pred_eq_capture", "((order (item) @a (item) @b) (#eq? @a @b))", f"{_TWO} WHERE p.type = 'order' AND a.text = b.text")
tree_query("pred_match", '((order) @x (#match? @x "^[FO]$"))', f"{_ONE} WHERE type = 'order' AND regexp_matches(text, '^[FO]$')")
tree_query("pred_not_match", '((order) @x (#not-match? @x "F|O"))', f"{_ONE} WHERE type = 'order' AND NOT regexp_matches(text, 'F|O')")
tree_query("pred_lua_match", '((customer) @x (#lua-match? @x "^%u+$"))', f"{_ONE} WHERE type = 'customer' AND regexp_matches(text, '^[A-Z]+$')")
tree_query("pred_any_of", '((customer) @x (#any-of? @x "BUILDING" "MACHINERY"))', f"{_ONE} WHERE type = 'customer' AND text IN ('BUILDING', 'MACHINERY')")
tree_query("pred_not_any_of", '((item) @x (#not-any-of? @x "A" "N"))', f"{_ONE} WHERE type = 'item' AND text NOT IN ('A', 'N')")
tree_query("pred_has_parent", "((_) @x (#has-parent? @x order))", f"{_ONE} WHERE type = 'item'")


def _by_status(n: DataFrame) -> DataFrame:
    """The forest with the order's status in its type, so that ancestors differ."""
    return n.withColumn("type", F.when(F.col("type") == "order", F.concat("type", "text")).otherwise(F.col("type")))


for _name, _test, _not in (("has_ancestor", "has-ancestor", ""), ("not_has_ancestor", "not-has-ancestor", "NOT"), ("not_has_parent", "not-has-parent", "NOT")):
    query(f"pred_{_name}", f"SELECT c.doc_id, 'x=' || c.node_id AS found FROM nodes p JOIN nodes c ON c.doc_id = p.doc_id AND c.parent_id = p.node_id WHERE c.type = 'item' AND {_not} p.text = 'F'")(
        lambda n, _test=_test: execute(_by_status(n), f"((item) @x (#{_test}? @x orderF))").select("doc_id", _listed())
    )
tree_query("pred_any_eq", '((order (item)+ @x) (#any-eq? @x "R"))', "SELECT doc_id, string_agg('x=' || node_id, ',' ORDER BY child_index) AS found FROM nodes WHERE type = 'item' GROUP BY doc_id, parent_id HAVING bool_or(text = 'R')", by_document=True)
tree_query("pred_any_match", '((order (item)+ @x) (#any-match? @x "[RA]"))', "SELECT doc_id, string_agg('x=' || node_id, ',' ORDER BY child_index) AS found FROM nodes WHERE type = 'item' GROUP BY doc_id, parent_id HAVING bool_or(text IN ('R', 'A'))", by_document=True)
tree_query("pred_count", "((order (item)+ @x) (#count? @x > 3))", "SELECT doc_id, string_agg('x=' || node_id, ',' ORDER BY child_index) AS found FROM nodes WHERE type = 'item' GROUP BY doc_id, parent_id HAVING count(*) > 3", by_document=True)
query("pred_is_exported", f"{_ONE} WHERE type = 'item' AND text <> 'R'")(
    lambda n: execute(n.withColumn("text", F.when(F.col("text") == "R", "r").otherwise(F.col("text"))), "((item) @x (#is-exported? @x))").select("doc_id", _listed())
)
query("dir_strip", "SELECT doc_id, node_id, regexp_replace(text, '[AEIOU]', '', 'g') AS text FROM nodes WHERE type = 'customer'")(
    lambda n: capture_rows(execute(n, '((customer) @x (#strip! @x "[AEIOU]"))')).select("doc_id", "node_id", "text")
)
query("dir_select_adjacent", "SELECT doc_id, count(*) AS n FROM (SELECT doc_id, parent_id, text, lead(text) OVER w AS nt, lag(text) OVER w AS pt FROM nodes WHERE type = 'order' WINDOW w AS (PARTITION BY doc_id ORDER BY child_index)) WHERE text = 'O' AND (nt = 'F' OR pt = 'F') GROUP BY 1")(
    lambda n: capture_rows(
        run_query(n.withColumn("type", F.when(F.col("type") == "order", F.concat(F.lit("order"), "text")).otherwise(F.col("type"))), "(customer [(orderO) @o (orderF) @f (orderP)]+ (#select-adjacent! @o @f))")
    ).where("name = 'o'").groupBy("doc_id").agg(F.count("*").alias("n"))
)
query("cursor_byte_range", f"{_ONE} WHERE type = 'order' AND last_desc * 2 + 2 > 10 AND node_id * 2 < 30")(lambda n: run_query(n, "(order) @x", byte_range=(10, 30)).select("doc_id", _listed()))
query("cursor_max_depth", f"{_ONE} WHERE depth <= 1")(lambda n: run_query(n, "(_) @x", max_start_depth=1).select("doc_id", _listed()))
query("cursor_match_limit", "SELECT doc_id, 'x=' || node_id AS found, n > 3 AS exceeded FROM (SELECT doc_id, node_id, row_number() OVER (PARTITION BY doc_id ORDER BY node_id) AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM nodes WHERE type = 'order') WHERE k <= 3")(
    lambda n: limited(execute(n, "(order) @x"), 3).select("doc_id", _listed(), "exceeded")
)
query("capture_rows", "SELECT p.doc_id, p.node_id AS a, c.node_id AS b FROM nodes p JOIN nodes c ON c.doc_id = p.doc_id AND c.parent_id = p.node_id WHERE p.type = 'order'")(
    lambda n: query_matches(n, compile_query("(order (item) @c) @p")).select("doc_id", F.col("captures")[0]["node_id"].alias("a"), F.col("captures")[1]["node_id"].alias("b"))
)

# spans and coordinates


@query("ranges_coalesce", "SELECT k AS doc_id, min(s) AS s, max(e) AS e FROM (SELECT *, sum(CASE WHEN r IS NULL OR s > r THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM (SELECT *, max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM (SELECT l_suppkey AS k, l_orderkey AS s, l_orderkey + CAST(l_quantity AS BIGINT) AS e FROM lineitem) WHERE s < e)) GROUP BY k, g", forest=False)
def ranges_coalesce(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc_id"), F.col("l_orderkey").alias("s"), (F.col("l_orderkey") + F.col("l_quantity").cast("long")).alias("e"))
    return sp.coalesce_ranges(r)


@query("utf16_units", "SELECT doc_id, CAST(length(text) + len(regexp_extract_all(text, '[\\x{10000}-\\x{10FFFF}]')) AS BIGINT) AS units, CAST(strlen(text) AS BIGINT) AS bytes FROM documents", forest=False)
def utf16_units(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", sp.utf16_units(F.col("text")).alias("units"), F.octet_length("text").cast("long").alias("bytes"))


@query("line_starts", "SELECT doc_id, line, CAST(coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_byte FROM (SELECT doc_id, k - 1 AS line, strlen(parts[k]) + 1 AS n FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)))", forest=False)
def line_starts(spark, sf_dir):
    return sp.line_starts(table(spark, sf_dir, "documents")).withColumn("line", F.col("line").cast("long"))


@query("highlight_resolve", "SELECT doc_id, type AS capture, CAST(2 * count(*) AS BIGINT) AS bytes FROM nodes GROUP BY 1, 2")
def highlight_resolve(n):
    flat = sp.resolve_highlights(n.select("doc_id", "start_byte", "end_byte", F.col("type").alias("capture"), F.lit(0).alias("pattern_index")))
    return flat.groupBy("doc_id", "capture").agg(F.sum(F.col("end_byte") - F.col("start_byte")).alias("bytes"))


@query("highlight_items", "SELECT doc_id, CAST(sum(CASE WHEN type = 'item' THEN 2 ELSE 0 END) AS BIGINT) AS item_bytes FROM nodes GROUP BY 1")
def highlight_items(n):
    flat = sp.resolve_highlights(n.select("doc_id", "start_byte", "end_byte", F.col("type").alias("capture"), F.lit(0).alias("pattern_index")))
    return flat.groupBy("doc_id").agg(F.sum(F.when(F.col("capture") == "item", F.col("end_byte") - F.col("start_byte")).otherwise(0)).alias("item_bytes"))


# rewriting, templates, diffs


@query("rewrite_apply", "SELECT doc_id, 'AB' || substr(text, 4, 2) || substr(text, 8) || CASE WHEN length(text) < 7 THEN 'no' ELSE '' END AS text FROM (SELECT p_partkey AS doc_id, p_brand || '-' || p_name AS text FROM part) WHERE length(text) >= 7", forest=False)
def rewrite_apply(spark, sf_dir):
    src = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.concat("p_brand", F.lit("-"), "p_name").alias("text")).where("length(text) >= 7")
    edits = src.select("doc_id", F.explode(F.array(F.struct(F.lit(0).alias("start_byte"), F.lit(3).alias("end_byte"), F.lit("AB").alias("new_text")), F.struct(F.lit(5).alias("start_byte"), F.lit(7).alias("end_byte"), F.lit("").alias("new_text")))).alias("e")).select("doc_id", "e.*")
    return rewrite(src, edits)[0]


@query("rewrite_coords", "SELECT p_partkey AS doc_id, k AS edit_seq, CASE k WHEN 0 THEN 0 ELSE 4 END AS start_byte, CASE k WHEN 0 THEN 3 ELSE 6 END AS old_end_byte, CASE k WHEN 0 THEN 2 ELSE 4 END AS new_end_byte FROM part, (SELECT unnest([0, 1]) AS k)", forest=False)
def rewrite_coords(spark, sf_dir):
    src = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.concat("p_brand", F.lit("-"), "p_name").alias("text"))
    edits = src.select("doc_id", F.explode(F.array(F.struct(F.lit(0).alias("start_byte"), F.lit(3).alias("end_byte"), F.lit("AB").alias("new_text")), F.struct(F.lit(5).alias("start_byte"), F.lit(7).alias("end_byte"), F.lit("").alias("new_text")))).alias("e")).select("doc_id", "e.*")
    return rewrite(src, edits)[1].select("doc_id", "edit_seq", "start_byte", "old_end_byte", "new_end_byte")



def _captures():
    return F.create_map(F.lit("NAME"), F.col("p_name"), F.lit("BRAND"), F.col("p_brand"))



@query("template_substitute", "SELECT p_partkey, replace(replace('$BRAND: $NAME ($BRAND)', '$BRAND', p_brand), '$NAME', p_name) AS text FROM part", forest=False)
def template_substitute(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", substitute_column(F.lit("$BRAND: $NAME ($BRAND)"), ["NAME", "BRAND"], _captures()).alias("text"))


@query("where_clauses", "SELECT p_partkey FROM part WHERE contains(p_name, 'in') AND NOT regexp_matches(p_brand, '[24]$')", forest=False)
def where_clauses(spark, sf_dir):
    return table(spark, sf_dir, "part").where(where_column('contains($NAME, "in"); not matches($BRAND, "[24]$")', _captures())).select("p_partkey")


@query("tree_diff", "SELECT doc_id, min(s) AS s, max(e) AS e FROM (SELECT *, sum(CASE WHEN r IS NULL OR s > r THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM (SELECT doc_id, node_id * 2 AS s, node_id * 2 + 2 AS e, max(node_id * 2 + 2) OVER (PARTITION BY doc_id ORDER BY node_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM nodes WHERE type = 'item' AND text = 'R')) GROUP BY doc_id, g")
def tree_diff(n):
    return diff_trees(n, n.withColumn("text", F.when((F.col("type") == "item") & (F.col("text") == "R"), F.lit("changed")).otherwise(F.col("text"))))


# languages and parsing


@query("detect_language", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'json' WHEN 1 THEN 'python' WHEN 2 THEN 'make' WHEN 3 THEN 'go' ELSE NULL END AS lang FROM part", forest=False)
def detect(spark, sf_dir):
    path = F.concat(F.lit("src/"), "p_partkey", F.element_at(F.array(*map(F.lit, (".json", ".PY", "/Makefile", ".x.go", ".unknown"))), (F.col("p_partkey") % 5 + 1).cast("int")))
    return table(spark, sf_dir, "part").select("p_partkey", detect_language(path).alias("lang"))


@query("json_pairs", "SELECT event_id AS doc_id, k AS key, json_extract_string(props, '$.\"' || k || '\"') AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)", forest=False)
def json_pairs(spark, sf_dir):
    found = query_sources(table(spark, sf_dir, "events"), "json", "(pair key: (string (string_content) @k) value: (number) @v)", "event_id", "props")
    return found.select("doc_id", F.col("captures")[0]["text"].alias("key"), F.col("captures")[1]["text"].alias("value"))


@query("json_nodes", "SELECT 'number' AS type, CAST(sum(len(json_keys(props))) AS BIGINT) AS n FROM events UNION ALL SELECT 'object', count(*) FROM events UNION ALL SELECT 'pair', CAST(sum(len(json_keys(props))) AS BIGINT) FROM events", forest=False)
def json_nodes(spark, sf_dir):
    nodes = parse(table(spark, sf_dir, "events"), "json", "event_id", "props")
    return nodes.where("type in ('object', 'pair', 'number')").groupBy("type").agg(F.count("*").alias("n"))


@query("calc_eval", "SELECT p_partkey AS doc_id, CAST(p_size * 3 - (p_partkey % 7) AS BIGINT) AS value FROM part", forest=False)
def calc_eval(spark, sf_dir):
    texts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.concat(F.col("p_size"), F.lit("*3 - "), F.col("p_partkey") % 7).alias("text"))
    nodes = parse(texts, "calc")
    # the root's expression: (size * 3) - k, by its operators and numbers in order
    numbers = nodes.where("type = 'number'").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("node_id", F.col("text").cast("long").alias("v")))).alias("v"))
    ops = nodes.where("type in ('+', '-', '*', '/') and field = 'operator'").groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("depth", "type"))), lambda x: x["type"]), "").alias("ops"))
    return numbers.join(ops, "doc_id").where("ops = '-*'").select("doc_id", (F.col("v")[0]["v"] * F.col("v")[1]["v"] - F.col("v")[2]["v"]).alias("value"))


# markup and code


@query("html_elements", "SELECT page_id AS doc_id, CAST(len(regexp_extract_all(html, '<p>')) AS BIGINT) AS paragraphs, CAST(len(regexp_extract_all(html, '<li>')) AS BIGINT) AS items FROM pages", forest=False)
def html_elements(spark, sf_dir):
    found = query_sources(table(spark, sf_dir, "pages"), parse_html, "(element (start_tag name: (tag_name) @t))", "page_id", "html")
    name = F.col("captures")[0]["text"]
    return found.groupBy("doc_id").agg(F.count_if(name == "p").alias("paragraphs"), F.count_if(name == "li").alias("items"))


@query("html_injections", "SELECT page_id AS doc_id, 'javascript' AS language, regexp_extract(html, '<script>(.*?)</script>', 1) AS text FROM pages UNION ALL SELECT page_id, 'css', regexp_extract(html, '<style>(.*?)</style>', 1) FROM pages", forest=False)
def html_injections(spark, sf_dir):
    from ..operators.code import injection_query

    q = '((script_element (raw_text) @injection.content) (#set! injection.language "javascript"))\n((style_element (raw_text) @injection.content) (#set! injection.language "css"))'
    return injection_query(table(spark, sf_dir, "pages"), parse_html, q, "page_id", "html").select("doc_id", "language", "text")


def _snippets(spark, sf_dir):
    """A small program for each part, with names and numbers of the part."""
    part = table(spark, sf_dir, "part")
    text = F.format_string('import "m%d";\nfun f%d(a, b) { if (a > %d) { print g(b); } return a * %d; } // %s\nvar v = f%d(1, "%s");', F.col("p_partkey") % 9, "p_partkey", "p_size", "p_size", "p_brand", "p_partkey", "p_type")
    return part.select(F.col("p_partkey").alias("doc_id"), text.alias("text"))


@query("code_tags", "SELECT p_partkey AS doc_id, 'definition.function' AS kind, 'f' || p_partkey AS name FROM part UNION ALL SELECT p_partkey, 'definition.variable', 'v' FROM part UNION ALL SELECT p_partkey, 'reference.call', unnest(['g', 'f' || p_partkey]) FROM part", forest=False)
def code_tags(spark, sf_dir):
    from ..grammar.samples import language
    from ..operators.code import infer_tags_query, tags

    return tags(query_sources(_snippets(spark, sf_dir), "lox", infer_tags_query(language("lox")))).select("doc_id", "kind", "name")


@query("code_grep", "SELECT p_partkey AS doc_id, 'f' || p_partkey AS fn FROM part WHERE contains('f' || p_partkey, '1')", forest=False)
def code_grep(spark, sf_dir):
    from ..grep.search import grep

    return grep(_snippets(spark, sf_dir), 'find lox::$F(1, $X) where { contains($F, "1") }').select("doc_id", F.col("captures")["F"].alias("fn"))


@query("code_rewrite", "SELECT p_partkey AS doc_id, 'import \"m' || (p_partkey % 9) || '\";' || chr(10) || 'fun f' || p_partkey || '(a, b) { if (a > ' || p_size || ') { print log(b); } return a * ' || p_size || '; } // ' || p_brand || chr(10) || 'var v = f' || p_partkey || '(1, \"' || p_type || '\");' AS text FROM part", forest=False)
def code_rewrite(spark, sf_dir):
    from ..grep.search import grep_replace

    return grep_replace(_snippets(spark, sf_dir), "find lox::g($X) replace { log($X) }").select("doc_id", "text")


@query("code_highlights", "SELECT p_partkey AS doc_id, 'comment' AS capture, CAST(3 + strlen(p_brand) AS BIGINT) AS bytes FROM part UNION ALL SELECT p_partkey, 'string', CAST(2 + strlen('m' || (p_partkey % 9)) + 2 + strlen(p_type) AS BIGINT) FROM part", forest=False)
def code_highlights(spark, sf_dir):
    from ..grammar.samples import lox_grammar
    from ..operators.code import highlight_sources, infer_highlight_query

    flat = highlight_sources(_snippets(spark, sf_dir), "lox", infer_highlight_query(lox_grammar()))
    return flat.where("capture in ('comment', 'string')").groupBy("doc_id", "capture").agg(F.sum(F.col("end_byte") - F.col("start_byte")).cast("long").alias("bytes"))


@query("import_rows", "SELECT p_partkey AS doc_id, 'import' AS kind, 'pkg' || p_size || '.mod' AS path, 'm' AS alias FROM part UNION ALL SELECT p_partkey, 'from', 'base.n' || p_size, '' FROM part", forest=False)
def import_rows(spark, sf_dir):
    from ..operators.imports import extract_imports

    part = table(spark, sf_dir, "part")
    text = F.format_string('"""import no"""\nimport pkg%d.mod as m  # import not\nfrom base import (\n  n%d,\n)\n', "p_size", "p_size")
    docs = part.select(F.col("p_partkey").alias("doc_id"), F.lit("python").alias("lang"), text.alias("text"))
    return extract_imports(docs).select("doc_id", "kind", "path", "alias")


@query("edit_stream_final", "SELECT user_id AS doc_id, CAST(count(*) AS BIGINT) AS n_edits, string_agg(event_type || ';', '' ORDER BY event_id DESC) AS text FROM events GROUP BY 1", forest=False)
def edit_stream_final(spark, sf_dir):
    from ..streaming.edits import final_texts

    edits = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("version"), F.lit(0).alias("start_byte"), F.lit(0).alias("old_end_byte"), F.concat("event_type", F.lit(";")).alias("new_text"))
    return final_texts(edits).select("doc_id", F.col("n_edits").cast("long").alias("n_edits"), "text")


from . import languages, lookups  # noqa: E402, F401 - register their queries here
