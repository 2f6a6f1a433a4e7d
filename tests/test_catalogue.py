import os

import duckdb
import pytest

from treeql.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


LOOKUPS = (
    "dot_graph named_counts child_by_type error_counts syntax_errors typed_captures descendant_for_range named_descendant_for_range match_root utf16_offsets utf16_ranges utf16_edits points tokens_in_ranges shifted_by_edit "
    "changed_ranges edits_applied updated_nodes parse_utf16 parse_ranges parse_runtime table_functions shebangs import_rows_go_java_starlark diagnostics embedded_nodes tags_of_methods language_support tokens updated_tags updated_highlights_utf16"
).split()


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", ["forest_nodes", "axis_siblings", "sexpr", "walk_skip_children", "query_two_children", "query_plus_run", "pred_any_match", "dir_select_adjacent", "ranges_coalesce", "line_starts", "tree_diff", "json_pairs", "code_tags", "html_injections", "detect_language", "pred_has_ancestor", "pred_not_has_parent", "pred_is_exported", "where_clauses", "highlight_resolve", *LOOKUPS])
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = catalogue.QUERIES[name](spark, SF)
    cursor = con.execute(catalogue.ORACLES[name])
    names = [c[0] for c in cursor.description]
    order = sorted(names)
    assert order == sorted(df.columns)
    want = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr) == want


def test_entry_points():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_sql_ends_under_a_limit(name):
    """DuckDB 2.0 may hang on a limit over materialised CTEs."""
    import threading

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    timer = threading.Timer(30, con.interrupt)
    timer.start()
    con.execute(f"select * from ({catalogue.ORACLES[name]}) limit 1000000").fetchall()
    timer.cancel()
