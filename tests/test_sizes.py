"""Plans whose tasks and driver must not grow with their input."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import treeql.functions as functions
from treeql import partitions
from treeql.grammar.samples import parser
from treeql.operators import navigation as nav
from treeql.operators import spans
from treeql.operators.parse import parse
from treeql.plans import catalogue, lookups
from treeql.sources import walk as sources
from treeql.sources.walk import Policy, stats, walk

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_are_not_broadcast(spark):
    """Small sides too: their files say little about their rows."""
    docs = spark.createDataFrame([(1, "[1]"), (2, "[2]")], "doc_id long, text string")
    ranges = docs.select("doc_id", F.lit(0).alias("start_byte"), F.lit(1).alias("end_byte"))
    units = docs.select("doc_id", F.lit(0).alias("start_unit"), F.lit(1).alias("end_unit"))
    for df in (spans.to_utf16_ranges(ranges, docs), spans.from_utf16_ranges(units, docs), catalogue.QUERIES["descendant_utf16"](spark, SF), catalogue.QUERIES["updated_nodes"](spark, SF)):
        assert "Broadcast" not in plan(df)


def _walked(spark, root, **policy):
    return sorted((r.path.rsplit("/", 1)[1], r.lang, r.size, r.is_binary, r.text) for r in walk(spark, str(root), Policy(**policy)).collect())


def test_a_table_of_part_files_counts_as_one(spark, tmp_path):
    """Whether a table is a file or a folder of part files."""
    for name in ("a.parquet", "b.parquet/part-0.parquet", "b.parquet/c.parquet/part-1.parquet", "d/e.json"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"PAR1\0" if "parquet" in name else b"[1]")
    assert _walked(spark, tmp_path, as_one=(".parquet",)) == [("a.parquet", None, 5, True, None), ("b.parquet", None, 10, True, None), ("e.json", "json", 3, False, "[1]")]
    assert [r.name for r in catalogue.QUERIES["walked_files"](spark, str(tmp_path)).orderBy("name").collect()] == ["a.parquet", "b.parquet"]
    assert tuple(catalogue.QUERIES["walk_stats"](spark, str(tmp_path)).first()) == (2, 0, 2)


def test_large_files_show_by_their_heads(spark, tmp_path, monkeypatch):
    """A file of over 2 GB is no value of a column, and a walk that needs no text doesn't read it."""
    for name, data in {"a.json": b"[1]", "b [1].bin": b"a\0b" * 10, "run": b"#!" + b" " * 10_000 + b"/bin/sh\nexit", "c*": b"x" * 9000 + b"\0"}.items():
        (tmp_path / name).write_bytes(data)
    whole = _walked(spark, tmp_path)
    monkeypatch.setattr(sources, "WHOLE_BYTES", 4)
    assert _walked(spark, tmp_path) == whole and [x[1] for x in whole] == ["json", None, None, "bash"]
    monkeypatch.undo()
    with (tmp_path / "huge.bin").open("wb") as f:
        f.truncate((2 << 30) + 5)
    assert tuple(stats(walk(spark, str(tmp_path))).first()[:3]) == (5, 1, 2)


def test_roots_of_ranges_without_comparing_all(spark):
    """As the smallest of all nodes that hold a range; empty ranges at borders and empty nodes too."""
    nodes = parse(spark.createDataFrame([(1, '{"a": [1, ""], "b": [] , "c": [[]]}'), (2, "[1,"), (3, "[[[7]]]")], "doc_id long, text string"), "json").cache()
    ranges = spark.createDataFrame([(d, s * 100 + e, s, e) for d in (1, 2, 3) for s in range(36) for e in range(s, 37)], "doc_id long, range_id int, s int, e int")
    hold = nodes.select("doc_id", "node_id", "type", "start_byte", "end_byte").join(ranges, "doc_id").where("start_byte <= s and end_byte >= e")
    best = F.min_by(F.struct("node_id", "type"), F.struct(F.col("end_byte") - F.col("start_byte"), "node_id"))
    want = sorted(tuple(r) for r in hold.groupBy("doc_id", "range_id").agg(best.alias("n")).select("doc_id", "range_id", "n.node_id", "n.type").collect())
    found = nav.match_root(nodes, ranges)
    assert sorted(tuple(r) for r in found.collect()) == want
    assert "Join" not in plan(found)


def test_sorted_partitions_grow_with_the_files(spark, monkeypatch):
    monkeypatch.setattr(partitions, "SORTED_BYTES", 1000)
    for name in ("changed_ranges", "ranges_coalesce", "named_counts"):
        assert "REPARTITION_BY_NUM" in plan(catalogue.QUERIES[name](spark, SF))


def test_small_scans_and_joins_are_spread(spark, monkeypatch):
    for name in ("parse_ranges", "parse_runtime", "parse_limits", "table_functions", "updated_highlights_utf16"):
        assert "RoundRobinPartitioning" in plan(catalogue.QUERIES[name](spark, SF)), name


def test_table_functions_parse_equal_texts_once(monkeypatch):
    calls = []
    monkeypatch.setattr(functions, "parser", lambda lang: calls.append(lang) or parser(lang))
    for made, args in ((functions.RunQuery(), ("[1]", "json", "(number) @n")), (functions.Tokenize(), ("[1]", "json"))):
        assert list(made.eval(*args)) == list(made.eval(*args)) != []
    found = functions.ParseNodes()
    assert [r[0] for r in [*found.eval(1, "[1]", "json"), *found.eval(2, "[1]", "json")] if r[2] is None] == [1, 2]
    assert len(calls) == 3


def test_texts_reach_python_in_bounded_batches(spark):
    """However many rows a partition has: 40 texts of 1 MB don't come at once."""
    conf = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(conf)
    spark.conf.set(conf, str(256 << 20))
    try:
        docs = partitions.spread(spark.range(0, 40, 1, 4).select(F.col("id").alias("doc_id"), F.expr("repeat('[1, 2]  ', 131072)").alias("text")).coalesce(1))
        counted = docs.coalesce(1).mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long")
        sizes = [r.n for r in counted.collect()]
    finally:
        spark.conf.set(conf, before)
    assert sum(sizes) == 40 and max(sizes) <= 10


def test_kept_results_are_bounded_by_their_rows(monkeypatch):
    """A text's results may weigh far more than the text."""
    monkeypatch.setattr(partitions, "KEPT_ROWS", 10)
    calls = []
    once = partitions.Once(lambda text: calls.append(text) or [0] * int(text), len)
    for text in (b"4", b"5", b"4", b"11", b"11", b"4", b"6", b"4"):
        assert len(once(text)) == int(text)
        assert sum(map(len, once._kept.values())) <= 10
    assert calls == [b"4", b"5", b"11", b"11", b"6", b"4"]


@pytest.mark.parametrize("named", [False, True])
def test_smallest_nodes_by_batches_as_by_rows(spark, monkeypatch, named):
    """Whatever a batch holds: parts of documents, ranges alone, documents without nodes or ranges, trees that lack nodes."""
    texts = ['[1, [2, {"a": [3, {}]}], "x"]', "7", "[[[[[[8]]]]], []]", '{"k":[[],[[]],""]}', "", "[1,"]
    nodes = parse(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "json").cache()
    ranges = spark.createDataFrame([(d, s * 100 + e, s, e) for d in range(7) for s in range(31) for e in range(s, 32)], "doc_id long, range_id int, s int, e int").where("doc_id <> 1")
    by_rows = []
    climb = nav._climbed
    for given in (nodes, nodes.where("node_id % 5 <> 3"), nodes.withColumn("last_desc", F.when(F.col("node_id") == 2, 9).otherwise(F.col("last_desc")))):
        events = [b for b in given.sparkSession.createDataFrame(nav._events(given, ranges).orderBy("doc_id", "at", "kind", "node_id", "end").collect(), nav._events(given, ranges).schema).toArrow().to_batches()]
        table = pa.Table.from_batches(events).combine_chunks()

        class Given:
            schema = nav._events(given, ranges).schema

            @staticmethod
            def mapInArrow(run, ddl):
                return [[r for b in run(iter(table.to_batches(max_chunksize=n))) for r in zip(*(c.to_pylist() for c in b.columns))] for n in (1, 2, 3, 7, 50, 100_000)]

        monkeypatch.setattr(nav, "_climbed", climb)
        found = nav._smallest(Given, named)
        monkeypatch.setattr(nav, "_climbed", lambda *a: None)
        want = nav._smallest(Given, named)
        assert found == want and len(want[0]) > 300
        by_rows.append(want[0])
    assert by_rows[0] != by_rows[1]


def test_batches_of_trees_are_not_read_row_by_row():
    """Each document's open nodes come from sorting: two documents, the first one of them begun in the batch before."""
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 1, 2, 2, 2], "kind": pa.array([0, 1, 0, 0, 1], pa.int32()), "node_id": pa.array([5, None, 0, 1, None], pa.int32()), "last_desc": pa.array([5, None, 1, 1, None], pa.int32()), "end": [12, 14, 4, 3, 3], "type": ["item", None, "a", "b", None], "fits": [True, None, True, False, None], "range_id": pa.array([None, 5, None, None, 1], pa.int32())})
    held = [(9, 20, 0, "top", True), (6, 14, 4, "order", True)]
    for named, nodes in ((False, [4, 1]), (True, [4, 0])):
        take, _, node, after = nav._climbed(held, batch, named)
        assert (take.tolist(), node.tolist(), after) == ([1, 4], nodes, [(1, 4, 0, "a", True), (1, 3, 1, "b", False)])


def test_ranges_of_nodes_come_with_their_trees(spark):
    """Read once for both: as many scans as the nodes alone need, and rows as from a table of ranges."""
    for name, named in (("descendant_for_range", False), ("named_descendant_for_range", True)):
        nodes = catalogue.customer_forest(spark, SF)
        nodes = nodes.withColumn("is_named", F.col("type") != "item") if named else nodes
        got = catalogue.QUERIES[name](spark, SF)
        apart = nav.smallest_containing(nodes, lookups._spread_ranges(nodes), named)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, apart.collect()))
        scans = [plan(df).split("Initial Plan")[-1].count("FileScan") for df in (catalogue.QUERIES[name](spark, SF), nodes)]
        assert scans[0] <= scans[1]


def test_highlights_are_flattened_where_they_are_found(spark):
    """No shuffle of captures, and the stretches that a shuffle by document gives; with patterns of lone nodes and with others."""
    from treeql.grammar.samples import lox_grammar
    from treeql.operators.code import highlight, highlight_sources, infer_highlight_query
    from treeql.query.execute import query_sources

    texts = ['fun f(a) { return "é" + a; } // c\nvar v = f(1, nil);', "", None, "var = 1 $ (", 'print "x";', 'print "x";', "// only"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    lone = infer_highlight_query(lox_grammar())
    for query in (lone, lone + '\n(call_expression (identifier) @function)\n((string) @s (#eq? @s "\\"x\\""))\n(_)+ @any'):
        found, want = highlight_sources(docs, "lox", query), highlight(query_sources(docs, "lox", query))
        assert found.columns == want.columns and sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
        assert len({r.doc_id for r in found.collect()}) == 5
    assert plan(catalogue.QUERIES["code_highlights"](spark, SF)).count("MapInArrow") == 1
