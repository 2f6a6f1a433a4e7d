import random

import corpus_pipeline as C
from treeql.llm import registry

from .cases import SCHEMA, awkward, clashing, words
from .test_near_and_repeats import links


def corpus():
    rng = random.Random(8)
    rows = [(i, words(rng, 60), "en", f"s{i % 3}", 0) for i in range(40)]
    rows += [(100, rows[0][1], "en", "s1", 0), (101, rows[1][1] + " tail", "en", "s1", 0), (102, "123 ... 456", "en", "s0", 0), (103, None, None, None, None)]
    item = words(rng, 30, 90)
    rows += [(104, words(rng, 20) + " " + item + " " + words(rng, 20), "en", "s2", 0)]
    return rows, item


def test_each_stage_on_its_own_input(spark, tmp_path):
    rows, item = corpus()
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = {i: t for i, t, *_ in rows}
    want = []
    left = {i: t for i, t in left.items() if t and any(c.isalpha() for c in t)}
    want.append(set(left))
    last = {t: i for i, t in sorted(left.items())}
    left = {i: t for i, t in left.items() if last[t] == i}
    want.append(set(left))
    root = links(left.items())
    left = {i: t for i, t in left.items() if root[i][1] == i}
    want.append(set(left))
    left = {i: t for i, t in left.items() if item not in t}
    want.append(set(left))
    for (_, stage), ids in zip(C.STAGES, want):
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [f.name for f in SCHEMA.fields]
        assert {r.doc_id for r in docs.collect()} == ids
    mixed = C.STAGES[-1][1](spark, docs, str(tmp_path))
    assert mixed.columns[:5] == docs.columns and {"taken", "target"} <= set(mixed.columns)
    assert {r.doc_id for r in mixed.collect()} <= want[-1] and mixed.where("taken <= 0").count() == 0
    assert sorted(r.doc_id for r in C.run(spark, str(tmp_path)).collect()) == sorted(r.doc_id for r in mixed.collect())


def lay_out(spark, path, docs, items=((1, "an item that nothing holds at all"),)):
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return spark.read.parquet(f"{path}/documents.parquet")


def test_empty_table(spark, tmp_path):
    docs = lay_out(spark, tmp_path, spark.createDataFrame([], SCHEMA))
    for _, stage in C.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
    assert C.run(spark, str(tmp_path)).count() == 0


def test_nulls_repeated_rows_and_more_columns(spark, tmp_path):
    rng = random.Random(3)
    near = words(rng, 70)
    rows = [(20, near, "en", None, None), (21, near + " tail", "en", None, None), (21, words(rng, 70), None, "a", 1), (None, near + " end", "en", "a", 1)]
    docs = awkward(spark, rows).selectExpr("*", "1 as size", "'t' as Taken", "named_struct('a', cast(null as int)) as more", "array(1) as row")
    docs = lay_out(spark, tmp_path, docs)
    counts = []
    for name, stage in C.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "mixing":
            assert out.columns == docs.columns
        path = str(tmp_path / name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        counts.append(docs.count())
    # texts with letters: 4 (twice), 5, 6, None, 7, 8 and the four rows above; 5 stays for 4; the near copy under 21 goes, the other text under it doesn't
    assert counts[:4] == [11, 9, 8, 8]
    assert {"size", "Taken", "mix_size", "mix_taken", "target", "source_size"} <= set(docs.columns)
    assert sorted(map(str, C.run(spark, str(tmp_path)).collect())) == sorted(map(str, docs.collect()))


def test_columns_named_like_the_operators_own(spark, tmp_path):
    rows, _ = corpus()
    plain, other = tmp_path / "plain", tmp_path / "other"
    docs = spark.createDataFrame(rows, SCHEMA)
    lay_out(spark, plain, docs)
    lay_out(spark, other, clashing(docs))
    assert sorted(r.doc_id for r in C.run(spark, str(plain)).collect()) == sorted(r.doc_id for r in C.run(spark, str(other)).collect())


def test_one_query_for_each_operator():
    names = registry.queries()
    assert all(sum(k.startswith(f"op{n}_") for k in names) == 1 for n in range(1, 11))
    assert set(registry.oracle_sql()) <= set(names)
