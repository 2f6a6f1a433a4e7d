import random
import time

from pyspark.sql import functions as F

import treeql.functions as functions
from treeql.sources import languages as L
from treeql.sources.walk import Policy, parse_files, stats, walk
from treeql.streaming.edits import edited_texts, final_texts


def test_detection(spark):
    paths = {"a/b.json": "json", "x/Makefile": "make", "q.PY": "python", "BUILD": "starlark", "a.test.go": "go", "none": None, "a.zzz": None}
    got = spark.createDataFrame([(p,) for p in paths], "p string").select("p", L.detect_language(F.col("p")).alias("l")).collect()
    assert {r.p: r.l for r in got} == paths
    lines = {"#!/usr/bin/env -S FOO=1 python3 -u": "python", "#!/bin/bash": "bash", "#! /usr/bin/env node": "javascript", "plain": None}
    got = spark.createDataFrame([(x,) for x in lines], "p string").select("p", L.detect_by_shebang(F.col("p")).alias("l")).collect()
    assert {r.p: r.l for r in got} == lines
    got = spark.createDataFrame([(" Golang ",), ("JSON",), ("what",)], "p string").select(L.detect_by_name(F.col("p")))
    assert [r[0] for r in got.collect()] == ["go", "json", None]
    assert L.display_name("some_lang") == "Some Lang" and L.languages(spark).where("has_grammar").count() == 4


def test_walk(spark, tmp_path):
    for name, data in {"a.json": b"[1]", "sub/b.lox": b"var x = 1;", "node_modules/c.json": b"[2]", "d.min.js": b"x", "e.bin": b"a\0b", "run": b"#!/bin/sh\n", "big.json": b"[" + b"1," * 200_000 + b"1]"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    files = walk(spark, str(tmp_path), Policy(should_parse=F.col("length") < 10_000_000)).cache()
    assert sorted((r.path.rsplit("/", 1)[1], r.lang, r.is_binary, r.is_large) for r in files.collect()) == [
        ("a.json", "json", False, False), ("b.lox", "lox", False, False), ("big.json", "json", False, True), ("e.bin", None, True, False), ("run", "bash", False, False),
    ]
    s = stats(files).first()
    assert (s.found, s.parsed, s.binary, s.large) == (5, 3, 1, 1)
    assert parse_files(files.where("not is_large")).where("type = 'number'").count() == 2


def test_stream_equals_batch(spark, tmp_path):
    """Edits out of order and repeated, over several batches."""
    rng = random.Random(2)
    rows = [(rng.randrange(3), v, a := rng.randrange(10), a + rng.randrange(4), f"t{v}é") for v in range(60)]
    schema = "doc_id long, version long, start_byte int, old_end_byte int, new_text string"
    came = rows + rng.sample(rows, 20)
    rng.shuffle(came)
    for kept in (1000, 4):
        source, last, late = tmp_path / f"in{kept}", {}, [0]
        for k in range(4):
            spark.createDataFrame(came[20 * k : 20 * k + 20], schema).coalesce(1).write.mode("append").parquet(str(source))

        def take(df, _, last=last, late=late):
            for r in df.collect():
                last[r.doc_id] = r.version, r.text
                late[0] += r.n_late

        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
        writer = edited_texts(stream, kept).writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / f"ck{kept}"))
        query = writer.trigger(availableNow=True).start()
        assert query.awaitTermination(60)
        want = {r.doc_id: (r.version, r.text) for r in final_texts(spark.createDataFrame(came, schema)).collect()}
        if kept == 1000:
            assert last == want and not late[0]
        else:
            assert set(last) == set(want) and late[0] > 0  # what can't be placed is counted


def test_idle_documents_leave_the_state(spark, tmp_path):
    """A stream with a time-out has no end of its own: it runs until the second edit of the document starts anew."""
    schema = "doc_id long, version long, start_byte int, old_end_byte int, new_text string"
    source, seen = tmp_path / "in", []
    add = lambda v: spark.createDataFrame([(1, v, 0, 0, f"t{v}")], schema).coalesce(1).write.mode("append").parquet(str(source))
    add(1)
    stream = spark.readStream.schema(schema).parquet(str(source))
    out = edited_texts(stream, idle_ms=1000).writeStream.foreachBatch(lambda df, _: seen.extend(r.text for r in df.collect()))
    query = out.option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="500 milliseconds").start()
    try:
        until = time.time() + 60
        while not seen and time.time() < until:
            time.sleep(0.2)
        time.sleep(8)
        add(2)
        while len(seen) < 2 and time.time() < until:
            time.sleep(0.2)
    finally:
        query.stop()
    assert seen == ["t1", "t2"]


def test_table_functions(spark):
    functions.register(spark)
    spark.createDataFrame([(1, "[1, 2]")], "id long, t string").createOrReplaceTempView("texts")
    assert spark.sql("SELECT type, text FROM texts, LATERAL parse_nodes(id, t, 'json') WHERE type = 'number' ORDER BY text").collect() == [("number", "1"), ("number", "2")]
    assert spark.sql("SELECT text FROM texts, LATERAL run_query(t, 'json', '(array (number) @n .)')").collect() == [("2",)]
    assert spark.sql("SELECT path FROM LATERAL extract_imports('import os', 'python')").collect() == [("os",)]
