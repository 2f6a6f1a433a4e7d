import numpy as np
from pyspark.sql import functions as F

from treeql.llm import token_counts as T

from .cases import SCHEMA, awkward, clashing


def encoder():
    with open(T.VOCABULARY, "rb") as f:
        return T._encoder("test", f.read())


def test_counts_equal_encoding(spark):
    docs = awkward(spark, [(i, f"document {i} " * (i % 17), "en", "a", 0) for i in range(100, 160)])
    want = sorted((r.doc_id or -1, len(encoder().encode_ordinary(r.text or ""))) for r in docs.collect())
    for block in (3, 64, T.BLOCK_TOKENS):
        got = T.token_counts(clashing(docs).repartition(3), block_tokens=block)
        assert sorted((r.doc_id or -1, r.n_tokens) for r in got.collect()) == want


def test_round_trip_of_blocks(spark):
    docs = awkward(spark).where("doc_id is not null").coalesce(1)
    blocks, order = T.token_blocks(docs, block_tokens=50)
    ids = np.frombuffer(b"".join(r.payload for r in blocks.orderBy("shard", "block").collect()), "<u2")
    texts = [encoder().decode(list(part[:-1])) for part in np.split(ids, np.flatnonzero(ids == T.END) + 1)[:-1]]
    places = sorted((r.ordinal, r.id) for r in order.collect())
    want = {(r.doc_id, r.text or "") for r in docs.collect()}
    assert {(i, texts[k]) for k, i in places} == want and len(texts) == docs.count()


def test_flat_files(spark, tmp_path):
    data = np.array([5, 6, 9, 9, 7, 7, 7, 9, 8], "<u2")
    (tmp_path / "a.bin").write_bytes(data.tobytes())
    (tmp_path / "b.bin").write_bytes(np.array([9], "<u2").tobytes() + b"x")
    (tmp_path / "c %41.bin").write_bytes(b"")
    for block in (1, 2, 4, 100):
        rows = T.separator_scan(T.flat_blocks(spark, str(tmp_path), block_tokens=block), end=9)
        got = sorted((r.shard[-5:], r.ordinal, r.n_tokens, r.finished) for r in rows.collect())
        assert got == [("a.bin", 0, 2, True), ("a.bin", 1, 0, True), ("a.bin", 2, 3, True), ("a.bin", 3, 1, False), ("b.bin", 0, 0, True)]


def test_empty_table(spark):
    assert T.token_counts(spark.createDataFrame([], SCHEMA)).agg(F.count("*")).first()[0] == 0
