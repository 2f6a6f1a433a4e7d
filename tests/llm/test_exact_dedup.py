import hashlib
import random
from collections import defaultdict

from treeql.llm import exact_dedup as D

from .cases import SCHEMA, awkward, clashing, spark_rows, sql_rows


def test_trie_keeps_all_strings():
    rng = random.Random(2)
    trie, want = D.PatriciaTrie(), defaultdict(lambda: [None, 0])
    for i in range(3000):
        key = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 9)))
        trie.insert(key, [i, 1, 1])
        want[key][0] = i
        want[key][1] += 1
    got = {k: [v[0], v[2]] for k, v in trie.clear()}
    assert got == dict(want)


def test_spill_loses_nothing():
    trie, out = D.PatriciaTrie(), defaultdict(int)
    for i in range(4000):
        trie.insert(b"head" + str(i % 900).encode() * 3, [i, 1, 1])
        if trie.held > 20_000:
            for k, v in trie.spill(10_000):
                out[k] += v[2]
            assert trie.held <= 10_000
    for k, v in trie.clear():
        out[k] += v[2]
    assert sum(out.values()) == 4000 and len(out) == 900


def test_equals_sql(spark):
    docs = awkward(spark, [(i, f"text {i % 7}", "en", "a", 0) for i in range(100, 200)], repeated=False).where("doc_id is not null")
    for budget in (D.TRIE_BYTES, 500):
        assert spark_rows(D.exact_dedup(clashing(docs), trie_bytes=budget)) == sql_rows(D.ORACLE, documents=docs)


def test_ties_leave_one(spark):
    rows = D.exact_dedup(awkward(spark)).collect()
    by_text = defaultdict(list)
    for r in rows:
        by_text[r.text_sha256].append(r)
    assert all(sum(r.kept for r in group) == 1 and {r.group_size for r in group} == {len(group)} for group in by_text.values())
    assert [r.keep_id for r in rows if r.doc_id == 4] == [5, 5]
    assert by_text[hashlib.sha256(b"").hexdigest()][0].keep_id == 9
    twice = spark.createDataFrame([(1, "t"), (1, "t"), (1, "t")], "doc_id long, text string")
    assert sorted(r.kept for r in D.exact_dedup(twice).collect()) == [False, False, True]


def test_empty_table(spark):
    assert D.exact_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
