import random
from collections import Counter, defaultdict

import numpy as np

from treeql.llm import ngram_join as J
from treeql.llm import substring_dedup as S
from treeql.llm import tokens

from .cases import SCHEMA, WORD, awkward, clashing, spark_rows, sql_rows, words


def test_word_hashes():
    texts = [b"", b"  ", "a b\ta  été x".encode(), b"x" * 3_000_000 + b" y", b"word " * 700_000, b"a"]
    hashes, offsets = tokens.word_hashes(texts)
    counts = [len(WORD.findall(t.decode())) for t in texts]
    assert list(np.diff(offsets)) == counts
    assert hashes[0] == hashes[2] == hashes[-1] != hashes[1]
    seen = {}
    for i, t in enumerate(texts):
        for w, h in zip(WORD.findall(t.decode())[:1000], hashes[offsets[i] :]):
            assert seen.setdefault(w, h) == h


def grams(text):
    w = WORD.findall(text or "")
    return frozenset(zip(*[w[i:] for i in range(5)])) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def links(rows):
    sets = {i: grams(t) for i, t in rows}
    inverted = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            inverted[g].append(i)
    count, root = Counter(), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in sets.items():
        for j, n in Counter(j for g in s for j in inverted[g] if j > i).items():
            if n >= 0.8 * (len(s) + len(sets[j]) - n) - 1e-9:
                count[i] += 1
                count[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (count[i], find(i)) for i in sets}


def test_join_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_SETS", 16)  # large groups fall into several blocks
    rng = random.Random(7)
    rows, base = [], [words(rng, 80).split() for _ in range(5)]
    for i in range(200):
        copy = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            copy[rng.randrange(80)] = f"edit{rng.randrange(9)}"
        rows.append((1000 + i, " ".join(copy), "en", "a", 0))
    docs = awkward(spark, rows, repeated=False).where("doc_id is not null")
    want = links([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.doc_id: (r.n_links, r.class_id) for r in J.ngram_join(clashing(docs)).collect()}
    assert got == want
    kept = J.keep_one_per_group(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, root) in want.items() if i == root)


def thue_morse(n, a, b):
    return "".join(a if i.bit_count() % 2 == 0 else b for i in range(n))


#: Words of one letter pattern and its complement, which polynomial hashes of bytes can't tell apart.
PATTERNS = [(thue_morse(n, "a", "b"), thue_morse(n, "b", "a")) for n in (1024, 2048, 4096, 8192)]


def test_patterned_words_have_hashes_of_their_own():
    for a, b in PATTERNS:
        assert len(set(tokens.word_hashes([a.encode(), b.encode()])[0].tolist())) == 2


def test_join_of_patterned_words(spark):
    rng = random.Random(5)
    rows = []
    for k, (a, b) in enumerate(PATTERNS):
        rest = words(rng, 3)
        rows += [(10 * k + i, f"{w} {rest}", "en", "a", 0) for i, w in enumerate((a, b))]
        long = words(rng, 30)
        rows += [(10 * k + 2 + i, f"{w} {long}", "en", "a", 0) for i, w in enumerate((a, b))]
    want = links([(r[0], r[1]) for r in rows])
    docs = spark.createDataFrame(rows, SCHEMA)
    assert {r.doc_id: (r.n_links, r.class_id) for r in J.ngram_join(docs).collect()} == want
    assert any(n for n, _ in want.values()) and not all(n for n, _ in want.values())


def test_one_identifier_with_several_texts(spark):
    rng = random.Random(6)
    base, other = words(rng, 60), words(rng, 60)
    near = base + " tail"
    rows = [(1, base, "en", "a", 0), (7, near, "en", "a", 0), (7, other, "en", "a", 0), (7, near, "en", "a", 0), (1, base, "en", "b", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted((r.doc_id, r.text) for r in J.keep_one_per_group(docs).collect()) == sorted([(1, base), (1, base), (7, other)])
    got = sorted((r.doc_id, r.class_id, r.copy_of, r.n_copies, r.n_links) for r in J.ngram_join(docs).collect())
    assert got == [(1, 1, 1, 2, 3)] * 2 + [(7, 1, 7, 2, 3)] * 2 + [(7, 7, 7, 1, 0)]


def test_join_awkward(spark):
    got = J.ngram_join(awkward(spark)).collect()
    assert len(got) == 12
    by_id = {r.doc_id: r for r in got}
    assert by_id[5].class_id == 4 and by_id[5].n_copies == 3 and by_id[4].n_links == 2
    assert all(by_id[i].class_id == i and by_id[i].n_links == 0 for i in (1, 2, 3, 6, 9))
    assert J.ngram_join(spark.createDataFrame([], SCHEMA)).count() == 0


def test_bands_reach_the_recall():
    for recall in (0.9, 0.99, 0.9995):
        bands, rows = J.choose_bands(0.8, recall, 360)
        assert 1 - (1 - 0.8**rows) ** bands >= recall and bands * rows <= 360


def windows(texts, size):
    docs = [WORD.findall(t) for t in texts]
    count = Counter(tuple(d[i : i + size]) for d in docs for i in range(len(d) - size + 1))
    return [{i for i in range(len(d) - size + 1) if count[tuple(d[i : i + size])] > 1} for d in docs]


def test_equal_windows_share_their_anchor():
    rng = random.Random(3)
    for _ in range(60):
        vocabulary, size = rng.choice([1, 2, 3, 20, 1000]), rng.choice([5, 12, 35])
        base = words(rng, 120, vocabulary).split()
        texts = []
        for _ in range(6):
            at = rng.randrange(100)
            texts.append(" ".join(words(rng, rng.randint(0, 60), vocabulary).split() + base[at : at + rng.randint(0, 90)] + words(rng, rng.randint(0, 60), vocabulary).split() * rng.randint(1, 3)))
        laid, wall, first, counts, starts = S._laid_out([t.encode() for t in texts], size)
        name, place = S.anchors(laid, wall, size)
        seen = {}
        for p in np.flatnonzero(starts):
            anchor = (name[p], place[p] - p) if place[p] >= 0 else None
            assert seen.setdefault(tuple(laid[p : p + size]), anchor) == anchor


def test_removal_equals_sql(spark):
    rng = random.Random(9)
    passage, rows = words(rng, 90).split(), []
    for i in range(60):
        at = rng.randrange(40)
        body = words(rng, rng.randint(0, 80)).split() + (passage[at : at + rng.randint(20, 60)] if i % 3 else []) + words(rng, rng.randint(0, 50)).split()
        rows.append((100 + i, "  ".join(body), "en", "a", 0))
    rows += [(200, "again " * 120, "en", "a", 0), (201, "a b c " * 50, "en", "a", 0), (202, rows[4][1], "en", "a", 0)]
    docs = awkward(spark, rows, repeated=False).where("doc_id is not null")
    assert spark_rows(S.remove_repeats(clashing(docs))) == sql_rows(S.ORACLE, documents=docs)


def test_digests_decide_whatever_the_names(monkeypatch):
    """With names of two bits, different passages share anchors all the time; their digests stay apart."""
    whole = tokens.word_hashes
    monkeypatch.setattr(S, "word_hashes", lambda texts: (whole(texts)[0] & np.uint64(3), whole(texts)[1]))
    rng = random.Random(2)
    texts = ["", " \n", words(rng, 3), *["  ".join(words(rng, rng.randint(30, 90), 3).split()) + rng.choice(["", " ", "\t\n"]) for _ in range(40)]]
    texts += [texts[5], texts[6] + " x"]
    text, _, d1, d2, a, b = S.segments([t.encode() for t in texts], 12)
    seen, back = {}, {}
    for t, x, y, i, j in zip(text, d1, d2, a, b):
        stretch = tuple(WORD.findall(texts[t])[i : j + 12])
        assert len(stretch) == j - i + 12
        assert seen.setdefault((x, y), stretch) == stretch and back.setdefault(stretch, (x, y)) == (x, y)
    assert len(seen) < len(text)


def test_removal_of_patterned_words_equals_sql(spark):
    rng = random.Random(4)
    rows = []
    for k, pair in enumerate(PATTERNS):
        rest = words(rng, 40)
        rows += [(10 * k + i, f"{w} {rest}", "en", "a", 0) for i, w in enumerate(pair)]
        rows += [(10 * k + 2 + i, " ".join([w] * 36), "en", "a", 0) for i, w in enumerate(pair)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = spark_rows(S.remove_repeats(docs))
    assert got == sql_rows(S.ORACLE, documents=docs)
    assert {r["doc_id"]: r["n_removed"] for r in map(dict, got)}[0] == 40


def test_removal_awkward(spark):
    rng = random.Random(1)
    same = words(rng, 60)
    docs = awkward(spark, [(50, same, "en", "a", 0), (50, same, "en", "a", 0), (51, words(rng, 34), "en", "a", 0), (52, words(rng, 34), "en", "a", 0)])
    got = [r for r in S.remove_repeats(docs, with_text=True).collect()]
    assert len(got) == 16
    assert [(r.n_words, r.n_removed, r.kept_text) for r in got if r.doc_id == 50] == [(60, 60, "")] * 2
    assert all(r.n_removed == 0 for r in got if r.doc_id in (1, 2, 3, 51, 52))
    assert S.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
