import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from treeql.llm import gbt, quality
from treeql.llm import language_id as L

from .cases import SCHEMA, awkward, clashing

SYLLABLES = {"en": ["th", "ing", "on", "the", "er"], "fr": ["eau", "oi", "é", "ch", "que"], "de": ["sch", "ung", "ü", "ei", "keit"], "es": ["ción", "ñ", "ll", "ado", "ar"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_held_out_languages(spark):
    rng = random.Random(1)
    rows = [(i, text(rng, lang, rng.randint(8, 60)), lang, "a", 0) for i in range(400) for lang in [rng.choice(list(SYLLABLES))]]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in L.identify(clashing(docs)).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, *_ in rows)
    held = [(got[i].lang_pred, lang) for i, _, lang, *_ in rows if got[i].held_out]
    assert np.mean([a == b for a, b in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_labels_of_the_held_out_fold_do_not_matter(spark):
    rng = random.Random(2)
    rows = [(i, text(rng, lang, 20), lang, "a", 0) for i in range(200) for lang in [rng.choice(list(SYLLABLES))]]
    other = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 4 == 2 else lang, s, n) for i, t, lang, s, n in rows]
    a, b = (sorted(map(tuple, L.identify(spark.createDataFrame(r, SCHEMA)).collect())) for r in (rows, other))
    assert a == b


def test_language_awkward(spark):
    got = [tuple(r) for r in L.identify(awkward(spark)).collect()]
    assert len(got) == 12
    by_id = {g[0]: g for g in got}
    assert [by_id[i][2] for i in (1, 2, 3, 9, 10)] == ["und"] * 5
    assert by_id[4][2] != "und"
    assert L.identify(spark.createDataFrame([], SCHEMA)).count() == 0
    unlabelled = spark.createDataFrame([(1, "abc", None, "a", 3)], SCHEMA)
    assert [r.lang_pred for r in L.identify(unlabelled).collect()] == ["und"]


def test_codewords_are_apart():
    for n in (2, 3, 4, 6, 7, 20, 60):
        code = L.codewords(n).astype(int)
        assert len({tuple(c) for c in code}) == n
        assert min((a != b).sum() for i, a in enumerate(code) for b in code[:i]) >= (1 if n == 2 else 2)


def test_trees_learn_and_flatten():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 6))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] * x[:, 2] > 0)).astype(float)
    model = gbt.fit(x[:2000], y[:2000], trees=60, depth=4)
    assert ((model.probability(x[2000:]) > 0.5) == y[2000:]).mean() > 0.93
    assert gbt.fit(x, np.ones(3000)).probability(x)[0] > 0.99


def test_flattened_trees_equal_a_walk_of_each_row():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 4)).round(1)
    model = gbt.fit(x, (x[:, 0] + x[:, 1] > 0).astype(float), trees=20, depth=3)

    def walk(row):
        margin = model.base
        for feature, threshold, value in zip(model.feature, model.threshold, model.value):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            margin += value[node - len(feature)]
        return margin

    assert np.allclose(model.margin(x), [walk(row) for row in x])


def test_shares_and_decoding_equal_brute_force():
    texts = ["", "a", "Äb ab\tAB ab", "xyz " * 300]
    for text, row in zip(texts, L.shares([t.encode() for t in texts])):
        data = (b" " + text.encode() + b" ").translate(bytes(32 if c in b"\t\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256)))
        count = Counter()
        for n in (2, 3, 4):
            for i in range(len(data) - n + 1):
                value = 0
                for byte in data[i : i + n]:
                    value = (value * 257 + byte) % 2**32
                count[(value * 2654435769 % 2**32) >> 19] += 1
        want = np.zeros(L.BUCKETS)
        want[list(count)] = list(count.values())
        assert np.allclose(row, want / max(want.sum(), 1))
    rng = np.random.default_rng(3)
    code = L.codewords(5)
    model = L.Model(list("abcde"), code, rng.normal(size=(6, code.shape[1])), rng.normal(size=code.shape[1]), np.ones(code.shape[1]), rng.uniform(0.5, 2, code.shape[1]))
    x = rng.normal(size=(50, 6))
    who, score, ambiguous = model.decode(x)
    for i, row in enumerate(x):
        margins = np.clip(row @ model.weights - model.centre, -8, 8)
        loss = [sum(t * np.log(1 + np.exp(-m * (1 if bit else -1))) for t, m, bit in zip(model.trust, margins, word)) for word in code]
        p = np.exp(-np.array(loss)) / np.exp(-np.array(loss)).sum()
        assert who[i] == p.argmax() and np.isclose(score[i], p.max()) and ambiguous[i] == (sorted(p)[-1] - sorted(p)[-2] < L.MARGIN)


def test_a_rare_language_is_learnt_from_all_its_rows(spark):
    rng = random.Random(6)
    rows = [(i, text(rng, "en", 20), "en", "a", 0) for i in range(400)] + [(1000 + i, text(rng, "de", 20), "de", "a", 0) for i in range(12)]
    got = L.identify(spark.createDataFrame(rows, SCHEMA), max_train_rows=20).collect()
    assert np.mean([r.lang_pred == ("de" if r.doc_id >= 1000 else "en") for r in got]) > 0.95


SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_held_out_rows_of_the_given_tables(spark):
    docs, marks = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    known = {r.doc_id: r.lang for r in docs.where("lang is not null").collect()}
    got = [r for r in L.identify(docs).collect() if r.held_out and r.doc_id in known and r.lang_pred != L.UNKNOWN]
    assert np.mean([r.lang_pred == known[r.doc_id] for r in got]) > 0.97
    quality_of = {r.doc_id: r.quality for r in marks.collect()}
    got = [r for r in quality.quality_scores(docs, marks).collect() if r.held_out and r.doc_id in quality_of]
    assert np.mean([r.predicted == quality_of[r.doc_id] for r in got]) > 0.9


def quality_rows(n):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        t = text(rng, "en", 40) if good else " ".join(w + "***" for w in text(rng, "en", 40).split())
        rows.append((i, t, "en", "a", 0))
        labels.append((i, int(good), 0))
    return rows, labels


def test_quality_on_held_out_rows(spark):
    rows, labels = quality_rows(300)
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.quality_scores(clashing(docs), marks).collect()}
    held = [i for i, r in got.items() if r.held_out]
    assert held == [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i].predicted == labels[i][1] for i in held]) > 0.95


def test_quality_awkward(spark):
    marks = spark.createDataFrame([(4, 1, 0), (4, 0, 0), (6, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality_scores(awkward(spark), marks).collect()
    assert len(got) == 12 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.quality_scores(awkward(spark), none).collect()} == {0.5}
    assert quality.quality_scores(spark.createDataFrame([], SCHEMA), none).count() == 0
