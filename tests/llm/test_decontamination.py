import random

from hypothesis import given, settings
from hypothesis import strategies as st

from treeql.llm import decontamination as D

from .cases import SCHEMA, awkward, clashing


def brute(item, text):
    """The least edit distance of `item` to any passage of `text`, by the usual table."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        now = [0]
        for i, x in enumerate(item, 1):
            now.append(min(row[i] + 1, now[-1] + 1, row[i - 1] + (x != c)))
        row = now
        best = min(best, row[-1])
    return best


@settings(max_examples=200, deadline=None)
@given(st.text("ab ", min_size=1, max_size=20), st.text("abc ", max_size=60))
def test_myers(item, text):
    assert D.nearest(D._masks(item), len(item), text)[0] == brute(item, text)


@settings(max_examples=200, deadline=None)
@given(st.text("abcd ", min_size=1, max_size=30), st.text("abcd ", max_size=120), st.sampled_from([0.0, 0.1, 0.3]))
def test_pigeonhole_misses_nothing(item, text, rate):
    folded = D.fold(item).strip()
    k = D.budget(len(folded), rate)
    found = list(D.Matcher([(1, item)], rate).find(text))
    least = brute(folded, D.fold(text)) if folded else None
    if folded and text and least <= k:
        (_, distance, start, end), = found
        assert distance == least and brute(folded, D.fold(text)[start:end]) == distance
    else:
        assert not found


def test_planted_passages(spark):
    rng = random.Random(5)
    make = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    items = [(i, make(30)) for i in range(6)] + [(6, None), (7, " ")]
    edited = list(items[1][1].upper())
    for i in (3, 40, 90):
        edited[i] = "z"
    rows = [(100, make(50) + " " + items[0][1] + " " + make(20), "en", "a", 0), (101, "".join(edited).replace(" ", "\n"), "en", "a", 0), (102, make(200), "en", "a", 0)]
    docs, bench = awkward(spark, rows), spark.createDataFrame(items, "item_id int, text string")
    for size in (D.BLOCK_CHARS, 200):
        got = {(r.doc_id, r.item_id): r.distance for r in D.contaminated(clashing(docs), bench, block_chars=size).collect()}
        assert got == {(100, 0): 0, (101, 1): 3}
        kept = D.drop_contaminated(clashing(docs), bench, block_chars=size)
        assert kept.columns == clashing(docs).columns
        assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(r.doc_id or -1 for r in docs.collect() if r.doc_id not in (100, 101))


def test_runs_of_blanks_count_as_one(spark):
    item = "which of these four cities lies farthest north of the river and its three bridges"
    texts = [(i, "Before   it.  " + item.replace(" ", gap) + gap + "after") for i, gap in enumerate(["  ", "\r\n", "\n\n    ", " "])] + [(9, "of the river  and its")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    for asked in (item, item.replace(" ", "\t ")):
        bench = spark.createDataFrame([(1, asked)], "item_id int, text string")
        got = {r.doc_id: (r.distance, texts[r.doc_id][1][r.start_char : r.end_char].split()) for r in D.contaminated(docs, bench).collect()}
        assert got == {i: (0, item.split()) for i in range(4)}
        assert [r.doc_id for r in D.drop_contaminated(docs, bench).collect()] == [9]


def test_empty_tables(spark):
    none, bench = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "item_id long, text string")
    assert D.contaminated(none, bench).count() == 0
    assert D.contaminated(awkward(spark), bench).count() == 0
    assert D.drop_contaminated(awkward(spark), bench).count() == 12
