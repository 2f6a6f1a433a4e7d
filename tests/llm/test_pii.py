import hashlib
import math
import random
import re

from treeql.llm import pii

from .cases import SCHEMA, awkward, clashing

PATTERNS = [
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def brute(text):
    found = []
    for rank, pattern in enumerate(PATTERNS):
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if [True, rank == 1 and all(int(x) <= 255 for x in m[0].split(".")), 12 <= len(digits) <= 19 and luhn(digits), 9 <= len(digits) <= 15][rank]:
                found.append((m.start(), rank, m.end()))
    found.sort()
    listed = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in found)
    return [sum(k == i for _, k, _ in found) for i in range(4)] + [hashlib.sha256(listed.encode()).hexdigest()]


def test_base_spans_equal_brute_force(spark):
    rng = random.Random(4)
    bits = list("aZ09._%+-@@..,:() \n") + ["+1 ", "4111 1111 1111 1111", "a@b.c", "1.2.3.4", "é", "😀", "+49 (30) 123-4567", "255.255.255.255"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["1.2.3.4 " * 1000, "a" * 100_000, "1" * 3000 + " ", "a@b" + ".c" * 20_000, "a@b.c_d@e.f %x@y.z" * 300]
    docs = awkward(spark, [(1000 + i, t, "en", "a", 0) for i, t in enumerate(texts)])
    want = sorted(([r.doc_id or -1, *brute(r.text)] for r in docs.collect()), key=repr)
    got = [[r.doc_id or -1, *r[1:6]] for r in pii.digest(pii.find_private(clashing(docs))).collect()]
    assert sorted(got, key=repr) == want


def test_disclosing_terms(spark):
    rows = [(i, f"word{i} filler text nothing zanzibar, contact person@corp.com now item{i} other") for i in range(6)]
    rows += [(100 + i, f"plain nothing other document text filler number{i} {'contact' if i < 150 else ''}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.digest(pii.find_private(docs)).collect()}
    text = rows[0][1]
    terms = {text[int(a) : int(b)] for kind, a, b in (s.split(":") for s in spans[0].split(",")) if kind == "term"}
    assert terms == {"zanzibar", "now"}  # other words stand in many documents without the address
    assert all(not s for i, s in spans.items() if i >= 100)
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert clean[1] == "word1 filler text nothing , contact [EMAIL]  item1 other" and clean[100] == rows[6][1]


def terms_of(text, spans):
    return {text[int(a) : int(b)] for kind, a, b in (s.split(":") for s in (spans or "").split(",") if s) if kind == "term"}


def test_values_of_one_or_two_texts(spark):
    cards = ["4111 1111 1111 1111", "4111-1111-1111-1111"]
    texts = ["common words quixote wrote to lone@corp.com about things", *(f"common words pancho paid {c} about things {w}" for c, w in zip(cards, ("north", "south")))]
    rows = [*enumerate(texts), *((100 + i, "common words wrote to about paid things north south") for i in range(200))]
    spans = {r.doc_id: r.spans for r in pii.digest(pii.find_private(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    # both formats are one value, so that a term must stand with both
    assert [terms_of(texts[i], spans[i]) for i in range(3)] == [{"quixote"}, {"pancho"}, {"pancho"}]


def test_terms_count_and_stand_in_whole_texts(spark):
    far = " ".join(["filler"] * 60)
    texts = [f"quixote {far} one@corp.com {far} quixote", f"one@corp.com and quixote {far}", f"{far} one@corp.com {far} {far} quixote", f"of quixote {far} alone"]
    rows = [*enumerate(texts), *((100 + i, f"and of {far} alone") for i in range(2000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.digest(pii.find_private(docs)).collect()}
    for i, text in enumerate(texts):
        assert {text[int(a) : int(b)] for kind, a, b in (s.split(":") for s in spans[i].split(",")) if kind == "term"} == {"quixote"}
        assert spans[i].count("term") == text.count("quixote")
    assert not any(s for i, s in spans.items() if i >= 100)


def test_terms_are_words_in_any_dress(spark):
    texts = ["common (Quixote) paid lone@corp.com for O'Neil, \"Anne-Marie\" and user77x!"]
    rows = [*enumerate(texts), *((100 + i, "common paid for and other") for i in range(200))]
    spans = {r.doc_id: r.spans for r in pii.digest(pii.find_private(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert terms_of(texts[0], spans[0]) == {"Quixote", "O'Neil", "Anne-Marie", "user77x"}


WORD = re.compile(r"[^\W_](?:[^\W_]|['’-](?=[^\W_]))+")


def brute_terms(rows, support=3, disclosure=0.9):
    """The spans of terms by document, from counts over all pairs of a value and a word."""
    held, blank = {}, {}
    for i, (_, text) in enumerate(rows):
        found, body = set(), list(text)
        for rank, pattern in enumerate(PATTERNS):
            for m in pattern.finditer(text):
                digits = re.sub("[^0-9]", "", m[0])
                if [True, rank == 1 and all(int(x) <= 255 for x in m[0].split(".")), 12 <= len(digits) <= 19 and luhn(digits), 9 <= len(digits) <= 15][rank]:
                    found.add((rank, digits if rank >= 2 else ".".join(str(int(x)) for x in m[0].split(".")) if rank == 1 else m[0].lower()))
                    body[m.start() : m.end()] = " " * (m.end() - m.start())
        held[i], blank[i] = found, "".join(body)
    words = {i: {m[0].lower() for m in WORD.finditer(b)} for i, b in blank.items()}
    share = {}
    for value in {v for s in held.values() for v in s}:
        own = [i for i in held if value in held[i]]
        texts = {rows[i][1] for i in own}
        for word in set().union(*(words[i] for i in own)):
            both, n_term = [i for i in own if word in words[i]], sum(word in w for w in words.values())
            ic = math.log2(len(rows) / len(own))
            if ic and len({rows[i][1] for i in both}) >= min(support, len(texts)):
                share[word] = max(share.get(word, -1), math.log2(len(both) * len(rows) / (n_term * len(own))) / ic)
    return {rows[i][0]: [(m.start(), m.end()) for m in WORD.finditer(b) if share.get(m[0].lower(), -1) >= disclosure - 1e-12] for i, b in blank.items()}


def test_terms_equal_brute_force(spark):
    rng = random.Random(12)
    values = ["one@corp.com", "Two@corp.com", "10.0.0.7", "010.0.0.7", "4111 1111 1111 1111", "4111-1111-1111-1111", "+49 30 1234567", "+49 (30) 123-4567"]
    rows = []
    for i in range(160):
        body = [f"w{rng.randrange(60)}" for _ in range(rng.randint(3, 12))]
        if rng.random() < 0.25:
            k = rng.randrange(len(values))
            body.insert(rng.randrange(len(body)), values[k])
            body += [f"near{k // 2}"] * (rng.random() < 0.8)
        rows.append((i, " ".join(body)))
    rows += [(500 + i, rows[i][1]) for i in range(30)]
    got = {}
    for r in pii.digest(pii.find_private(spark.createDataFrame(rows, "doc_id long, text string"))).collect():
        got[r.doc_id] = [(int(a), int(b)) for kind, a, b in (s.split(":") for s in r.spans.split(",") if s) if kind == "term"]
    assert got == brute_terms(rows) and any(got.values())


def test_empty_and_columns(spark):
    assert pii.digest(pii.find_private(spark.createDataFrame([], SCHEMA))).count() == 0
    docs = clashing(awkward(spark))
    assert pii.sanitise(docs).columns == docs.columns and pii.sanitise(docs).count() == 12
