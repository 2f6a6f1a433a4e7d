"""Personal data: patterns, and terms that reveal them by corpus co-occurrence.

Four patterns (email, ip, card, phone) give the base spans of each text. The terms of a text are its words outside of them. Over the whole corpus,
how often a term stands in a document with a protected value, against how often either occurs in documents at all, gives the information that the
term reveals about it, PMI(term; value). A term that reveals at least the share `DISCLOSURE` of the value's own information
IC(value) = log2(documents / documents with it) exceeds the disclosure threshold: all its occurrences, in every text, are spans of kind term.
It must stand with the value in at least `SUPPORT` different texts, or in all texts that hold the value where these are
fewer: a value of one text is revealed by the terms that are rare in the corpus. All formats of a card, phone or ip are one value.
`sanitise` replaces base spans by their kind, generalises such terms, and removes those that determine the value.

Only terms that are rare enough for some value (`_most`, an exact bound) meet the values of their texts, and values that stand in the same texts are
counted as one, so that a text with many values and words is not paired in full.

All of it is DataFrame expressions. Positions come from the pieces between matches: a match starts after all earlier
pieces and matches. Patterns use possessive loops and start only where a run starts, so that no text takes quadratic time.
Java's matcher and the contract's patterns agree: a loop that cannot give back a character to any later part is possessive.

Defined cases: a null or empty text has no spans and counts of 0; repeated rows get the same spans; a term never overlaps a base span;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, materialise, read_table, small_side

KINDS = ("email", "ip", "card", "phone", "term")
SUPPORT = 3
DISCLOSURE = 0.9
REMOVE_AT = 0.999
#: Matches are placed in blocks of so many, so that placing n of them takes no n * n steps.
BLOCK = 256

#: Pattern by kind, and a test that a text without any match mostly fails at once.
PATTERNS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "contains(body, '@')"),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"body rlike '[0-9]\\.[0-9]'"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", "body rlike '[0-9]{2}|[0-9][ -][0-9]'"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "contains(body, '+')"),
}
#: Words of letters and digits, of two characters at least, whatever stands around them; hyphens and apostrophes inside belong to them.
TERM = r"[\p{L}\p{N}](?:[\p{L}\p{M}\p{N}]|['’-](?=[\p{L}\p{N}]))++"

_VALID = {
    "email": "true",
    "ip": r"forall(split(x.value, '[.]'), p -> cast(p as double) <= 255)",
    "card": "length(regexp_replace(x.value, '[^0-9]', '')) between 12 and 19 and luhn_check(regexp_replace(x.value, '[^0-9]', ''))",
    "phone": "length(regexp_replace(x.value, '[^0-9]', '')) between 9 and 15",
}
_FOUND = "array<struct<start:bigint,value:string>>"


def _let(value: str, name: str, then: str) -> str:
    """SQL for `then` with `name` bound to `value`."""
    return f"transform(array({value}), {name} -> {then})[0]"


def with_matches(df: DataFrame, name: str, body: str, pattern: str, test: str = "true") -> DataFrame:
    """`df` with `name`: the matches of `pattern` in column `body` as array of (start, value), in code points."""
    p = F.lit(pattern)
    m, z, b = f"__m_{name}", f"__z_{name}", f"__b_{name}"
    empty = f"cast(array() as {_FOUND})"
    df = df.withColumn(m, F.when(F.expr(test), F.regexp_extract_all(F.col(body), p, F.lit(0))))
    # the optimiser may move a column's expression into a lambda, to be run for each element: _let binds its value once
    gaps = F.slice(F.split(F.col(body), pattern, -1), 1, F.size(m))
    df = df.withColumn(z, F.when(F.size(m) > 0, F.zip_with(m, gaps, lambda v, g: F.struct(F.length(g).cast("long").alias("gap"), v.alias("value")))))
    df = df.drop(m)
    each = "struct(a.at + x.gap + length(x.value) as at, concat(a.found, array(struct(a.at + x.gap as start, x.value as value))) as found)"
    place = _let(z, "zz", f"transform(sequence(0, (size(zz) - 1) div {BLOCK}), k -> aggregate(slice(zz, cast(k * {BLOCK} + 1 as int), {BLOCK}), struct(0L as at, {empty} as found), (a, x) -> {each}))")
    df = df.withColumn(b, F.expr(f"case when size({z}) > 0 then {place} end"))
    df = df.drop(z)
    # running sums of the blocks' lengths, one for each block
    sums = "aggregate(bb, struct(0L as at, array(0L) as sums), (s, y) -> struct(s.at + y.at as at, concat(s.sums, array(s.at + y.at)) as sums)).sums"
    moved = "flatten(transform(bb, (k, i) -> transform(k.found, x -> struct(x.start + oo[i] as start, x.value as value))))"
    whole = _let(b, "bb", _let(sums, "oo", moved))
    return df.withColumn(name, F.expr(f"case when size({b}) > 0 then {whole} else {empty} end")).drop(b)


def placed_terms(body: str, own: str):
    """Spans (start, rank, end, share) of the words of `body` that the map `own` (word in lower case -> share) has, in order.

    A single expression, so that each text is taken apart once. Places are summed in blocks, as in `with_matches`.
    """
    kind = "array<struct<start:bigint,rank:int,end:bigint,share:double>>"
    parts = F.struct(F.regexp_extract_all(F.col(body), F.lit(TERM), F.lit(0)).alias("words"), F.split(F.col(body), TERM, -1).alias("gaps"), F.col(own).alias("own"))

    def place(t):
        words = F.zip_with(t["words"], F.slice(t["gaps"], 1, F.size(t["words"])), lambda v, g: F.struct(F.length(g).cast("long").alias("gap"), F.length(v).cast("long").alias("len"), F.try_element_at(t["own"], F.lower(v)).alias("share")))
        return F.transform(F.array(words), blocks)[0]

    def blocks(z):
        none = F.expr(f"cast(array() as {kind})")

        def step(a, x):
            start = a["at"] + x["gap"]
            span = F.struct(start.alias("start"), F.lit(4).alias("rank"), (start + x["len"]).alias("end"), x["share"].alias("share"))
            return F.struct((start + x["len"]).alias("at"), F.when(x["share"].isNull(), a["found"]).otherwise(F.concat(a["found"], F.array(span))).alias("found"))

        each = F.transform(F.sequence(F.lit(0), F.floor((F.size(z) - 1) / BLOCK).cast("int")), lambda k: F.aggregate(F.slice(z, k * BLOCK + 1, F.lit(BLOCK)), F.struct(F.lit(0).cast("long").alias("at"), none.alias("found")), step))
        return F.transform(F.array(each), joined)[0]

    def joined(b):
        def onward(s, y):
            return F.struct((s["at"] + y["at"]).alias("at"), F.concat(s["sums"], F.array(s["at"] + y["at"])).alias("sums"))

        zero = F.lit(0).cast("long")
        sums = F.aggregate(b, F.struct(zero.alias("at"), F.array(zero).alias("sums")), onward)["sums"]
        moved = lambda offsets: F.flatten(F.transform(b, lambda y, i: F.transform(y["found"], lambda x: F.struct((x["start"] + offsets[i]).alias("start"), x["rank"].alias("rank"), (x["end"] + offsets[i]).alias("end"), x["share"].alias("share")))))
        return F.transform(F.array(sums), moved)[0]

    return F.transform(F.array(parts), place)[0]


def base_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows (id, text_hash, body, spans, row) with spans as sorted array of (start, rank, end, value); rank is the kind's place in KINDS."""
    body = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.col(id_col).alias("id"), F.xxhash64(body).alias("text_hash"), body.alias("body"), *([F.struct(*carry).alias("row")] if carry else []))
    for rank, kind in enumerate(PATTERNS):
        df = with_matches(df, kind, "body", *PATTERNS[kind])
        as_span = f"transform(filter({kind}, x -> {_VALID[kind]}), x -> struct(x.start as start, {rank} as rank, x.start + length(x.value) as end, x.value as value))"
        df = df.withColumn(kind, F.expr(as_span))
    return df.withColumn("spans", F.array_sort(F.concat(*PATTERNS))).drop(*PATTERNS)


def _entity(span: str):
    """A protected value's name: its kind, and the value without case, separators and leading zeros of an ip's parts."""
    value, rank = F.lower(f"{span}.value"), F.col(f"{span}.rank")
    plain = F.when(rank >= 2, F.regexp_replace(value, "[^0-9]", "")).when(rank == 1, F.regexp_replace(value, r"(?<![0-9])0+(?=[0-9])", "")).otherwise(value)
    return F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), rank + 1), plain)


def _blanked(spans: str) -> str:
    """SQL for `body` with spaces in place of the spans, so that positions stay."""
    kind = "array<struct<start:bigint,end:bigint>>"
    last = "a[size(a) - 1]"
    apart = f"aggregate({spans}, cast(array() as {kind}), (a, x) -> case when size(a) > 0 and x.start < {last}.end then concat(slice(a, 1, size(a) - 1), array(struct({last}.start as start, greatest(x.end, {last}.end) as end))) else concat(a, array(struct(x.start as start, x.end as end))) end)"
    before = "case when i = 0 then 0 else s[i - 1].end end"
    put = f"concat(substring(body, cast({before} + 1 as int), cast(x.start - {before} as int)), repeat(' ', cast(x.end - x.start as int)))"
    joined = f"concat(array_join(transform(s, (x, i) -> {put}), ''), substring(body, cast(s[size(s) - 1].end + 1 as int)))"
    return f"case when size({spans}) = 0 then body else {_let(apart, 's', joined)} end"


def _terms(body: str = "body"):
    """A row for each different term of a text."""
    return F.explode(F.array_distinct(F.transform(F.regexp_extract_all(F.col(body), F.lit(TERM), F.lit(0)), F.lower)))


def _most(n_entity, total: int, disclosure: float):
    """In so many documents a term can stand at most if it is to reveal a value of `n_entity` documents: it stands with it in n_entity at most."""
    return n_entity * F.pow(F.lit(float(total)) / n_entity, F.lit(1 - disclosure)) * (1 + 1e-9)


def disclosing(kept: DataFrame, support: int, disclosure: float) -> DataFrame:
    """Rows (term, share): terms that reveal at least the share `disclosure` of some value's information, and the largest such share.

    Each step counts by key with partial sums before its shuffle; all counts are of rows, and a row counts a term and a value once.
    """
    with Scratch(kept.sparkSession) as tables:
        holders = kept.where(F.size("spans") > 0)
        copies = holders.groupBy("text_hash").agg(F.count("*").alias("copies"))
        texts = tables.write(holders.select("text_hash", "spans", "body").dropDuplicates(["text_hash"]).join(copies, "text_hash"), "pii-texts")
        values = texts.select("text_hash", "copies", F.explode("spans").alias("s")).select("text_hash", "copies", _entity("s").alias("entity")).distinct()
        # values with the same texts have the same figures for each term: two hashes of the set of texts stand for them
        sets = [F.expr(f"bit_xor(xxhash64(text_hash, {seed}))").alias(f"set{seed}") for seed in (1, 2)]
        figures = values.groupBy("entity").agg(F.sum("copies").alias("n_entity"), F.count("*").alias("held"), *sets)
        group = ["n_entity", "held", "set1", "set2"]
        groups = tables.write(values.join(figures, "entity").select("text_hash", *group).distinct(), "pii-values")
        total, largest = kept.count(), groups.agg(F.max("n_entity")).first()[0]
        words = kept.select((F.size("spans") > 0).alias("holds"), _terms().alias("term")).groupBy("term").agg(F.count("*").alias("n_term"), F.max("holds").alias("holds"))
        rare = words.where(F.col("holds") & (F.col("n_term") <= _most(F.lit(largest), total, disclosure))).drop("holds")
        rare = tables.write(rare, "pii-rare")
        pairs = texts.select("text_hash", "copies", _terms().alias("term")).join(small_side(rare), "term").join(groups, "text_hash")
        pairs = pairs.where(F.col("n_term") <= _most(F.col("n_entity"), total, disclosure))
        pairs = pairs.groupBy("term", "n_term", *group).agg(F.sum("copies").alias("n_both"), F.count("*").alias("texts")).where(F.col("texts") >= F.least(F.lit(support), F.col("held")))
        n = F.lit(float(total))
        pmi = F.log2(F.col("n_both") * n / (F.col("n_term") * F.col("n_entity")))
        share = pmi / F.nullif(F.log2(n / F.col("n_entity")), F.lit(0.0))
        return materialise(pairs.groupBy("term").agg(F.max(share).alias("share")).where(F.col("share") >= disclosure), "pii-terms")


def find_private(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """Rows (id, spans, row): all spans of every document as sorted array of (start, rank, end, share)."""
    found = base_spans(docs, id_col, text_col)
    kept = materialise(found.select("id", "text_hash", "spans", F.expr(_blanked("spans")).alias("body")), "pii-base")
    terms = small_side(disclosing(kept, support, disclosure))
    # the words of a text are placed only where it holds such a term, and only its own terms keep their places
    own = kept.select("id", "text_hash", _terms().alias("term")).join(terms, "term").groupBy("id", "text_hash").agg(F.map_from_entries(F.collect_set(F.struct("term", "share"))).alias("own"))
    marked = materialise(own, "pii-marked")
    same = [F.col("k.id").eqNullSafe(F.col("m.id")), F.col("k.text_hash") == F.col("m.text_hash")]
    places = kept.alias("k").join(small_side(marked).alias("m"), same[0] & same[1]).select("k.id", "k.text_hash", placed_terms("k.body", "own").alias("terms"))
    flagged = materialise(places.dropDuplicates(["id", "text_hash"]), "pii-flagged")
    key = [F.col("b.id").eqNullSafe(F.col("f.id")), F.col("b.text_hash") == F.col("f.text_hash")]
    out = kept.drop("body").alias("b").join(flagged.alias("f"), key[0] & key[1], "left")
    base = "transform(spans, x -> struct(x.start as start, x.rank as rank, x.end as end, cast(null as double) as share))"
    out = out.select("b.id", "b.text_hash", F.expr(base).alias("base"), F.expr(f"array_sort(concat({base}, coalesce(terms, cast(array() as array<struct<start:bigint,rank:int,end:bigint,share:double>>))))").alias("spans"))
    if not carry:
        return out
    rows = docs.select(F.struct(*carry).alias("row"), F.col(id_col).alias("i"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"))
    out = out.dropDuplicates(["id", "text_hash"])
    return rows.join(out, F.col("i").eqNullSafe(F.col("id")) & (F.col("h") == F.col("text_hash"))).select("id", "base", "spans", "row")


def _listed(spans: str):
    names = "array({})".format(", ".join(f"'{k}'" for k in KINDS))
    return F.expr(f"array_join(transform({spans}, x -> concat_ws(':', {names}[x.rank], x.start, x.end)), ',')")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    counts = [F.expr(f"cast(size(filter(base, x -> x.rank = {rank})) as bigint)").alias(f"n_{kind}") for rank, kind in enumerate(KINDS[:4])]
    return found.select(F.col("id").alias(id_col), *counts, F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """The rows of `docs` with base spans replaced by their kind in brackets, and disclosing terms generalised to
    `[TERM]` or, where they determine the value (a share of at least REMOVE_AT), removed. Overlapping spans are replaced once,
    by the kind of the first."""
    columns = docs.columns
    found = find_private(docs, id_col, text_col, tuple(columns), support, disclosure)
    apart = "aggregate(spans, cast(array() as array<struct<start:bigint,rank:int,end:bigint,share:double>>), (a, x) -> case when size(a) > 0 and x.start < a[size(a) - 1].end then concat(slice(a, 1, size(a) - 1), array(struct(a[size(a) - 1].start as start, a[size(a) - 1].rank as rank, greatest(x.end, a[size(a) - 1].end) as end, a[size(a) - 1].share as share))) else concat(a, array(x)) end)"
    found = found.select("row", F.expr(f"case when size(spans) > 0 then {apart} else spans end").alias("s"), F.col("row").getField(text_col).alias("body"))
    names = "array({})".format(", ".join(f"'[{k.upper()}]'" for k in KINDS))
    gap = "substring(body, cast(case when i = 0 then 1 else s[i - 1].end + 1 end as int), cast(x.start - case when i = 0 then 0 else s[i - 1].end end as int))"
    put = f"case when x.rank = 4 and x.share >= {REMOVE_AT} then '' else {names}[x.rank] end"
    joined = f"concat(array_join(transform(s, (x, i) -> concat({gap}, {put})), ''), substring(body, cast(s[size(s) - 1].end + 1 as int)))"
    text = F.expr(f"case when size(s) = 0 or body is null then body else {_let('s', 's', joined)} end")
    return found.select(*[text.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in columns])


def op8_pii(spark, sf_dir: str) -> DataFrame:
    """The personal data in all documents."""
    return digest(find_private(read_table(spark, sf_dir, "documents")))


QUERIES = {"op8_pii": op8_pii}
ORACLES: dict[str, str] = {}
