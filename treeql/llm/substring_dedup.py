"""Removal of passages that occur twice, by recompression.

A window is WINDOW consecutive words of one document. Words under a window that also starts anywhere else are removed.

Recompression gives equal passages equal interior symbols. A text starts as its words' hashes. First, runs of one word are named by the word
and the run's length; then, in each round, every symbol falls to the left or the right class by a bit of its hash, and each left
symbol followed by a right one is named as a pair. Names are hashes of what they stand for, so that all executors
agree on them without exchanging any. With every symbol goes the stretch of words that its being there depends on: a pair depends on
its two parts only, a symbol that stays single also on the neighbour that it did not join. If a window holds that
stretch, every equal window holds the symbol at the same place; stretches keep the order of their symbols.

So each window has an anchor that equal windows share: at the highest level where there is one, the first symbol of at least `LEAST` words
whose stretch lies in the window; failing that, one of at least two words; else a hash of the window itself. Consecutive windows with one anchor make a segment, about one for ten words.

1.  A pass over the texts gives the segments: anchor, the 128-bit BLAKE2b digest of the words themselves under the segment, document, place.
2.  Segments are counted by (anchor, digest) and anchors by their different digests. A segment that occurs twice is repeated whole. A segment with an anchor that has several digests
    may share single windows with the others: such segments, one of each digest, are verified window by window in a second pass over
    their documents, with a digest of each window's words.
3.  Repeated places go back to their documents, and the words outside them are kept.

The names of recompression only say what to compare; that passages are equal is decided by the cryptographic digests of their words, joined by single blanks. A name that
two different symbols happen to share costs a comparison and changes no result.

Sums shrink before every shuffle and joins on anchors are plain sort-merge joins, whose hot keys Spark splits. Only documents with an anchor that occurs
twice take part in the passes after the first.

Defined cases: a null or empty text has no words; a text of fewer than WINDOW words keeps all; repeated rows, with or without one identifier, repeat each
other; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bound_batches, materialise, read_table, small_side, text_slices
from .tokens import SPACES, mix, word_hashes

WINDOW, ROUNDS, LEAST = 35, 5, 6
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_C1, _C2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


class Words:
    """The words of several texts joined by single blanks, for digests of stretches."""

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b" ".join(texts), np.uint8)
        blank = SPACES[data]
        after = np.ones(len(data), bool)
        after[1:] = blank[:-1]
        ends = np.cumsum([len(t) + 1 for t in texts])
        #: Of each text, the number of its first word; one more than texts.
        self.first = np.concatenate(([0], np.searchsorted(np.flatnonzero(~blank & after), ends)))
        keep = ~(blank & after)
        flat = np.where(blank, 32, data)[keep].astype(np.uint8)
        after = after[keep]
        self._starts = np.append(np.flatnonzero((flat != 32) & after), len(flat) + (not len(flat) or flat[-1] != 32))
        self._flat = memoryview(flat.tobytes())

    def digests(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """(stretches, 2): a digest of the words start .. end - 1, for each stretch."""
        flat, blake2b = self._flat, hashlib.blake2b
        places = zip(self._starts[start].tolist(), (self._starts[end] - 1).tolist())
        return np.frombuffer(b"".join([blake2b(flat[a:b], digest_size=16).digest() for a, b in places]), "<i8").reshape(-1, 2)


def _first_round(words: np.ndarray, wall: np.ndarray):
    """Runs of one word as symbols: names, first word, end, and the stretch each depends on (its neighbours too)."""
    new = np.ones(len(words), bool)
    new[1:] = (words[1:] != words[:-1]) | wall[1:] | wall[:-1]
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(words))
    size = end - start
    name = np.where(size > 1, mix(words[start] + size.astype(np.uint64) * _C1), words[start])
    return name, start, end, start - 1, end + 1, wall[start]


def _pair_round(name, start, end, low, high, wall, salt: int):
    left = (mix(name ^ np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) & np.uint64(1)).astype(bool)
    joins = np.zeros(len(name), bool)
    joins[:-1] = left[:-1] & ~left[1:] & ~wall[:-1] & ~wall[1:]
    joined = np.zeros(len(name), bool)
    joined[1:] = joins[:-1]
    # single symbols also depend on the neighbour that they might have joined
    after, before = np.append(high[1:], high[-1:] + 1), np.append(low[:1] - 1, low[:-1])
    high2 = np.where(left & ~joins, after, high)
    low2 = np.where(~left & ~joined, before, low)
    at = np.flatnonzero(joins)
    name, end = name.copy(), end.copy()
    name[at] = mix(name[at] * _C1 + name[at + 1] * _C2 + np.uint64(salt))
    end[at], high2[at] = end[at + 1], high[at + 1]
    stay = ~joined
    return name[stay], start[stay], end[stay], low2[stay], high2[stay], wall[stay]


def anchors(words: np.ndarray, wall: np.ndarray, window: int, rounds: int = ROUNDS, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """For each place, the anchor of the window that starts there: its name and first word (-1: the window itself).

    `words` holds the texts one after another with one wall between; windows over a wall mean nothing.
    """
    levels = [_first_round(words, wall)]
    for r in range(1, rounds + 1):
        levels.append(_pair_round(*levels[-1], r))
    n = len(words)
    name, place = np.zeros(n, np.uint64), np.full(n, -1, np.int64)
    open_ = np.arange(n)
    for level, size in [(r, least) for r in range(rounds, 0, -1)] + [(r, 2) for r in range(rounds, -1, -1)]:
        names, start, end, low, high, walls = levels[level]
        use = ~walls & (end - start >= size)
        if not use.any() or not len(open_):
            continue
        names, start, low, high = names[use], start[use], low[use], high[use]
        i = np.searchsorted(low, open_)
        inside = i < len(low)
        inside[inside] = high[i[inside]] <= open_[inside] + window
        hit = open_[inside]
        name[hit], place[hit] = mix(names[i[inside]] + np.uint64(2 * level + (size > 2))), start[i[inside]]
        open_ = open_[~inside]
    return name, place


def _laid_out(texts: list[bytes], window: int):
    """Words of all texts with walls between, the texts' offsets, and which places start a window."""
    hashes, offsets = word_hashes(texts)
    counts = np.diff(offsets)
    first = offsets[:-1] + np.arange(len(texts)) + 1
    words = np.zeros(len(hashes) + len(texts) + 1, np.uint64)
    wall = np.ones(len(words), bool)
    at = np.arange(len(hashes)) + np.repeat(np.arange(len(texts)), counts) + 1
    words[at], wall[at] = hashes, False
    starts = np.zeros(len(words), bool)
    edge = np.zeros(len(words) + 1, np.int64)
    long = counts >= window
    np.add.at(edge, first[long], 1)
    np.add.at(edge, first[long] + counts[long] - window + 1, -1)
    starts = np.cumsum(edge)[:-1] > 0
    return words, wall, first, counts, starts


def segments(texts: list[bytes], window: int = WINDOW):
    """Columns (text, anchor, first half and second half of the digest, first window, last window)."""
    hashes, wall, first, counts, starts = _laid_out(texts, window)
    name, place = anchors(hashes, wall, window)
    p = np.flatnonzero(starts)
    if not len(p):
        return (np.zeros(0, np.int64),) * 6
    own = place[p] < 0
    alone = np.zeros(own.sum(), np.uint64)
    for i in range(window):
        alone = mix(alone * _C1 + hashes[p[own] + i])
    name[p[own]] = alone
    new = np.ones(len(p), bool)
    new[1:] = own[1:] | (place[p][1:] != place[p][:-1]) | (name[p][1:] != name[p][:-1]) | (np.diff(p) > 1)
    at = np.flatnonzero(new)
    a, b = p[at], p[np.append(at[1:], len(p)) - 1]
    text = np.searchsorted(first, a, side="right") - 1
    words = Words(texts)
    # a place among the laid-out words counts the walls before it too
    digest = words.digests(a - text - 1, b - text - 1 + window)
    return text, name[a].view(np.int64), digest[:, 0], digest[:, 1], a - first[text], b - first[text]


_KEY = ("anchor", "d1", "d2")


def _find(window: int):
    def run(batches):
        for batch in batches:
            for piece, texts in text_slices(batch, lambda x: x.column("text")):
                text, anchor, d1, d2, a, b = segments(texts, window)
                take = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("id").take(take), piece.column("text_hash").take(take), pa.array(anchor), pa.array(d1), pa.array(d2), pa.array(a, pa.int32()), pa.array(b, pa.int32())],
                    names=["id", "text_hash", *_KEY, "a", "b"],
                )

    return run


def _windows(window: int):
    """(id, text_hash, text, at): the digest of every window that starts in the stretches `at` of its text."""

    def run(batches):
        for batch in batches:
            for piece, texts in text_slices(batch, lambda x: x.column("text")):
                words = Words(texts)
                lists = piece.column("at").to_pylist()
                rows = [(i, words.first[i] + x["a"], words.first[i] + x["b"] + 1) for i, xs in enumerate(lists) for x in xs]
                if not rows:
                    continue
                p = np.concatenate([np.arange(a, b) for _, a, b in rows])
                text = np.repeat([i for i, _, _ in rows], [b - a for _, a, b in rows])
                take = pa.array(text)
                digest = words.digests(p, p + window)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("id").take(take), piece.column("text_hash").take(take), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array(p - words.first[text], pa.int32())],
                    names=["id", "text_hash", "d1", "d2", "p"],
                )

    return run


def _cut(window: int):
    """(row, text, spans of window starts) -> (row, words, words removed, hash and text of the kept words)."""

    def run(batches):
        for batch in batches:
            with_text = "want_text" in batch.schema.names
            for piece, texts in text_slices(batch, lambda x: x.column("text")):
                n, removed, digest, kept = [], [], [], []
                for text, spans in zip(texts, piece.column("spans").to_pylist()):
                    words = _WORD.findall(text)
                    n.append(len(words))
                    if spans:
                        edge = np.zeros(len(words) + 1, np.int64)
                        for x in spans:
                            edge[x["a"]] += 1
                            edge[x["b"] + window] -= 1
                        words = [words[i] for i in np.flatnonzero(np.cumsum(edge)[:-1] == 0)]
                    removed.append(n[-1] - len(words))
                    body = b" ".join(words)
                    digest.append(hashlib.sha256(body).hexdigest())
                    kept.append(body.decode("utf-8", "replace") if with_text else None)
                columns = {"id": piece.column("id"), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
                if with_text:
                    columns["kept_text"] = pa.array(kept, pa.string())
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def _with_documents(rows: DataFrame, lists: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """The rows (id, text_hash, text) that `lists` (id, text_hash, column) has something for, with it, and the other rows.

    Lists have no bound in bytes, so they are never broadcast. Their documents' keys may be, which keeps all other texts out of the shuffle.
    """
    keys = small_side(lists.select(F.col("id").alias("i"), F.col("text_hash").alias("h")))
    same = F.col("id").eqNullSafe(F.col("i")) & (F.col("text_hash") == F.col("h"))
    side = lists.withColumnsRenamed({"id": "i", "text_hash": "h"})
    found = rows.join(keys, same, "left_semi").hint("merge").join(side.hint("merge"), same).drop("i", "h")
    return found, rows.join(keys, same, "left_anti")


def repeated_spans(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows (id, text_hash, spans) of the documents with repeated windows; spans: stretches (a, b) of their first words.

    `rows` has (id, text_hash, text).
    """
    kind = rows.schema["id"].dataType.simpleString()
    with Scratch(rows.sparkSession) as tables:
        segs = tables.write(rows.mapInArrow(_find(window), f"id {kind}, text_hash long, anchor long, d1 long, d2 long, a int, b int"), "substring-segments")
        counted = segs.groupBy(*_KEY).agg(F.count("*").alias("n"))
        several = counted.groupBy("anchor").agg(F.count("*").alias("kinds"), F.max("n").alias("most")).where("kinds > 1 or most > 1")
        shared = tables.write(counted.join(several, "anchor").select(*_KEY, "n", "kinds"), "substring-shared")
        marked = tables.write(segs.join(small_side(shared), list(_KEY)), "substring-marked")
        tables.drop(segs, shared)
        # segments that occur twice are repeated whole
        whole = marked.where("n > 1").select("id", "text_hash", "a", "b")
        # where an anchor has several kinds of segment, one of each is verified window by window (of rows that repeat wholly, every window is repeated, so
        # counting both is right)
        kinds = marked.where("kinds > 1").groupBy(*_KEY).agg(F.min(F.struct("id", "text_hash", "a", "b")).alias("one"))
        some = kinds.select("one.*").groupBy("id", "text_hash").agg(F.collect_list(F.struct("a", "b")).alias("at"))
        single, _ = _with_documents(rows, tables.write(some, "substring-check"), "at")
        hashed = tables.write(single.mapInArrow(_windows(window), f"id {kind}, text_hash long, d1 long, d2 long, p int"), "substring-windows")
        again = tables.write(hashed.groupBy("d1", "d2").agg(F.count("*").alias("n")).where("n > 1").select("d1", "d2"), "substring-again")
        found = hashed.join(small_side(again), ["d1", "d2"]).select("id", "text_hash", F.col("p"))
        lone = found.select("id", "text_hash", F.col("p").alias("a"), F.col("p").alias("b"))
        spans = whole.unionByName(lone).distinct()
        return materialise(spans.groupBy("id", "text_hash").agg(F.collect_list(F.struct("a", "b")).alias("spans")), "substring-spans")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """Rows (id, n_words, n_removed, kept_sha256) of all documents, and kept_text if asked for."""
    bound_batches(docs)
    body = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(body).alias("text_hash"), body.cast("binary").alias("text"))
    hit, rest = _with_documents(rows, repeated_spans(rows, window), "spans")
    rest = rest.withColumn("spans", F.expr("cast(null as array<struct<a:int,b:int>>)"))
    both = hit.unionByName(rest).select("id", "text", "spans", *([F.lit(True).alias("want_text")] if with_text else []))
    kind = f"id {rows.schema['id'].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")
    return both.mapInArrow(_cut(window), kind).withColumnRenamed("id", id_col)


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document without the passages that occur twice in the corpus."""
    return remove_repeats(read_table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), p AS (
  SELECT doc_id, words, unnest(CASE WHEN len(words) >= 35 THEN range(1, len(words) - 33) ELSE [] END) AS a FROM w
), h AS (
  SELECT doc_id, a, md5(array_to_string(words[a:a + 34], ' ')) AS h FROM p
), twice AS (
  SELECT h FROM h GROUP BY h HAVING count(*) > 1
), spans AS (
  SELECT doc_id, list(DISTINCT a) AS starts FROM h JOIN twice USING (h) GROUP BY doc_id
), covered AS (
  SELECT doc_id, list_sort(list_distinct(flatten(list_transform(starts, lambda a: range(a, a + 35))))) AS gone FROM spans
), kept AS (
  SELECT w.doc_id, len(words) AS n, CASE WHEN gone IS NULL THEN words ELSE list_transform(list_filter(range(1, len(words) + 1), lambda i: NOT list_contains(gone, i)), lambda i: words[i]) END AS rest
  FROM w LEFT JOIN covered USING (doc_id)
)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(n - len(rest) AS BIGINT) AS n_removed, sha256(array_to_string(rest, ' ')) AS kept_sha256 FROM kept
"""
QUERIES = {"op9_substring_dedup": op9_substring_dedup}
ORACLES = {"op9_substring_dedup": ORACLE}
