"""Benchmark decontamination by pigeonhole edit matching.

An item of m characters is found in a text if some passage lies within k = floor(m * error_rate) edits of it. The item
is split into k + 1 pieces, one of which such a passage must hold unchanged. An Aho-Corasick automaton finds the pieces
of all items in one run over a whole text; around each hit a window of the item's length and k more on each side is
verified with Myers' bit-parallel distance. Letters are compared without case and a run of white space as one character;
positions are those of the text as it stands.

The items are sent to the executors in blocks of at most `block_chars` characters, and each block meets all rows, so
that neither the driver nor an executor holds more than one block.

Defined cases: a null or empty text holds no item; a null or blank item is never found; items with equal texts are all
reported; repeated rows are reported each; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, read_table, text_slices

ERROR_RATE = 0.08
BLOCK_CHARS = 4_000_000
_BLANKS = {ord(c): " " for c in "\t\n\x0b\x0c\r"}


def fold(text: str) -> str:
    """Lower case and plain blanks, character by character, so that positions stay."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    return low.translate(_BLANKS)


_RUN = re.compile(r"[\x20\x09-\x0D]{2,}")


def collapse(text: str) -> tuple[str, Callable[[int], int]]:
    """`text` with each run of white space as one blank, and a function from places in it to places in `text`."""
    runs = [m.span() for m in _RUN.finditer(text)]
    if not runs:
        return text, lambda i: i
    gone = [0, *accumulate(b - a - 1 for a, b in runs)]
    blanks = [a - g for (a, _), g in zip(runs, gone)]
    return _RUN.sub(" ", text), lambda i: i + gone[bisect_left(blanks, i)]


def budget(m: int, error_rate: float) -> int:
    return int(m * error_rate + 1e-9)


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """`item` cut into k + 1 parts of nearly equal length, with their offsets."""
    edges = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:])]


def nearest(masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """The least distance of a pattern to any passage of `text`, and where the first such passage ends (Myers 1999).

    `masks`: for each character, bits at its places in the pattern.
    """
    full, last = (1 << m) - 1, 1 << (m - 1)
    vp, vn, score, best, end = full, 0, m, m, 0
    get = masks.get
    for i, c in enumerate(text, 1):
        x = get(c, 0) | vn
        d0 = ((vp + (x & vp)) ^ vp) | x
        hn = vp & d0
        hp = vn | (full & ~(vp | d0))
        if hp & last:
            score += 1
        elif hn & last:
            score -= 1
            if score < best:
                best, end = score, i
        x = hp << 1
        vn = x & d0
        vp = ((hn << 1) | ~(x | d0)) & full
    return best, end


def _masks(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


class Matcher:
    """Finds a block of items (identifier, text) in texts."""

    def __init__(self, items: list[tuple[int | None, str]], error_rate: float = ERROR_RATE):
        self.items = []
        at: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            folded = fold(text or "").strip()
            if not folded:
                continue
            k = budget(len(folded), error_rate)
            for offset, piece in pieces(folded, k):
                at.setdefault(piece, []).append((len(self.items), offset))
            self.items.append((item_id, folded, k))
        self.automaton = ahocorasick.Automaton()
        for piece, places in at.items():
            self.automaton.add_word(piece, (len(piece), places))
        if at:
            self.automaton.make_automaton()
        self._both: dict[int, tuple[dict, dict]] = {}

    def masks(self, i: int) -> tuple[dict, dict]:
        if i not in self._both:
            self._both[i] = _masks(self.items[i][1]), _masks(self.items[i][1][::-1])
        return self._both[i]

    def find(self, text: str) -> Iterator[tuple[int | None, int, int, int]]:
        """(item, distance, start, end) of the nearest passage for each item in `text`."""
        if not self.items or not text:
            return
        folded = fold(text)
        diagonals: dict[int, set[int]] = {}
        for end, (size, places) in self.automaton.iter(folded):
            for i, offset in places:
                diagonals.setdefault(i, set()).add(end + 1 - size - offset)
        for i, starts in diagonals.items():
            if found := self._verify(i, sorted(starts), folded):
                yield self.items[i][0], *found

    def search(self, text: str) -> Iterator[tuple[int | None, int, int, int]]:
        """As `find`, with runs of white space in `text` as one blank; start and end are places in `text`."""
        flat, place = collapse(text)
        for item, distance, start, end in self.find(flat):
            yield item, distance, place(start), place(end - 1) + 1

    def _verify(self, i: int, starts: list[int], text: str) -> tuple[int, int, int] | None:
        _, item, k = self.items[i]
        m = len(item)
        for start in starts:
            if start >= 0 and text.startswith(item, start):
                return 0, start, start + m
        best = None
        low = high = None
        for start in [*starts, None]:
            if low is not None and (start is None or start - k > high):
                distance, end = nearest(self.masks(i)[0], m, text[max(low, 0) : high])
                if distance <= k and (best is None or distance < best[0]):
                    best = distance, max(low, 0) + end
                low = None
            if start is not None:
                low, high = start - k if low is None else low, start + m + k
        if best is None:
            return None
        distance, end = best
        # the same distance read backwards from its end gives the start
        _, back = nearest(self.masks(i)[1], m, text[max(end - m - k, 0) : end][::-1])
        return distance, end - back, end


def blocks(benchmark: DataFrame, item_col: str, text_col: str, block_chars: int) -> Iterator[list[tuple]]:
    block, size = [], 0
    for row in benchmark.select(item_col, text_col).where(F.length(text_col) > 0).toLocalIterator():
        block.append((row[0], row[1]))
        size += len(row[1])
        if size >= block_chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def _detect(shared, error_rate: float):
    def run(batches):
        matcher = Matcher([(i, collapse(text)[0]) for i, text in shared.value], error_rate)
        for batch in batches:
            for piece, texts in text_slices(batch, lambda x: x.column(1)):
                out = [(doc, *hit) for doc, text in zip(piece.column(0).to_pylist(), texts) for hit in matcher.search(text.decode())]
                if out:
                    kinds = [batch.schema.types[0], *[pa.int64()] * 4]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["id", "item", "distance", "start", "end"])

    return run


def _keep_clean(shared, error_rate: float, text_col: str):
    def run(batches):
        matcher = Matcher([(i, collapse(text)[0]) for i, text in shared.value], error_rate)
        for batch in batches:
            for piece, texts in text_slices(batch, lambda x: x.column(0).field(text_col)):
                clean = [next(matcher.search(text.decode()), None) is None for text in texts]
                yield piece.filter(pa.array(clean, pa.bool_()))

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", error_rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows (id, item_id, distance, start_char, end_char): the passage of each item nearest to it, per document."""
    bound_batches(docs)
    spark = docs.sparkSession
    id_type, item_type = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"id {id_type}, item bigint, distance bigint, start bigint, end bigint"
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = None
    for block in blocks(benchmark, item_col, item_text_col, block_chars):
        part = rows.mapInArrow(_detect(spark.sparkContext.broadcast(block), error_rate), schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], schema)
    return out.select(F.col("id").alias(id_col), F.col("item").cast(item_type).alias(item_col), "distance", F.col("start").alias("start_char"), F.col("end").alias("end_char"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", error_rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of `docs`, all columns, that hold no item."""
    bound_batches(docs)
    spark, columns = docs.sparkSession, docs.columns
    rows = docs.select(F.struct(*columns).alias("__row"))
    for block in blocks(benchmark, item_col, item_text_col, block_chars):
        rows = rows.mapInArrow(_keep_clean(spark.sparkContext.broadcast(block), error_rate, text_col), rows.schema)
    return rows.select("__row.*")


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    """All passages of benchmark items in all documents."""
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


QUERIES = {"op6_decontamination": op6_decontamination}
ORACLES: dict[str, str] = {}
