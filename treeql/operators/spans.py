"""Interval algebra and coordinates."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..partitions import dealt, shuffled


def coalesce_ranges(ranges: DataFrame, key: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(key, s, e) with empty ranges dropped and ranges that overlap or touch merged, by gaps and islands."""
    order = Window.partitionBy(*key).orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = dealt(ranges.where("s < e").select(*key, "s", "e"), *key).withColumn("new", (reach.isNull() | (F.col("s") > reach)).cast("int"))
    marked = marked.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*key, "island").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("island")


def overlapping(tokens: DataFrame, ranges: DataFrame) -> DataFrame:
    """Rows of `tokens` (doc_id, start_byte, end_byte, ...) that overlap one of the document's ranges (doc_id, s, e)."""
    r = ranges.select(F.col("doc_id").alias("d_"), "s", "e")
    return tokens.join(r, (F.col("doc_id") == F.col("d_")) & (F.col("end_byte") > F.col("s")) & (F.col("start_byte") < F.col("e")), "left_semi")


def line_starts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line, start_byte) of every line."""
    lines = docs.select(F.col(id_col), F.posexplode(F.split(text_col, "\n", -1)).alias("line", "body"))
    before = F.sum(F.octet_length("body") + 1).over(Window.partitionBy(id_col).orderBy("line").rowsBetween(Window.unboundedPreceding, -1))
    return lines.select(id_col, "line", F.coalesce(before, F.lit(0)).cast("long").alias("start_byte"))


def utf16_units(text: Column) -> Column:
    """Length of a text in UTF-16 code units."""
    return (F.octet_length(F.encode(text, "UTF-16LE")) / 2).cast("long")


def utf16_for_byte(text: Column, byte: Column) -> Column:
    """The UTF-16 offset of a byte offset of the UTF-8 text; null inside a character or outside of the text."""
    raw = F.encode(text, "UTF-8")
    size = F.octet_length(text)
    next_ = F.conv(F.hex(F.substring(raw, byte + 1, F.lit(1))), 16, 10).cast("int")
    edge = (byte >= 0) & (byte <= size) & ((byte == size) | (next_ < 128) | (next_ >= 192))
    return F.when(edge, utf16_units(F.substring(raw, F.lit(1), byte).cast("string")))


def byte_for_utf16(text: Column, unit: Column) -> Column:
    """The byte offset of a UTF-16 offset; null between the halves of a pair or outside of the text."""
    raw = F.encode(text, "UTF-16LE")
    high = F.conv(F.hex(F.substring(raw, unit * 2 + 2, F.lit(1))), 16, 10).cast("int")
    n = F.octet_length(raw) / 2
    edge = (unit >= 0) & (unit <= n) & ((unit == n) | (high < 220) | (high > 223))
    return F.when(edge, F.octet_length(F.decode(F.substring(raw, F.lit(1), (unit * 2).cast("int")), "UTF-16LE")).cast("long"))


def decode_utf16(content: Column, order: str = "LE") -> Column:
    """Text of binary UTF-16; an odd number of bytes is an error."""
    return F.when(F.octet_length(content) % 2 == 1, F.raise_error(F.lit("UTF-16 text of odd length"))).otherwise(F.decode(content, f"UTF-16{order}"))


def point_for_byte(text: Column, byte: Column) -> Column:
    """(row, column) of a byte offset, the column in bytes."""
    before = F.substring(F.encode(text, "UTF-8"), F.lit(1), byte).cast("string")
    last = F.element_at(F.split(before, "\n", -1), -1)
    return F.struct((F.size(F.split(before, "\n", -1)) - 1).alias("row"), F.octet_length(last).alias("column"))


def flatten(ranges: list[tuple[int, int, str, int, int]]) -> list[tuple[int, int, str]]:
    """Ranges (start, end, capture, pattern, seq) without overlap: each stretch goes to the range that starts last there, of these to the one that ends
    first, then to the later pattern; adjacent stretches of one capture are joined."""
    ranges = sorted(r for r in ranges if r[0] < r[1])
    edges = sorted({x for r in ranges for x in r[:2]})
    out: list[tuple[int, int, str]] = []
    open_: list[tuple] = []
    k = 0
    for s, e in zip(edges, edges[1:]):
        while k < len(ranges) and ranges[k][0] <= s:
            start, end, capture, pattern, seq = ranges[k]
            heapq.heappush(open_, (-start, end, -pattern, -seq, capture))
            k += 1
        while open_ and open_[0][1] <= s:
            heapq.heappop(open_)
        if open_:
            capture = open_[0][4]
            if out and out[-1][1] == s and out[-1][2] == capture:
                out[-1] = out[-1][0], e, capture
            else:
                out.append((s, e, capture))
    return out


#: Flattened captures.
FLAT = "doc_id bigint, start_byte int, end_byte int, capture string, pattern_index int"
_FLAT = pa.schema([("doc_id", pa.int64()), ("start_byte", pa.int32()), ("end_byte", pa.int32()), ("capture", pa.string()), ("pattern_index", pa.int32())])


def flat_batches(found: Iterable[tuple[int, list[tuple[int, int, str]]]]) -> Iterator[pa.RecordBatch]:
    """Batches of `FLAT` from the stretches (start, end, capture) of each document."""
    out = []
    for doc, stretches in found:
        out.extend((doc, s, e, c, 0) for s, e, c in stretches)
        if len(out) > 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _FLAT.types)], schema=_FLAT)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _FLAT.types)], schema=_FLAT)


def resolve_highlights(ranges: DataFrame) -> DataFrame:
    """(doc_id, start_byte, end_byte, capture, pattern_index) with overlaps flattened, document by document.

    A sweep with a heap takes n log n steps, where a join of stretches with the ranges that cover them would take n * n for a long document.
    """
    seq = F.coalesce(F.col("seq"), F.lit(0)) if "seq" in ranges.columns else F.lit(0)
    rows = ranges.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("start_byte").cast("int").alias("s"), F.col("end_byte").cast("int").alias("e"), "capture", F.col("pattern_index").cast("int").alias("p"), seq.cast("int").alias("q"))

    def sweep(batches):
        from ..query.execute import by_document

        return flat_batches((doc, flatten([(r["s"], r["e"], r["capture"], r["p"], r["q"]) for r in held])) for doc, held in by_document(batches))

    # by a hash of its own: see run_query
    return rows.repartition(F.xxhash64("doc_id")).sortWithinPartitions("doc_id").mapInArrow(sweep, FLAT)


def to_utf16_ranges(ranges: DataFrame, texts: DataFrame) -> DataFrame:
    """Ranges (doc_id, start_byte, end_byte, ...) with start_unit and end_unit of the texts (doc_id, text); those that cut a character are dropped."""
    both = ranges.join(shuffled(texts.select("doc_id", F.col("text").alias("__text"))), "doc_id")
    both = both.withColumns({"start_unit": utf16_for_byte(F.col("__text"), F.col("start_byte")), "end_unit": utf16_for_byte(F.col("__text"), F.col("end_byte"))})
    return both.where("start_unit is not null and end_unit is not null").drop("__text")


def from_utf16_ranges(ranges: DataFrame, texts: DataFrame) -> DataFrame:
    """Ranges (doc_id, start_unit, end_unit, ...) with start_byte and end_byte of the texts (doc_id, text); those that cut a pair are dropped."""
    both = ranges.join(shuffled(texts.select("doc_id", F.col("text").alias("__text"))), "doc_id")
    both = both.withColumns({"start_byte": byte_for_utf16(F.col("__text"), F.col("start_unit")), "end_byte": byte_for_utf16(F.col("__text"), F.col("end_unit"))})
    return both.where("start_byte is not null and end_byte is not null").drop("__text")


def edits_from_utf16(edits: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Edits (doc_id, start_unit, old_end_unit, new_end_unit) in bytes: starts and old ends in the old texts, new ends in the new ones."""
    both = edits.join(shuffled(old.select("doc_id", F.col("text").alias("__o"))), "doc_id").join(shuffled(new.select("doc_id", F.col("text").alias("__n"))), "doc_id")
    at = lambda text, unit: byte_for_utf16(F.col(text), F.col(unit))
    out = both.withColumns({"start_byte": at("__o", "start_unit"), "old_end_byte": at("__o", "old_end_unit"), "new_end_byte": at("__n", "new_end_unit")})
    return out.where("start_byte is not null and old_end_byte is not null and new_end_byte is not null").drop("__o", "__n")
