"""Rewriting, edits and structural diffs."""

from __future__ import annotations

from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .navigation import below, down_the_tree
from .spans import coalesce_ranges


def rewrite(sources: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply edits (doc_id, start_byte, end_byte, new_text) to sources (doc_id, text).

    Returns (doc_id, text) of all sources, and the edits in order with their coordinates after the edits before them: edit_seq, start_byte,
    old_end_byte, new_end_byte and their points. Overlapping edits and two insertions at one place are an error; edits that touch are not.
    """
    order = Window.partitionBy("doc_id").orderBy("start_byte", "end_byte")
    back, size = F.lag("end_byte").over(order), F.octet_length("new_text")
    clash = (back > F.col("start_byte")) | ((F.lag("start_byte").over(order) == F.col("start_byte")) & (back == F.col("end_byte")) & (F.col("start_byte") == F.col("end_byte")))
    placed = edits.select("doc_id", "start_byte", "end_byte", "new_text").withColumns({"edit_seq": F.row_number().over(order) - 1, "back": F.coalesce(back, F.lit(0)), "clash": F.coalesce(clash, F.lit(False))})
    placed = placed.withColumn("start_byte", F.when(F.col("clash"), F.raise_error(F.lit("edits overlap"))).otherwise(F.col("start_byte")))
    moved = F.coalesce(F.sum(size - (F.col("end_byte") - F.col("start_byte"))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = placed.withColumn("moved", moved)
    listed = placed.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("edit_seq", "back", "start_byte", "end_byte", "new_text"))).alias("edits"))
    raw = F.encode("text", "UTF-8")
    both = sources.select("doc_id", "text", raw.alias("raw")).join(listed, "doc_id", "left")
    pieces = F.transform("edits", lambda x: F.concat(F.substring(F.col("raw"), x["back"].cast("int") + 1, (x["start_byte"] - x["back"]).cast("int")), F.encode(x["new_text"], "UTF-8")))
    joined = F.aggregate(pieces, F.lit(b""), lambda a, x: F.concat(a, x))
    tail = F.expr("substring(raw, cast(element_at(edits, -1).end_byte + 1 as int))")
    texts = both.select("doc_id", F.when(F.col("edits").isNull(), F.col("text")).otherwise(F.concat(joined, tail).cast("string")).alias("text"), F.col("text").alias("__old"))
    # points of an edit are read in the text as the edits before it leave it: new pieces so far, then the old text
    now = F.aggregate(F.slice(pieces, 1, F.col("k")), F.lit(b""), lambda a, x: F.concat(a, x))
    coords = both.where("edits is not null").select("doc_id", "raw", "edits", F.posexplode("edits").alias("k", "x"))
    coords = coords.withColumn("head", F.concat(now, F.expr("substring(raw, cast(x.back + 1 as int), cast(x.start_byte - x.back as int))")))
    coords = coords.withColumns({"old": F.concat("head", F.expr("substring(raw, cast(x.start_byte + 1 as int), cast(x.end_byte - x.start_byte as int))")), "new": F.concat("head", F.encode("x.new_text", "UTF-8"))})
    out = coords.select("doc_id", F.col("x.edit_seq").alias("edit_seq"), *[c for n, col in (("start", "head"), ("old_end", "old"), ("new_end", "new")) for c in _at(n, F.col(col))])
    return texts.drop("__old"), out


def _at(name: str, raw: Column) -> list[Column]:
    lines = F.split(raw.cast("string"), "\n", -1)
    return [F.octet_length(raw).alias(f"{name}_byte"), (F.size(lines) - 1).alias(f"{name}_row"), F.octet_length(F.element_at(lines, -1)).alias(f"{name}_col")]


def apply_edits(text: Column, edits: Column) -> Column:
    """`text` with an array of (start_byte, end_byte, new_text) applied back to front; ends beyond the text are cut, inverted edits skipped."""
    raw = F.encode(text, "UTF-8")
    ordered = F.reverse(F.array_sort(F.filter(edits, lambda x: x["start_byte"] <= x["end_byte"])))

    def one(a: Column, x: Column) -> Column:
        n = F.octet_length(a)
        s, e = F.least(x["start_byte"], n).cast("int"), F.least(x["end_byte"], n).cast("int")
        return F.concat(F.substring(a, F.lit(1), s), F.encode(x["new_text"], "UTF-8"), F.substring(a, e + 1, n - e))

    return F.aggregate(ordered, raw, one, lambda a: a.cast("string"))


def shift_nodes(nodes: DataFrame, edits: DataFrame) -> DataFrame:
    """`nodes` after one edit per document (doc_id, start_byte, old_end_byte, new_end_byte): spans moved, `dirty` where the edit touches."""
    e = edits.select("doc_id", F.col("start_byte").alias("es"), F.col("old_end_byte").alias("eo"), F.col("new_end_byte").alias("en"))
    both = nodes.join(e, "doc_id", "left")
    delta = F.col("en") - F.col("eo")
    after, holds = F.col("start_byte") >= F.col("eo"), F.col("end_byte") >= F.col("eo")
    inside = (F.col("start_byte") < F.col("eo")) & (F.col("end_byte") > F.col("es")) | ((F.col("es") == F.col("eo")) & (F.col("start_byte") <= F.col("es")) & (F.col("end_byte") >= F.col("es")))
    new_start = F.when(F.col("es").isNotNull() & after & (F.col("start_byte") > F.col("es")), F.col("start_byte") + delta).otherwise(F.col("start_byte"))
    new_end = F.when(F.col("es").isNull(), F.col("end_byte")).when(holds, F.col("end_byte") + delta).when(F.col("end_byte") > F.col("es"), F.col("en")).otherwise(F.col("end_byte"))
    return both.withColumns({"dirty": F.coalesce(inside, F.lit(False)), "__s": new_start, "__e": new_end}).withColumns({"start_byte": F.col("__s"), "end_byte": F.col("__e")}).drop("es", "eo", "en", "__s", "__e")


def changed_ranges(edits: DataFrame) -> DataFrame:
    """The edit log (doc_id, start_byte, new_end_byte) as coalesced ranges (doc_id, s, e)."""
    return coalesce_ranges(edits.select("doc_id", F.col("start_byte").alias("s"), F.greatest(F.col("new_end_byte"), F.col("start_byte") + 1).alias("e")))


def with_paths(nodes: DataFrame) -> DataFrame:
    """`nodes` with `path`: the child indexes from the root, joined by dots."""
    join = lambda above, own: f"{above}.{own}" if above else str(own)
    rest = tuple(c for c in nodes.columns if c not in ("doc_id", "node_id"))
    return down_the_tree(nodes, "child_index", "path", pa.string(), "string", "", join, join, rest).select(*nodes.columns, "path")


def _step(above: bytes, own: int) -> bytes:
    return blake2b(above + own.to_bytes(4, "little"), digest_size=16).digest()


def diff_trees(old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc_id, s, e): spans of the topmost nodes whose type or number of children differ, of leaves also whose text does, coalesced.

    Nodes at one place meet by a digest of their path, which is as short for deep trees as for others.
    """
    columns = ["type", "child_count", "start_byte", "end_byte", "text"]
    at = lambda nodes, keep: down_the_tree(nodes, "child_index", "place", pa.binary(), "binary", b"", _step, _step, tuple(keep))
    a = at(old, columns).select("doc_id", "place", *[F.col(c).alias(f"o_{c}") for c in columns])
    both = at(new, [*columns, "last_desc"]).join(a, ["doc_id", "place"])
    differs = (F.col("type") != F.col("o_type")) | (F.col("child_count") != F.col("o_child_count")) | ~F.col("text").eqNullSafe(F.col("o_text"))
    # only nodes that differ meet in the window that finds the topmost of them
    bad = both.where(differs)
    top = bad.withColumn("__below", below(F.lit(True))).where("not __below")
    spans = top.select("doc_id", F.least("start_byte", "o_start_byte").alias("s"), F.greatest("end_byte", "o_end_byte").alias("e"))
    return coalesce_ranges(spans)
