"""Mixing sources to target weights by hash-threshold histograms.

Every document has a 48-bit hash of its identifier. A source that may take a fraction of its words takes the documents
whose hash lies below a threshold. The threshold is found without sorting: words are summed by source and hash bucket,
a running sum over the buckets finds the one bucket in which the budget ends, and only that bucket is summed again at
twelve further bits, until all bits are spent. A source that may take more than its words repeats every document a
whole number of times first and finds a threshold for the rest.

Sources are ranked in one task, with one small row each: their number, not that of the documents, has to fit there (thousands or millions, not one per document).

Defined cases: a null or empty text has size 0 and takes 0 words; a null source is a source of its own, last in order;
a null identifier hashes as the empty string; rows with one identifier share a hash and are taken or left together;
a source without words has target 0; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, small_side, word_count

BITS, LEVEL_BITS = 48, 12


def _hash48(id_col: str):
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], cap: int) -> DataFrame:
    """One row per source: size, target and the whole repeats and remainder of the words that it may take.

    Shares of the total follow the weights, dealt to the sources by code point in turn, null last. No target exceeds
    `cap` times its source; the excess goes to the others by weight. In order of size over weight, the first source
    whose share of what is left stays within its cap fixes the common level; all before it are at their caps. The
    windows here have one row per source, not per document.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    in_turn = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (F.row_number().over(in_turn) - 1) % len(weights) + 1)
    ranked = by_source.withColumn("w", w.cast("long"))
    everything = Window.partitionBy(F.lit(0))
    by_fill = everything.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum(F.lit(cap) * F.col("source_size")).over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = ranked.withColumns({
        "left": F.sum("source_size").over(everything) - before,
        "left_w": F.sum("w").over(by_fill.rowsBetween(0, Window.unboundedFollowing)),
        "place": F.row_number().over(by_fill),
    })
    fits = F.col("w") * F.col("left") <= cap * F.col("source_size") * F.col("left_w")
    level = F.min(F.when(fits, F.struct("place", "left", "left_w"))).over(everything)
    ranked = ranked.withColumn("level", level)
    capped = F.col("level").isNull() | (F.col("place") < F.col("level.place"))
    share = F.col("w") * F.col("level.left")
    per_repeat = F.col("source_size") * F.col("level.left_w")
    target = F.when(capped, (cap * F.col("source_size")).cast("double")).otherwise(share.cast("double") / F.col("level.left_w"))
    whole = F.when(F.col("source_size") == 0, 0).when(capped, cap).otherwise(F.expr("(w * level.left) div nullif(source_size * level.left_w, 0)"))
    ranked = ranked.withColumns({"target": target, "repeats": whole.cast("long")})
    rest = F.when(capped | (F.col("source_size") == 0), 0).otherwise(F.floor((share - F.col("repeats") * per_repeat) / F.col("level.left_w")))
    return ranked.select("source", "source_size", "target", "repeats", rest.cast("long").alias("rest"))


def thresholds(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """The targets with `below`: documents with a smaller hash are taken once more than `repeats` times.

    Sums by (source, bucket) shrink before the shuffle, so that a source with most of the rows costs no more than any.
    The running sums have at most 4096 rows per source.
    """
    found = targets.withColumns({"prefix": F.lit(0).cast("long"), "used": F.lit(0).cast("long")})
    for level in range(BITS // LEVEL_BITS):
        shift = BITS - LEVEL_BITS * (level + 1)
        t = small_side(found.where("rest > 0").select(F.col("source").alias("s"), "prefix", "used", "rest"))
        inside = sizes.join(t, sizes["source"].eqNullSafe(t["s"]) & (F.shiftright("hash", shift + LEVEL_BITS) == t["prefix"]))
        sums = inside.groupBy("source", F.shiftright("hash", shift).alias("bucket"), "used", "rest").agg(F.sum("size").alias("words"))
        run = F.col("used") + F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
        # the first bucket whose end lies beyond the budget, and the words before it
        edge = sums.withColumn("upto", run).where("upto > rest").groupBy("source").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("words")).alias("used"))).alias("edge"))
        edge = edge.select(F.col("source").alias("s"), "edge.bucket", F.col("edge.used").alias("edge_used"))
        found = found.join(edge, found["source"].eqNullSafe(edge["s"]), "left").select(
            "source", "source_size", "target", "repeats", "rest", F.coalesce("bucket", F.lit(0)).alias("prefix"), F.coalesce("edge_used", F.lit(0)).alias("used")
        )
        # one row per source, written so that the next level doesn't plan this one again
        found = materialise(found, "mix-level")
    return found.select("source", "source_size", "target", "repeats", F.when(F.col("rest") > 0, F.col("prefix")).otherwise(0).alias("below"))


def mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: Sequence[str] = ()) -> DataFrame:
    """Rows (id, source, size, source_size, target, taken) of all documents, and the struct `row` of the columns `carry`.

    `carry` columns are read in a second pass over `docs`; without them the texts are read once.
    """
    source = F.col(source_col).cast("string").alias("source")
    measured = {"size": word_count(F.col(text_col)), "hash": _hash48(id_col)}
    sizes = materialise(docs.select(F.col(id_col).alias("id"), source, *[c.alias(k) for k, c in measured.items()]), "mix-sizes")
    targets = materialise(source_targets(sizes, weights, cap), "mix-targets")
    cuts = small_side(materialise(thresholds(sizes, targets), "mix-cuts")).withColumnRenamed("source", "s")
    rows = docs.select(F.col(id_col).alias("id"), source, *[c.alias(k) for k, c in measured.items()], F.struct(*carry).alias("row")) if carry else sizes
    taken = F.col("size") * (F.col("repeats") + (F.col("hash") < F.col("below")).cast("long"))
    out = rows.join(cuts, rows["source"].eqNullSafe(cuts["s"])).select(F.col("id").alias(id_col), rows["source"], "size", "source_size", "target", taken.alias("taken"), *(["row"] if carry else []))
    return out


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents of the corpus with the words that the mix takes of each."""
    from .common import read_table

    return mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: The same by a sort: words up to each hash within a source.
SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS hash
  FROM {documents}
), by_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source
), weighted AS (
  SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS w FROM by_source
), filled AS (
  SELECT *, row_number() OVER f AS place,
         CAST(sum(source_size) OVER () AS BIGINT)
           - CAST(coalesce(sum(3 * source_size) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS left_words,
         CAST(sum(w) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS left_w
  FROM weighted WINDOW f AS (ORDER BY CAST(source_size AS DOUBLE) / w, source NULLS LAST)
), level AS (
  SELECT place AS p, left_words AS l, left_w AS lw FROM filled WHERE w * left_words <= 3 * source_size * left_w ORDER BY place LIMIT 1
), targets AS (
  SELECT source, source_size,
         CASE WHEN p IS NULL OR place < p THEN CAST(3 * source_size AS DOUBLE) ELSE CAST(w * l AS DOUBLE) / lw END AS target,
         CASE WHEN source_size = 0 THEN 0 WHEN p IS NULL OR place < p THEN 3 ELSE (w * l) // (source_size * lw) END AS repeats,
         CASE WHEN source_size = 0 OR p IS NULL OR place < p THEN 0 ELSE (w * l - ((w * l) // (source_size * lw)) * source_size * lw) // lw END AS rest
  FROM filled LEFT JOIN level ON TRUE
), run AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY hash RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM sizes
)
SELECT {columns}
FROM run JOIN targets t ON run.source IS NOT DISTINCT FROM t.source
"""
ORACLE = SQL.replace("{documents}", "documents").replace(
    "{columns}", "doc_id, size, source_size, target, CAST(size * (repeats + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken"
)
QUERIES = {"op1_mixing": op1_mixing}
ORACLES = {"op1_mixing": ORACLE}
