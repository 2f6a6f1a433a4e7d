"""Quality scores: histogram gradient-boosted trees over document statistics.

One pass over the texts turns each into some forty statistics (byte classes, word and line shape, repetition). The
trees are fitted on the driver to a bounded sample of labelled rows (`max_train_rows`), flattened into arrays and sent
to the executors, which traverse them for whole batches. Only statistics of the text enter a score.

Defined cases: a null text has the statistics of an empty one and gets a score; a null label is no label; rows that
repeat a labelled identifier count as one row with the mean label, and of different texts under it the one with the least hash of its statistics is learnt from; without labels of both kinds every score is the share of label 1
(0.5 without labels); an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gbt
from .common import bound_batches, materialise, read_table, small_side, text_slices

MAX_TRAIN_ROWS = 30_000
HELD_OUT_OF = 5
CUT = 0.3

#: Groups of bytes whose shares of a text are features.
CLASSES = {
    "lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789",
    "space": b" \t\r\x0b\x0c", "newline": b"\n", "stop": b".", "comma": b",", "ask": b"?!", "star": b"*", "hash": b"#",
    "dollar": b"$", "percent": b"%", "and": b"&", "bar": b"|", "at": b"@", "dash": b"-", "quote": b"'\"`",
    "bracket": b"()[]{}<>", "other": b"/\\:;_=+~^", "control": bytes(range(0, 9)) + bytes(range(14, 32)), "high": bytes(range(128, 256)),
}
_WORDS = ("words", "bytes", "mean_word", "unique", "top_word", "short", "long", "capital", "odd", "pairs", "lines", "line_mean", "line_max", "line_same", "line_same_bytes", "ends")
WIDTH = len(CLASSES) + len(_WORDS)


def _class_matrix() -> np.ndarray:
    m = np.zeros((256, len(CLASSES)))
    for j, members in enumerate(CLASSES.values()):
        m[list(members), j] = 1
    return m


def _shape(text: bytes) -> tuple:
    """The statistics of words and lines."""
    words = text.split()
    n = len(words)
    if not n:
        return (0.0, np.log1p(len(text))) + (0.0,) * (len(_WORDS) - 2)
    counts = Counter(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=n)
    capital = sum(c for w, c in counts.items() if 65 <= w[0] <= 90)
    odd = sum(c for w, c in counts.items() if not w.strip(b".,;:!?'\"()-").isalnum() and w.isascii())
    pairs = len(set(zip(words, words[1:])))
    lines = [x for x in text.split(b"\n") if x.strip()]
    seen = Counter(lines)
    same = sum(c - 1 for c in seen.values())
    same_bytes = sum((c - 1) * len(x) for x, c in seen.items())
    ends = sum(c for x, c in seen.items() if x.rstrip()[-1:] in b".!?")
    return (
        np.log1p(n), np.log1p(len(text)), float(sizes.mean()), len(counts) / n, max(counts.values()) / n, float((sizes <= 2).mean()),
        float((sizes >= 14).mean()), capital / n, odd / n, pairs / max(n - 1, 1), np.log1p(len(lines)), len(text) / len(lines),
        np.log1p(max(map(len, lines))), same / len(lines), same_bytes / len(text), ends / len(lines),
    )


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of `WIDTH` statistics for each text."""
    if not texts:
        return np.zeros((0, WIDTH), np.float32)
    matrix = _class_matrix()
    shares = np.stack([np.bincount(np.frombuffer(t, np.uint8), minlength=256) @ matrix / max(len(t), 1) for t in texts])
    return np.hstack([shares, np.array([_shape(t) for t in texts])]).astype(np.float32)


def _measure(batches):
    for batch in batches:
        for piece, texts in text_slices(batch, lambda x: x.column(1)):
            values = pa.array(statistics(texts).reshape(-1), pa.float32())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, WIDTH), pa.int32()), values)
            yield pa.RecordBatch.from_arrays([piece.column(0), lists], names=["id", "stats"])


def _score(model: gbt.Trees):
    def run(batches):
        for batch in batches:
            x = np.asarray(batch.column(1).flatten()).reshape(len(batch), WIDTH)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.probability(x), pa.float64())], names=["id", "score"])

    return run


def in_fold(id_col: str, of: int, fold: int):
    """Whether crc32 of the identifier as text leaves `fold` modulo `of`."""
    return F.coalesce(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % of == fold, F.lit(False))


def train(stats: DataFrame, labels: DataFrame, max_train_rows: int = MAX_TRAIN_ROWS) -> gbt.Trees:
    """Fit to labels (id, y): all of them, or if there are more a share by hash with `max_train_rows` expected rows."""
    labelled = labels.where("y is not null and id is not null").groupBy("id").agg(F.avg("y").alias("y"))
    n = labelled.count()
    if n > max_train_rows:
        labelled = labelled.where(F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1_000_000)) < int(1_000_000 * max_train_rows / n))
    # one row for each label, so that repeated identifiers can't exceed the bound
    rows = stats.join(small_side(labelled), "id").groupBy("id").agg(F.min_by("stats", F.xxhash64("stats")).alias("stats"), F.first("y").alias("y")).toArrow().sort_by("id")
    x = np.asarray(rows.column("stats").combine_chunks().flatten()).reshape(len(rows), WIDTH).astype(np.float64)
    return gbt.fit(x, (np.asarray(rows.column("y")) >= 0.5).astype(np.float64))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", held_out_of: int = HELD_OUT_OF, cut: float = CUT, max_train_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """Rows (id, held_out, score, predicted) of all documents; rows in fold 0 of `held_out_of` aren't learnt from."""
    bound_batches(docs)
    id_type = docs.schema[id_col].dataType.simpleString()
    stats = materialise(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(_measure, f"id {id_type}, stats array<float>"), "quality-stats")
    known = labels.where(~in_fold(id_col, held_out_of, 0)).select(F.col(id_col).cast(id_type).alias("id"), F.col(label_col).cast("double").alias("y"))
    scored = stats.mapInArrow(_score(train(stats, known, max_train_rows)), f"id {id_type}, score double")
    return scored.select(F.col("id").alias(id_col), in_fold("id", held_out_of, 0).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def op5_quality(spark, sf_dir: str) -> DataFrame:
    """Every document's score, learnt from the labels outside the held-out fold."""
    return quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


QUERIES = {"op5_quality": op5_quality}
ORACLES: dict[str, str] = {}
