"""Language identification by error-correcting output codes.

Each language gets a codeword of bits. For each bit, a binary classifier over hashed byte n-grams tells the languages
with a one from those with a zero; its weights are the logarithms of the ratio of the two sides' mean n-gram shares. A
text's bits, as signed margins, are compared with every codeword under a logistic loss in which a bit weighs as much as
it was reliable on the training rows; the nearest codeword wins. A text whose two nearest codewords are about as
near is flagged as ambiguous.

Training reads a bounded sample of labelled rows (`max_train_rows` expected ones of each language, chosen by a hash of the identifier), so that a rare language is learnt from all its
rows at every size; what reaches the driver is a table of counts by language, one of n-gram shares and one of bit statistics. Scoring reads every whole text.

Defined cases: a text that is null or has no letter is `und` with score 0; without labelled rows every text is `und`
with score 0; with one language every text with a letter gets it, with score 1; null languages aren't learnt; rows that
repeat are scored alike; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, read_table, text_slices
from .quality import in_fold

MAX_TRAIN_ROWS = 5_000
BUCKETS = 1 << 13
HELD_OUT_OF, HELD_OUT = 4, 2
UNKNOWN = "und"
MARGIN = 0.2
_CHUNK = 1 << 20


def shares(texts: list[bytes]) -> np.ndarray:
    """For each text the shares of its hashed n-grams of 2, 3 and 4 bytes, ASCII capitals as small letters.

    Long texts are counted piece by piece, so that memory does not grow with them.
    """
    out = np.zeros((len(texts), BUCKETS), np.float32)
    low = np.arange(256, dtype=np.uint32)
    low[65:91] += 32
    low[[9, 10, 11, 12, 13]] = 32
    for i, text in enumerate(texts):
        total = np.zeros(BUCKETS, np.int64)
        data = b" " + text + b" "
        for at in range(0, max(len(data) - 1, 1), _CHUNK):
            b = low[np.frombuffer(data, np.uint8, min(_CHUNK + 3, len(data) - at), at)]
            g = b.copy()
            for n in range(1, 4):
                g = g[:-1] * np.uint32(257) + b[n:]
                starts = g[:_CHUNK]
                if len(starts):
                    total += np.bincount(((starts * np.uint32(2654435769)) >> np.uint32(19)).astype(np.int64), minlength=BUCKETS)
        out[i] = total / max(total.sum(), 1)
    return out


def codewords(n: int) -> np.ndarray:
    """(n, bits) of zeros and ones: the exhaustive code up to six languages, else random words far apart."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 6:
        columns = [(1, *rest) for rest in product((0, 1), repeat=n - 1) if 0 in rest]
        return np.array(columns, np.int8).T
    rng = np.random.default_rng(7)
    bits = 6 * int(np.ceil(np.log2(n)))
    best, far = None, -1
    for _ in range(50):
        code = rng.integers(0, 2, (n, bits), dtype=np.int8)
        code = code[:, (code.min(0) != code.max(0))]
        signed = code.astype(np.float32) * 2 - 1
        apart = (code.shape[1] - signed @ signed.T) / 2 + np.eye(n) * bits
        if apart.min() > far:
            best, far = code, apart.min()
    return best


@dataclass(frozen=True)
class Model:
    languages: list[str]
    code: np.ndarray  # (languages, bits)
    weights: np.ndarray  # (buckets, bits)
    centre: np.ndarray
    scale: np.ndarray
    trust: np.ndarray  # how much a bit's loss weighs

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest language, its score, and whether the next one is about as near."""
        n = len(self.languages)
        if n == 1:
            return np.zeros(len(x), np.int64), np.ones(len(x)), np.zeros(len(x), bool)
        m = np.clip((x @ self.weights - self.centre) * self.scale, -8, 8)
        signed = self.code.astype(np.float64) * 2 - 1
        loss = sum(self.trust[b] * np.log1p(np.exp(-m[:, b : b + 1] * signed[:, b])) for b in range(len(self.trust)))
        near = np.exp(loss.min(1, keepdims=True) - loss)
        p = near / near.sum(1, keepdims=True)
        top = np.sort(p, 1)
        return p.argmax(1), top[:, -1], top[:, -1] - top[:, -2] < MARGIN


def _sum_shares(batches):
    """For each language the sum of its texts' shares, and their number under bucket -1."""
    sums: dict[str, np.ndarray] = {}
    rows: dict[str, int] = {}
    for batch in batches:
        for piece, texts in text_slices(batch, lambda x: x.column(1), 256):
            x = shares(texts)
            for i, lang in enumerate(piece.column(0).to_pylist()):
                sums.setdefault(lang, np.zeros(BUCKETS))
                sums[lang] += x[i]
                rows[lang] = rows.get(lang, 0) + 1
    for lang, total in sums.items():
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"lang": [lang] * (len(used) + 1), "bucket": np.append(used, -1), "amount": np.append(total[used], rows[lang])}, schema=pa.schema([("lang", pa.string()), ("bucket", pa.int64()), ("amount", pa.float64())]))


def _bit_margins(weights: np.ndarray, code: np.ndarray, languages: list[str]):
    place = {x: i for i, x in enumerate(languages)}

    def run(batches):
        bits = code.shape[1]
        sums = np.zeros((2, bits, 3))
        for batch in batches:
            for piece, texts in text_slices(batch, lambda x: x.column(1), 256):
                raw = shares(texts) @ weights
                own = code[[place[x] for x in piece.column(0).to_pylist()]]
                for side in (0, 1):
                    hit = own == side
                    sums[side] += np.stack([hit.sum(0), (raw * hit).sum(0), (raw**2 * hit).sum(0)], 1)
        at = [(s, b, k) for s in (0, 1) for b in range(bits) for k in range(3)]
        yield pa.RecordBatch.from_pydict({"cell": [s * bits * 3 + b * 3 + k for s, b, k in at], "amount": [float(sums[x]) for x in at]}, schema=pa.schema([("cell", pa.int64()), ("amount", pa.float64())]))

    return run


def train(rows: DataFrame) -> Model | None:
    """Fit to rows (lang, text). Both passes send sums by language, bucket and bit, never rows."""
    sums = rows.mapInArrow(_sum_shares, "lang string, bucket long, amount double").groupBy("lang", "bucket").agg(F.sum("amount").alias("amount")).toArrow()
    if not len(sums):
        return None
    names = sums.column("lang").to_pylist()
    languages = sorted(set(names))
    place = {x: i for i, x in enumerate(languages)}
    at, bucket, amount = np.array([place[x] for x in names]), np.asarray(sums.column("bucket")), np.asarray(sums.column("amount"))
    mean, n = np.zeros((len(languages), BUCKETS)), np.zeros(len(languages))
    inside = bucket >= 0
    n[at[~inside]] = amount[~inside]
    mean[at[inside], bucket[inside]] = amount[inside]
    mean = (mean + 1e-6) / n[:, None]
    mean /= mean.sum(1, keepdims=True)
    code = codewords(len(languages))
    ones = code.astype(np.float64)
    with np.errstate(invalid="ignore", divide="ignore"):
        side1 = (ones.T @ mean) / ones.sum(0)[:, None]
        side0 = ((1 - ones).T @ mean) / np.maximum((1 - ones).sum(0), 1)[:, None]
    weights = (np.log(side1 + 1e-7) - np.log(side0 + 1e-7)).T.astype(np.float32)
    bits = code.shape[1]
    cells = rows.mapInArrow(_bit_margins(weights, code, languages), "cell long, amount double").groupBy("cell").agg(F.sum("amount").alias("amount")).toArrow()
    flat = np.zeros(2 * bits * 3)
    flat[np.asarray(cells.column("cell"))] = np.asarray(cells.column("amount"))
    count, first, second = (flat.reshape(2, bits, 3)[:, :, k] for k in range(3))
    mu = first / np.maximum(count, 1)
    spread = np.sqrt(np.maximum(second / np.maximum(count, 1) - mu**2, 1e-9))
    centre = (mu[1] * spread[0] + mu[0] * spread[1]) / (spread[0] + spread[1])
    apart = np.maximum(mu[1] - mu[0], 1e-6)
    # a bit is as reliable as its two sides lie apart, in spreads
    reliable = apart / (spread[0] + spread[1])
    trust = np.clip(reliable, 0.05, 4)
    return Model(languages, code, weights, centre, 4 / apart, trust * bits / trust.sum() if bits else trust)


def _predict(model: Model | None, of):
    def run(batches):
        for batch in batches:
            for piece, texts in text_slices(batch, of, 256):
                letters = np.asarray(piece.column(1).to_pylist(), dtype=bool)
                langs, scores, flags = np.full(len(texts), UNKNOWN, dtype=object), np.zeros(len(texts)), np.zeros(len(texts), bool)
                if model and letters.any():
                    who, score, flag = model.decode(shares([t for t, has in zip(texts, letters) if has]))
                    langs[letters], scores[letters], flags[letters] = np.array(model.languages, dtype=object)[who], score, flag
                columns = [piece.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(flags, pa.bool_())]
                rest = [c for c in piece.schema.names if c == "row"]
                yield pa.RecordBatch.from_arrays(columns + [piece.column(c) for c in rest], names=["id", "lang_pred", "score", "ambiguous", *rest])

    return run


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", carry: tuple[str, ...] = (), max_train_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """Rows (id, held_out, lang_pred, score, ambiguous) of all documents, and the struct `row` of the columns `carry`."""
    bound_batches(docs)
    out_of = in_fold(id_col, HELD_OUT_OF, HELD_OUT)
    labelled = docs.where(~out_of & F.col(lang_col).isNotNull() & F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))
    known = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).cast("binary").alias("text"), F.col(id_col).alias("id"))
    counts = docs.where(~out_of & F.col(lang_col).isNotNull()).groupBy(F.col(lang_col).alias("lang")).count().collect()
    many = [F.lit(x) for lang, n in counts if n > max_train_rows for x in (lang, int(1_000_000 * max_train_rows / n))]
    if many:
        share = F.coalesce(F.create_map(*many)[F.col("lang")], F.lit(1_000_000))
        known = known.where(F.pmod(F.xxhash64("id", F.lit(29)), F.lit(1_000_000)) < share)
    model = train(known.select("lang", "text"))
    id_type = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col)
    # a carried row holds the text already
    inside = text_col in carry
    more = ([] if inside else [text.cast("binary").alias("text")]) + ([F.struct(*carry).alias("row")] if carry else [])
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letters"), *more)
    kind = f"id {id_type}, lang_pred string, score double, ambiguous boolean" + (f", row {rows.schema['row'].dataType.simpleString()}" if carry else "")
    scored = rows.mapInArrow(_predict(model, (lambda x: x.column("row").field(text_col)) if inside else (lambda x: x.column("text"))), kind)
    return scored.select(F.col("id").alias(id_col), in_fold("id", HELD_OUT_OF, HELD_OUT).alias("held_out"), "lang_pred", "score", "ambiguous", *(["row"] if carry else []))


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    """Every document's language, learnt outside the held-out fold."""
    return identify(read_table(spark, sf_dir, "documents"))


QUERIES = {"op3_language_id": op3_language_id}
ORACLES: dict[str, str] = {}
