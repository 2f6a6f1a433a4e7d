"""Near-duplicate documents by n-gram Jaccard similarity: MinHash banding, then verification on full n-gram sets.

1.  Every text becomes its set of hashed five-word n-grams, a 128-bit digest of that set, and one hash per band of its MinHash signature. Texts
    with equal sets form a class, which is a node of what follows.
2.  Classes meet in a shuffle on band hashes. Each bucket gives links to its smallest node only, so that a bucket of m members
    gives m rows; the connected components of these links are clusters that hold every candidate pair.
3.  The full sets of each cluster's classes are dealt to block pairs of bounded volume and compared there, all against all, by matrix
    products over the n-grams that occur twice. A block pair returns, for each class, its number of links and a
    root of its linked part: never the pairs themselves.
4.  Link counts are summed and the roots' components give the groups.

Bands: of all (bands, rows) that find a pair at the threshold with probability `recall`, the one with the fewest accidental candidates below
it that stays within `most_hashes` hash functions. More than the shared-bucket pairs are verified (whole clusters are), so recall is higher still.

Defined cases: a text with fewer than five words has one n-gram, all its words; a null text, or one without words, has none, is in no group
and has no link; a null identifier is in no group either; repeated rows are members of one class; rows that share an identifier but not the n-grams are documents of their own;
an empty table gives an empty result.
"""

from __future__ import annotations

import math
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bound_batches, materialise, read_table, small_side, text_slices
from .tokens import mix, runs, word_hashes

N, THRESHOLD, RECALL, MOST_HASHES = 5, 0.8, 0.9995, 360
BLOCK_SETS, BLOCK_GRAMS = 128, 400_000
_COLUMNS = 4096


def choose_bands(threshold: float, recall: float, most_hashes: int) -> tuple[int, int]:
    best = None
    for rows in range(1, 33):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))
        if bands * rows <= most_hashes:
            s = np.linspace(0, threshold, 200)
            best = min(best or (math.inf,), (float((1 - (1 - s**rows) ** bands).mean()), bands, rows))
    return best[1], best[2]


def gram_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Each text's sorted set of hashed n-grams."""
    hashes, offsets = word_hashes(texts)
    grams = runs(hashes, n)
    out = []
    for a, b in zip(offsets, offsets[1:]):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        else:
            out.append(runs(hashes[a:b], b - a, 1) if b > a else np.zeros(0, np.uint64))
    return out


def set_keys(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, 2): the 128-bit BLAKE2b digest of each sorted set."""
    return np.frombuffer(b"".join(blake2b(s.data, digest_size=16).digest() for s in sets), "<i8").reshape(-1, 2)


def band_hashes(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """(non-empty sets, bands): a hash of each band of the MinHash signatures."""
    rng = np.random.default_rng(11)
    factors = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32) | np.uint32(1)
    shifts = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    out = np.zeros((len(sets), bands), np.uint64)
    for k in range(bands * rows):
        least = np.minimum.reduceat((flat ^ shifts[k]) * factors[k], starts)
        out[:, k // rows] = out[:, k // rows] * np.uint64(0xFF51AFD7ED558CCD) + least
    return mix(out + np.arange(bands, dtype=np.uint64)).view(np.int64)


_ROW = ("id", "text_hash", "bytes")


def _signatures(n: int, bands: int, rows: int):
    def run(batches):
        for batch in batches:
            for piece, texts in text_slices(batch, lambda x: x.column("text")):
                sets = gram_sets(texts, n)
                sizes = np.array([len(s) for s in sets])
                keys = set_keys(sets)
                full = np.flatnonzero(sizes)
                hashes = band_hashes([sets[i] for i in full], bands, rows) if len(full) else np.zeros((0, bands), np.int64)
                offsets = np.concatenate(([0], np.cumsum((sizes > 0) * bands)))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(hashes.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*map(piece.column, _ROW), pa.array(sizes), pa.array(keys[:, 0]), pa.array(keys[:, 1]), lists], names=[*_ROW, "n", "k1", "k2", "bands"])

    return run


def _sets(n: int):
    """(id, text) -> (id, k1, k2, grams); a task gives each text of an identifier once, however often its row is repeated."""

    def run(batches):
        given = set()
        for batch in batches:
            for piece, texts in text_slices(batch, lambda x: x.column("text")):
                sets = gram_sets(texts, n)
                keys = set_keys(sets)
                ids = piece.column("id").to_pylist()
                new = []
                for i, key in enumerate(zip(ids, *keys.T.tolist())):
                    if key not in given:
                        given.add(key)
                        new.append(i)
                offsets = np.concatenate(([0], np.cumsum([len(sets[i]) for i in new])))
                flat = np.concatenate([sets[i] for i in new]).view(np.int64) if new else np.zeros(0, np.int64)
                take = pa.array(new, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [piece.column("id").take(take), pa.array(keys[new, 0], pa.int64()), pa.array(keys[new, 1], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))],
                    names=["id", "k1", "k2", "grams"],
                )

    return run


def overlaps(a: list[np.ndarray], b: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of the intersections of sets, each of `a` with each of `b` (None: of `a`), by products of 0/1 matrices."""
    both = a + (b or [])
    flat = np.concatenate(both)
    owner = np.repeat(np.arange(len(both)), [len(s) for s in both])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate(([True], flat[1:] != flat[:-1]))
    gram = np.cumsum(new) - 1
    twice = np.bincount(gram)[gram] > 1
    gram, owner = np.cumsum(new & twice)[twice] - 1, owner[twice]
    out = np.zeros((len(a), len(b) if b is not None else len(a)), np.float32)
    total = int(gram[-1]) + 1 if len(gram) else 0
    for low in range(0, total, _COLUMNS):
        i, j = np.searchsorted(gram, (low, low + _COLUMNS))
        m = np.zeros((len(both), min(_COLUMNS, total - low)), np.float32)
        m[owner[i:j], gram[i:j] - low] = 1
        out += m[: len(a)] @ (m[len(a) :] if b is not None else m).T
    return out


def _roots(links: np.ndarray) -> np.ndarray:
    """The smallest member of each member's connected part, for a square matrix of links."""
    root = np.arange(len(links))
    for i in range(len(links)):
        if root[i] != i:
            continue
        edge = np.array([i])
        while len(edge):
            near = links[edge].any(0) & (root > i)
            edge = np.flatnonzero(near)
            root[edge] = i
    return root


def _verify(threshold: float):
    """Rows (cluster, i, j, block, node, size, grams) of whole block pairs in order -> (node, links, root)."""

    def compare(rows: list[tuple]):
        i, j = rows[0][1], rows[0][2]
        left = [r for r in rows if r[3] == i]
        right = [r for r in rows if r[3] == j] if j != i else None
        if not left or right == [] or (right is None and len(left) < 2):
            return
        a, b = [r[6] for r in left], [r[6] for r in right] if right is not None else None
        size_a = np.array([len(s) for s in a], np.float64)
        size_b = np.array([len(s) for s in b], np.float64) if b is not None else size_a
        common = overlaps(a, b).astype(np.float64)
        near = common >= threshold * (size_a[:, None] + size_b[None, :] - common) - 1e-9
        weight_a = np.array([r[5] for r in left])
        if b is None:
            np.fill_diagonal(near, False)
            square, members, links = near, left, near @ weight_a
        else:
            weight_b = np.array([r[5] for r in right])
            square = np.block([[np.zeros((len(a), len(a)), bool), near], [near.T, np.zeros((len(b), len(b)), bool)]])
            members, links = left + right, np.concatenate((near @ weight_b, near.T @ weight_a))
        nodes = [r[4] for r in members]
        for m, root in enumerate(_roots(square)):
            if links[m]:
                yield nodes[m], int(links[m]), nodes[root]

    def run(batches):
        def results():
            held, seen, key = [], set(), None
            for batch in batches:
                columns = [batch.column(c).to_pylist() for c in range(6)]
                lists = batch.column(6)
                values, offsets = lists.values.to_numpy(zero_copy_only=False).view(np.uint64), lists.offsets.to_numpy()
                for r, row in enumerate(zip(*columns)):
                    if row[:3] != key:
                        if held:
                            yield from compare(held)
                        held, seen, key = [], set(), row[:3]
                    # several tasks may give the set of a class whose row is repeated
                    if row[4] not in seen:
                        seen.add(row[4])
                        held.append((*row, values[offsets[r] : offsets[r + 1]].copy()))
            if held:
                yield from compare(held)

        out = []
        for x in results():
            out.append(x)
            if len(out) >= 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["node", "links", "root"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["node", "links", "root"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) of every node of `edges` (a, b): the smallest node that it is connected with.

    Each round takes the least label around every node and then the label of that label, until nothing changes; rounds are
    written to the shared folder, and removed when the next one stands. Labels shrink before each shuffle, so that a node with most of the edges is no hot key in the sums.
    """
    with Scratch(edges.sparkSession) as tables:
        both = tables.write(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
        labels = tables.write(both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("label")), "cc-labels")
        while True:
            around = both.join(labels.select(F.col("a").alias("b"), "label"), "b").select("a", "label")
            least = around.unionByName(labels).groupBy("a").agg(F.min("label").alias("label"))
            onward = labels.select(F.col("a").alias("label"), F.col("label").alias("onward"))
            jumped = least.join(onward, "label").select("a", F.least("label", "onward").alias("label"))
            now = tables.write(jumped, "cc-labels")
            same = now.join(labels.withColumnRenamed("label", "was"), "a").where("label <> was").limit(1).count() == 0
            tables.drop(labels)
            labels = now
            if same:
                return materialise(labels.select(F.col("a").alias("node"), F.col("label").alias("root")), "cc-roots")


def group_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, most_hashes: int = MOST_HASHES) -> DataFrame:
    """A row for each document: its identifier, text_hash and bytes, and of what it belongs to: copy_of, n_copies, links to other classes, class_id (null where it
    stands alone), and whether it is the document that stays for its group."""
    bound_batches(docs)
    bands, rows = choose_bands(threshold, recall, most_hashes)
    body = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(body).alias("text_hash"), F.octet_length(body).alias("bytes"), body.cast("binary").alias("text"))
    signed = materialise(texts.mapInArrow(_signatures(n, bands, rows), "id long, text_hash long, bytes int, n long, k1 long, k2 long, bands array<long>"), "ngram-signatures")
    with Scratch(docs.sparkSession) as tables:
        classes = signed.where("n > 0 and id is not null").groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("size"), F.first("n").alias("n"), F.first("bands").alias("bands"))
        # numbers of the rows as they are written name the classes from here on
        classes = tables.write(classes.withColumn("node", F.monotonically_increasing_id()), "ngram-classes")
        # a band's hash holds its number already
        banded = classes.select("node", F.explode("bands").alias("band"))
        buckets = banded.groupBy("band").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select("band", "least")
        met = banded.join(small_side(tables.write(buckets, "ngram-buckets")), "band").where("node > least")
        # a class is linked to the least of its smallest members, and these to that one: as connected, with far fewer links
        met = met.groupBy("node").agg(F.min("least").alias("low"), F.collect_set("least").alias("others"))
        links = F.expr("concat(array(struct(node as a, low as b)), transform(filter(others, x -> x <> low), x -> struct(x as a, low as b)))")
        clusters = components(met.select(F.explode(links).alias("l")).select("l.*").distinct())
        members = tables.write(clusters.join(classes.drop("bands"), "node").select(F.col("root").alias("cluster"), "node", "rep", "size", "n", "k1", "k2"), "ngram-members")
        volume = members.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_GRAMS), F.lit(1)).cast("int").alias("blocks"))
        placed = members.join(small_side(tables.write(volume, "ngram-volume")), "cluster").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        placed = tables.write(placed, "ngram-placed")
        wanted = small_side(placed.select(F.col("rep").alias("id")).distinct())
        sets = texts.select("id", "text").join(wanted, "id", "left_semi").mapInArrow(_sets(n), "id long, k1 long, k2 long, grams array<long>")
        sets = sets.join(small_side(placed.withColumnRenamed("rep", "id").drop("n")), ["id", "k1", "k2"])
        other = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        pairs = other.select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "size", "grams")
        pairs = pairs.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
        verified = tables.write(pairs.mapInArrow(_verify(threshold), "node long, links long, root long"), "ngram-verified")
        groups = components(verified.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
        grouped = groups.join(classes.select("node", "rep", "k1", "k2"), "node")
        # the smallest identifier names the group; of several classes with it, one stays
        least = tables.write(grouped.groupBy("root").agg(F.min("rep").alias("class_id"), F.min(F.struct("rep", "k1", "k2", "node")).alias("stays")), "ngram-groups")
        least = groups.join(least, "root").select("node", "class_id", F.col("stays.node").alias("stays"))
        known = tables.write(verified.groupBy("node").agg(F.sum("links").alias("links")).join(least, "node", "left"), "ngram-known")
        linked = classes.select("k1", "k2", "node", "rep", "size").join(small_side(known), "node", "left").where("size > 1 or links is not null")
        linked = linked.select("k1", "k2", "rep", "size", "links", F.coalesce("class_id", "rep").alias("class_id"), (F.coalesce("stays", "node") == F.col("node")).alias("stays"))
        linked = materialise(linked, "ngram-linked")
    has = signed.select(*_ROW, *[F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col(k)).alias(k) for k in ("k1", "k2")])
    return has.join(small_side(linked), ["k1", "k2"], "left").select(
        *_ROW, F.coalesce("rep", "id").alias("copy_of"), F.coalesce("size", F.lit(1)).cast("long").alias("n_copies"), F.coalesce("links", F.lit(0)).alias("links"), "class_id",
        F.coalesce(F.col("stays") & (F.col("id") == F.col("class_id")), F.lit(True)).alias("stays"),
    )


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows (id, class_id, copy_of, n_copies, n_links) of all documents.

    class_id: the smallest document of the group that links connect; copy_of: the smallest of those with the same n-grams, of which there
    are n_copies; n_links: the other documents at or above the threshold.
    """
    rows = group_rows(docs, id_col, text_col, **options)
    return rows.select(F.col("id").alias(id_col), F.coalesce("class_id", "id").alias("class_id"), "copy_of", "n_copies", (F.col("links") + F.col("n_copies") - 1).cast("long").alias("n_links"))


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs`, all columns, without those that another row of their group stands for: the smallest identifier stays.

    A row goes by its identifier and its text, so that another text under the same identifier is left alone; rows equal in both go or stay together. Rows without n-grams stay, as do
    rows without identifier. Only the identifiers and hashes of the texts that go meet the documents.
    """
    gone = materialise(group_rows(docs, id_col, text_col, **options).where("not stays").select(*[F.col(c).alias(f"__gone_{c}") for c in _ROW]).distinct(), "ngram-gone")
    body = F.coalesce(F.col(text_col), F.lit(""))
    same = (F.col(id_col).cast("long") == F.col("__gone_id")) & (F.xxhash64(body) == F.col("__gone_text_hash")) & (F.octet_length(body) == F.col("__gone_bytes"))
    return docs.join(small_side(gone), same, "left_anti")


def op10_ngram_join(spark, sf_dir: str) -> DataFrame:
    """Every document's group of near copies and its number of links."""
    return ngram_join(read_table(spark, sf_dir, "documents"))


QUERIES = {"op10_ngram_join": op10_ngram_join}
ORACLES: dict[str, str] = {}
