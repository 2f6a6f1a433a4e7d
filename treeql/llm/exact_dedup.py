"""Exact deduplication by Patricia-trie owners.

A text's owner is the partition of its byte length and content hash. Both on the reading side (to send each text once
per task, so that a group with a third of all rows is no hot key) and on the owner's side, full byte strings go into a
compressed radix trie under the header (length, hash); a terminal node keeps the identifier that stays and the number
of rows. Equality is thus decided on all bytes, never on a hash alone.

Memory: a trie that holds more than `trie_bytes` spills by subtree. A reading task passes its largest subtrees on as
they are, since the owners merge them again. An owner reads its rows in the order of their headers, so that every
subtree before the current header is complete and leaves as a result.

Defined cases: a null text counts as empty; empty texts are equal to each other; a null identifier is smaller than any
other; of rows with the same text and identifier one stays; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, materialise, read_table, small_side, text_slices

TRIE_BYTES = 64 << 20
_HEADER, _HEADER_SIZE = ">qQ", 16
_NODE_COST = 300


class _Node:
    __slots__ = ("children", "label", "value")

    def __init__(self, label: bytes, value: list | None = None):
        self.label, self.value, self.children = label, value, {}


def _common(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of `a` and `b[at:]`, by halving."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[at + low : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


class PatriciaTrie:
    """Byte strings with [best identifier, rows with it, rows]; `largest` says which identifier is best."""

    def __init__(self, largest: bool = True):
        self.root, self.held, self.largest = _Node(b""), 0, largest

    def _merge(self, value: list, new: list) -> None:
        a, b = value[0], new[0]
        value[2] += new[2]
        if a == b:
            value[1] += new[1]
        elif a is None or (b is not None and (b > a) == self.largest):
            value[0], value[1] = b, new[1]

    def insert(self, key: bytes, value: list) -> None:
        node, at, size = self.root, 0, len(key)
        while at < size:
            child = node.children.get(key[at])
            if child is None:
                node.children[key[at]] = _Node(key[at:], value)
                self.held += size - at + _NODE_COST
                return
            label = child.label
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            n = _common(label, key, at)
            fork = _Node(label[:n])
            child.label = label[n:]
            fork.children[child.label[0]] = child
            node.children[label[0]] = fork
            self.held += _NODE_COST
            node, at = fork, at + n
        if node.value is None:
            node.value = value
        else:
            self._merge(node.value, value)

    def drain(self, node: _Node, prefix: bytes) -> Iterator[tuple[bytes, list]]:
        """All terminals at and below `node`; `prefix` ends before its label."""
        stack = [(node, prefix + node.label)]
        while stack:
            node, key = stack.pop()
            if node.value is not None:
                yield key, node.value
            stack.extend((c, key + c.label) for c in node.children.values())

    def spill(self, target: int) -> Iterator[tuple[bytes, list]]:
        """Cut the largest subtrees below the first fork until at most `target` bytes stay."""
        fork, prefix = self.root, b""
        while len(fork.children) == 1 and fork.value is None:
            prefix, fork = prefix + fork.label, next(iter(fork.children.values()))
        cost = {k: sum(len(n.label) + _NODE_COST for n in self._nodes(c)) for k, c in fork.children.items()}
        for k in sorted(cost, key=cost.get, reverse=True):
            if self.held <= target:
                break
            yield from self.drain(fork.children.pop(k), prefix + fork.label)
            self.held -= cost[k]
        if self.held > target:
            yield from self.clear()

    def _nodes(self, node: _Node) -> Iterator[_Node]:
        stack = [node]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(node.children.values())

    def clear(self) -> Iterator[tuple[bytes, list]]:
        root, self.root, self.held = self.root, _Node(b""), 0
        yield from self.drain(root, b"")


_SHARED = pa.schema([("len", pa.int64()), ("chash", pa.int64()), ("body", pa.binary()), ("best", pa.int64()), ("ties", pa.int64()), ("n", pa.int64())])
_OWNED = pa.schema([("len", pa.int64()), ("chash", pa.int64()), ("sha", pa.string()), ("best", pa.int64()), ("ties", pa.int64()), ("n", pa.int64())])


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + (len(row[2]) if isinstance(row[2], bytes) else 64)
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def _insert_all(batches, trie: PatriciaTrie) -> Iterator[bytes]:
    """Insert each row; gives its header after each."""
    for batch in batches:
        for piece, bodies in text_slices(batch, lambda x: x.column(2)):
            size, chash, best, ties, n = (piece.column(i).to_pylist() for i in (0, 1, 3, 4, 5))
            for k, body in enumerate(bodies):
                header = struct.pack(_HEADER, size[k], chash[k] & 0xFFFFFFFFFFFFFFFF)
                trie.insert(header + body, [best[k], ties[k], n[k]])
                yield header


def _share(largest: bool, budget: int):
    def run(batches):
        def rows():
            trie = PatriciaTrie(largest)
            for _ in _insert_all(batches, trie):
                if trie.held > budget:
                    yield from trie.spill(budget // 2)
            yield from trie.clear()

        def shaped():
            for key, value in rows():
                size, chash = struct.unpack_from(_HEADER, key)
                yield size, chash - (1 << 64) if chash >> 63 else chash, key[_HEADER_SIZE :], *value

        yield from _batches(shaped(), _SHARED)

    return run


def _own(largest: bool, budget: int):
    def run(batches):
        def rows():
            trie = PatriciaTrie(largest)
            header = b""
            for now in _insert_all(batches, trie):
                if trie.held > budget and now != header:
                    # rows come in the order of headers: all but the current subtree are complete
                    for key, value in list(trie.clear()):
                        if key.startswith(now):
                            trie.insert(key, value)
                        else:
                            yield key, value
                header = now
            yield from trie.clear()

        def shaped():
            for key, (best, ties, n) in rows():
                if n > 1:
                    size, chash = struct.unpack_from(_HEADER, key)
                    yield size, chash - (1 << 64) if chash >> 63 else chash, hashlib.sha256(memoryview(key)[_HEADER_SIZE :]).hexdigest(), best, ties, n

        yield from _batches(shaped(), _OWNED)

    return run


def repeated_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest: bool = True, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row for each text of two or more rows: len, chash, sha, best (the identifier that stays), ties, n."""
    bound_batches(docs)
    text = F.coalesce(F.col(text_col), F.lit(""))
    one = F.lit(1).cast("long")
    rows = docs.select(F.octet_length(text).cast("long").alias("len"), F.xxhash64(text).alias("chash"), text.cast("binary").alias("body"), F.col(id_col).cast("long").alias("best"), one.alias("ties"), one.alias("n"))
    shared = rows.mapInArrow(_share(largest, trie_bytes), "len long, chash long, body binary, best long, ties long, n long")
    owned = shared.repartition("len", "chash").sortWithinPartitions("len", F.expr("shiftrightunsigned(chash, 1)"), "chash")
    return owned.mapInArrow(_own(largest, trie_bytes), "len long, chash long, sha string, best long, ties long, n long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest: bool = True, carry: tuple[str, ...] = (), trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """Rows (id, keep_id, group_size, kept, text_sha256) of all documents, and the struct `row` of the columns `carry`.

    Only identifiers and hashes meet the owners' rows, and only those of repeated texts: a counted small side is
    broadcast, a larger one is joined by shuffle, whose hot keys Spark splits.
    """
    groups = materialise(repeated_texts(docs, id_col, text_col, largest, trie_bytes), "exact-groups")
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("len"), F.xxhash64(text).alias("chash"), F.sha2(text.cast("binary"), 256).alias("sha"), *([F.struct(*carry).alias("row")] if carry else []))
    out = slim.join(small_side(groups), ["len", "chash", "sha"], "left")
    stays = F.col("n").isNull() | F.col("id").cast("long").eqNullSafe(F.col("best"))
    out = out.withColumns({"kept": stays, "tied": F.coalesce(F.col("ties") > 1, F.lit(False)) & stays})
    if groups.where("ties > 1").limit(1).count():
        # rows with the same text and identifier: the first of them as they were written stays
        tied = materialise(out.where("tied").withColumn("serial", F.monotonically_increasing_id()), "exact-ties")
        first = tied.groupBy("len", "sha").agg(F.min("serial").alias("first"))
        tied = tied.join(first, ["len", "sha"]).withColumn("kept", F.col("serial") == F.col("first"))
        out = out.where("not tied").unionByName(tied.select(*out.columns))
    return out.select(
        F.col("id").alias(id_col),
        F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("best")).cast("long").alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        "kept",
        F.col("sha").alias("text_sha256"),
        *(["row"] if carry else []),
    )


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with the one of its equal texts that stays."""
    return exact_dedup(read_table(spark, sf_dir, "documents"))


ORACLE = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS body FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY body) AS keep_id, CAST(count(*) OVER (PARTITION BY body) AS BIGINT) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
FROM t
"""
QUERIES = {"op2_exact_dedup": op2_exact_dedup}
ORACLES = {"op2_exact_dedup": ORACLE}
