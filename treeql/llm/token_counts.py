"""Token counts from flat token files by separator scan.

A flat token file is a sequence of token identifiers of fixed width, each document ended by the end-of-document identifier, without any index. It is kept here
as a table of blocks of equal length (shard, block, payload), so that any engine part can read any block; a document may cross any number of blocks.

Each block is searched for separators at once. A block returns the tokens before its first separator, the lengths between its separators, and where its last
one ends. A prefix scan over the blocks of a shard (running token and separator counts, running greatest separator end) gives each block the
number of documents before it and the tokens that an earlier block has of its first one, which stitches documents across boundaries.

`token_blocks` writes such blocks from texts, with the order of documents in each shard on the side; `flat_blocks` cuts existing files.

Defined cases: a null or empty text has 0 tokens (its separator isn't counted); the separator's own string in a text is ordinary text; tokens after the last separator of a shard are an unfinished
document; bytes at the end of a file that make no whole identifier are no token; repeated rows are counted each; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, materialise, read_table, text_slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed values of that vocabulary: its splitting pattern, and the free identifier that ends documents.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END = 50256
BLOCK_TOKENS = 1 << 18
DTYPE = "<u2"
_ENCODERS: dict = {}


def _encoder(name: str, ranks: bytes):
    """The tokenizer, built once in each Python worker."""
    if name not in _ENCODERS:
        import tiktoken

        pairs = (line.split() for line in ranks.splitlines() if line)
        _ENCODERS[name] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})
    return _ENCODERS[name]


_LAID = pa.schema([("shard", pa.int64()), ("seq", pa.int64()), ("id", pa.int64()), ("payload", pa.binary())])


def _lay_out(name: str, shared, end: int, dtype: str, block_tokens: int):
    """Texts -> rows of blocks (payload set) and of documents (payload null, seq: the place among the shard's documents)."""

    def run(batches):
        encoder = _encoder(name, shared.value)
        shard = TaskContext.get().partitionId()
        held, size, blocks, documents = [], 0, 0, 0
        width = np.dtype(dtype).itemsize

        def cut(everything: bool):
            nonlocal held, size, blocks
            flat = np.concatenate(held) if held else np.zeros(0, dtype)
            stop = len(flat) if everything else len(flat) // block_tokens * block_tokens
            payloads = [flat[a : min(a + block_tokens, stop)].tobytes() for a in range(0, stop, block_tokens)]
            held, size = [flat[stop:]], len(flat) - stop
            n = len(payloads)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([shard] * n, pa.int64()), pa.array(range(blocks, blocks + n), pa.int64()), pa.nulls(n, pa.int64()), pa.array(payloads, pa.binary())], schema=_LAID)
            blocks += n

        for batch in batches:
            for _, texts in text_slices(batch, lambda x: x.column(1)):
                for text in texts:
                    tokens = encoder.encode_ordinary(text.decode())
                    tokens.append(end)
                    held.append(np.array(tokens, dtype))
                    size += len(tokens)
                if size * width >= 8 << 20:
                    yield from cut(False)
            ids = batch.column(0)
            n = len(ids)
            yield pa.RecordBatch.from_arrays([pa.array([shard] * n, pa.int64()), pa.array(range(documents, documents + n), pa.int64()), ids.cast(pa.int64()), pa.nulls(n, pa.binary())], schema=_LAID)
            documents += n
        yield from cut(True)

    return run


def token_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, end: int = END, dtype: str = DTYPE, block_tokens: int = BLOCK_TOKENS) -> tuple[DataFrame, DataFrame]:
    """Flat token blocks (shard, block, payload) of all texts, and the documents (shard, ordinal, id) in their order."""
    bound_batches(docs)
    with open(vocabulary, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    laid = materialise(rows.mapInArrow(_lay_out(vocabulary, shared, end, dtype, block_tokens), "shard long, seq long, id long, payload binary"), "token-blocks")
    blocks = laid.where("payload is not null").select("shard", F.col("seq").alias("block"), "payload")
    return blocks, laid.where("payload is null").select("shard", F.col("seq").alias("ordinal"), "id")


def flat_blocks(spark: SparkSession, path: str, dtype: str = DTYPE, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks (shard, block, payload) of existing flat files at `path` (a file, or a folder of files) of any size; shard is a file's path.

    The driver lists names and lengths only. Each block is a byte range that a task reads by itself, so that one large file is read by many tasks.
    """
    step = block_tokens * np.dtype(dtype).itemsize
    bound_batches(spark.range(0), max(1, (8 << 20) // step))
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    files = [(f.getPath().toString(), f.getLen()) for f in fs.listStatus(where) if f.isFile() and not f.getPath().getName().startswith(("_", "."))]
    kind = pa.schema([("shard", pa.string()), ("block", pa.int64()), ("payload", pa.binary())])

    def run(batches):
        for batch in batches:
            for shard, block, size in zip(*(batch.column(i).to_pylist() for i in range(3))):
                # Hadoop writes local paths with one slash only
                uri = "file://" + shard.removeprefix("file:") if shard.startswith("file:/") and not shard.startswith("file://") else shard
                system, name = FileSystem.from_uri(quote(uri, safe="/:@"))
                with system.open_input_file(name) as f:
                    payload = f.read_at(min(step, size - block * step), block * step)
                yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([block]), pa.array([payload], pa.binary())], schema=kind)

    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / step)))
    ranges = spark.createDataFrame(files, "shard string, size long").where("size > 0").select("shard", blocks.alias("block"), "size")
    tasks = max(1, sum(-(-size // step) for _, size in files) // 256)
    return ranges.repartition(tasks, "shard", "block").mapInArrow(run, "shard string, block long, payload binary")


def _scan(end: int, dtype: str):
    def run(batches):
        for batch in batches:
            tokens, found, head, after, inner = [], [], [], [], []
            for payload in batch.column(2).to_pylist():
                ids = np.frombuffer(payload, dtype, len(payload) // np.dtype(dtype).itemsize)
                at = np.flatnonzero(ids == end)
                tokens.append(len(ids))
                found.append(len(at))
                head.append(int(at[0]) if len(at) else len(ids))
                after.append(int(at[-1]) + 1 if len(at) else None)
                inner.append(np.diff(at) - 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(tokens, pa.int64()), pa.array(found, pa.int64()), pa.array(head, pa.int64()), pa.array(after, pa.int64()), pa.array(inner, pa.list_(pa.int64()))],
                names=["shard", "block", "tokens", "found", "head", "after", "inner"],
            )

    return run


def separator_scan(blocks: DataFrame, end: int = END, dtype: str = DTYPE) -> DataFrame:
    """Rows (shard, ordinal, n_tokens, finished): the length of each document of each shard, in order."""
    kind = blocks.schema["shard"].dataType.simpleString()
    scanned = blocks.select("shard", "block", "payload").mapInArrow(_scan(end, dtype), f"shard {kind}, block long, tokens long, found long, head long, after long, inner array<long>")
    earlier = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = scanned.withColumns({"start": F.coalesce(F.sum("tokens").over(earlier), F.lit(0)), "before": F.coalesce(F.sum("found").over(earlier), F.lit(0))})
    placed = placed.withColumn("ended", F.coalesce(F.max(F.col("start") + F.col("after")).over(earlier), F.lit(0)))
    carried = F.col("start") - F.col("ended")
    is_last = F.lead("block").over(Window.partitionBy("shard").orderBy("block")).isNull()
    rest = F.when(F.col("found") > 0, F.col("tokens") - F.col("after")).otherwise(carried + F.col("tokens"))
    whole = F.when(F.col("found") > 0, F.concat(F.array(carried + F.col("head")), "inner")).otherwise(F.expr("cast(array() as array<bigint>)"))
    placed = placed.select("shard", "before", whole.alias("whole"), F.when(is_last & (rest > 0), rest).alias("rest"))
    ended = F.transform("whole", lambda n, i: F.struct((F.col("before") + i).alias("ordinal"), n.alias("n_tokens"), F.lit(True).alias("finished")))
    open_one = F.when(F.col("rest").isNotNull(), F.array(F.struct((F.col("before") + F.size("whole")).alias("ordinal"), F.col("rest").alias("n_tokens"), F.lit(False).alias("finished")))).otherwise(F.expr("cast(array() as array<struct<ordinal:bigint,n_tokens:bigint,finished:boolean>>)"))
    return placed.select("shard", F.explode(F.concat(ended, open_one)).alias("d")).select("shard", "d.*")


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, end: int = END, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Rows (id, n_tokens) of all documents, counted in their flat token blocks."""
    blocks, order = token_blocks(docs, id_col, text_col, vocabulary, end, DTYPE, block_tokens)
    counted = separator_scan(blocks, end)
    return order.join(counted, ["shard", "ordinal"]).select(F.col("id").alias(id_col), "n_tokens")


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    """The number of tokens of every document."""
    return token_counts(read_table(spark, sf_dir, "documents"))


QUERIES = {"op4_token_counts": op4_token_counts}
ORACLES: dict[str, str] = {}
