"""Shared pieces of the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..partitions import bound_batches  # noqa: F401 - the operators take it from here

#: White space between words; a word is a maximal run of anything else.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Sides of at most so many rows and bytes may be broadcast after they have been counted.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir. Where none is named, a session that runs in one process gets a temporary one; on a cluster that is an error,
    as its machines share no local folder."""
    sc = spark.sparkContext
    where = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="treeql-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def _write(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as a Parquet table in the shared folder and read it back, which cuts its lineage. The table stays, since lazy results read it."""
    return _write(df, name)[0]


class Scratch:
    """Tables that are needed only until a later one has been written: as `materialise`, but removed at the end of the `with` block, or by `drop`."""

    def __init__(self, spark: SparkSession):
        self._spark, self._paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def write(self, df: DataFrame, name: str) -> DataFrame:
        out, path = _write(df, name)
        self._paths.append((out, path))
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table, path in [x for x in self._paths if any(x[0] is t for t in tables)]:
            self._paths.remove((table, path))
            where = self._spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self._spark._jsc.hadoopConfiguration()).delete(where, True)

    def __exit__(self, *error) -> None:
        self.drop(*[t for t, _ in self._paths])


def _width(field) -> Column:
    """The bytes of a column's value, of nested ones those of its JSON."""
    kind, c = field.dataType.typeName(), F.col(f"`{field.name}`")
    if kind in ("struct", "array", "map"):
        return F.octet_length(F.to_json(c))
    return F.octet_length(c) if kind in ("string", "binary") else F.lit(8)


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """`df` with a broadcast hint if it has at most `limit` rows and `size` bytes; else as it is, for a shuffled join."""
    width = sum((F.coalesce(_width(f), F.lit(0)) for f in df.schema.fields), F.lit(16)).cast("long")
    rows, total = df.select(width.alias("w")).limit(limit + 1).agg(F.count("*"), F.coalesce(F.sum("w"), F.lit(0))).first()
    return F.broadcast(df) if rows <= limit and total <= size else df


def word_count(text: Column) -> Column:
    """Number of words of a text, null as empty."""
    pieces = F.size(F.split(text, SPACE + "+", -1))
    ends = text.rlike(r"\A" + SPACE).cast("int") + F.substring(text, -1, 1).rlike(SPACE).cast("int")
    return F.when(text.isNull() | (text == ""), F.lit(0)).otherwise(pieces - ends).cast("long")


def text_slices(batch, of, rows: int = 512):
    """Slices of an Arrow batch of at most `rows` rows, with their texts as bytes; `of` takes the column of texts from a slice.

    Only one slice's texts are Python objects at a time, and what Arrow has freed goes back to the system.
    """
    for start in range(0, len(batch), rows):
        piece = batch.slice(start, rows)
        yield piece, [t.encode() if isinstance(t, str) else t or b"" for t in of(piece).to_pylist()]
    pa.default_memory_pool().release_unused()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
