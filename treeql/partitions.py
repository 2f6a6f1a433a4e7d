"""How rows reach Python: in enough partitions for the session, and each text once where many are equal."""

from __future__ import annotations

from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

T = TypeVar("T")
#: Results of so many texts, of so many bytes and so many rows of results together, are kept in a task: the rows of a text may weigh fifty times the text.
KEPT_TEXTS, KEPT_BYTES, KEPT_ROWS = 4096, 8 << 20, 100_000
#: Texts come to Python in batches of at most so many rows and bytes.
BATCH_ROWS, BATCH_BYTES = 10_000, 8 << 20


#: Rows of a small scan, or of what was shuffled, are dealt over so many partitions that each comes from about so many bytes of the plan's own estimate.
SPREAD_BYTES = 2 << 20
#: A join's estimate is of no use: what was shuffled has so many partitions for each slot.
SHUFFLED_EACH = 8


def by_size(df: DataFrame, each: int) -> int:
    """As many partitions as `df` needs for `each` bytes of its estimated size, one for each slot at least and 20,000 at most."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(max(df.sparkSession.sparkContext.defaultParallelism, size // each), 20_000)


#: Rows that are sorted by document are dealt over so many partitions that each comes from about so many bytes of files.
SORTED_BYTES = 8 << 20


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """`df` by a hash of `keys`, in partitions whose number grows with the files that it comes from, so that what a task sorts does not; small tables stay as they are.

    Adaptive execution would join partitions by their bytes as shuffled, which are a fraction of their rows in memory. Sizes come from the leaves of the plan, as joins are estimated by products.
    """
    n = _by_leaves(df)
    return df.repartition(n, *keys) if n > df.sparkSession.sparkContext.defaultParallelism else df


def _by_leaves(df: DataFrame) -> int:
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return min(sum(s for s in sizes if s < 1 << 50) // SORTED_BYTES, 20_000)


def swept(df: DataFrame) -> DataFrame:
    """`df` by a hash of its doc_id, for a sweep in Python: in partitions that grow with its files as those of `dealt`; of small tables in as many as adaptive execution finds.

    By a hash of its own: see `query.execute.run_query`.
    """
    key, n = F.xxhash64("doc_id"), _by_leaves(df)
    return df.repartition(n, key) if n > df.sparkSession.sparkContext.defaultParallelism else df.repartition(key)


def bound_batches(df: DataFrame, rows: int = 1000, size: int = 8 << 20) -> None:
    """Let Arrow batches of the session hold at most so many rows and bytes, if it allows more: whole texts pass through them, and their buffers stand outside of
    the executor's heap on either side. The session keeps the setting, as results are lazy and read it when they run."""
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = str(conf.get(key)).lower().removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            conf.set(key, str(most))


def spread(df: DataFrame) -> DataFrame:
    """`df` in as many partitions as the session has slots, or more for its size, if it is a mere scan of fewer or has been shuffled; its texts reach Python in bounded batches.

    A table of one small file is one partition, which one task would parse, and adaptive execution puts what was shuffled into few partitions by its bytes, which say little about the time that
    Python takes. Larger tables have more partitions than slots and stay as they are. Batches are bounded by bytes, as 10,000 texts of a large partition may be any number of them.
    """
    bound_batches(df, BATCH_ROWS, BATCH_BYTES)
    slots = df.sparkSession.sparkContext.defaultParallelism
    execution = df._jdf.queryExecution()
    if execution.executedPlan().nodeName() == "AdaptiveSparkPlan":
        return df.repartition(slots * SHUFFLED_EACH)
    if execution.toRdd().getNumPartitions() >= slots:
        return df
    return df.repartition(by_size(df, SPREAD_BYTES))


def shuffled(df: DataFrame) -> DataFrame:
    """`df` as a side of a join by document that is never broadcast: columnar files are so much smaller than their rows that Spark would send a million texts through the driver."""
    return df.hint("merge")


class Once:
    """`f` of texts, remembered for a bounded number of texts and rows of results, since tables often hold equal ones. `weigh` counts the rows of a result, one by default."""

    def __init__(self, f: Callable[[bytes | tuple], T], weigh: Callable[[T], int] = lambda found: 1):
        self._f, self._weigh, self._kept, self._size, self._rows = f, weigh, {}, 0, 0

    def __call__(self, text: bytes | tuple) -> T:
        """`text` may be a tuple of a text and whatever else decides the result."""
        found = self._kept.get(text)
        if found is None:
            found = self._f(text)
            size, rows = len(text) if isinstance(text, bytes) else len(text[0]), self._weigh(found)
            if size > KEPT_BYTES or rows > KEPT_ROWS:
                return found
            if len(self._kept) >= KEPT_TEXTS or self._size + size > KEPT_BYTES or self._rows + rows > KEPT_ROWS:
                self._kept.clear()
                self._size = self._rows = 0
            self._kept[text] = found
            self._size += size
            self._rows += rows
        return found
