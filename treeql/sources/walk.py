"""Directory trees of files as a DataFrame, filtered and parsed."""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..grammar.samples import GRAMMARS
from ..operators.parse import parse
from .languages import detect_by_shebang, detect_language


@dataclass
class Policy:
    """What a walk takes; `should_parse` and `skip_tree` are tests of a file's row."""

    large_bytes: int = 256 * 1024
    skip_dirs: tuple[str, ...] = (".git", ".graft", ".hg", ".svn", "vendor", "node_modules")
    skip_endings: tuple[str, ...] = (".min.js", ".min.css", ".map", ".wasm")
    should_parse: Column | None = None
    skip_tree: Column | None = None
    #: A folder whose name ends so counts as one file, as tables of part files do: its size is the sum of theirs, and it has no text where any of them is binary or there are several.
    as_one: tuple[str, ...] = ()
    extra: dict = field(default_factory=dict)


#: Whether a file of more bytes is binary shows in its head, which the driver reads: no task then reads a file that it can't split, and no value of over 2 GB is made. So many heads are read at once.
WHOLE_BYTES, HEAD_BYTES, AT_ONCE = 64 << 20, 8192, 16


def _heads(spark: SparkSession, paths: list[str]) -> list[tuple[str, bool, str | None]]:
    """(path, whether it is binary, first line) by the first bytes of each file; a first line that begins like a shebang is read to its end."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def read(path: str) -> tuple[str, bool, str | None]:
        at = jvm.org.apache.hadoop.fs.Path(path)
        stream = at.getFileSystem(conf).open(at)
        try:
            head = more = bytes(stream.readNBytes(HEAD_BYTES))
            if b"\0" in head:
                return path, True, None
            while head[:2] == b"#!" and b"\n" not in more and (more := bytes(stream.readNBytes(HEAD_BYTES))):
                head += more
            return path, False, head.split(b"\n", 1)[0].decode("utf-8", "replace")
        finally:
            stream.close()

    with ThreadPoolExecutor(AT_ONCE) as pool:
        return list(pool.map(read, paths))


def walk(spark: SparkSession, root: str, policy: Policy | None = None) -> DataFrame:
    """(doc_id, path, lang, size, is_large, is_binary, text) of the files below `root` that the policy takes.

    Names are tested before contents are read into any expression; binary files (a zero byte in the first 8 KB) keep their row without text. Of files over `WHOLE_BYTES` only the head
    is read for that, so a walk that doesn't ask for `text` reads no large file.
    """
    policy = policy or Policy()
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    inside = [F.col("path").contains(f"/{d}/") for d in policy.skip_dirs]
    ends = [F.col("path").endswith(e) for e in policy.skip_endings]
    taken = ~reduce(Column.__or__, [*inside, *ends], F.lit(False))
    files = read.load(root).where(taken)
    first = lambda text: F.element_at(F.split(text, "\n", 2), 1)
    text = F.when(~F.col("is_binary"), F.col("content").cast("string"))
    small = files.where(F.col("length") <= WHOLE_BYTES).withColumn("is_binary", F.expr("contains(substring(content, 1, 8192), X'00')")).withColumn("text", text)
    parts = [small.select("path", "modificationTime", "length", "is_binary", "text", first(F.col("text")).alias("line"))]
    large = {r.path: (r.modificationTime, r.length) for r in files.where(F.col("length") > WHOLE_BYTES).select("path", "modificationTime", "length").collect()}
    heads = _heads(spark, list(large))
    if heads:
        sized = spark.createDataFrame([(path, *large[path], binary, line) for path, binary, line in heads], "path string, modificationTime timestamp, length long, is_binary boolean, line string")
        parts.append(sized.where("is_binary").select("path", "modificationTime", "length", "is_binary", F.lit(None).cast("string").alias("text"), "line"))
        texts = [path for path, binary, _ in heads if not binary]
        if texts:
            # the contents are read only if the column `text` is asked for
            whole = read.load([t.replace("\\", "\\\\").translate({ord(c): f"\\{c}" for c in "*?[]{}"}) for t in texts])
            parts.append(whole.join(F.broadcast(sized.select("path", "is_binary", "line")), "path").select("path", "modificationTime", "length", "is_binary", F.col("content").cast("string").alias("text"), "line"))
    files = reduce(DataFrame.unionByName, parts)
    if policy.as_one:
        files = _as_one(files, spark, root, policy.as_one)
    files = files.withColumns({"is_large": F.col("length") >= policy.large_bytes, "lang": F.coalesce(detect_language(F.col("path")), detect_by_shebang(F.col("line")))})
    if policy.should_parse is not None:
        files = files.where(policy.should_parse)
    if policy.skip_tree is not None:
        files = files.withColumn("lang", F.when(~policy.skip_tree, F.col("lang")))
    return files.select(F.xxhash64("path").alias("doc_id"), "path", "lang", F.col("length").alias("size"), "is_large", "is_binary", "text")


def _as_one(files: DataFrame, spark: SparkSession, root: str, endings: tuple[str, ...]) -> DataFrame:
    """`files` with those below the topmost folder under `root` that ends so as one row of the folder's path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toUri().toString().rstrip("/")
    inner = F.when(F.startswith("path", F.lit(base + "/")), F.substring("path", len(base) + 1, 1 << 30)).otherwise(F.col("path"))
    folder = F.regexp_extract(inner, "^(.*?(?:" + "|".join(map(re.escape, endings)) + "))/", 1)
    held = files.withColumn("path", F.when(folder == "", F.col("path")).when(F.startswith("path", F.lit(base + "/")), F.concat(F.lit(base), folder)).otherwise(folder))
    one = F.when((F.count("*") == 1) & ~F.bool_or("is_binary"), F.first("text"))
    return held.groupBy("path").agg(F.max("modificationTime").alias("modificationTime"), F.sum("length").alias("length"), F.bool_or("is_binary").alias("is_binary"), one.alias("text"), F.when(F.count("*") == 1, F.first("line")).alias("line"))


def parse_files(files: DataFrame) -> DataFrame:
    """Nodes of the files whose language has a grammar, with lang; others have none."""
    parts = [parse(files.where(F.col("lang") == lang), lang).withColumn("lang", F.lit(lang)) for lang in GRAMMARS]
    return reduce(DataFrame.unionByName, parts)


def stats(files: DataFrame) -> DataFrame:
    """One row of counts."""
    known = F.col("lang").isin(*GRAMMARS)
    return files.agg(F.count("*").alias("found"), F.count_if(known).alias("parsed"), F.count_if("is_binary").alias("binary"), F.count_if("is_large").alias("large"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
