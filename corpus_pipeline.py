"""The corpus pipeline: stages over `documents`, each written as Parquet and read again by the next.

A stage takes (spark, docs, sf_dir) and returns the rows that it keeps. All but the last return the columns of `documents`; the last adds what
the mix takes of each row.

Defined cases, for every stage: an empty table gives an empty one; nulls in any column but the text change nothing; a null or empty text has no language and goes with the first stage; rows
equal in text are one to the second stage, which keeps the largest identifier; other texts under one identifier are judged each by itself; further columns of `documents` pass through. A
figure of the mix whose name a column has already is called mix_<name>.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeql.llm.common import materialise, read_table
from treeql.llm.decontamination import drop_contaminated
from treeql.llm.exact_dedup import exact_dedup
from treeql.llm.language_id import UNKNOWN, identify
from treeql.llm.mixing import mix
from treeql.llm.ngram_join import keep_one_per_group


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those without any letter go."""
    return identify(docs, carry=tuple(docs.columns)).where(F.col("lang_pred") != UNKNOWN).select("row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the largest identifier."""
    return exact_dedup(docs, carry=tuple(docs.columns)).where("kept").select("row.*")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest identifier."""
    return keep_one_per_group(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the mix takes words, with their size, their source's size and target, and the words taken."""
    out = mix(docs, carry=tuple(docs.columns)).where("taken > 0")
    names = {c.lower() for c in docs.columns}
    return out.select("row.*", *[F.col(c).alias(f"mix_{c}" if c in names else c) for c in ("size", "source_size", "target", "taken")])


STAGES = [("language", language), ("exact_dedup", exact), ("ngram_join", near), ("decontamination", benchmark), ("mixing", mixed)]

#: Language identification and near copies aren't SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
