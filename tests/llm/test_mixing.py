import random

import pytest
from pyspark.sql import functions as F

from treeql.llm import mixing

from .cases import SCHEMA, awkward, clashing, spark_rows, sql_rows, words

COLUMNS = ["doc_id", "size", "source_size", "target", "taken"]


def test_equals_sorted_sql(spark):
    rng = random.Random(3)
    rows = [(i, words(rng, rng.randint(0, 60)), "en", rng.choice(["s1", "s1", "s1", "s2", "s3", None]), 0) for i in range(100, 500)]
    docs = awkward(spark, rows)
    assert spark_rows(mixing.mix(docs).select(*COLUMNS)) == sql_rows(mixing.ORACLE, documents=docs)


def test_bounds_and_reruns(spark):
    docs = awkward(spark, [(i, "one two three", "en", "big" if i % 3 else "small", 0) for i in range(100, 400)])
    once, again = mixing.mix(clashing(docs)), mixing.mix(docs)
    assert spark_rows(once) == spark_rows(again)
    assert once.where("taken > 3 * size or target > 3 * source_size").count() == 0
    off = once.groupBy("source").agg(F.abs(F.sum("taken") - F.first("target")).alias("off"), F.max("size").alias("most"))
    assert off.where("off > most").count() == 0
    total = once.groupBy("source").agg(F.first("target").alias("t"), F.first("source_size").alias("s")).agg(F.sum("t"), F.sum("s")).first()
    assert total[0] == pytest.approx(total[1])


def test_empty_table(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
