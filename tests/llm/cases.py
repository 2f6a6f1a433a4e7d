"""Small tables with the awkward cases that every operator has to bear, and a runner of a query's SQL."""

import random
import re

import duckdb
import pandas as pd
from pyspark.sql import types as T

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    ]
)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def awkward(spark, extra=(), repeated=True):
    """Nulls in each column, empty and blank texts, a long one, copies, a repeated row."""
    rng = random.Random(1)
    long = words(rng, 30_000, 5000)
    rows = [
        (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \t\n\x0b", None, None, 4), (4, "same text here now and then", "en", "a", 5),
        (5, "same text here now and then", "fr", "b", 5), (6, long, "en", "b", len(long)), (None, "no identifier at all", "en", "b", 1),
        (7, "é😀 ß x", "de", "", 6), (8, "x" * 50_000, "en", "c", 50_000), (9, None, None, None, None), (10, "...", "en", "c", 3),
    ]
    if repeated:
        rows += [(4, "same text here now and then", "en", "a", 5)]
    return spark.createDataFrame(rows + list(extra), SCHEMA)


def clashing(df):
    """The same rows with columns named like the operators' own."""
    from pyspark.sql import functions as F

    for name in ("id", "n", "size", "rep", "root", "anchor", "body", "spans", "row", "kept", "hash", "block", "shard", "score", "best", "k1", "stats"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def sql_rows(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(f"{name}_frame", df.toPandas().astype({"doc_id": "Int64"}))
        con.execute(f"create view {name} as select * from {name}_frame")
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    return sorted((tuple(sorted(zip(names, (None if pd.api.types.is_scalar(v) and pd.isna(v) else v for v in r)))) for r in cursor.fetchall()), key=repr)


def spark_rows(df):
    return sorted((tuple(sorted(r.asDict().items())) for r in df.collect()), key=repr)
