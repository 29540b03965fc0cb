"""Shared rows and small reference computations, written from the operators' contracts."""

from __future__ import annotations

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                       T.StructField("n_chars", T.LongType())])

WORDS = "the of and to in that is was for river stone green window paper quiet garden letter music winter road".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + (str(r.randrange(40)) if r.random() < 0.5 else "") for _ in range(n))


def edge_rows() -> list[tuple]:
    long_text = prose(1, 30_000)
    return [(1, None, "en", "a", None), (2, "", "en", None, 0), (3, "   \n\t ", None, "a", 5),
            (4, prose(4, 120), "en", "a", 1), (4, prose(4, 120), "en", "a", 1), (5, prose(4, 120), "en", "b", 1),
            (None, "null id here", "en", "b", 1), (7, long_text, "en", "b", 1), (8, "x" * 20_000, "en", "c", 1),
            (9, "été où 中文 😀 '\x1c's", "fr", "c", 1), (10, "### $$$ 123", None, None, 1)]


def edge_table(spark, extra: dict[str, str] | None = None):
    """The rows above, with extra columns whose names clash with results."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame(edge_rows(), SCHEMA)
    return df.select("*", *[F.lit(v).alias(k) for k, v in (extra or {}).items()])


def empty_table(spark):
    return spark.createDataFrame([], SCHEMA)
