"""Small tables with nulls, ties, repeated rows, long texts and clashing column names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLASHING = ("_maybe", "key", "n", "_word", "_bits", "score", "words", "cid", "_noise", "my.dot", "_sha", "_keep", "_nth", "first", "doc", "whole", "spans")
SCHEMA = "doc_id long, text string, path string"


def plain(spark: SparkSession, texts: list[str | None]) -> DataFrame:
    return spark.createDataFrame([(i, t, f"src/{i}") for i, t in enumerate(texts)], SCHEMA)


def awkward(spark: SparkSession) -> DataFrame:
    long_text = " ".join(f"word{i % 977}" for i in range(30_000))
    rows = [
        (1, "a b c d e f g", "x/1"),
        (1, "a b c d e f g", "x/1"),
        (2, "a b c d e f g", "x/2"),
        (3, None, None),
        (4, "", "y/4"),
        (5, "   \n\t", "y/5"),
        (None, "a b c d e f g", "x/n"),
        (None, None, None),
        (6, long_text, "z/6"),
        (7, "one", "z/7"),
        (-8, "ÉCOLE İstanbul \U0001f600 ß", "z/8"),
        (9, long_text + " end", "z/9"),
    ]
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(0) for c in CLASHING})


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
