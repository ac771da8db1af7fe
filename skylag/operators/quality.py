"""Table-level quality checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skylag.sources.scratch import materialize

SALTS = 16


def missing(df: DataFrame, name: str) -> Column:
    """NULL, or NaN in a float column."""
    col = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, T.DoubleType | T.FloatType):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def null_fractions(df: DataFrame) -> DataFrame:
    """(column, null_fraction) of every column from one aggregation."""
    row = df.agg(
        *[F.avg(missing(df, c).cast("double")).alias(f"_{i}") for i, c in enumerate(df.columns)]
    )
    pairs = [
        F.struct(F.lit(c).alias("column"), F.col(f"_{i}").alias("null_fraction"))
        for i, c in enumerate(df.columns)
    ]
    return row.select(F.inline(F.array(*pairs)))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: how many rows repeat an earlier one, NULL equal to NULL.

    Whole rows are wide, so the first pass moves only a 64-bit digest and its count.
    Rows whose digest is unique cannot be duplicates; only the others are compared in
    full, which makes the figure exact even when two different rows share a digest. A row
    that fills much of the table is counted apart by scan partition, then summed.
    """
    columns = [F.col(f"`{c}`") for c in df.columns]
    hashed = df.withColumns({"_digest": F.xxhash64(*columns), "_salt": F.spark_partition_id() % SALTS})
    repeated = materialize(
        hashed.groupBy("_digest").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_digest"),
        "repeated-digests",
    )
    salted = repeated.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    parts = (
        hashed.join(salted, ["_digest", "_salt"], "left_semi")
        .groupBy("_digest", "_salt", *columns)
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    groups = parts.groupBy("_digest", *columns).agg(F.sum("_n").alias("_n"))
    return groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"))


def data_quality(
    df: DataFrame, required: Sequence[str] = (), max_null_fraction: float = 0.5
) -> DataFrame:
    """Rows (check, column, value, passed): emptiness, columns, NULL shares, duplicates."""
    row = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.avg(missing(df, c).cast("double")).alias(f"_{i}") for i, c in enumerate(df.columns)],
    )

    def line(check: str, column: str | None, value: Column, passed: Column) -> Column:
        return F.struct(
            F.lit(check).alias("check"),
            F.lit(column).cast("string").alias("column"),
            value.cast("double").alias("value"),
            F.coalesce(passed, F.lit(True)).alias("passed"),
        )

    lines = [line("row_count", None, F.col("_rows"), F.col("_rows") > 0)]
    for name in required:
        present = F.lit(name in df.columns)
        lines.append(line("required_column", name, present.cast("int"), present))
    for i, name in enumerate(df.columns):
        share = F.col(f"_{i}")
        lines.append(line("null_fraction", name, share, share <= max_null_fraction))
    duplicates = duplicate_rows(df).select(
        F.inline(F.array(line("duplicate_rows", None, F.col("duplicate_rows"), F.col("duplicate_rows") == 0)))
    )
    return row.select(F.inline(F.array(*lines))).unionAll(duplicates)


def passed(report: DataFrame) -> DataFrame:
    """One row: did every check pass, and how many did not."""
    return report.agg(
        F.every("passed").alias("passed"), F.count_if(~F.col("passed")).alias("n_issues")
    )
