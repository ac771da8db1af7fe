"""Joins with a table of counted keys, where a few keys may hold most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys with more than a HOT-th of all rows are fewer than HOT: their table is broadcast, whatever the input.
HOT = 2048


def join_counted(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """`rows` joined to `groups` (one row per key; `size` = how many of the `total` rows have it) on `keys`.

    Rows of frequent keys stay where they are; all others meet by a shuffle in which no key has
    more than a HOT-th of the rows. Keys must not be null.
    """
    bound = total // HOT
    often = groups.where(F.col(size) > bound)
    seldom = groups.where(F.col(size) <= bound)
    named = [F.col(k).alias(f"_hot_{k}") for k in keys]
    known = F.broadcast(often.select(*named).withColumn("_often", F.lit(True)))  # fewer than HOT rows
    same: Column = F.lit(True)
    for k in keys:
        same = same & (rows[k] == known[f"_hot_{k}"])
    marked = rows.join(known, same, "left").drop(*(f"_hot_{k}" for k in keys))
    few = marked.where(F.col("_often").isNull()).drop("_often").join(seldom, keys)
    many = marked.where(F.col("_often").isNotNull()).drop("_often").join(F.broadcast(often), keys)  # fewer than HOT rows
    return few.unionByName(many)
