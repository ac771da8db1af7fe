"""Selecting rows by a set of keys without shuffling the rows that are not in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The table of key bits has at most 2 ** (BITS - 6) rows of 16 bytes, whatever the input: 2 MB.
BITS = 23


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names near `names` that `df` does not use."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def col(name: str) -> Column:
    """A top-level column, also when its name holds dots or quotes."""
    return F.col("`" + name.replace("`", "``") + "`")


def _word(key: Column) -> Column:
    return F.shiftrightunsigned(key, 64 - (BITS - 6))


def _bit(key: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), key.bitwiseAND(F.lit(63)).cast("int"))


def key_bits(keys: DataFrame, key: Column) -> DataFrame:
    """One bit for each 64-bit `key`, in a table of bounded size."""
    return keys.select(_word(key).alias("_word"), _bit(key).alias("_bit")).groupBy("_word").agg(
        F.bit_or("_bit").alias("_bits")
    )


def with_maybe(df: DataFrame, bits: DataFrame, key: Column, name: str) -> DataFrame:
    """Add `name`: false where `key` certainly has no bit set by `key_bits`.

    The broadcast table has at most 2 ** (BITS - 6) rows. When it fills up, more rows are
    called possible, which costs time and changes no result.
    """
    word, mask = fresh(df, "_word", "_bits")
    small = F.broadcast(bits.toDF(word, mask))
    joined = df.withColumn("_probe_" + word, _word(key))
    found = joined.join(small, joined["_probe_" + word] == small[word], "left")
    return found.withColumn(
        name, F.coalesce(F.col(mask).bitwiseAND(_bit(key)) != 0, F.lit(False))
    ).drop("_probe_" + word, word, mask)


def without(df: DataFrame, dropped: DataFrame, key: list[Column], names: list[str]) -> DataFrame:
    """Rows of `df` whose `key` is not a row of `dropped` (columns `names`); null equals null.

    Only rows that share a bit with a dropped key are shuffled; all others go straight through.
    """
    maybe, *local = fresh(df, "_maybe", *(f"_key{i}" for i in range(len(key))))
    bits = key_bits(dropped, F.xxhash64(*names))
    marked = with_maybe(df, bits, F.xxhash64(*key), maybe)
    out = dropped.select(*(F.col(n).alias(c) for n, c in zip(names, local, strict=True))).distinct()
    some = marked.where(F.col(maybe))
    condition = F.lit(True)
    for k, c in zip(key, local, strict=True):
        condition = condition & k.eqNullSafe(out[c])
    kept = some.join(out, condition, "left_anti")
    return marked.where(~F.col(maybe)).unionByName(kept).drop(maybe)


def once(df: DataFrame, repeated: DataFrame, key: list[Column], names: list[str]) -> DataFrame:
    """`df` with one row of each `key` that is a row of `repeated` (columns `names`); all other rows stay."""
    maybe, nth, *local = fresh(df, "_maybe", "_nth", *(f"_key{i}" for i in range(len(key))))
    marked = with_maybe(df, key_bits(repeated, F.xxhash64(*names)), F.xxhash64(*key), maybe)
    out = repeated.select(*(F.col(n).alias(c) for n, c in zip(names, local, strict=True))).distinct().withColumn(nth, F.lit(1))
    condition = F.lit(True)
    for k, c in zip(key, local, strict=True):
        condition = condition & k.eqNullSafe(out[c])
    some = marked.where(F.col(maybe)).join(out, condition, "left")
    # Rows of one key are ranked within their partition first, so that only its first ones are shuffled.
    listed = some.where(F.col(nth).isNotNull())
    number = F.row_number().over(Window.partitionBy(*local).orderBy(F.lit(0)))
    first = listed.withColumn(nth, number).where(F.col(nth) == 1)
    own = [col(c) for c in df.columns]
    return marked.where(~F.col(maybe)).select(own).unionByName(some.where(F.col(nth).isNull()).select(own)).unionByName(first.select(own))
