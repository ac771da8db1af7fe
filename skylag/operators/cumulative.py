"""Exact running totals and order statistics without a one-task window.

A window ordered over a whole group sends that group to one task. Here the distinct
values are range-partitioned into slices first. Each slice is summed on its own, the
few slice totals give each slice its starting offset, and the running sum happens
inside a slice only. Repeated values have been counted before the shuffle, so a value
or key that holds a third of all rows is one row here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylag.sources.scratch import materialize

_SLICE = "_slice"


def cumulative_counts(
    counts: DataFrame,
    keys: Sequence[str],
    value: str,
    measures: Sequence[str],
    slices: Column | None = None,
) -> DataFrame:
    """Add `cum_<m>` (running sum up to and including the value) and `total_<m>`.

    `counts` holds one row per (keys, value); keys are never NULL, and a NULL value
    sorts first. The sliced table is written once, because the slice borders are
    sampled and must be the same for the offsets and for the rows. `slices`, a
    condition over `before_<m>`, `in_<m>` and `total_<m>`, leaves out slices that the
    caller does not need before their rows are sorted.
    """
    keys = list(keys)
    sliced = materialize(
        counts.select(*keys, value, *measures)
        .repartitionByRange(*keys, value)
        .withColumn(_SLICE, F.spark_partition_id()),
        "cumulative",
    )
    group = keys or [F.lit(0)]
    earlier = Window.partitionBy(*group).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    # One row per slice and key at most: partitions plus keys, not rows.
    offsets = (
        sliced.groupBy(*keys, _SLICE)
        .agg(*[F.sum(m).alias(f"in_{m}") for m in measures])
        .select(
            *keys,
            _SLICE,
            *[f"in_{m}" for m in measures],
            *[F.coalesce(F.sum(f"in_{m}").over(earlier), F.lit(0)).alias(f"before_{m}") for m in measures],
            *[F.sum(f"in_{m}").over(whole).alias(f"total_{m}") for m in measures],
        )
    )
    if slices is not None:
        offsets = offsets.where(slices)
    inside = (
        Window.partitionBy(*keys, _SLICE).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    )
    # Offsets are few: they move to the slices, never the other way round.
    return sliced.join(offsets.hint("shuffle_hash"), [*keys, _SLICE]).select(
        *keys,
        value,
        *measures,
        *[(F.col(f"before_{m}") + F.sum(m).over(inside)).alias(f"cum_{m}") for m in measures],
        *[f"total_{m}" for m in measures],
    )


def page(df: DataFrame, order: Sequence[str], offset: int, limit: int) -> DataFrame:
    """Rows offset .. offset+limit-1 in a total order: `order`, then row hash, then all columns.

    Pages of any size and offset fit together without gaps or repeats, also where order keys
    tie. Only keys are counted and summed; rows are read where their key lies on the page. Row
    hash bins split a key that many rows share. Rows of a bin that lies wholly on the page are
    taken as they are; only those of its first and last bin are ranked, so a page of any share of
    the rows spreads over many tasks (copies of one whole row share a bin). Columns must be orderable.
    """
    row_hash = F.xxhash64(*df.columns)
    key = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(order)], F.shiftright(row_hash, 48).alias("bin"))
    counts = df.groupBy(key.alias("_key")).agg(F.count(F.lit(1)).alias("n"))
    end = offset + limit
    overlap = (F.col("before_n") < end) & (F.col("before_n") + F.col("in_n") > offset)
    running = cumulative_counts(counts, [], "_key", ["n"], slices=overlap)
    first = F.col("cum_n") - F.col("n")
    on_page = running.where((F.col("cum_n") > offset) & (first < end))
    edge = materialize(on_page.agg(F.min("_key").alias("_low"), F.max("_key").alias("_high")), "page")
    if edge.first()["_low"] is None:
        return df.limit(0)
    cut = materialize(on_page.where((first < offset) | (F.col("cum_n") > end)).select(F.col("_key").alias("_cut"), first.alias("_first")), "page-ends")
    total = [*order, row_hash, *[F.col(c) for c in df.columns if c not in order]]
    near = (
        df.withColumn("_key", key)
        .join(F.broadcast(edge), (F.col("_key") >= F.col("_low")) & (F.col("_key") <= F.col("_high")))  # one row
        .join(F.broadcast(cut), (F.col("_key") >= F.col("_cut")) & (F.col("_key") <= F.col("_cut")), "left")  # two rows at most
    )
    rank = F.col("_first") + F.row_number().over(Window.partitionBy("_cut").orderBy(*total)) - 1
    ends = near.where(F.col("_first").isNotNull()).withColumn("_rank", rank).where((F.col("_rank") >= offset) & (F.col("_rank") < end))
    whole = near.where(F.col("_first").isNull())
    return whole.select(*df.columns).unionAll(ends.select(*df.columns)).orderBy(*total)


def at_rank(value: str, measure: str, rank: Column) -> Column:
    """Aggregate: the value at a zero-based rank, counting `measure` rows per value."""
    cum = F.col(f"cum_{measure}")
    return F.max(F.when((cum - F.col(measure) <= rank) & (rank < cum), F.col(value)))


def linear_percentile(value: str, measure: str, fraction: float) -> Column:
    """Aggregate: percentile with linear interpolation over a cumulative table."""
    position = F.lit(float(fraction)) * (F.col(f"total_{measure}") - 1)
    low, high = at_rank(value, measure, F.floor(position)), at_rank(value, measure, F.ceil(position))
    part = F.max(position - F.floor(position))
    return low + part * (high - low)
