"""Shards of near equal bytes that never part equal texts: minimax contiguous partition.

Equal texts form one atomic group. Groups stand in the order of a 63-bit hash of their text
(two texts that share the hash stay together, too). The smallest capacity with which a greedy
walk needs no more than the wanted shards is found by binary search; the cuts then lie as even as
that capacity allows.

The walk only asks "which group ends last at or before x". It asks a table of blocks (runs of
groups with common leading hash bits): 2 ** 16 blocks at first, and wherever an answer depends
on the inside of a block, that block is split in FAN parts by one more query over the stored group
ends, until no answer is open. The driver sees blocks, a few ten thousand rows at any size.

A row's slot is its rank by (hash, salt, id): running sums over (hash, salt) cells give each
cell's first slot, and rows are numbered inside their cell, so a group that holds a third
of all rows is numbered by SALTS tasks.

Everything is DataFrame functions. Defined results: a null text has size 1, like an empty one, and
forms its own group; rows that repeat everything get neighbouring slots; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skylag.llm.keys import col
from skylag.sources.scratch import materialize

HASH_BITS = 63
FIRST_BITS = 16
FAN_BITS = 6
SALTS = 4096


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(
        col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(col("text")), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(col("text")), 64 - HASH_BITS).alias("place"),
        F.pmod(F.xxhash64(col("doc_id")), F.lit(SALTS)).cast("int").alias("salt"),
    )


def _cells(rows: DataFrame) -> DataFrame:
    """(place, salt) cells with the bytes up to their end and the rows before their start."""
    bin_of = F.shiftright("place", HASH_BITS - FIRST_BITS)
    cells = rows.groupBy("place", "salt").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    cells = cells.withColumn("bin", bin_of)
    inside = Window.partitionBy("bin").orderBy("place", "salt")
    cells = cells.withColumns({"run_size": F.sum("size").over(inside), "run_n": F.sum("n").over(inside)})
    # At most 2 ** 16 bins, added up in two steps of at most 2 ** 8 rows a group.
    bins = rows.groupBy(bin_of.alias("bin")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    bins = bins.withColumn("top", F.shiftright("bin", 8))
    tops = bins.groupBy("top").agg(F.sum("size").alias("size"), F.sum("n").alias("n"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    of_top, of_all = before.partitionBy("top").orderBy("bin"), before.partitionBy(F.lit(0)).orderBy("top")
    prior = lambda name, window: F.coalesce(F.sum(name).over(window), F.lit(0))
    tops = tops.select("top", prior("size", of_all).alias("top_size"), prior("n", of_all).alias("top_n"))
    bins = bins.select("top", "bin", prior("size", of_top).alias("bin_size"), prior("n", of_top).alias("bin_n"))
    starts = bins.join(tops, "top").select(
        "bin", (F.col("bin_size") + F.col("top_size")).alias("size_before"), (F.col("bin_n") + F.col("top_n")).alias("n_before")
    )
    return cells.join(starts, "bin").select(
        "place",
        "salt",
        (F.col("size_before") + F.col("run_size")).alias("end"),
        (F.col("n_before") + F.col("run_n")).alias("end_n"),
        (F.col("n_before") + F.col("run_n") - F.col("n")).alias("first"),
    )


class _Blocks:
    """Ends of groups, as far as they were asked for."""

    def __init__(self, cells: DataFrame):
        self.cells = cells
        self.blocks = self._fetch(HASH_BITS - FIRST_BITS, None)
        self._index()

    def _fetch(self, shift: int, parents: tuple[int, list[int]] | None) -> list[dict]:
        at = F.shiftright("place", shift)
        chosen = self.cells if parents is None else self.cells.where(F.shiftright("place", parents[0]).isin(parents[1]))
        rows = chosen.groupBy(at.alias("key")).agg(
            F.min("place").alias("low"), F.max("place").alias("high"), F.max("end").alias("end"), F.max("end_n").alias("end_n")
        )
        return [{**r.asDict(), "shift": shift, "whole": r["low"] == r["high"]} for r in rows.collect()]

    def _index(self) -> None:
        self.blocks.sort(key=lambda b: b["high"])
        self.ends = [b["end"] for b in self.blocks]
        self.total = self.ends[-1] if self.ends else 0
        self.open: set[int] = set()

    def floor(self, x: int) -> int:
        """The last known group end at or before x; notes the block that may hold a later one."""
        i = bisect_right(self.ends, x)
        if i < len(self.ends) and not self.blocks[i]["whole"]:
            self.open.add(i)
        return self.ends[i - 1] if i else 0

    def after(self, x: int) -> int:
        """The first known group end after x."""
        i = bisect_right(self.ends, x)
        if i < len(self.ends) and not self.blocks[i]["whole"]:
            self.open.add(i)
        return self.ends[min(i, len(self.ends) - 1)]

    def refine(self) -> None:
        """Split the noted blocks: at most 2 ** FAN_BITS rows for each."""
        by_shift: dict[int, list[int]] = {}
        for i in self.open:
            by_shift.setdefault(self.blocks[i]["shift"], []).append(self.blocks[i]["key"])
        kept = [b for i, b in enumerate(self.blocks) if i not in self.open]
        for shift, keys in by_shift.items():
            kept += self._fetch(max(0, shift - FAN_BITS), (shift, keys))
        self.blocks = kept
        self._index()

    def reach(self, start: int, shards: int, capacity: int) -> int:
        for _ in range(shards):
            if start == self.total:
                break
            start = self.floor(start + capacity)
        return start

    def at(self, end: int) -> dict:
        return self.blocks[bisect_left(self.ends, end)]


def plan_cuts(blocks: _Blocks, shards: int) -> tuple[int, list[int]]:
    """The smallest feasible capacity, and the bytes at which the shards end."""
    while True:
        low, high = -(-blocks.total // shards), blocks.total
        while low < high:
            middle = (low + high) // 2
            if blocks.reach(0, shards, middle) == blocks.total:
                high = middle
            else:
                low = middle + 1
        cuts, start = [], 0
        for left in range(shards - 1, 0, -1):
            target = start + -(-(blocks.total - start) // (left + 1))
            below = blocks.floor(target)
            above = blocks.after(below)
            best = above if above - target < target - below or below <= start else below
            if not (start < best <= start + low and blocks.reach(best, left, low) == blocks.total):
                best = below
            if not (start < best <= start + low and blocks.reach(best, left, low) == blocks.total):
                best = blocks.floor(start + low)  # the farthest cut is feasible whenever any is
            cuts.append(best)
            start = best
        if not blocks.open:
            return low, cuts
        blocks.refine()


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row."""
    rows = materialize(_rows(docs), "shard-rows")
    cells = materialize(_cells(rows), "shard-cells")
    blocks = _Blocks(cells)
    _, cuts = plan_cuts(blocks, shards) if blocks.total else (0, [])
    number, first = F.lit(0), [0]
    for end in cuts:
        block = blocks.at(end)
        number = number + F.when(F.col("place") > block["high"], 1).otherwise(0)
        first.append(block["end_n"])
    nth = F.row_number().over(Window.partitionBy("place", "salt").orderBy("doc_id"))
    numbered = rows.join(cells.select("place", "salt", "first"), ["place", "salt"]).withColumns({"nth": nth, "shard": number.cast("int")})
    start = F.get(F.lit(first).cast("array<bigint>"), F.col("shard"))
    return numbered.select(
        "doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("nth") - 1 - start).cast("long").alias("slot")
    )
