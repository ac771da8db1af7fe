"""Merkle manifest of a data set by a butterfly exchange.

Rows become leaves; the leaves of one tree (here: of one source), in order, are hashed in runs of FANOUT
until one node is left; the roots of all trees, in order, become the leaves of the upper tree.

1. One scan hashes every row into a slim leaf. Leaves are range-partitioned by (tree, order) and get their exact
   place in the tree from per-slice counts, so one tree with a third of all rows spreads over many slices.
2. Aligned blocks of FANOUT ** depth leaves are the partitions of the exchange. Each hashes its own
   subtree; a last run with fewer nodes, even one, is hashed as well.
3. Butterfly: in round r, partitions whose subtrees are brothers at height r, and which have the same place below it, swap
   their subtree roots. Every one of them hashes the common ancestor for itself and notes what it received: its
   siblings. After log(partitions) rounds each partition holds the root and the whole upper part of its proofs, so
   nothing is passed down again. A smaller last subtree serves its larger brothers in turn.
4. A block's leaves meet their block's upper proof in one task, which completes the proof of each leaf.

A round moves FANOUT small rows per partition and is stored, so a lost executor repeats one round at most.

Defined results: a null is hashed as `-` (an empty value as `0:`); null order keys come first; rows with the same order
key are ordered by their leaf; rows that repeat completely are leaves of their own; a null tree comes before all
others; an empty table gives an empty result; columns beside the named ones are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from skylag.llm.keys import col
from skylag.sources.scratch import materialize

FANOUT = 3
#: Leaves of a block: FANOUT ** DEPTH.
DEPTH = 7
#: Slices of the ordered leaves; one small row per slice is broadcast.
SLICES = 4096
#: Rows that a task hashes at once, beside the block it is in.
ROWS = 8192


def node_hash(*digests: str) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def field(value: Column) -> Column:
    """Length-prefixed UTF-8 of a value, so that neighbouring fields cannot be taken for one another."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def heights(leaves: int, fanout: int = FANOUT) -> list[int]:
    """Number of nodes on each level, from the leaves to the root."""
    out = [leaves]
    while out[-1] > 1:
        out.append(-(-out[-1] // fanout))
    return out


def run_sizes(place: int, leaves: int, fanout: int = FANOUT) -> list[tuple[int, int]]:
    """(place within the run, nodes of the run) on every level below the root of the leaf at `place`."""
    out = []
    for nodes in heights(leaves, fanout)[:-1]:
        out.append((place % fanout, min(fanout, nodes - place // fanout * fanout)))
        place //= fanout
    return out


def fold(leaf: str, places: list[tuple[int, int]], proof: list[str]) -> str:
    """The root that a leaf and the siblings of its path lead to."""
    at = 0
    for place, size in places:
        others = proof[at : at + size - 1]
        at += size - 1
        leaf = node_hash(*others[:place], leaf, *others[place:])
    return leaf


def placed(leaves: DataFrame, slices: int = SLICES) -> tuple[DataFrame, DataFrame]:
    """`leaves` (tree string not null, ordered by `at`, then `leaf`) with `place`, from 0 in each tree; and `leaves` of each tree."""
    spark = leaves.sparkSession
    wanted = min(slices, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1))
    names = ["tree", "at", "leaf", *(c for c in leaves.columns if c not in ("tree", "at", "leaf"))]
    salted = leaves.select(*names, F.monotonically_increasing_id().alias("_tie"))
    order = [F.asc("tree"), F.asc_nulls_first("at"), F.asc("leaf"), F.asc("_tie")]
    sliced = salted.repartitionByRange(wanted, *order).sortWithinPartitions(*order).drop("_tie")
    stored = sliced.withColumn("_slice", F.spark_partition_id())
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stored.schema) + ", _nth long"

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, seen = None, 0
        for batch in batches:
            nth = []
            for t in batch.column(0).to_pylist():
                if t != tree:
                    tree, seen = t, 0
                nth.append(seen)
                seen += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nth, pa.int64())], [*batch.schema.names, "_nth"])

    numbered = materialize(stored.mapInArrow(number, schema), "merkle-leaves")
    counts = materialize(numbered.groupBy("tree", "_slice").agg(F.count(F.lit(1)).alias("m")), "merkle-counts")
    before = Window.partitionBy("tree").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("tree", "_slice", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("_start"))
    # Only the first tree of a slice can continue from an earlier one: one row per slice.
    continued = starts.where("_start > 0").select(F.col("tree").alias("_tree"), F.col("_slice").alias("_from"), "_start")
    at = (F.col("tree") == F.col("_tree")) & (F.col("_slice") == F.col("_from"))
    joined = numbered.join(F.broadcast(continued), at, "left")  # at most SLICES rows
    rows = joined.withColumn("place", F.col("_nth") + F.coalesce("_start", F.lit(0))).drop("_tree", "_from", "_start", "_slice", "_nth")
    return rows, counts.groupBy("tree").agg(F.sum("m").alias("leaves"))


class _Block:
    """Levels of a block: `depth` of them, or, where it is the whole tree, until one node is left.

    A first block that is not full is the whole tree; where it is full, both are the same.
    """

    def __init__(self, leaves: list[str], number: int, fanout: int, depth: int):
        self.fanout, self.levels = fanout, [leaves]
        whole = number == 0 and len(leaves) < fanout**depth
        while len(self.levels[-1]) > 1 if whole else len(self.levels) <= depth:
            low = self.levels[-1]
            self.levels.append([node_hash(*low[i : i + fanout]) for i in range(0, len(low), fanout)])

    @property
    def root(self) -> str:
        return self.levels[-1][0]

    def proof(self, place: int) -> list[str]:
        out = []
        for nodes in self.levels[:-1]:
            first = place // self.fanout * self.fanout
            out += nodes[first:place] + nodes[place + 1 : first + self.fanout]
            place //= self.fanout
        return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows of one block after another; rows arrive ordered by tree and place. The first two columns are tree and block."""
    held: list[tuple] = []
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        for key, rows in groupby(zip(*columns, strict=True), key=lambda r: r[:2]):
            rows = list(rows)
            if held and held[0][:2] != key:
                yield held
                held = []
            held += rows
    if held:
        yield held


def _swap(state: DataFrame, fanout: int) -> DataFrame:
    """The butterfly rounds. `state`: tree, block, blocks, leaves, node; returns it with `proof`, the siblings above the block."""
    state = materialize(state.withColumn("proof", F.array().cast("array<string>")), "merkle-round-0")
    most = state.agg(F.max("blocks")).first()[0] or 0
    width, number = 1, 0
    while width < most:
        number += 1
        own = F.floor(F.col("block") / width)
        size = lambda s: F.least(F.lit(width).cast("long"), F.col("blocks") - s * width)
        low = F.col("block") - own * width
        subtrees = F.ceil(F.col("blocks") / width)
        open_ = state.where(F.col("blocks") > width)
        first = F.floor(own / fanout) * fanout
        brothers = F.explode(F.sequence(first, F.least(first + (fanout - 1), subtrees - 1)))
        sent = open_.withColumn("_own", own).withColumn("_low", low).withColumn("_size", size(own)).withColumn("_to", brothers)
        there = size(F.col("_to"))
        receivers = F.when(F.col("_to") == F.col("_own"), F.array("_low")).when(
            F.col("_low") < there, F.sequence(F.col("_low"), there - 1, F.col("_size"))
        )
        sent = sent.select(
            "tree", "blocks", "leaves", "node", "_own", (F.col("_to") == F.col("_own")).alias("_self"), "proof",
            "_to", F.explode(receivers).alias("_place"),
        ).withColumn("block", F.col("_place") + F.col("_to") * width)
        swapped = sent.groupBy("tree", "block").agg(
            F.first("blocks").alias("blocks"),
            F.first("leaves").alias("leaves"),
            F.sort_array(F.collect_list(F.struct("_own", "node", "_self"))).alias("met"),  # at most `fanout`
            F.first(F.when(F.col("_self"), F.col("proof")), ignorenulls=True).alias("proof"),
        )
        others = F.filter("met", lambda m: ~m["_self"])
        done = state.where(F.col("blocks") <= width)
        state = swapped.select(
            "tree", "block", "blocks", "leaves",
            F.sha2(F.array_join(F.transform("met", lambda m: m["node"]), ""), 256).alias("node"),
            F.concat("proof", F.transform(others, lambda m: m["node"])).alias("proof"),
        )
        state = materialize(state.unionByName(done.select(*state.columns)), f"merkle-round-{number}")
        width *= fanout
    return state


def trees(leaves: DataFrame, fanout: int = FANOUT, depth: int = DEPTH, slices: int = SLICES) -> tuple[DataFrame, DataFrame]:
    """Placed leaves with their block; and for every block the tree's `leaves`, its root (`node`) and the block's upper `proof`."""
    span = fanout**depth
    rows, sizes = placed(leaves, slices)
    rows = rows.withColumn("block", F.floor(F.col("place") / span))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for block in _blocks(batches):
            out.append((*block[0][:2], _Block([r[3] for r in block], block[0][1], fanout, depth).root))
            if len(out) >= ROWS:
                yield _batch(out, roots_schema)
                out = []
        if out:
            yield _batch(out, roots_schema)

    roots_ddl = "tree string, block long, node string"
    roots_schema = to_arrow_schema(StructType.fromDDL(roots_ddl))
    roots = _dealt(rows.select("tree", "block", "place", "leaf")).mapInArrow(local, roots_ddl)
    known = roots.join(sizes, "tree").withColumn("blocks", F.ceil(F.col("leaves") / span))
    return rows, _swap(known, fanout)


def _dealt(rows: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """Rows of a block together and in order; with the columns of `blocks`.

    A repartition by columns is neither split nor read locally by adaptive execution, so a block stays in one task.
    """
    dealt = rows.repartition("tree", "block")
    if blocks is not None:
        dealt = dealt.join(blocks, ["tree", "block"])
    return dealt.sortWithinPartitions("tree", "block", "place")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def manifest(
    docs: DataFrame,
    tree: str = "source",
    order: str = "doc_id",
    columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    observed: Column | None = None,
    fanout: int = FANOUT,
    depth: int = DEPTH,
    slices: int = SLICES,
) -> DataFrame:
    """One row per row of `docs`: its leaf, where it is, and the proof that it belongs to the data set.

    Columns: the order key, tree, leaf, place and leaves (in its tree), tree_place and trees (in the upper tree), subroot,
    root, proof (siblings, left to right, level by level), folded_root and verified: whether `observed` (a leaf hash by
    another reading of the row; the leaf itself by default) leads to the root along the proof.
    """
    name = F.coalesce(F.concat(F.lit("="), col(tree).cast("string")), F.lit("-"))  # "-" sorts before "="
    leaf = leaf_hash(*(col(c) for c in columns))
    slim = docs.select(name.alias("tree"), col(order).alias("at"), leaf.alias("leaf"), (leaf if observed is None else observed).alias("observed"))
    slim = slim.withColumn("observed", F.nullif("observed", "leaf"))
    stored = materialize(slim, "merkle-slim")
    rows, blocks = trees(stored, fanout, depth, slices)
    subroots = materialize(blocks.where("block = 0").select("tree", F.col("node").alias("leaf")), "merkle-subroots")
    tops, upper = trees(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("at"), "leaf"), fanout, depth, slices)
    upper = _completed(tops.withColumn("observed", F.lit(None).cast("string")), upper, fanout, depth)
    upper = upper.select(
        F.col("at").alias("tree"), F.col("proof").alias("high"), "root", F.col("place").alias("tree_place"), F.col("leaves").alias("trees")
    )
    done = _completed(rows, blocks.join(materialize(upper, "merkle-upper"), "tree"), fanout, depth)
    named = F.when(F.col("tree") != "-", F.substring("tree", 2, 1 << 30))
    return done.withColumn("tree", named).withColumn("verified", F.col("folded_root") == F.col("root"))


def _completed(rows: DataFrame, blocks: DataFrame, fanout: int, depth: int) -> DataFrame:
    """Leaves with whole proofs: each block's leaves beside the block's upper proof, in one task."""
    span = fanout**depth
    above = ["high", "root", "tree_place", "trees"] if "high" in blocks.columns else []
    known = blocks.select("tree", "block", "leaves", F.col("node").alias("subroot"), F.col("proof").alias("middle"), *above)
    ddl = (
        f"tree string, at {rows.schema['at'].dataType.simpleString()}, leaf string, place long, leaves long, tree_place long, "
        "trees long, subroot string, root string, proof array<string>, folded_root string"
    )
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for block in _blocks(batches):
            number, leaves, subroot, middle, *top = block[0][1], *block[0][6:]
            high, root, tree_place, trees_ = top or ([], subroot, 0, 1)
            built = _Block([r[3] for r in block], number, fanout, depth)
            for tree, _, place, leaf, at, observed, *_ in block:
                proof = [*built.proof(place - number * span), *middle, *high]
                sizes = run_sizes(place, leaves, fanout) + run_sizes(tree_place, trees_, fanout)
                folded = fold(leaf if observed is None else observed, sizes, proof)
                out.append((tree, at, leaf, place, leaves, tree_place, trees_, subroot, root, proof, folded))
            if len(out) >= ROWS:
                yield _batch(out, schema)
                out = []
        if out:
            yield _batch(out, schema)

    return _dealt(rows.select("tree", "block", "place", "leaf", "at", "observed"), known).mapInArrow(run, ddl)
