"""Exact duplicates by an extendible-hash index on shared files.

1. Every row becomes an index entry (64-bit key, digest, id) in a table of the shared
   checkpoint folder. Only keys that occur twice can hide copies.
2. The directory starts with one bucket and doubles while a bucket of repeated keys is
   over its capacity; it is planned from at most 2 ** DIRECTORY_BITS prefix sums.
3. Rows of repeated keys are combined inside their scan task (copies become one node with
   a count), then each bucket goes to its owner task. An owner walks its keys in order,
   chains the different texts of one key, and compares whole texts byte by byte.

Defined results: a null text is the empty text; a null id is smaller than any id; of rows
that repeat both id and text exactly one is kept; an empty table gives an empty result;
further columns of the input are ignored by `duplicates` and passed on by `deduplicate`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skylag.llm.keys import col, fresh, key_bits, with_maybe
from skylag.sources.scratch import materialize

DIRECTORY_BITS = 16
#: Bytes of text for which one bucket is meant.
BUCKET_BYTES = 16 << 20
#: A scan task hands on the nodes it has combined when they hold this many bytes.
COMBINE_BYTES = 32 << 20
#: Each group of copies is offered under so many salts to the rows that look it up.
SALTS = 8

_NODE = pa.schema(
    [("key", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("text", pa.binary())]
)
_NODE_SQL = "key long, keep_id long, group_size long, text binary"
_GROUP = pa.schema(
    [("key", pa.int64()), ("sha", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64())]
)
_GROUP_SQL = "key long, sha binary, keep_id long, group_size long"


def text_key(name: str = "text"):
    return F.xxhash64(F.coalesce(col(name), F.lit("")))


def _larger(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else max(a, b)


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Copies that meet in one scan task become one node."""
    nodes: dict[bytes, list] = {}
    held = 0

    def flush():
        rows = [(key, keep, n, text) for text, (key, keep, n) in nodes.items()]
        for at in range(0, len(rows), 1000):
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows[at : at + 1000], strict=True), _NODE.types, strict=True)],
                schema=_NODE,
            )

    for batch in batches:
        for key, doc_id, text in zip(*(batch.column(i) for i in range(3)), strict=True):
            raw = text.as_py()
            node = nodes.get(raw)
            if node is None:
                nodes[raw] = [key.as_py(), doc_id.as_py(), 1]
                held += len(raw) + 200
            else:
                node[1] = _larger(node[1], doc_id.as_py())
                node[2] += 1
            if held > COMBINE_BYTES:
                yield from flush()
                nodes.clear()
                held = 0
    yield from flush()


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Owner task: nodes arrive by key; the texts of one key form a chain."""
    current, chain, out = None, [], []

    def close():
        out.extend((current, hashlib.sha256(text).digest(), keep, n) for text, keep, n in chain)

    def emit():
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out, strict=True), _GROUP.types, strict=True)], schema=_GROUP
        )

    for batch in batches:
        for values in zip(*(batch.column(i) for i in range(4)), strict=True):
            key, keep, n, text = (v.as_py() for v in values)
            if key != current:
                close()
                current, chain = key, []
            for node in chain:
                if node[0] == text:  # all bytes
                    node[1] = _larger(node[1], keep)
                    node[2] += n
                    break
            else:
                chain.append([text, keep, n])
        if len(out) > 1000:
            yield emit()
            out.clear()
    close()
    if out:
        yield emit()


def plan_directory(weights: dict[int, int], capacity: int) -> list[int]:
    """Bucket of each directory slot after doubling until no bucket that can split is over capacity.

    `weights` maps a prefix of DIRECTORY_BITS bits to its bytes. A bucket is a run of slots that
    share its first bits; the directory is as deep as its deepest bucket.
    """
    depth, buckets = 0, [(0, 0)]  # (local depth, leading bits)
    total = {(0, 0): sum(weights.values())}
    done: list[tuple[int, int]] = []
    below: dict[tuple[int, int], int] = dict(total)
    for local in range(1, DIRECTORY_BITS + 1):
        shift = DIRECTORY_BITS - local
        for prefix, w in weights.items():
            at = (local, prefix >> shift)
            below[at] = below.get(at, 0) + w
    while buckets:
        local, bits = buckets.pop()
        if below.get((local, bits), 0) > capacity and local < DIRECTORY_BITS:
            depth = max(depth, local + 1)  # the directory doubles when a bucket outgrows it
            buckets += [(local + 1, 2 * bits), (local + 1, 2 * bits + 1)]
        else:
            done.append((local, bits))
    directory = [0] * (1 << depth)
    for number, (local, bits) in enumerate(sorted(done, key=lambda b: b[1] << (DIRECTORY_BITS - b[0]))):
        width = 1 << (depth - local)
        directory[bits * width : (bits + 1) * width] = [number] * width
    return directory


class Index:
    """The entries of all rows, and the groups of the rows whose key repeats."""

    def __init__(self, docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, id_column: str = "doc_id", text: str = "text"):
        spark = docs.sparkSession
        raw = F.coalesce(col(text), F.lit(""))
        self.entries = materialize(
            docs.select(
                col(id_column).cast("long").alias("doc_id"),
                text_key(text).alias("key"),
                F.unhex(F.sha2(raw, 256)).alias("sha"),
                F.octet_length(raw).cast("long").alias("bytes"),
            ),
            "index-entries",
        )
        repeated = materialize(
            self.entries.groupBy("key")
            .agg(F.count(F.lit(1)).alias("n"), F.max("bytes").alias("bytes"))
            .where("n > 1"),
            "index-repeated",
        )
        self.bits = key_bits(repeated, F.col("key"))
        slot = F.shiftrightunsigned("key", 64 - DIRECTORY_BITS).cast("int")
        weights = {
            r["slot"]: r["bytes"]  # at most 2 ** DIRECTORY_BITS rows
            for r in repeated.groupBy(slot.alias("slot")).agg(F.sum(F.col("bytes") + 64).alias("bytes")).collect()
        }
        capacity = max(bucket_bytes, sum(weights.values()) >> (DIRECTORY_BITS - 2))
        self.directory = plan_directory(weights, capacity)
        self.depth = len(self.directory).bit_length() - 1
        self.buckets = max(self.directory) + 1
        (maybe,) = fresh(docs, "_maybe")
        copies = with_maybe(docs, self.bits, text_key(text), maybe).where(F.col(maybe))
        nodes = copies.select(
            text_key(text).alias("key"), col(id_column).cast("long").alias("doc_id"), raw.cast("binary").alias("text")
        ).mapInArrow(_combine, _NODE_SQL)
        if self.depth:
            address = spark.createDataFrame(list(enumerate(self.directory)), "_slot int, bucket int")
            at = F.shiftrightunsigned("key", 64 - self.depth).cast("int")
            # at most 2 ** DIRECTORY_BITS rows
            nodes = nodes.withColumn("_slot", at).join(F.broadcast(address), "_slot")
        else:
            nodes = nodes.withColumn("bucket", F.lit(0))
        owned = (
            nodes.repartition(self.buckets, "bucket")
            .sortWithinPartitions("bucket", "key")
            .select("key", "keep_id", "group_size", "text")
        )
        self.groups = materialize(owned.mapInArrow(_own, _GROUP_SQL), "index-groups")


def duplicates(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per document: the row that stays of its group, the group's size, its digest."""
    index = Index(docs, bucket_bytes)
    marked = with_maybe(index.entries, index.bits, F.col("key"), "_maybe")
    alone = marked.where(~F.col("_maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha"
    )
    salted = index.groups.select(
        "sha", "keep_id", "group_size", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    )
    grouped = (
        marked.where(F.col("_maybe"))
        .select("doc_id", "sha", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("_salt"))
        .join(salted, ["sha", "_salt"])
    )
    nth = F.row_number().over(Window.partitionBy("sha", "doc_id").orderBy(F.lit(0)))
    grouped = grouped.withColumn("_nth", nth).select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_nth") == 1)).alias("kept"), "sha"
    )
    return alone.unionByName(grouped).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256")
    )


def deduplicate(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The rows of `docs` that stay, with all their columns."""
    index = Index(docs, bucket_bytes)
    maybe, keeper, nth, sha, keep = fresh(docs, "_maybe", "_keeper", "_nth", "_sha", "_keep")
    marked = with_maybe(docs, index.bits, text_key(), maybe)
    own = F.xxhash64(text_key(), col("doc_id").cast("long"))
    keepers = key_bits(index.groups, F.xxhash64("key", "keep_id"))
    some = with_maybe(marked.where(F.col(maybe)), keepers, own, keeper).where(F.col(keeper))
    groups = index.groups.select(F.col("sha").alias(sha), F.col("keep_id").alias(keep))
    stays = some.join(
        groups,
        (F.unhex(F.sha2(F.coalesce(col("text"), F.lit("")), 256)) == groups[sha])
        & col("doc_id").cast("long").eqNullSafe(groups[keep]),
        "inner",
    )
    one = stays.withColumn(nth, F.row_number().over(Window.partitionBy(sha, keep).orderBy(F.lit(0)))).where(F.col(nth) == 1)
    return marked.where(~F.col(maybe)).select(*map(col, docs.columns)).unionByName(one.select(*map(col, docs.columns)))
