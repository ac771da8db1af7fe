"""Passages that repeat across documents, by prefix-partitioned suffix trees.

A document's window is `width` consecutive words. A word is repeated if a window covers it whose words also start in a
document with a smaller id.

1. One scan hashes words and picks anchors: of the runs of ANCHOR words in each window the one with the least
   hash, leftmost on ties. Equal windows have the same anchor at the same place, so the suffixes that start at anchors (one in twenty)
   miss no repeat. Hashes only choose places and route rows; what counts as equal is decided on words.
2. Copies of a whole text are told by its digest: only the one with the smallest id goes on, the others are repeated as a whole.
3. The first ANCHOR words are the prefix that splits suffixes into groups. Groups within one document
   hold no repeat and end here. For the others the suffixes, with the words before them, are cut from the texts.
4. Groups of up to GROUP suffixes go to tasks as they are; each task sorts its suffixes and finds the depth of their common
   prefixes (the inner nodes of the suffix tree), and likewise for the words before the anchors. A node of depth d behind an anchor and one
   of depth width - d before it make a repeated window; neighbouring windows join into maximal repeats.
5. Groups beyond GROUP are split by prefixes of full width: each window of the suffix is its own prefix, whose group is
   one deep node. Of such a node only the smallest id matters, which is a minimum per key and never a group in one task.

Defined results: a null text has no words; a null id counts as the smallest long; documents with equal ids do not make one
another's words repeated; rows that repeat id and text get the same result each; an empty table gives an empty result;
further columns are ignored by `repeated_words` and passed on by `remove_repeats`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylag.llm import hashing
from skylag.llm.hot import HOT, join_counted
from skylag.llm.keys import col, fresh, key_bits, with_maybe
from skylag.sources.scratch import materialize

WIDTH = 50
#: Words of an anchor: the shortest prefix of a suffix.
ANCHOR = 12
#: Suffixes of a group that one task holds: some 100 MB with all that a tree needs.
GROUP = 32_768
#: A task builds the trees of whole groups once they have this many suffixes.
BATCH = 16_384
#: Rows of texts that leave a task at once.
ROWS = 1000
LEAST = -(1 << 63)

_SPACE = np.ones(256, np.uint8)
_SPACE[[9, 10, 11, 12, 13, 32]] = 0
_STEP = 0x9FB21C651E98DF25
_BACK = pow(_STEP, -1, 1 << 64)


def anchors(h: np.ndarray, row: np.ndarray, width: int, size: int) -> tuple[np.ndarray, ...]:
    """hash, word, first window start, number of window starts of every anchor of a run of rows.

    `h`, `row`: hash and row of each word.
    """
    n = len(h)
    if n < width:
        return (np.empty(0, np.uint64),) + (np.empty(0, np.int64),) * 3
    up, down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)])) for b in (_STEP, _BACK))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[:n])])
    gram = hashing.mix((total[size:] - total[:-size]) * down[: n - size + 1])
    span = width - size + 1
    key = (gram >> np.uint64(32) << np.uint64(32)) | np.arange(len(gram), dtype=np.uint64)
    full = -(-len(key) // span) * span
    blocks = np.concatenate([key, np.full(full - len(key), np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, span)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = np.flatnonzero(row[: n - width + 1] == row[width - 1 :])
    if not len(starts):
        return (np.empty(0, np.uint64),) + (np.empty(0, np.int64),) * 3
    at = (np.minimum(behind[starts], ahead[starts + span - 1]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    # A later window of another row never has the same anchor, so runs of equal anchors are runs of windows.
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return gram[at[first]], at[first], starts[first], np.diff(np.append(first, len(at)))


_ANCHOR = pa.struct([("gram", pa.int64()), ("start", pa.int32()), ("left", pa.int16()), ("windows", pa.int16())])
_SCAN = pa.schema([("doc", pa.int64()), ("key", pa.int64()), ("sha", pa.binary()), ("words", pa.int64()), ("anchors", pa.list_(_ANCHOR))])
_SCAN_SQL = "doc long, key long, sha binary, words long, anchors array<struct<gram: long, start: int, left: smallint, windows: smallint>>"


def _scan(width: int, size: int):
    """One row per document: digest, number of words, and its anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2)
            for first, data, offsets in hashing.runs(texts):
                rows = len(offsets) - 1
                begin, end, row = hashing.places(data, offsets, _SPACE)
                h = hashing.hashes(data, begin, end) if len(begin) else np.empty(0, np.uint64)
                gram, at, start, windows = anchors(h, row, width, size)
                counts = np.bincount(row, minlength=rows)
                base = np.concatenate([[0], np.cumsum(counts)])
                owner = row[at]
                ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=rows))]).astype(np.int32)
                fields = [
                    pa.array(gram.view(np.int64)), pa.array((start - base[owner]).astype(np.int32)),
                    pa.array((at - start).astype(np.int16)), pa.array(windows.astype(np.int16)),
                ]
                found = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(fields, fields=list(_ANCHOR)))
                raw = data.tobytes()
                sha = [hashlib.sha256(raw[a:b]).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, rows), batch.column(1).slice(first, rows), pa.array(sha, pa.binary()),
                     pa.array(counts.astype(np.int64)), found],
                    schema=_SCAN,
                )

    return run


_CUT_SQL = "gram long, doc long, key long, starts array<int>, left int, words binary"
_CUT = pa.schema(
    [("gram", pa.int64()), ("doc", pa.int64()), ("key", pa.int64()), ("starts", pa.list_(pa.int32())), ("left", pa.int32()), ("words", pa.binary())]
)


def _cut(width: int):
    """Suffixes at the wanted anchors of each text, from `left` words before the anchor to the end of its last window.

    A suffix that recurs within its document is one row with all places where it starts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, key, text, wanted in zip(*(batch.column(i) for i in range(4)), strict=True):
                words = (text.as_py() or b"").split()
                seen: dict[tuple, list[int]] = {}
                for a in wanted.as_py():
                    start = a["start"]
                    piece = b" ".join(words[start : start + a["windows"] + width - 1])
                    seen.setdefault((a["gram"], a["left"], piece), []).append(start)
                out += [(gram, doc.as_py(), key.as_py(), starts, left, piece) for (gram, left, piece), starts in seen.items()]
                if len(out) >= 2000:
                    yield _batch(out, _CUT)
                    out = []
            if out:
                yield _batch(out, _CUT)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _sorted_depths(group: np.ndarray, words: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by (group, words), and how many words each row of that order shares with the one before it."""
    keyed = np.concatenate([group[:, None].astype(np.int32), words], axis=1).astype(">u4")
    order = np.argsort(np.ascontiguousarray(keyed).view(f"V{4 * keyed.shape[1]}").ravel(), kind="stable")
    ranked, sizes = keyed[order], size[order]
    differs = ranked[1:] != ranked[:-1]
    depth = np.where(differs.any(axis=1), differs.argmax(axis=1) - 1, words.shape[1])
    depth = np.minimum(depth, np.minimum(sizes[1:], sizes[:-1]))  # -1: another group
    return order, np.concatenate([[-1], depth])


def _nodes(order: np.ndarray, depths: np.ndarray, depth: int) -> np.ndarray:
    """The node of the given depth above each row."""
    node = np.empty(len(order), np.int64)
    node[order] = np.cumsum(depths < depth)
    return node


def repeats(group: np.ndarray, doc: np.ndarray, left: np.ndarray, words: pa.Array, width: int, size: int) -> tuple[np.ndarray, ...]:
    """row, first, last: runs of windows of a row (places after its start) that also stand in a row of a smaller doc.

    `words`: each row's words, apart by one space; the anchor is `left` words from its start.
    """
    split = pc.split_pattern(words, " ")
    ids = pc.dictionary_encode(split.flatten()).indices.to_numpy().astype(np.int32) + 1  # equal words, equal numbers
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))]).astype(np.int64)
    n, before = len(group), width - size
    length = np.diff(ends)
    anchor = ends[:-1] + left

    def matrix(columns: int, step: int, start: np.ndarray, count: np.ndarray) -> np.ndarray:
        out = np.zeros((n, columns), np.int32)
        for j in range(columns):
            inside = np.flatnonzero(count > j)
            out[inside, j] = ids[start[inside] + step * j]
        return out

    _, group = np.unique(group, return_inverse=True)
    behind = np.minimum(length - left, width)
    ahead = np.minimum(left, before)
    right = _sorted_depths(group, matrix(width, 1, anchor, behind), behind)
    lefts = _sorted_depths(group, matrix(max(before, 1), -1, anchor - 1, ahead), ahead)
    windows = length - width + 1
    hit = np.zeros((n, before + 1), bool)  # by place after the row's start
    for shift in range(before + 1):  # a window that starts `shift` words before its anchor
        rows = np.flatnonzero((left >= shift) & (left - shift < windows))
        if len(rows) < 2:
            continue
        pair = _nodes(*right, width - shift)[rows] * (n + 1) + _nodes(*lefts, shift)[rows]
        order = np.argsort(pair, kind="stable")
        ranked = pair[order]
        first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        least = np.repeat(np.minimum.reduceat(doc[rows][order], first), np.diff(np.append(first, len(rows))))
        some = rows[order][doc[rows][order] > least]
        hit[some, left[some] - shift] = True
    edge = np.zeros((n, 1), bool)
    step = np.diff(np.concatenate([edge, hit, edge], axis=1).astype(np.int8), axis=1)
    row, first = np.nonzero(step == 1)
    _, last = np.nonzero(step == -1)
    return row, first, last - 1


_SPAN = pa.schema([("doc", pa.int64()), ("key", pa.int64()), ("start", pa.int32()), ("stop", pa.int32())])
_SPAN_SQL = "doc long, key long, start int, stop int"


def _trees(width: int, size: int, batch_rows: int):
    """Repeated spans of words of each document, from suffixes that arrive by group."""

    def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        column = {c: table.column(c).combine_chunks() for c in table.column_names}
        numbers = {c: column[c].to_numpy() for c in ("gram", "doc", "left")}
        row, first, last = repeats(numbers["gram"], numbers["doc"], numbers["left"].astype(np.int64), column["words"], width, size)
        taken = column["starts"].take(pa.array(row))
        many = pc.list_value_length(taken).to_numpy(zero_copy_only=False)
        start = taken.flatten().to_numpy()
        owner = pa.array(np.repeat(row, many))
        yield pa.RecordBatch.from_arrays(
            [column["doc"].take(owner), column["key"].take(owner), pa.array((start + np.repeat(first, many)).astype(np.int32)),
             pa.array((start + np.repeat(last, many) + width).astype(np.int32))],
            schema=_SPAN,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            count += batch.num_rows
            if count < batch_rows:
                continue
            gram = batch.column(0).to_numpy()
            cut = int(np.searchsorted(gram, gram[-1]))  # the last group may go on in the next batch
            if cut:
                held[-1], rest = batch.slice(0, cut), batch.slice(cut)
                yield from solve(pa.Table.from_batches(held))
                held, count = [rest], rest.num_rows
        if held:
            yield from solve(pa.Table.from_batches(held))

    return run


_WINDOW_SQL = "window binary, doc long, key long, start int"
_WINDOW = pa.schema([("window", pa.binary()), ("doc", pa.int64()), ("key", pa.int64()), ("start", pa.int32())])


def _full_prefixes(width: int):
    """Every window of the suffixes of overfull groups, by the digest of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, key, starts, words in zip(*(batch.column(i) for i in (1, 2, 3, 5)), strict=True):
                doc_id, text_key, begins, text = doc.as_py(), key.as_py(), starts.as_py(), words.as_py()
                edges = [-1, *np.flatnonzero(np.frombuffer(text, np.uint8) == 32).tolist(), len(text)]
                for i in range(len(edges) - width):
                    digest = hashlib.sha256(text[edges[i] + 1 : edges[i + width]]).digest()
                    out += [(digest, doc_id, text_key, b + i) for b in begins]
                if len(out) >= 5000:
                    yield _batch(out, _WINDOW)
                    out = []
            if out:
                yield _batch(out, _WINDOW)

    return run


def _met(known: dict[bytes, int], width: int):
    """Spans of the windows that are frequent deep nodes (digest to smallest doc); neighbouring windows are one span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[int]] = []
            for window, doc, key, start in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                low = known.get(window)
                if low is None or doc <= low:
                    continue
                if out and out[-1][:2] == [doc, key] and out[-1][3] == start + width - 1:
                    out[-1][3] += 1
                else:
                    out.append([doc, key, start, start + width])
            if out:
                yield _batch(out, _SPAN)

    return run


def _source(docs: DataFrame) -> DataFrame:
    text = F.coalesce(col("text"), F.lit(""))
    return docs.select(
        F.coalesce(col("doc_id").cast("long"), F.lit(LEAST)).alias("doc"), F.xxhash64(text).alias("key"), text.cast("binary").alias("text")
    )


def repeated_spans(docs: DataFrame, width: int = WIDTH, size: int = ANCHOR, group: int = GROUP, batch_rows: int = BATCH) -> DataFrame:
    """doc, key, whole, spans for every distinct (id, text) with repeated words.

    `whole`: all of the text is repeated; else `spans` lists (start, stop) of words, which may overlap. `key` is
    xxhash64 of the text; a null id is LEAST.
    """
    if not 1 <= size < width:
        raise ValueError("an anchor is shorter than a window")
    source = _source(docs)
    scanned = materialize(source.mapInArrow(_scan(width, size), _SCAN_SQL), "substring-anchors")
    long_enough = scanned.where(F.col("words") >= width)
    copies = materialize(
        long_enough.groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("head"), F.min("key").alias("head_key")).where("n > 1"),
        "substring-copies",
    )
    total = copies.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    marked = with_maybe(long_enough, key_bits(copies, F.xxhash64("sha")), F.xxhash64("sha"), "_maybe")
    slim = marked.where("_maybe").select("doc", "key", "sha")
    whole = join_counted(slim, copies, ["sha"], "n", total).where("doc > head").select("doc", "key").distinct()
    # One row of each class of equal texts goes on. A text can share its bit with a copied one and have no copy.
    lonely = slim.join(copies.select("sha"), "sha", "left_anti").select("doc", "key")
    heads = materialize(copies.select(F.col("head").alias("doc"), F.col("head_key").alias("key")).unionByName(lonely), "substring-heads")
    names = ["doc", "key", "anchors"]
    first = with_maybe(marked.where("_maybe").select(names), key_bits(heads, F.xxhash64("doc", "key")), F.xxhash64("doc", "key"), "_head")
    first = first.where("_head").join(heads, ["doc", "key"], "left_semi").dropDuplicates(["doc", "key"])
    going = marked.where("NOT _maybe").select(names).unionByName(first.select(names))
    places = materialize(going.select("doc", "key", F.inline("anchors")), "substring-suffixes")
    groups = materialize(
        places.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").select("gram", "n"),
        "substring-groups",
    )
    in_groups = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shared = with_maybe(places, key_bits(groups, F.xxhash64("gram")), F.xxhash64("gram"), "_maybe").where("_maybe").drop("_maybe")
    wanted = join_counted(shared, groups.withColumn("overfull", F.col("n") > group), ["gram"], "n", in_groups)
    per_text = wanted.groupBy("doc", "key").agg(F.collect_list(F.struct("gram", "start", "left", "windows")).alias("wanted"))  # of one text
    per_text = materialize(per_text, "substring-wanted")
    texts = with_maybe(source, key_bits(per_text, F.xxhash64("doc", "key")), F.xxhash64("doc", "key"), "_maybe").where("_maybe")
    once = texts.groupBy("doc", "key").agg(F.first("text").alias("text")).join(per_text, ["doc", "key"])
    cut = materialize(once.select("doc", "key", "text", "wanted").mapInArrow(_cut(width), _CUT_SQL), "substring-cut")
    # The suffixes themselves were counted per place; a group of many places in few suffixes is split all the same.
    overfull = groups.where(F.col("n") > group).select("gram", "n")
    over_bits = key_bits(overfull, F.xxhash64("gram"))
    sized = with_maybe(cut, over_bits, F.xxhash64("gram"), "_maybe")
    fit = sized.where("NOT _maybe").drop("_maybe")
    perhaps = sized.where("_maybe").drop("_maybe")
    over = join_counted(perhaps, overfull, ["gram"], "n", in_groups).drop("n")
    fit = fit.unionByName(perhaps.join(overfull.select("gram"), "gram", "left_anti"))
    trees = fit.select("gram", "doc", "key", "starts", "left", "words").repartition("gram").sortWithinPartitions("gram")
    spans = trees.mapInArrow(_trees(width, size, batch_rows), _SPAN_SQL)
    windows = materialize(over.select("gram", "doc", "key", "starts", "left", "words").mapInArrow(_full_prefixes(width), _WINDOW_SQL), "substring-windows")
    nodes = materialize(
        windows.groupBy("window").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high"),
        "substring-nodes",
    )
    bound = nodes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // HOT
    often = nodes.where(F.col("n") > bound)
    known = {bytes(r["window"]): r["low"] for r in often.collect()}  # fewer than HOT rows
    more = windows.mapInArrow(_met(known, width), _SPAN_SQL)
    seldom = windows.join(F.broadcast(often.select("window")), "window", "left_anti").join(nodes.where(F.col("n") <= bound), "window")
    more = more.unionByName(seldom.where("doc > low").select("doc", "key", "start", (F.col("start") + width).alias("stop")))
    listed = spans.unionByName(more).groupBy("doc", "key").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))  # of one text
    none = F.array().cast("array<struct<start: int, stop: int>>")
    return materialize(
        listed.select("doc", "key", F.lit(False).alias("whole"), "spans").unionByName(
            whole.select("doc", "key", F.lit(True).alias("whole"), none.alias("spans"))
        ),
        "substring-spans",
    )


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of words, number of repeated ones, and the words that stay, for text, whole, spans in the last three columns."""
    for whole_batch in batches:
        for first in range(0, whole_batch.num_rows, ROWS):
            batch = whole_batch.slice(first, ROWS)
            n_words, n_removed, kept = [], [], []
            *rest, texts, whole, spans = batch.columns
            for text, all_of_it, cuts in zip(texts, whole.to_pylist(), spans, strict=True):
                words = (text.as_py() or b"").split()
                n_words.append(len(words))
                if all_of_it:
                    stay = []
                elif cuts.is_valid and len(cuts):
                    gone = np.zeros(len(words), bool)
                    for cut in cuts.as_py():
                        gone[cut["start"] : cut["stop"]] = True
                    stay = [words[i] for i in np.flatnonzero(~gone).tolist()]
                else:
                    stay = words
                n_removed.append(len(words) - len(stay))
                kept.append(b" ".join(stay))
            yield pa.RecordBatch.from_arrays(
                [*rest, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary())],
                [*batch.schema.names[:-3], "n_words", "n_removed", "kept"],
            )


def _with_spans(docs: DataFrame, **options) -> tuple[DataFrame, list[str]]:
    """`docs` with doc, key, whole and spans under fresh names; only rows that have some are shuffled."""
    spans = repeated_spans(docs, **options)
    doc, key, whole, found, maybe = names = fresh(docs, "_doc", "_key", "_whole", "_spans", "_maybe")
    own = docs.withColumn(doc, F.coalesce(col("doc_id").cast("long"), F.lit(LEAST))).withColumn(key, F.xxhash64(F.coalesce(col("text"), F.lit(""))))
    marked = with_maybe(own, key_bits(spans, F.xxhash64("doc", "key")), F.xxhash64(doc, key), maybe)
    no = [F.lit(None).cast("boolean").alias(whole), F.lit(None).cast("array<struct<start: int, stop: int>>").alias(found)]
    straight = marked.where(~F.col(maybe)).select("*", *no)
    joined = marked.where(F.col(maybe)).join(spans.toDF(doc, key, whole, found), [doc, key], "left").select(*map(col, straight.columns))
    return straight.unionByName(joined), names


def repeated_words(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_removed and `kept`, the words that stay, joined by one space, of every document."""
    rows, (_, _, whole, found, _) = _with_spans(docs.select("doc_id", "text"), **options)
    slim = rows.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"), F.col(whole).alias("whole"), F.col(found).alias("spans"))
    done = slim.mapInArrow(_kept, "doc_id long, n_words long, n_removed long, kept binary")
    return done.withColumn("kept", F.col("kept").cast("string"))


def remove_repeats(docs: DataFrame, **options) -> DataFrame:
    """`docs` with its columns, where a text with repeated words holds only the words that stay, joined by one space."""
    rows, (doc, key, whole, found, maybe) = _with_spans(docs, **options)
    has = F.coalesce(F.col(whole) | (F.size(found) > 0), F.lit(False))
    names = [c for c in docs.columns if c != "text"]
    inner = [f"c{i}" for i in range(len(names))]
    cut = rows.where(has).select(*(col(c).alias(i) for c, i in zip(names, inner, strict=True)), col("text").cast("binary").alias("text"), F.col(whole), F.col(found))
    ddl = ", ".join(f"{i} {docs.schema[c].dataType.simpleString()}" for c, i in zip(names, inner, strict=True))
    done = cut.mapInArrow(_kept, f"{ddl}, n_words long, n_removed long, kept binary")
    back = done.select(*(F.col(i).alias(c) for c, i in zip(names, inner, strict=True)), F.col("kept").cast("string").alias("text"))
    order = [col(c) for c in docs.columns]
    return rows.where(~has).select(order).unionByName(back.select(order))
