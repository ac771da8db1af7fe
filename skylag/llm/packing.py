"""Documents packed into sequences by vector best-fit.

A sequence has three capacities: tokens, documents and attention cost (the sum of squared
lengths). Pieces are placed by falling length. Among the open sequences with room in every
capacity, one is chosen by weighted residuals: either the least norm of what would remain, or
the largest dot product of demand and residual (over the residual's square, so a
tight one wins). Weights say how scarce each capacity is.

1. Tokenise the distinct words of each chunk of texts once, most of them once in a task, cut documents longer than a sequence, and store one slim
   row per piece. Special tokens' strings in a text are special tokens, as the tokenizer's plain call has it.
2. Deal pieces by a hash of (document, piece, content, salt) into groups of about GROUP pieces and pack
   each group in one task. The salt is 0 where a piece first occurs in a batch of stored rows, and
   tells later copies of it apart (rows that repeat id and text, or null ids with empty texts). With thousands of pieces a group, its last unfilled sequences are a
   fraction of a percent. A document or source with any share of the rows spreads over all groups.

A sequence closes when no piece of its group fits any more. A piece that no sequence can hold
on its own (cost or tokens below its demand) still gets one for itself.

Defined results: a null or empty text is the closing id alone; equal rows are packed each for
itself; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylag.llm import hashing
from skylag.llm.keys import col
from skylag.llm.workers import lean, small_batches
from skylag.sources.scratch import materialize

TOKENS = 2048
#: Documents in a sequence: one for each token at most, so only tokens bind by default.
DOCUMENTS = 2048
#: Squared lengths in a sequence; TOKENS ** 2 is what one whole piece needs.
COST = TOKENS * TOKENS
CLOSING = struct.pack("<I", 0)
GROUP = 10_000
#: How fast a capacity that does not bind loses weight.
SCARCITY = 8
#: Bytes of text whose distinct words are tokenised together: a task needs some twenty-five times as many.
CHUNK = 2 << 20
#: Bytes and ids of the parts of words that a task keeps from chunk to chunk, four bytes an id; further ones are tokenised in each chunk.
KEPT = 16 << 20
#: Words whose ids are put in a row at once.
STEP = 1 << 19

_PIECE = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
)
_PIECE_SQL = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _gather(flat: np.ndarray, edges: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries of the lists `which`, one after another, and the edges of these lists."""
    start, size = edges[which], edges[which + 1] - edges[which]
    ends = np.concatenate([[0], np.cumsum(size)])
    return flat[np.arange(ends[-1]) + np.repeat(start - ends[:-1], size)], ends


#: Letters, digits, marks, and bytes whose words are not cut: apostrophes, control characters, all beyond ASCII.
_LETTER, _DIGIT, _MARK, _ODD = 1, 2, 3, 4
_KIND = np.full(256, _ODD, np.uint8)
_KIND[33:127] = _MARK
_KIND[48:58] = _DIGIT
_KIND[97:123] = _LETTER
_KIND[39] = _ODD


class _Words:
    """Ids of words. The tokenizer drops white space and no rule of it reaches across, so words stand alone.

    It lowers A-Z and parts letters, digits and marks, so plain words are cut there, and every distinct part is tokenised once (ids of up
    to KEPT bytes are kept for later chunks): all in one text, where letters are told apart by the tokens that end a run, and others by a special token between them.
    """

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        names = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(names.values()) + 1, bool)
        self.ends[[i for t, i in names.items() if t.endswith("</w>")]] = True
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.special]
        self.gap, self.gap_id = self.special[0], names[self.special[0]]
        self.known, self.flat, self.edges = pa.array([], pa.binary()), np.empty(0, np.uint32), np.zeros(1, np.int64)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, parts: list[bytes], kinds: np.ndarray, special: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the parts, one after another, and their edges."""
        letters, alone = np.flatnonzero(kinds == _LETTER), np.flatnonzero(special)
        others = np.flatnonzero((kinds != _LETTER) & ~special)
        flat, sizes = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        if len(letters):
            ids = self._ids([b" ".join(parts[i] for i in letters).decode()])[0]
            flat.append(ids)
            sizes.append(np.diff(np.flatnonzero(self.ends[ids]), prepend=-1))
        if len(others):
            ids = self._ids([self.gap.join(parts[i].decode("utf-8", "replace") for i in others)])[0]
            gaps = np.flatnonzero(ids == self.gap_id)
            flat.append(np.delete(ids, gaps))
            sizes.append(np.diff(np.concatenate([[-1], gaps, [len(ids)]])) - 1)
        for ids in self._ids([parts[i].decode("utf-8", "replace") for i in alone]) if len(alone) else ():
            flat.append(ids)
            sizes.append(np.array([len(ids)]))
        order = np.empty(len(parts), np.int64)
        order[np.concatenate([letters, others, alone])] = np.arange(len(parts))
        return _gather(np.concatenate(flat), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), order)

    def learn(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, one after another, and their edges."""
        n = len(words)
        offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + n + 1].astype(np.int64)
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        folded = pc.ascii_lower(words)
        special = np.zeros(n, bool)
        for s in self.special:
            special |= pc.match_substring(folded, s).to_numpy(zero_copy_only=False)
        low = hashing.LOWER[data]
        size = np.diff(offsets)
        raw = np.repeat(special, size)
        low[raw] = data[raw]  # only its exact string is a special token
        kind = _KIND[low]
        odd = np.concatenate([[0], np.cumsum(kind == _ODD)])
        kind[np.repeat((odd[offsets[1:]] > odd[offsets[:-1]]) | special, size)] = _ODD
        cut = np.ones(len(low) + 1, bool)
        if len(low):
            cut[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
            cut[offsets] = True
        start = np.flatnonzero(cut)
        count = len(start) - 1
        parts = pa.Array.from_buffers(pa.binary(), count, [None, pa.py_buffer(start.astype(np.int32)), pa.py_buffer(low.tobytes())])
        coded = pc.dictionary_encode(parts)
        which = coded.indices.to_numpy()
        distinct = len(coded.dictionary)
        kinds, marked = np.zeros(distinct, np.uint8), np.zeros(distinct, bool)
        kinds[which] = kind[start[:-1]]
        marked[which] = raw[start[:-1]]
        flat, ends = self._look_up(coded.dictionary, kinds, marked, which)
        return flat, ends[np.searchsorted(start, offsets)]

    def _look_up(self, parts: pa.Array, kinds: np.ndarray, special: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the distinct parts `which`, one after another, and their edges. A part's bytes alone decide its kind."""
        at = pc.fill_null(pc.index_in(parts, value_set=self.known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        fresh = np.flatnonzero(at < 0)
        new = parts.take(pa.array(fresh))
        at[fresh] = len(self.known) + np.arange(len(fresh))
        ids, ends = self._encode(new.to_pylist(), kinds[fresh], special[fresh])
        flat, edges = np.concatenate([self.flat, ids]), np.concatenate([self.edges, self.edges[-1] + ends[1:]])
        if self.known.nbytes + new.nbytes + flat.nbytes + edges.nbytes <= KEPT:
            self.known, self.flat, self.edges = pa.concat_arrays([self.known, new]), flat, edges
        return _gather(flat, edges, at[which])


def _documents(words: _Words, texts: pa.Array) -> Iterator[bytes]:
    """Ids of each text, four bytes each, with the closing id."""
    lists = pc.ascii_split_whitespace(texts)  # as a list of words; an empty one where white space leads or ends
    coded = pc.dictionary_encode(lists.flatten())
    flat, edges = words.learn(coded.dictionary)
    indices = coded.indices.to_numpy()
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
    row = 0
    while row < len(texts):
        last = max(row + 1, int(np.searchsorted(ends, ends[row] + STEP, side="right")) - 1)
        found, at = _gather(flat, edges, indices[ends[row] : ends[last]])
        raw, at = found.astype("<u4").tobytes(), 4 * at[ends[row : last + 1] - ends[row]]
        for begin, end in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            yield raw[begin:end] + CLOSING
        row = last


def tokenise(docs: DataFrame, vocabulary: str, tokens: int = TOKENS) -> DataFrame:
    """One row per piece of a document. `vocabulary`: a tokenizer file that each task can open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words(vocabulary)
        held: list[pa.RecordBatch] = []

        def cut():
            table = pa.Table.from_batches(held).combine_chunks()
            texts = pc.fill_null(table.column(1), "").combine_chunks()
            out = []
            for doc_id, ids in zip(table.column(0).to_pylist(), _documents(words, texts), strict=True):
                for piece, start in enumerate(range(0, len(ids) // 4, tokens)):
                    part = ids[4 * start : 4 * (start + tokens)]
                    out.append((doc_id, piece, start, len(part) // 4, zlib.crc32(part)))
                if len(out) >= 5000:
                    yield _batch(out, _PIECE)
                    out = []
            if out:
                yield _batch(out, _PIECE)

        pool = pa.default_memory_pool()
        size = 0
        for batch in batches:
            ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))])
            row = 0
            while row < batch.num_rows:  # a batch holds up to 10,000 texts
                last = max(row + 1, int(np.searchsorted(ends, ends[row] + CHUNK - size, side="right")) - 1)
                held.append(batch.slice(row, last - row))
                size += int(ends[last] - ends[row])
                row = last
                if size >= CHUNK or row < batch.num_rows:
                    yield from cut()
                    held.clear()
                    size = 0
                    pool.release_unused()
        if held:
            yield from cut()

    slim = docs.select(col("doc_id").cast("long").alias("doc_id"), col("text").cast("string").alias("text"))
    return slim.mapInArrow(lean(run), _PIECE_SQL)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


class Packer:
    """Sequences of one group. `rule`: "norm" (least rest) or "dot" (demand that points where room is left)."""

    def __init__(self, demands: np.ndarray, capacity: tuple[int, int, int], rule: str = "norm"):
        if rule not in ("norm", "dot"):
            raise ValueError(f"unknown rule {rule!r}")
        self.rule, self.capacity = rule, np.array(capacity, np.int64)
        wanted = demands.sum(axis=0) / self.capacity
        # The capacity that asks for most sequences is the scarce one; others count by how near they come.
        self.weights = (wanted / wanted.max()) ** SCARCITY
        self.least = demands.min(axis=0)
        self.rest = np.empty((1024, 3), np.int64)
        self.number = np.empty(1024, np.int64)
        self.open, self.made = 0, 0

    def place(self, demand: np.ndarray) -> tuple[int, int]:
        """Sequence and offset of the next piece."""
        rest = self.rest[: self.open]
        fits = np.flatnonzero((rest >= demand).all(axis=1))
        if len(fits):
            room, want = rest[fits] / self.capacity, demand / self.capacity
            if self.rule == "norm":
                score = (self.weights * (room - want) ** 2).sum(axis=1)
            else:
                score = -(self.weights * room * want).sum(axis=1) / (self.weights * room * room).sum(axis=1)
            at = fits[int(np.argmin(score))]
        else:
            if self.open == len(self.rest):
                self.rest = np.concatenate([self.rest, np.empty_like(self.rest)])
                self.number = np.concatenate([self.number, np.empty_like(self.number)])
            at = self.open
            self.rest[at], self.number[at] = self.capacity, self.made
            self.open += 1
            self.made += 1
        number, offset = int(self.number[at]), int(self.capacity[0] - self.rest[at, 0])
        self.rest[at] -= demand
        if (self.rest[at] < self.least).any():  # closed: the last open one takes its place
            self.open -= 1
            self.rest[at], self.number[at] = self.rest[self.open], self.number[self.open]
        return number, offset


def _salted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces with `_salt`: 0 where a piece first occurs in its batch, and else another number each time."""
    part = TaskContext.get().partitionId()
    for number, batch in enumerate(batches):
        keys = batch.select(["doc_id", "piece", "ids_crc32"]).to_pandas()
        again = keys.groupby(list(keys.columns), dropna=False).cumcount().to_numpy(np.int64)
        salt = np.where(again > 0, again + (number << 20) + (part << 42), 0)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(salt)], [*batch.schema.names, "_salt"])


def pack(
    pieces: DataFrame, tokens: int = TOKENS, documents: int = DOCUMENTS, cost: int = COST, rule: str = "norm", group: int = GROUP
) -> DataFrame:
    """`pieces` with sequence_id and offset; every capacity holds for every sequence."""
    count = pieces.count()
    groups = max(1, -(-count // group))

    def run(frame):
        frame = frame.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        length = frame["length"].to_numpy()
        demands = np.stack([length, np.ones_like(length), length * length], axis=1)
        packer = Packer(demands, (tokens, documents, cost), rule)
        placed = [packer.place(d) for d in demands]
        frame["sequence_id"] = [(int(g) << 32) + n for g, (n, _) in zip(frame["_group"], placed, strict=True)]
        frame["offset"] = [o for _, o in placed]
        return frame.drop(columns="_group")

    salted = pieces.select("doc_id", "piece", "start", "length", "ids_crc32").mapInArrow(lean(_salted), _PIECE_SQL + ", _salt long")
    dealt = salted.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "_salt"), F.lit(groups))).drop("_salt")
    return dealt.groupBy("_group").applyInPandas(run, _PIECE_SQL + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, **limits) -> DataFrame:
    with small_batches(docs.sparkSession, CHUNK):
        pieces = materialize(tokenise(docs, vocabulary, limits.get("tokens", TOKENS)), "pieces")
    return pack(pieces, **limits)
