"""Quality by importance resampling: which documents look drawn from the target texts.

Two generative models of hashed n-grams (in 2 ** BUCKET_BITS buckets) are counted: one over all
documents, one over the target, here labelled good rows. A document's log weight is the sum of
log(target / raw) over its n-grams. Sampling without replacement in proportion to the
weights is a top-k of log weight + Gumbel noise.

The n-grams are one to three tokens long, and a token is taken by its shape: the case of its letters,
digits or none, whether it repeats one of the three tokens before, whether it touches the token before; marks
are taken as they are. Shapes tell shouting, tables and repetition from prose in any language.
With words themselves as tokens, weights followed the mix of languages instead, and a fifth of the
good labelled rows fell below the cut (0.2 % do with shapes).

Shapes cannot see which words a text uses (insults, say), so words have a pair of models of their own: in
how many good and in how many bad labelled rows each run of one or two words occurs. A row counts
once for a word, however long it is, and only words that stand against a row are used: at least
WORD_RATIO times as frequent in bad rows, by more than chance among all words tried. The words common in a
language are about as frequent in either class, so the mix of languages has no part in it.
A document with such words has the sum of their log ratios as word weight, and its shapes count no more
than the cut: no length of normal prose outweighs the words.

* The raw model counts every document. The target model is fit on at most TARGET_ROWS labelled
  rows, chosen by a hash of their id.
* Counts leave a scan task as one row per bucket, so the driver sees 2 ** BUCKET_BITS sums.
* `k` defaults to the number of documents whose weight clears the cut, with no words against them. The cut is the
  log weight that best separates the labelled rows (balanced error, at most TARGET_ROWS good and bad rows each).
* Noise comes from a hash of id and text: a lost task repeats it. TEMPERATURE scales it.
* The score is log weight + word weight + noise, the log weight of a document with words against it being held
  to the cut at most.
* The k-th largest score is found exactly by counting score keys, 16 bits at a time.

Defined results: a null or empty text has weight 0; a null id is hashed as 0; rows equal at the k-th
score all stay; labels without a document are ignored; labels that contradict each other count
as bad; without good labels every weight is 0, without bad ones the cut is 0, and with k given it
is kept; further columns are passed on by `select_documents` and ignored by `weigh`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skylag.llm import hashing
from skylag.llm.keys import col
from skylag.llm.workers import lean, small_batches
from skylag.sources.scratch import materialize

BUCKET_BITS = 16
#: Most labelled rows of each class that the models and the cut are fit on.
TARGET_ROWS = 40_000
#: Gumbel noise times this is added to the log weight.
TEMPERATURE = 1.0
#: Added to every bucket's count.
PRIOR = 0.5
#: A word stands against a row if it is so many times as frequent in bad rows as in good ones,
WORD_RATIO = 8.0
#: occurs in so many bad rows,
WORD_ROWS = 5
#: and so few words are expected to look like that by chance, among all that were tried.
WORD_CHANCE = 0.1

# Kinds of bytes: 0 white space, 1 letters, digits and all beyond ASCII, 2 marks.
_KINDS = np.full(256, 2, np.uint8)
_KINDS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KINDS[[*range(9, 14), 32]] = 0
# Words are of letters, digits and all beyond ASCII.
_WORD_KINDS = (_KINDS == 1).astype(np.uint8)

_UPPER, _SMALL, _DIGIT = (np.zeros(256, bool) for _ in range(3))
_UPPER[65:91] = _SMALL[97:123] = _DIGIT[48:58] = True
#: How many tokens back a repetition is looked for.
BACK = 3


def _shapes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the shape, and row, of every token."""
    starts, ends, row = hashing.places(data, offsets, _KINDS)
    h = hashing.hashes(data, starts, ends)
    # Letters of Latin-1 are two bytes in UTF-8: C3 and one that tells their case.
    late = np.zeros(len(data), bool)
    late[1:] = data[:-1] == 0xC3
    upper, small = _UPPER[data] | (late & (data < 0x9F)), _SMALL[data] | (late & (data >= 0x9F))
    up, low, digit = (np.concatenate([[0], np.cumsum(a)]) for a in (upper, small, _DIGIT[data]))
    ups, lows, digits = (c[ends] - c[starts] for c in (up, low, digit))
    first = up[np.minimum(starts + 2, ends)] > up[starts]
    case = np.select([digits > 0, ups == 0, (ups > 1) & (lows == 0), (ups == 1) & first], [0, 1, 2, 3], 4)
    again = np.zeros(len(h), bool)
    for k in range(1, BACK + 1):
        again[k:] |= (h[k:] == h[:-k]) & (row[k:] == row[:-k])
    word = _KINDS[data[starts]] == 1
    shape = np.where(word, hashing.mix((case * 2 + again).astype(np.uint64)), h)
    touches = np.zeros(len(h), np.uint64)
    touches[1:] = (starts[1:] == ends[:-1]) & (row[1:] == row[:-1])
    return hashing.mix(shape * np.uint64(2) + touches), row


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every run of one to three tokens."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    one, row = _shapes(data, offsets)
    two = hashing.mix(one[:-1] * np.uint64(3) + one[1:])
    three = hashing.mix(two[:-1] * np.uint64(5) + one[2:])
    in_two, in_three = row[1:] == row[:-1], row[2:] == row[:-2]
    bucket = np.concatenate([one, two[in_two], three[in_three]]) >> np.uint64(64 - BUCKET_BITS)
    return bucket.astype(np.int64), np.concatenate([row, row[:-1][in_two], row[:-2][in_three]])


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of one or two words."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    starts, ends, row = hashing.places(data, offsets, _WORD_KINDS)
    one = hashing.hashes(data, starts, ends)
    inside = row[1:] == row[:-1]
    two = hashing.mix(one[:-1] * np.uint64(3) + one[1:])[inside]
    return np.concatenate([one, two]).view(np.int64), np.concatenate([row, row[:-1][inside]])


def _once(word: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word once a row."""
    _, at = np.unique(hashing.mix(word.view(np.uint64) ^ hashing.mix(row.astype(np.uint64))), return_index=True)
    return word[at], row[at]


def _among(word: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which words are among the sorted known ones, and their places there."""
    at = np.minimum(np.searchsorted(known, word), len(known) - 1)
    return known[at] == word, at


def labelled(labels: DataFrame, good, limit: int = TARGET_ROWS) -> DataFrame:
    """At most `limit` ids of either class: doc_id, good."""
    one = labels.where(col("doc_id").isNotNull()).groupBy(col("doc_id").alias("doc_id")).agg(
        F.min(F.coalesce(good.cast("int"), F.lit(0))).alias("good")
    )
    mixed = F.xxhash64("doc_id", F.lit("label"))
    return one.where("good = 1").orderBy(mixed).limit(limit).unionByName(one.where("good = 0").orderBy(mixed).limit(limit))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    size = 1 << BUCKET_BITS
    raw, target = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for batch in batches:
        wanted = batch.column(1).to_numpy(zero_copy_only=False) == 1
        for first, data, offsets in hashing.runs(batch.column(0)):
            bucket, row = _grams(data, offsets)
            raw += np.bincount(bucket, minlength=size)
            target += np.bincount(bucket[wanted[first + row]], minlength=size)
    seen = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays(
        [pa.array(seen.astype(np.int32)), pa.array(raw[seen]), pa.array(target[seen])], ["bucket", "raw", "target"]
    )


def fit_ratio(docs: DataFrame, sample: DataFrame) -> np.ndarray:
    """log(target / raw) of each bucket; `sample` has at most 2 * TARGET_ROWS rows."""
    marked = docs.select(col("doc_id").alias("doc_id"), col("text").alias("text")).join(F.broadcast(sample), "doc_id", "left")
    parts = marked.select("text", F.coalesce("good", F.lit(0)).alias("good")).mapInArrow(lean(_count), "bucket int, raw long, target long")
    raw, target = np.zeros(1 << BUCKET_BITS), np.zeros(1 << BUCKET_BITS)
    for r in parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    if not target.sum():
        return np.zeros(1 << BUCKET_BITS)
    share = lambda c: np.log((c + PRIOR) / (c.sum() + PRIOR * len(c)))
    return share(target) - share(raw)


def fit_words(docs: DataFrame, sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, in order, of words that stand against a row, and their log ratios (good / bad), all below 0."""
    rows = docs.select(col("doc_id").alias("doc_id"), col("text").alias("text")).join(F.broadcast(sample), "doc_id")

    def counted(known: np.ndarray | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, data, offsets in hashing.runs(batch.column(0)):
                    word, row = _words(data, offsets)
                    if known is not None:
                        hit, _ = _among(word, known)
                        word, row = word[hit], row[hit]
                    words, n = np.unique(_once(word, row)[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(n)], ["word", "n"])

        return run

    def counts(good: int, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        found = rows.where(F.col("good") == good).select("text").mapInArrow(lean(counted(known)), "word long, n long")
        found = found.groupBy("word").agg(F.sum("n").alias("n"))
        # At most 2 * TARGET_ROWS rows of text are counted, and only words of several of them arrive.
        listed = (found if good else found.where(F.col("n") >= WORD_ROWS)).toArrow()
        words, n = listed["word"].to_numpy(), listed["n"].to_numpy()
        order = np.argsort(words)
        return words[order], n[order]

    sizes = {r["good"]: r["count"] for r in rows.groupBy("good").count().collect()}
    words, bad = counts(0) if len(sizes) == 2 else (np.empty(0, np.int64),) * 2
    if not len(words):
        return np.empty(0, np.int64), np.empty(0)
    met, n = counts(1, words)
    good = np.zeros(len(words), np.int64)
    good[np.searchsorted(words, met)] = n
    ratio = np.log((good + PRIOR) / (sizes[1] + 2 * PRIOR)) - np.log((bad + PRIOR) / (sizes[0] + 2 * PRIOR))
    # Likelihood ratio of the row counts against equal shares in either class.
    total = sizes[0] + sizes[1]
    part = lambda k, size: k * np.log(np.maximum(k, 1) * total / ((good + bad) * size))
    sure = 2 * (part(bad, sizes[0]) + part(good, sizes[1])) >= 2 * np.log(len(words) / WORD_CHANCE)
    against = sure & (ratio <= -np.log(WORD_RATIO))
    return words[against], ratio[against]


def _word_weights(texts: pa.Array, words: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    """Sum of the log ratios of the words against each text."""
    weight = np.zeros(len(texts))
    if words is None or not len(words[0]):
        return weight
    known, ratio = words
    for first, data, offsets in hashing.runs(texts):
        word, row = _words(data, offsets)
        hit, _ = _among(word, known)
        word, row = _once(word[hit], row[hit])
        n = len(offsets) - 1
        weight[first : first + n] = np.bincount(row, weights=ratio[_among(word, known)[1]], minlength=n)
    return weight


def _weights(texts: pa.Array, ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    weight, count = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    for first, data, offsets in hashing.runs(texts):
        bucket, row = _grams(data, offsets)
        n = len(offsets) - 1
        weight[first : first + n] = np.bincount(row, weights=ratio[bucket], minlength=n)
        count[first : first + n] = np.bincount(row, minlength=n)
    return weight, count


def _joint(weight: np.ndarray, words: np.ndarray, cut: float) -> np.ndarray:
    """Weight of shapes and words; with words against a document, its shapes count no more than the cut."""
    return np.where(words < 0, np.minimum(weight, cut) + words, weight)


def _scores(weight: np.ndarray, noise: np.ndarray, temperature: float) -> np.ndarray:
    """Weight + Gumbel noise; `noise` holds 64-bit hashes."""
    u = ((noise.view(np.uint64) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
    return np.round(weight, 9) - temperature * np.log(-np.log(u))


def _keys(score: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the scores."""
    bits = (score + 0.0).view(np.int64)
    return np.where(bits < 0, ~bits ^ np.int64(-(2**63)), bits)


def _noise_column():
    return F.xxhash64(F.coalesce(col("doc_id").cast("long"), F.lit(0)), col("text"), F.lit("gumbel"))


def weigh(
    docs: DataFrame,
    ratio: np.ndarray,
    temperature: float = TEMPERATURE,
    words: tuple[np.ndarray, np.ndarray] | None = None,
    cut: float = 0.0,
) -> DataFrame:
    """doc_id, n_grams, log_weight, word_weight, score and the score's order key of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight, count = _weights(batch.column(1), ratio)
            against = _word_weights(batch.column(1), words)
            score = _scores(_joint(weight, against, cut), batch.column(2).to_numpy(), temperature)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(count), pa.array(weight), pa.array(against), pa.array(score), pa.array(_keys(score))],
                ["doc_id", "n_grams", "log_weight", "word_weight", "score", "order_key"],
            )

    slim = docs.select(col("doc_id").cast("long").alias("doc_id"), col("text").alias("text"), _noise_column().alias("noise"))
    return slim.mapInArrow(lean(run), "doc_id long, n_grams long, log_weight double, word_weight double, score double, order_key long")


def best_cut(weighed: DataFrame, sample: DataFrame) -> float:
    """The log weight that best separates good from bad labelled rows."""
    rows = weighed.join(F.broadcast(sample), "doc_id").select("good", "log_weight").collect()  # at most 2 * TARGET_ROWS
    good = np.sort([r["log_weight"] for r in rows if r["good"] == 1])
    bad = np.sort([r["log_weight"] for r in rows if r["good"] == 0])
    if not len(good) or not len(bad):
        return 0.0
    cuts = np.unique(np.concatenate([good, bad]))
    cuts = np.concatenate([[cuts[0] - 1], (cuts[1:] + cuts[:-1]) / 2])
    error = np.searchsorted(good, cuts) / len(good) + 1 - np.searchsorted(bad, cuts) / len(bad)
    return float(cuts[int(np.argmin(error))])


def kth_key(weighed: DataFrame, k: int) -> int:
    """The k-th largest order key: 2 ** 16 counts at a time, from the leading bits down."""
    low, left = -(1 << 63), k
    for shift in (48, 32, 16, 0):
        inside = weighed.where(F.col("order_key").between(low, low + (1 << (shift + 16)) - 1)) if shift < 48 else weighed
        counts = inside.groupBy(F.shiftright("order_key", shift).alias("part")).count().collect()
        for r in sorted(counts, key=lambda r: -r["part"]):
            if left <= r["count"]:
                low = r["part"] << shift
                break
            left -= r["count"]
        else:
            return -(1 << 63)
    return low


class Selection:
    """The fitted ratio, the stored weights, and the threshold of the top k."""

    def __init__(self, docs: DataFrame, labels: DataFrame, good, k: int | None = None, temperature: float = TEMPERATURE):
        sample = materialize(labelled(labels, good), "labelled")
        self.temperature = temperature
        self.ratio = fit_ratio(docs, sample)
        self.words = fit_words(docs, sample)
        marked = docs.select(col("doc_id").alias("doc_id"), col("text").alias("text")).join(F.broadcast(sample.select("doc_id")), "doc_id")
        self.cut = best_cut(weigh(marked, self.ratio), sample)
        self.weights = materialize(weigh(docs, self.ratio, temperature, self.words, self.cut), "weights")
        if k is None:
            k = self.weights.where((F.col("log_weight") >= self.cut) & (F.col("word_weight") == 0)).count()
        self.k = k
        self.threshold = kth_key(self.weights, k) if k > 0 else (1 << 63) - 1


def score(docs: DataFrame, labels: DataFrame, good, k: int | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """One row per document: its weights, its noisy score, and whether it is among the k."""
    with small_batches(docs.sparkSession):
        chosen = Selection(docs, labels, good, k, temperature)
    return chosen.weights.select(
        "doc_id", "n_grams", "log_weight", "word_weight", "score", (F.col("order_key") >= chosen.threshold).alias("kept")
    )


def select_documents(docs: DataFrame, labels: DataFrame, good, k: int | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """The rows of `docs` among the k, with all their columns; scores are worked out anew, not joined."""
    with small_batches(docs.sparkSession):
        chosen = Selection(docs, labels, good, k, temperature)
    ratio, words, cut, threshold = chosen.ratio, chosen.words, chosen.cut, chosen.threshold
    text_at = docs.columns.index("text")
    plain = [f"c{i}" for i in range(len(docs.columns))]  # no dots or clashes on the way through Arrow
    schema = T.StructType([T.StructField(c, f.dataType) for c, f in zip(plain, docs.schema, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight, _ = _weights(batch.column(text_at), ratio)
            weight = _joint(weight, _word_weights(batch.column(text_at), words), cut)
            keys = _keys(_scores(weight, batch.column(batch.num_columns - 1).to_numpy(), temperature))
            yield batch.filter(pa.array(keys >= threshold)).select(list(range(batch.num_columns - 1)))

    with_noise = docs.select("*", _noise_column()).toDF(*plain, "noise")
    return with_noise.mapInArrow(lean(run), schema).toDF(*docs.columns)
