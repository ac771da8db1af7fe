"""Benchmark passages in documents, by a prefix-filtered containment join.

A window is `window` consecutive words of an item (the whole item if it is shorter). A
window that occurs in a document has all its words there, so its rarest word is its
necessary prefix: words are ordered by their count over all documents, each window is
joined on the rarest word alone, and every meeting is verified word by word.

* A row per benchmark word and place is an anchor if that word is the rarest of a window.
* Document words that can be no anchor fall to a bit table of bounded size, inside the scan.
* Texts are cut into blocks of BLOCK words with `window - 1` more on either side, in one expression, so a word is told apart
  beside its block and never beside its document. Those that may be anchors go on with the words around them.
* Length bound: a run of equal words through the anchor must be as long as the window.
  Positional bound: the neighbour on one side at least must be equal.

Everything is DataFrame functions. Defined results: a null or empty text has no words; a row
that repeats id and text gets the same result as its copy; items without id or without words are
left out, items that share an id count once; further columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylag.llm.keys import col, key_bits, with_maybe, without
from skylag.sources.scratch import materialize

WINDOW = 13
#: Words of a block; a row of an exploded word holds no more, whatever the length of its text.
BLOCK = 256
#: Words before A-Z are lowered: the class without A-Z, since those become letters.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def fold(text: Column) -> Column:
    """A-Z lowered, all else as it is."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def _around(array: str, at: Column, radius: int) -> Column:
    """The words from `radius` before to `radius` after place `at`; null beyond either end."""
    return F.transform(F.sequence(F.lit(-radius), F.lit(radius)), lambda t: F.get(array, at + t))


def _exploded(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document word, and one for a document without; `key` matches whatever the case of the letters.

    `words` is the word's block and `at` its place there; `pos` is its place in the document of `n_words` words.
    """
    radius = window - 1

    def blocks(array: Column) -> Column:
        def block(first: Column) -> Column:
            before = F.least(first, F.lit(radius))
            return F.struct(
                first.alias("first"), before.alias("before"), F.size(array).alias("n_words"),
                F.slice(array, first - before + 1, before + BLOCK + radius).alias("words"),
            )

        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(array) - 1, F.lit(0)), F.lit(BLOCK)), block)

    # The array of one element binds the words, so that they are found once.
    cut = F.get(F.transform(F.array(words(col("text"))), blocks), F.lit(0))
    listed = docs.select(col("doc_id").alias("doc_id"), F.xxhash64(col("text")).alias("text_key"), F.inline(cut))
    own = F.slice("words", F.col("before") + 1, F.lit(BLOCK))
    return listed.select("doc_id", "text_key", "first", "before", "n_words", "words", F.posexplode_outer(own).alias("_i", "word")).select(
        "doc_id", "text_key", "n_words", "words", (F.col("_i") + F.col("before")).alias("at"), (F.col("_i") + F.col("first")).alias("pos"),
        "word", F.lower("word").alias("key"),
    )


def anchors(benchmark: DataFrame, docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rarest word of every window that has all its words in the corpus, with its surroundings."""
    items = (
        benchmark.where(col("item_id").isNotNull())
        .select(col("item_id").cast("string").alias("item_id"), F.transform(words(col("text")), fold).alias("words"))
        .where(F.size("words") > 0)
        .distinct()
    )
    spread = items.select("item_id", "words", F.posexplode("words").alias("pos", "word")).withColumn("key", F.lower("word"))
    vocabulary = spread.select("key").distinct()
    seen = with_maybe(_exploded(docs).select("key"), key_bits(vocabulary, F.xxhash64("key")), F.xxhash64("key"), "_maybe")
    counts = materialize(
        seen.where("_maybe").groupBy("key").agg(F.count(F.lit(1)).alias("n")).join(vocabulary, "key", "left_semi"), "word-counts"
    )
    span = F.least(F.size("words"), F.lit(window))
    of_item = Window.partitionBy("item_id", "words").orderBy("pos")
    rarest = F.min(F.struct("n", "key", "pos")).over(of_item.rowsBetween(0, window - 1))
    known = F.min("n").over(of_item.rowsBetween(0, window - 1))
    ranked = (
        spread.join(counts, "key", "left")
        .fillna(0, ["n"])
        .withColumns({"span": span, "rarest": rarest, "known": known})
        .where((F.col("pos") <= F.size("words") - F.col("span")) & (F.col("known") > 0))
    )
    return ranked.select("item_id", "words", "span", F.col("rarest.key").alias("key"), F.col("rarest.pos").alias("pos")).distinct().select(
        "item_id", "span", "key", _around("words", F.col("pos"), window - 1).alias("item_words")
    ).distinct()  # a repeated word has the same words around it at many places


def _candidates(docs: DataFrame, found: DataFrame, window: int) -> DataFrame:
    """The first word of every document, for its size, and all words that may be anchors, with their surroundings."""
    first = F.col("pos").isNull() | (F.col("pos") == 0)
    near = with_maybe(_exploded(docs, window), key_bits(found, F.xxhash64("key")), F.xxhash64("key"), "_maybe").where(F.col("_maybe") | first)
    around = F.when(F.col("_maybe"), _around("words", F.col("at"), window - 1))
    size = F.col("n_words").cast("long").alias("n_words")
    return near.select("doc_id", "text_key", "key", "pos", "_maybe", first.alias("first"), size, around.alias("doc_words"))


def _matches(near: DataFrame, found: DataFrame, window: int) -> DataFrame:
    """Runs of document words that are covered by windows of an item: [start, end)."""
    radius = window - 1
    near = near.where("_maybe")
    met = near.join(found, "key").where(F.col("n_words") >= F.col("span"))  # length bound
    same = lambda t: fold(F.get("doc_words", F.lit(radius + t))) == F.get("item_words", F.lit(radius + t))
    if radius:
        met = met.where((F.col("span") == 1) | F.coalesce(same(1), F.lit(False)) | F.coalesce(same(-1), F.lit(False)))
    equal = F.zip_with("doc_words", "item_words", lambda d, i: F.coalesce(fold(d) == i, F.lit(False)))
    met = met.withColumn("equal", equal).where(F.get("equal", F.lit(radius)))
    reach = lambda side: F.when(F.array_position(side, False) > 0, F.array_position(side, False) - 1).otherwise(radius)
    met = met.withColumns(
        {
            "left": reach(F.reverse(F.slice("equal", 1, radius))) if radius else F.lit(0),
            "right": reach(F.slice("equal", radius + 2, radius)) if radius else F.lit(0),
        }
    )
    return met.where(F.col("left") + F.col("right") + 1 >= F.col("span")).select(
        "doc_id", "text_key", "item_id", (F.col("pos") - F.col("left")).alias("start"), (F.col("pos") + F.col("right") + 1).alias("end")
    )


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """One row per document: its words, those hit, the items found, and whether 1/`share` is hit."""
    found = materialize(anchors(benchmark, docs, window), "anchors")
    near = materialize(_candidates(docs, found, window), "candidates")
    runs = materialize(_matches(near, found, window).distinct(), "benchmark-runs")
    # The runs of one document are as few as its words allow.
    before = Window.partitionBy("doc_id", "text_key").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    hit = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), "start")))
    hits = (
        runs.select("doc_id", "text_key", "start", "end").distinct().withColumn("hit", hit)
        .groupBy("doc_id", "text_key").agg(F.sum("hit").alias("n_hit"))
    )
    items = runs.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    sizes = near.where("first").select("doc_id", "text_key", "n_words")
    on = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_key"] == b["text_key"])
    both = hits.join(items, on(hits, items)).select(hits["doc_id"], hits["text_key"], "n_hit", "items")
    out = sizes.join(both, on(sizes, both), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        sizes["doc_id"],
        sizes["text_key"],
        "n_words",
        n_hit.alias("n_hit"),
        F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """The rows of `docs` that are not contaminated, with all their columns."""
    bad = materialize(contamination(docs, benchmark, window, share).where("contaminated").select("doc_id", "text_key"), "contaminated")
    return without(docs, bad, [col("doc_id"), F.xxhash64(col("text"))], ["doc_id", "text_key"])
