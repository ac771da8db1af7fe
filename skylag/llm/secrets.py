"""Secrets in texts: fixed patterns, and sliding-window entropy over candidate strings.

Patterns are matched leftmost and without overlap. Spark has no function for the places of
matches, so they follow from lengths: the pieces between matches (`split`) and the matches
(`regexp_extract_all`) alternate, and code points add up from the left.

Pieces are walked in blocks of BLOCK, so that a text of many matches costs in proportion to its length.

Entropy: a candidate is a run of at least WINDOW token characters outside the patterns' spans. A window of WINDOW characters
slides over it; per step one count goes up and one down, and the sum of n * log2(n) over the counts
changes by those two terms (held as whole millionths, so it never drifts). A class of characters has
its own threshold in bits. The span reaches from the first to the last window at or above it.
The allow list is held against that span, not against all of the run.

One projection: nothing is shuffled. A null text is empty; equal rows get equal results; further
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylag.llm.keys import col

# Kind, pattern, the group whose length counts, its least length.
KINDS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)
WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{%d,}"
#: Character class, pattern of its candidates, least bits per character; the first that fits counts. A run of
#: digits alone is a pattern's span already, so the digit class is for numbers in groups.
CLASSES = (("digit", r"^[0-9/_=+-]+$", 3.0), ("hexadecimal", r"^[0-9A-Fa-f]+$", 3.0), ("token", r"", 3.9))
#: Spans that are no secrets, as (pattern, pattern that must not be found): placeholders, dates and other short numbers, words.
#: Words are letters without six consonants in a row and without case that goes up and down.
ALLOW = (
    (r"^((?i:example|placeholder|changeme|xxxx)|[/_=+-])+$", r"^$"),
    (r"^[0-9]{1,4}([/_=-]+[0-9]{1,4})+$", r"^$"),
    (r"^[A-Za-z/_=+-]+$", r"[bcdfghjklmnpqrstvwxzBCDFGHJKLMNPQRSTVWXZ]{6}|[a-z][A-Z][a-z][A-Z]"),
)
#: Pieces between matches that are walked together.
BLOCK = 256
MILLION = 1_000_000
SPANS = "array<struct<start:bigint,rank:int,end:bigint,kind:string,found:string>>"


def _bound(value: Column, body) -> Column:
    """`body` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _gate(kind: str, pattern: str, least: int) -> str:
    """A cheap test first: most texts hold no match that counts."""
    return {"hex": rf"[0-9a-f]{{{least}}}", "access": rf"AKIA[A-Z0-9]{{{least - 4}}}"}.get(kind, pattern)


def _pieces(text: Column, pattern: str, group: int) -> Column:
    """(gap, found, counted) from left to right; the last piece has a gap only."""
    between = F.split(text, pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches
    return F.arrays_zip(between.alias("gap"), matches.alias("found"), counted.alias("counted"))


def _counts(x: Column, least: int) -> Column:
    return F.coalesce(F.char_length(x["counted"]) >= least, F.lit(False))


def _places(text: Column, pattern: str, group: int, least: int, kind: str, rank: int) -> Column:
    """Spans (start, rank, end, kind, match) of the matches whose group is long enough."""
    state = f"struct<at:bigint,out:{SPANS}>"

    def span(start: Column, end: Column, found: Column) -> Column:
        return F.struct(
            start.cast("bigint").alias("start"), F.lit(rank).alias("rank"), end.cast("bigint").alias("end"), F.lit(kind).alias("kind"), found.alias("found")
        )

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.char_length(x["gap"])
        end = begin + F.coalesce(F.char_length(x["found"]), F.lit(0))
        out = F.when(_counts(x, least), F.concat(acc["out"], F.array(span(begin, end, x["found"])))).otherwise(acc["out"])
        return F.struct(end.cast("bigint").alias("at"), out.alias("out")).cast(state)

    def block(pieces: Column):
        start = F.struct(F.lit(0).alias("at"), F.array().alias("out")).cast(state)
        return lambda b: F.aggregate(F.slice(pieces, b * BLOCK + 1, F.lit(BLOCK)), start, step)

    def shifted(blocks: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            base = F.aggregate(F.slice(blocks, F.lit(1), i), F.lit(0).cast("bigint"), lambda acc, y: acc + y["at"])
            return _bound(base, lambda at: F.transform(x["out"], lambda s: span(s["start"] + at, s["end"] + at, s["found"])))

        return F.flatten(F.transform(blocks, one))

    def walk(pieces: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / BLOCK).cast("int"))
        return _bound(F.transform(numbers, block(pieces)), shifted)

    walked = _bound(_pieces(text, pattern, group), walk)
    return F.when(F.regexp_like(text, F.lit(_gate(kind, pattern, least))), walked).otherwise(F.array().cast(SPANS))


def _blanked(text: Column) -> Column:
    """The text with a blank for each character of a pattern's span, pattern by pattern."""

    def without(kind: str, pattern: str, group: int, least: int):
        def blank(t: Column) -> Column:
            kept = F.transform(
                _pieces(t, pattern, group),
                lambda x: F.concat(
                    x["gap"],
                    F.coalesce(F.when(_counts(x, least), F.repeat(F.lit(" "), F.char_length(x["found"]))).otherwise(x["found"]), F.lit("")),
                ),
            )
            return F.when(F.regexp_like(t, F.lit(_gate(kind, pattern, least))), F.array_join(kept, "")).otherwise(t)

        return blank

    for kind, pattern, group, least in KINDS:
        text = _bound(text, without(kind, pattern, group, least))
    return text


def _sum_term(n: Column, window: int) -> Column:
    """n * log2(n) in millionths."""
    table = [0] + [round(k * math.log2(k) * MILLION) for k in range(1, window + 2)]
    return F.get(F.lit(table).cast("array<bigint>"), n)


def _hot_windows(found: Column, threshold: Column, window: int) -> Column:
    """(first, last): the first and last place at which a window at or above the threshold ends; -1: none."""
    letters = F.split(found, "")
    kinds = F.array_distinct(letters)
    place = F.transform(letters, lambda c: (F.array_position(kinds, c) - 1).cast("int"))
    state = "struct<counts:array<int>,total:bigint,first:int,last:int>"
    most = round(window * math.log2(window) * MILLION)

    def step(acc: Column, i: Column) -> Column:
        new, old = F.get(place, i), F.get(place, i - window)
        up = F.get(acc["counts"], new)
        down = F.get(acc["counts"], old) + F.when(new == old, 1).otherwise(0)
        total = acc["total"] + _sum_term(up + 1, window) - _sum_term(up, window)
        total = total + F.coalesce(_sum_term(down - 1, window) - _sum_term(down, window), F.lit(0))
        hot = (i >= window - 1) & (F.lit(most) - total >= F.floor(threshold * window * MILLION))
        return F.struct(
            F.transform(
                acc["counts"],
                lambda v, k: v + F.when(k == new, 1).otherwise(0) - F.when(F.coalesce(k == old, F.lit(False)), 1).otherwise(0),
            ).alias("counts"),
            total.cast("bigint").alias("total"),
            F.when(hot & (acc["first"] < 0), i).otherwise(acc["first"]).alias("first"),
            F.when(hot, i).otherwise(acc["last"]).alias("last"),
        ).cast(state)

    return F.aggregate(
        F.sequence(F.lit(0), F.size(letters) - 1),
        F.struct(
            F.transform(kinds, lambda _: F.lit(0)).alias("counts"),
            F.lit(0).cast("bigint").alias("total"),
            F.lit(-1).alias("first"),
            F.lit(-1).alias("last"),
        ).cast(state),
        step,
        lambda acc: F.struct(acc["first"], acc["last"]).cast("struct<first:int,last:int>"),
    )


def _entropy_spans(text: Column, window: int, rank: int) -> Column:
    candidates = _places(text, CANDIDATE % window, 0, window, "entropy", rank)

    def allowed(found: Column) -> Column:
        hit = F.lit(False)
        for pattern, unless in ALLOW:
            hit = hit | (F.regexp_like(found, F.lit(pattern)) & ~F.regexp_like(found, F.lit(unless)))
        return hit

    def threshold(x: Column) -> Column:
        out = F.lit(CLASSES[-1][2])
        for _, pattern, bits in reversed(CLASSES[:-1]):
            out = F.when(F.regexp_like(x["found"], F.lit(pattern)), F.lit(bits)).otherwise(out)
        return out

    def cut(x: Column) -> Column:
        ends = _hot_windows(x["found"], threshold(x), window)
        return F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["found"].alias("found"), ends.alias("ends"))

    def hot(y: Column) -> Column:
        first, last = y["ends"]["first"] - (window - 1), y["ends"]["last"] + 1
        return F.struct(y["start"].alias("start"), y["rank"].alias("rank"), first.alias("first"), last.alias("last"),
                        F.substring(y["found"], first + 1, last - first).alias("found"))

    scored = F.filter(F.transform(candidates, cut), lambda y: y["ends"]["first"] >= 0)
    spans = F.filter(F.transform(scored, hot), lambda y: ~allowed(y["found"]))
    return F.transform(
        spans,
        lambda y: F.struct(
            (y["start"] + y["first"]).cast("bigint").alias("start"),
            y["rank"].alias("rank"),
            (y["start"] + y["last"]).cast("bigint").alias("end"),
            F.lit("entropy").alias("kind"),
        ),
    )


def find_secrets(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: `base` and `entropy` spans as arrays of (start, rank, end, kind)."""
    text = F.coalesce(col("text"), F.lit(""))
    slim = lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"))
    base = F.concat(*(F.transform(_places(text, p, g, n, kind, i), slim) for i, (kind, p, g, n) in enumerate(KINDS)))
    more = _bound(_blanked(text), lambda t: _entropy_spans(t, window, len(KINDS)))
    return docs.select(col("doc_id").alias("doc_id"), base.alias("base"), more.alias("entropy"))


def digest(found: DataFrame) -> DataFrame:
    """Counts, the digest of the pattern spans, and all spans as text."""

    def joined(spans: Column) -> Column:
        named = F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
        return F.array_join(named, ",")

    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *(number(kind) for kind, *_ in KINDS),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.concat("base", "entropy")).alias("spans"),
    )
