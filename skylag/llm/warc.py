"""Not-modified revisits of a web archive, resolved to the page they stand for.

A revisit record holds no page: the server said "not modified". It stands for the latest earlier
full response of the same canonical URL. The validators of both are compared (ETag first,
weakly; else Last-Modified), and the headers that such an answer may renew replace the stored ones.

The as-of join runs in two steps, so one URL with a third of all records spreads over tasks:
inside (URL, slice of time) a running "last response so far", and for the start of each slice the last
response of the slices before. Bodies stay where they are; only ids, digests and headers move.

Defined results: records without URL or time resolve to nothing; of responses with the same time
the one with the largest id counts, and it must be strictly earlier than the revisit; without any
validator the outcome is `unchecked`; header names are compared in lower case and of a repeated name
the last value counts; null headers are none; further columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylag.llm.keys import col

SLICES = 1024
#: Headers that a not-modified answer may renew.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that only track the visitor.
TRACKING = r"^(utm_[a-z]+|gclid|fbclid|ref)(=|$)"


def canonical_url(url: Column) -> Column:
    """Host in lower case without `www.` and default port, path without last slash, sorted query; no scheme, no fragment."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(plain, r"^[^/?]*", 0)), r":(80|443)$", ""), r"^www[.]", "")
    path = F.regexp_replace(F.regexp_extract(plain, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(plain, r"[?](.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.regexp_like(p, F.lit(TRACKING))))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.concat(host, path, tail)


def header_map(headers: Column) -> Column:
    """Names in lower case; of a repeated name the last value."""
    entries = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    entries = F.coalesce(entries, F.array().cast("array<struct<key:string,value:string>>"))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(last)


def _validated(revisit: Column, response: Column) -> Column:
    """True, false, or null where there is nothing to compare."""
    tag = lambda h: F.regexp_replace(h["etag"], "^W/", "")
    return (
        F.when(tag(revisit).isNotNull() & tag(response).isNotNull(), tag(revisit) == tag(response))
        .when(
            revisit["last-modified"].isNotNull() & response["last-modified"].isNotNull(),
            revisit["last-modified"] == response["last-modified"],
        )
    )


def resolve(records: DataFrame) -> DataFrame:
    """One row per revisit. `records`: record_id, url, ts, kind, status, headers (map), digest."""
    events = records.select(
        col("record_id").alias("record_id"),
        col("url").alias("url"),
        canonical_url(col("url")).alias("canonical_url"),
        col("ts").cast("long").alias("ts"),
        (col("kind") == "revisit").alias("revisit"),
        header_map(col("headers")).alias("headers"),
        F.when((col("kind") == "response") & (col("status") == 200), F.struct(
            col("ts").cast("long").alias("ts"), col("record_id").alias("record_id"), col("digest").alias("digest"),
            F.to_json(header_map(col("headers"))).alias("headers"),
        )).alias("full"),
    ).where(F.col("revisit") | F.col("full").isNotNull())
    bounds = events.agg(F.min("ts").alias("low"), F.max("ts").alias("high"))
    width = F.greatest(F.ceil((F.col("high") - F.col("low") + 1) / SLICES), F.lit(1))
    sliced = events.join(F.broadcast(bounds)).withColumn(  # one row
        "slice", F.floor((F.col("ts") - F.col("low")) / width)
    )
    inside = Window.partitionBy("canonical_url", "slice").orderBy("ts", F.col("full").isNotNull(), "record_id")
    so_far = F.last("full", ignorenulls=True).over(inside)
    slices = sliced.groupBy("canonical_url", "slice").agg(F.max("full").alias("full"))
    prior = Window.partitionBy("canonical_url").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select("canonical_url", "slice", F.last("full", ignorenulls=True).over(prior).alias("carried"))
    seen = sliced.withColumn("seen", so_far).where("revisit")
    joined = seen.join(slices, ["canonical_url", "slice"], "left")
    page = F.when(F.col("canonical_url").isNotNull() & F.col("ts").isNotNull(), F.coalesce("seen", "carried"))
    found = joined.withColumn("page", page).withColumn("page_headers", F.from_json("page.headers", "map<string,string>"))
    valid = _validated(F.col("headers"), F.col("page_headers"))
    outcome = (
        F.when(F.col("page").isNull(), "no earlier response")
        .when(valid.isNull(), "unchecked")
        .when(valid, "resolved")
        .otherwise("validator mismatch")
    )
    renewed = F.map_filter("headers", lambda k, _: k.isin(*PERMITTED))
    stored = F.map_filter("page_headers", lambda k, _: ~F.map_contains_key(renewed, k))
    merged = F.map_concat(stored, renewed)
    usable = F.col("outcome").isin("resolved", "unchecked")
    return found.withColumn("outcome", outcome).select(
        "record_id",
        "url",
        "canonical_url",
        "ts",
        F.col("page.record_id").alias("refers_to"),
        F.col("page.ts").alias("refers_ts"),
        "outcome",
        F.when(usable, F.col("page.digest")).alias("digest"),
        F.when(usable, merged).alias("headers"),
    )


def header_text(headers: Column) -> Column:
    lines = F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat_ws(": ", e["key"], e["value"]))
    return F.array_join(lines, "\n")
