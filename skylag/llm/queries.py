"""Registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylag.llm import (
    chat,
    decontaminate,
    exact_dedup,
    jaccard_join,
    licenses,
    merkle,
    packing,
    quality,
    secrets,
    sharding,
    substrings,
    warc,
    whitening,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=16).withColumns(
        {"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")}
    )


def good_label():
    """What the pipeline calls good: high quality and not toxic."""
    return (F.col("quality") == 1) & (F.col("toxic") == 0)


@query
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), good_label())


@query
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicates(table(spark, sf_dir, "documents"))


ORACLES["op3_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


@query
def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=90).drop("text_key")


ORACLES["op4_ngram_jaccard_join"] = """
WITH RECURSIVE listed AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(3, len(w)) - 1], ' ') AS s
         FROM listed, unnest(range(1, len(w) - least(3, len(w)) + 2)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))),
reach(a, b) AS (SELECT doc_id, doc_id FROM listed UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id
FROM (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) LEFT JOIN sizes USING (doc_id)
"""


@query
def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")


ORACLES["op5_benchmark_decontamination"] = """
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
spans AS (SELECT item_id, w, least(13, len(w)) AS n FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS passage
            FROM spans, unnest(range(1, len(w) - n + 2)) AS t(i)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS passage
           FROM docs, sizes, unnest(range(1, len(w) - n + 2)) AS t(i)),
met AS (SELECT DISTINCT doc_id, i, n, item_id FROM places JOIN windows USING (n, passage)),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM met, unnest(range(i, i + n)) AS t(k) GROUP BY doc_id),
listed AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, list_sort(list_distinct(list(item_id))) AS ids FROM met GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs d LEFT JOIN hit USING (doc_id) LEFT JOIN listed USING (doc_id)
"""


def vocabulary() -> str:
    """The public vocabulary that packing uses; each task opens the file by this path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary())


def as_files(documents: DataFrame) -> DataFrame:
    """Documents as files: two to four folders deep by source, language and runs of ids."""
    number = F.col("doc_id")
    thousand, hundred = (F.floor(number / k).cast("string") for k in (1000, 100))
    below = (
        F.when(number % 3 == 0, number.cast("string"))
        .when(number % 3 == 1, F.concat_ws("/", hundred, number.cast("string")))
        .otherwise(F.concat_ws("/", thousand, hundred, number.cast("string")))
    )
    path = F.concat_ws("/", F.coalesce("source", F.lit("_")), F.coalesce("lang", F.lit("_")), F.coalesce(below, F.lit("_")))
    return documents.select("doc_id", path.alias("path"), "text")


@query
def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(as_files(table(spark, sf_dir, "documents")))


@query
def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(table(spark, sf_dir, "documents")))


def _sql_text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _sql_matches(pattern: str, group: int, least: int, kind: str, rank: int, source: str = "texts") -> str:
    """Spans of the matches of a pattern: lengths of the pieces between matches and of the matches add up."""
    p = _sql_text(pattern)
    return f"""
      SELECT doc_id, kind, rank, CAST(start AS BIGINT) AS start, CAST(start + length(found) AS BIGINT) AS stop, found FROM (
        SELECT doc_id, {_sql_text(kind)} AS kind, {rank} AS rank, matches[i] AS found, counted[i] AS part,
               list_sum(list_transform(gaps[1:i], lambda x: length(x)))
               + coalesce(list_sum(list_transform(matches[1:i - 1], lambda x: length(x))), 0) AS start
        FROM (SELECT doc_id, string_split_regex(text, {p}) AS gaps, regexp_extract_all(text, {p}, 0) AS matches,
                     regexp_extract_all(text, {p}, {group}) AS counted FROM {source}) AS m, unnest(range(1, len(matches) + 1)) AS t(i))
      WHERE length(part) >= {least}"""


def _sql_blanked(pattern: str, group: int, least: int, source: str) -> str:
    """Texts with blanks in place of the matches that count."""
    p = _sql_text(pattern)
    return f"""
      SELECT doc_id, array_to_string(list_transform(range(1, len(gaps) + 1), lambda i: gaps[i] || CASE
               WHEN i > len(matches) THEN '' WHEN length(counted[i]) >= {least} THEN repeat(' ', length(matches[i])) ELSE matches[i] END), '') AS text
      FROM (SELECT doc_id, string_split_regex(text, {p}) AS gaps, regexp_extract_all(text, {p}, 0) AS matches,
                   regexp_extract_all(text, {p}, {group}) AS counted FROM {source}) AS m"""


_W, _M = secrets.WINDOW, secrets.MILLION
_BITS = " ".join(f"WHEN regexp_matches(found, {_sql_text(p)}) THEN {b}" for _, p, b in secrets.CLASSES[:-1])
ORACLES["op8_secret_scans"] = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
base AS ({" UNION ALL ".join(_sql_matches(p, g, n, kind, i) for i, (kind, p, g, n) in enumerate(secrets.KINDS))}),
{"".join(f"blank{i + 1} AS ({_sql_blanked(p, g, n, f'blank{i}' if i else 'texts')})," for i, (_, p, g, n) in enumerate(secrets.KINDS))}
candidates AS ({_sql_matches(secrets.CANDIDATE % _W, 0, _W, "entropy", len(secrets.KINDS), f"blank{len(secrets.KINDS)}")}),
judged AS (SELECT *, CASE {_BITS} ELSE {secrets.CLASSES[-1][2]} END AS bits FROM candidates c),
windows AS (
  SELECT judged.*, j, list_sum(list_transform(map_values(list_histogram(string_split(substr(found, CAST(j + 1 AS BIGINT), {_W}), ''))),
                                               lambda n: CAST(round(n * log2(n) * {_M}) AS BIGINT))) AS total
  FROM judged, unnest(range(0, length(found) - {_W - 1})) AS t(j)),
hot AS (
  SELECT doc_id, 'entropy' AS kind, {len(secrets.KINDS)} AS rank, start + min(j) AS start, start + max(j) + {_W} AS stop,
         substr(found, CAST(min(j) + 1 AS BIGINT), CAST(max(j) - min(j) + {_W} AS BIGINT)) AS part
  FROM windows WHERE CAST(round({_W} * log2({_W}) * {_M}) AS BIGINT) - total >= floor(bits * {_W} * {_M})
  GROUP BY doc_id, start, found),
more AS (SELECT * EXCLUDE (part) FROM hot WHERE NOT ({" OR ".join(
  f"(regexp_matches(part, {_sql_text(p)}) AND NOT regexp_matches(part, {_sql_text(u)}))" for p, u in secrets.ALLOW)})),
spans AS (SELECT doc_id, kind, rank, start, stop FROM base UNION ALL SELECT * FROM more),
listed AS (
  SELECT doc_id, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop) AS spans,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop) FILTER (WHERE kind <> 'entropy') AS base,
         {", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k, *_ in secrets.KINDS)}
  FROM spans GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k, *_ in secrets.KINDS)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN listed USING (doc_id)
"""


@query
def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


ORACLES["op9_chat_formatting"] = """
WITH turns AS (SELECT DISTINCT conv_id, coalesce(turn, -1) AS turn, role, coalesce(text, '') AS text FROM conversations
               WHERE conv_id IS NOT NULL),
people AS (SELECT DISTINCT conv_id, role AS perspective FROM turns WHERE role <> 'system'),
shown AS (
  SELECT conv_id, perspective, turn, coalesce(role, 'unknown') AS speaker, coalesce(role = perspective, false) AS own,
         '<|im_start|>' || CASE WHEN role = 'system' THEN 'system' WHEN role = perspective THEN 'assistant'
           ELSE 'user name=' || replace(coalesce(role, 'unknown'), '<|', '< |') END || chr(10) AS header,
         replace(text, '<|', '< |') AS body, role, sha256(coalesce(role, 'unknown') || ':' || text) AS key
  FROM turns JOIN people USING (conv_id)),
placed AS (
  SELECT *, header || body || '<|im_end|>' || chr(10) AS rendered,
         sum(length(header || body) + 11) OVER (PARTITION BY conv_id, perspective ORDER BY turn, role NULLS FIRST, key) AS stop
  FROM shown)
SELECT conv_id, perspective, turn, speaker, rendered, CAST(stop - length(rendered) AS BIGINT) AS start, CAST(stop AS BIGINT) AS "end",
       CAST(CASE WHEN own THEN stop - length(rendered) + length(header) END AS BIGINT) AS mask_start,
       CAST(CASE WHEN own THEN stop - 1 END AS BIGINT) AS mask_end
FROM placed
"""


def archive(pages: DataFrame) -> DataFrame:
    """Records of an archive made from pages: each page fetched once, and asked for again later.

    The later request names the page by another spelling of its URL and is answered "not modified",
    with a validator that fits, one that does not, only a date, or none.
    """
    tag = F.concat(F.lit('"'), F.md5("html"), F.lit('"'))
    seen = F.concat(F.lit("day "), F.col("page_id") % 7)
    kind = F.col("page_id") % 5
    first = pages.select(
        (2 * F.col("page_id")).alias("record_id"),
        "url",
        (10 * F.col("page_id")).alias("ts"),
        F.lit("response").alias("kind"),
        F.when(F.col("page_id") % 11 == 0, 206).otherwise(200).alias("status"),
        F.create_map(
            F.lit("Content-Type"), F.lit("text/html"), F.lit("ETag"), tag,
            F.lit("Last-Modified"), seen, F.lit("Cache-Control"), F.lit("max-age=60"),
        ).alias("headers"),
        F.md5("html").alias("digest"),
    )
    spelling = (
        F.when(F.col("page_id") % 4 == 0, F.col("url"))
        .when(F.col("page_id") % 4 == 1, F.regexp_replace("url", "^https?://", "HTTP://WWW."))
        .when(F.col("page_id") % 4 == 2, F.concat("url", F.lit("#again")))
        .otherwise(F.concat(F.rtrim("url", F.lit("/")), F.lit("/")))
    )
    answer = F.map_filter(
        F.create_map(
            F.lit("etag"), F.when(kind < 2, F.concat(F.lit("W/"), tag)).when(kind == 2, F.concat(F.lit('"'), F.md5("url"), F.lit('"'))),
            F.lit("Last-Modified"), F.when(kind == 3, seen),
            F.lit("Date"), F.concat(F.lit("day "), F.col("page_id")),
            F.lit("Cache-Control"), F.lit("max-age=120"), F.lit("Set-Cookie"), F.lit("id=1"),
        ),
        lambda _, v: v.isNotNull(),
    )
    later = pages.select(
        (2 * F.col("page_id") + 1).alias("record_id"),
        spelling.alias("url"),
        (10 * F.col("page_id") + F.when(F.col("page_id") % 7 == 0, 0).otherwise(5)).alias("ts"),
        F.lit("revisit").alias("kind"),
        F.lit(304).alias("status"),
        answer.alias("headers"),
        F.lit(None).cast("string").alias("digest"),
    )
    return first.unionByName(later)


@query
def op10_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = warc.resolve(archive(table(spark, sf_dir, "pages")))
    return resolved.withColumn("headers", warc.header_text(F.col("headers")))


_CANONICAL = """
  regexp_replace(regexp_replace(lower(regexp_extract(plain, '^[^/?]*', 0)), ':(80|443)$', ''), '^www[.]', '')
  || regexp_replace(regexp_extract(plain, '^[^/?]*([^?]*)', 1), '/+$', '')
  || coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(regexp_extract(plain, '[?](.*)$', 1), '&'),
       lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|gclid|fbclid|ref)(=|$)'))), '&'), ''), '')
"""
ORACLES["op10_warc_revisits"] = f"""
WITH spelled AS (
  SELECT *, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN regexp_replace(url, '^https?://', 'HTTP://WWW.')
              WHEN 2 THEN url || '#again' ELSE rtrim(url, '/') || '/' END AS asked FROM pages),
records AS (
  SELECT page_id, 2 * page_id AS record_id, url, 10 * page_id AS ts, false AS revisit, html FROM spelled WHERE page_id % 11 <> 0
  UNION ALL
  SELECT page_id, 2 * page_id + 1, asked, 10 * page_id + CASE WHEN page_id % 7 = 0 THEN 0 ELSE 5 END, true, url AS html FROM spelled),
plain AS (SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS plain FROM records),
named AS (SELECT *, {_CANONICAL} AS canonical_url FROM plain),
pages_of AS (SELECT page_id, html AS page_html FROM pages),
revisits AS (SELECT n.*, md5(page_html) AS own, md5(html) AS other FROM named n JOIN pages_of USING (page_id) WHERE revisit),
full_pages AS (SELECT canonical_url, ts AS refers_ts, max(record_id) AS refers_to, arg_max(md5(html), record_id) AS digest,
                      arg_max(page_id % 7, record_id) AS day FROM named WHERE NOT revisit GROUP BY ALL),
met AS (SELECT r.*, refers_ts, refers_to, digest, day FROM revisits r ASOF LEFT JOIN full_pages f
        ON r.canonical_url = f.canonical_url AND r.ts > f.refers_ts),
judged AS (SELECT *, CASE WHEN refers_to IS NULL THEN 'no earlier response' WHEN page_id % 5 = 4 THEN 'unchecked'
                          WHEN page_id % 5 < 2 AND own = digest THEN 'resolved' WHEN page_id % 5 = 2 AND other = digest THEN 'resolved'
                          WHEN page_id % 5 = 3 AND page_id % 7 = day THEN 'resolved' ELSE 'validator mismatch' END AS outcome FROM met)
SELECT record_id, url, canonical_url, ts, refers_to, refers_ts, outcome,
       CASE WHEN outcome IN ('resolved', 'unchecked') THEN digest END AS digest,
       CASE WHEN outcome IN ('resolved', 'unchecked') THEN
         'cache-control: max-age=120' || chr(10) || 'content-type: text/html' || chr(10) || 'date: day ' || page_id || chr(10)
         || 'etag: ' || CASE WHEN page_id % 5 < 2 THEN 'W/' ELSE '' END || '"'
         || CASE WHEN page_id % 5 < 2 THEN own WHEN page_id % 5 = 2 THEN other ELSE digest END || '"' || chr(10)
         || 'last-modified: day ' || CASE WHEN page_id % 5 = 3 THEN page_id % 7 ELSE day END END AS headers
FROM judged
"""


@query
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model, error = whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return whitening.by_component(rows, model, error)


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = merkle.leaf_hash(*map(F.col, ("doc_id", "source", "lang", "n_chars")), F.translate("text", "\n", ""))
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    leaf = merkle.leaf_hash(*map(F.col, ("doc_id", "source", "lang", "n_chars", "text")))
    rows = merkle.manifest(docs, observed=F.when(even, tampered).otherwise(leaf))
    return rows.select(
        F.col("at").alias("doc_id"), "leaf", "subroot", "root", F.sha2(F.array_join("proof", ""), 256).alias("proof_sha256"), "folded_root", "verified"
    )


def _sql_field(name: str, value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def _sql_leaf(text: str) -> str:
    return "sha256(" + " || ".join(_sql_field(n, n) for n in ("doc_id", "source", "lang", "n_chars")) + " || " + _sql_field("text", text) + ")"


ORACLES["op12_merkle_manifest"] = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, source, {_sql_leaf("text")} AS leaf, {_sql_leaf("replace(text, chr(10), '')")} AS tampered,
         list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1),
             lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT))),
           lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
             lambda x, y: xor(x >> 1, 3988292384::BIGINT * (x & 1)))) & 1 AS odd,
         row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS place FROM documents),
levels(source, level, nodes) AS (
  SELECT source, 0, list(leaf ORDER BY place) FROM leaves GROUP BY source
  UNION ALL
  SELECT source, level + 1, list_transform(range(0, CAST(ceil(len(nodes) / 3.0) AS BIGINT)), lambda i: sha256(array_to_string(nodes[3 * i + 1:3 * i + 3], '')))
  FROM levels WHERE len(nodes) > 1),
subroots AS (SELECT source, nodes[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree_place FROM levels WHERE len(nodes) = 1),
tops(level, nodes) AS (
  SELECT 0, list(subroot ORDER BY tree_place) FROM subroots
  UNION ALL
  SELECT level + 1, list_transform(range(0, CAST(ceil(len(nodes) / 3.0) AS BIGINT)), lambda i: sha256(array_to_string(nodes[3 * i + 1:3 * i + 3], '')))
  FROM tops WHERE len(nodes) > 1),
low(doc_id, source, level, place, folded, proof) AS (
  SELECT doc_id, source, 0, place, CASE WHEN odd = 1 THEN coalesce(tampered, leaf) ELSE leaf END, '' FROM leaves
  UNION ALL
  SELECT doc_id, w.source, w.level + 1, place // 3,
         sha256(array_to_string(nodes[place - place % 3 + 1:place], '') || folded || array_to_string(nodes[place + 2:place - place % 3 + 3], '')),
         proof || array_to_string(nodes[place - place % 3 + 1:place], '') || array_to_string(nodes[place + 2:place - place % 3 + 3], '')
  FROM low w JOIN levels n ON n.level = w.level AND n.source IS NOT DISTINCT FROM w.source AND len(nodes) > 1),
high(doc_id, level, place, folded, proof) AS (
  SELECT doc_id, 0, tree_place, folded, proof FROM (
    SELECT doc_id, source, arg_max(folded, level) AS folded, arg_max(proof, level) AS proof FROM low GROUP BY doc_id, source) d
  JOIN subroots s ON s.source IS NOT DISTINCT FROM d.source
  UNION ALL
  SELECT doc_id, w.level + 1, place // 3,
         sha256(array_to_string(nodes[place - place % 3 + 1:place], '') || folded || array_to_string(nodes[place + 2:place - place % 3 + 3], '')),
         proof || array_to_string(nodes[place - place % 3 + 1:place], '') || array_to_string(nodes[place + 2:place - place % 3 + 3], '')
  FROM high w JOIN tops n ON n.level = w.level AND len(nodes) > 1),
ends AS (SELECT doc_id, arg_max(folded, level) AS folded_root, sha256(arg_max(proof, level)) AS proof_sha256 FROM high GROUP BY doc_id)
SELECT l.doc_id, leaf, subroot, nodes[1] AS root, proof_sha256, folded_root, folded_root = nodes[1] AS verified
FROM leaves l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source JOIN ends USING (doc_id), tops WHERE len(nodes) = 1
"""


@query
def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substrings.repeated_words(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLES["op13_substring_dedup"] = """
WITH docs AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
windows AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS passage FROM docs, unnest(range(1, len(w) - 48)) AS t(i)),
firsts AS (SELECT passage, min(doc_id) AS first_doc FROM windows GROUP BY passage HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT doc_id, list(DISTINCT k) AS ks FROM (
          SELECT doc_id, unnest(range(i, i + 50)) AS k FROM windows JOIN firsts USING (passage) WHERE doc_id > first_doc) GROUP BY doc_id),
flags AS (SELECT d.doc_id, w, ks, unnest(range(1, len(w) + 1)) AS k FROM docs d JOIN hit USING (doc_id)),
kept AS (SELECT doc_id, string_agg(w[k], ' ' ORDER BY k) AS text FROM flags WHERE NOT list_contains(ks, k) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ks), 0) AS BIGINT) AS n_removed,
       sha256(CASE WHEN ks IS NULL THEN array_to_string(w, ' ') ELSE coalesce(kept.text, '') END) AS kept_sha256
FROM docs d LEFT JOIN hit USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
