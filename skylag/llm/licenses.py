"""Licences of files: notices found by TF-IDF cosine, then inherited from the nearest directory above.

1. Each template is a sparse TF-IDF vector over the tokens of all templates; document frequencies of
   those tokens are counted over all files.
2. Wherever a token stands without which no window can reach THRESHOLD (the template's rare tokens),
   windows of the template's length around it are compared with the template.
   Whole licence texts and the headers that go with them (TEXTS, in `licence_texts`) are compared by vectors
   of the whole text: runs of WIDTH tokens tell where a file holds at least half of a text, and the densest
   window of the text's length there is compared. A text that is found goes before any notice within it, and of
   several texts the one of which most stands in the file, weighed by its cosine.
3. A file of which at least FILE_SHARE is notices and texts is a licence file; its directory gets its licence.
4. A file without a notice takes the licence of the nearest directory at or above its own: distinct
   directories are expanded to their ancestors and joined by path, then files join directories.

Defined results: a null text has no notice; a null path lies in the top directory; of equal scores
the first template counts; of several licence files of a directory the highest
score, then the smallest id; without any licence above, the result is `none`; repeated rows are
judged alike; given templates are used without the texts unless texts are given, too; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from importlib import resources

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylag.llm.keys import col
from skylag.sources.scratch import materialize

# Names and notices of public licences.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted"
    " provided that the following conditions are met",
}
#: Whole texts (`NAME.txt`) and headers of source files (`NAME.header.txt`), without lines of copyright.
TEXTS = {
    f.name.removesuffix(".txt"): f.read_text(encoding="utf-8")
    for f in sorted(resources.files(__package__).joinpath("licence_texts").iterdir(), key=lambda f: f.name)
}
#: Tokens of the runs that tell where a text stands.
WIDTH = 5
THRESHOLD = 0.8
FILE_SHARE = 0.3
_TOKEN = re.compile(r"[a-z]+|[0-9]+(?:\.[0-9]+)*")


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def _runs(listed: list[str]) -> Iterator[tuple[str, ...]]:
    return zip(*(listed[k:] for k in range(WIDTH)), strict=False)


def document_frequencies(files: DataFrame, vocabulary: set[str]) -> tuple[int, dict[str, int]]:
    """Files, and files that hold each token of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = Counter(), 0
        for batch in batches:
            n += batch.num_rows
            for text in batch.column(0):
                found.update(vocabulary.intersection(tokens(text.as_py() or "")))
        found[""] = n
        yield pa.RecordBatch.from_arrays([pa.array(list(found)), pa.array(list(found.values()), pa.int64())], ["token", "n"])

    sums = files.select(col("text")).mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    counts = {r["token"]: r["n"] for r in sums}  # as many rows as the templates have tokens
    return counts.pop("", 0), counts


class Matcher:
    """Templates and whole texts as weighted vectors."""

    def __init__(
        self, templates: dict[str, str], n: int, counts: dict[str, int], threshold: float = THRESHOLD, texts: dict[str, str] | None = None
    ):
        self.threshold = threshold
        self.parts = {name: tokens(text) for name, text in templates.items()}
        vocabulary = {t for part in self.parts.values() for t in part}
        self.idf = {t: math.log((1 + n) / (1 + counts.get(t, 0))) + 0.1 for t in vocabulary}
        self.vectors = {name: self._unit(Counter(part)) for name, part in self.parts.items()}
        self.anchors: dict[str, list[str]] = {}
        for name, vector in self.vectors.items():
            # Without any of the heavy tokens the cosine is at most the norm of the light ones.
            light = 0.0
            for token, weight in sorted(vector.items(), key=lambda x: (x[1], x[0])):
                light += weight * weight
                if math.sqrt(light) >= threshold:
                    self.anchors.setdefault(token, []).append(name)
        self.gate = set(self.anchors)
        whole = {name: tokens(text) for name, text in (texts or {}).items()}
        self.sizes = {name: len(part) for name, part in whole.items()}
        self.text_idf = {t: math.log((1 + n) / (1 + counts.get(t, 0))) + 0.1 for part in whole.values() for t in part}
        self.text_vectors = {name: self._unit(Counter(part), self.text_idf) for name, part in whole.items()}
        self.runs: dict[tuple[str, ...], list[str]] = {}
        self.least: dict[str, int] = {}
        for name, part in whole.items():
            own = set(_runs(part))
            for run in own:
                self.runs.setdefault(run, []).append(name)
            self.least[name] = max(1, len(own) // 2)
            # Without any of the rarest tokens a file holds less than half of the runs.
            for token in sorted(set(part), key=lambda t: (-self.text_idf[t], t)):
                if len(own) < self.least[name]:
                    break
                self.gate.add(token)
                own = {run for run in own if token not in run}

    def _unit(self, counted: Counter, idf: dict[str, float] | None = None) -> dict[str, float]:
        idf = self.idf if idf is None else idf
        weights = {t: k * idf[t] for t, k in counted.items() if t in idf}
        norm = math.sqrt(sum(w * w for w in weights.values())) or 1.0
        return {t: w / norm for t, w in weights.items()}

    def whole(self, listed: list[str]) -> tuple[str | None, float, set[int]]:
        """The whole text that stands in a file, its score, and the places of the tokens of all that do."""
        places: dict[str, list[int]] = {}
        for at, run in enumerate(_runs(listed)):
            for name in self.runs.get(run, ()):
                places.setdefault(name, []).append(at)
        found, score, most, covered = None, 0.0, 0.0, set()
        for name, hits in places.items():
            size = self.sizes[name]
            # A text may stand there more than once: the densest window first, then what is left beside it.
            parts = [hits]
            while parts:
                hits = parts.pop()
                first = last = dense = 0
                for i in range(len(hits)):
                    while hits[i] - hits[first] > size - WIDTH:
                        first += 1
                    if i + 1 - first > dense:
                        dense, last = i + 1 - first, i
                if dense < self.least[name]:
                    continue
                start, end = hits[last - dense + 1], hits[last] + WIDTH
                window = self._unit(Counter(listed[start:end]), self.text_idf)
                cosine = round(sum(w * self.text_vectors[name].get(t, 0.0) for t, w in window.items()), 6)
                if cosine >= self.threshold:
                    covered.update(range(start, end))
                    if (cosine * dense, cosine) > (most, score):
                        found, score, most = name.removesuffix(".header"), cosine, cosine * dense
                parts += [hits[: last - dense + 1], hits[last + 1 :]]
        return found, score, covered

    def best(self, text: str) -> tuple[str | None, float, float]:
        """Licence, score, and the share of the file's tokens that notices and whole texts take up."""
        listed = tokens(text)
        if self.gate.isdisjoint(listed):
            return None, 0.0, 0.0
        whole, whole_score, covered = self.whole(listed)
        found, score = None, 0.0
        for name, part in self.parts.items():
            size, tried = len(part), set()
            for at, token in enumerate(listed):
                if name not in self.anchors.get(token, ()):
                    continue
                for start in range(max(0, at - size + 1), max(0, min(at, len(listed) - size)) + 1):
                    if start in tried:
                        continue
                    tried.add(start)
                    window = self._unit(Counter(listed[start : start + size]))
                    cosine = round(sum(w * self.vectors[name].get(t, 0.0) for t, w in window.items()), 6)
                    if cosine >= self.threshold:
                        covered.update(range(start, min(start + size, len(listed))))
                        if cosine > score:
                            found, score = name, cosine
        if whole is not None:
            found, score = whole, whole_score
        return found, score, len(covered) / len(listed)


def notices(
    files: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, texts: dict[str, str] | None = None
) -> DataFrame:
    """doc_id, path, folder, licence, score, share of every file. `files`: doc_id, path, text."""
    if texts is None:
        texts = TEXTS if templates is None else {}
    templates = TEMPLATES if templates is None else templates
    vocabulary = {t for text in [*templates.values(), *texts.values()] for t in tokens(text)}
    matcher = Matcher(templates, *document_frequencies(files, vocabulary), threshold, texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            judged = [matcher.best(text.as_py() or "") for text in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([j[0] for j in judged], pa.string()),
                    pa.array([j[1] for j in judged], pa.float64()),
                    pa.array([j[2] for j in judged], pa.float64()),
                ],
                ["doc_id", "path", "licence", "score", "share"],
            )

    slim = files.select(col("doc_id").cast("long").alias("doc_id"), F.coalesce(col("path"), F.lit("")).alias("path"), col("text").alias("text"))
    found = slim.mapInArrow(run, "doc_id long, path string, licence string, score double, share double")
    return found.withColumn("folder", F.regexp_replace("path", "/?[^/]*$", ""))


def _ancestors(folders: DataFrame) -> DataFrame:
    """Each folder with itself and all above it, the top one being empty."""
    parts = F.split("folder", "/")
    depth = F.when(F.col("folder") == "", 0).otherwise(F.size(parts))
    return folders.select("folder", F.posexplode(F.transform(F.sequence(F.lit(0), depth), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("depth", "above"))


def scan(
    files: DataFrame,
    templates: dict[str, str] | None = None,
    threshold: float = THRESHOLD,
    file_share: float = FILE_SHARE,
    texts: dict[str, str] | None = None,
) -> DataFrame:
    """One row per file: licence, score, how it was found (`own`, `inherited`, `none`), and the folder it comes from."""
    found = materialize(notices(files, templates, threshold, texts), "notices")
    first = F.min(F.struct((-F.col("score")).alias("rank"), "doc_id", "licence", "score"))
    given = found.where(F.col("licence").isNotNull() & (F.col("share") >= file_share)).groupBy("folder").agg(first.alias("best"))
    given = materialize(given.select(F.col("folder").alias("above"), "best.licence", "best.score"), "folder-licences")
    bare = found.where(F.col("licence").isNull()).select("folder").distinct()
    near = _ancestors(bare).join(given, "above").groupBy("folder").agg(F.max(F.struct("depth", "above", "licence", "score")).alias("near"))
    near = near.select("folder", "near.above", F.col("near.licence").alias("inherited"), F.col("near.score").alias("inherited_score"))
    own = F.col("licence").isNotNull()
    joined = found.join(near, "folder", "left")
    return joined.select(
        "doc_id",
        "path",
        F.when(own, F.col("licence")).otherwise(F.col("inherited")).alias("licence"),
        F.when(own, F.col("score")).otherwise(F.col("inherited_score")).alias("score"),
        F.when(own, "own").when(F.col("inherited").isNotNull(), "inherited").otherwise("none").alias("how"),
        F.when(own, F.col("folder")).otherwise(F.col("above")).alias("licensed_by"),
    )
