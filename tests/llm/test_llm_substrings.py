"""Repeated passages against a dictionary of all windows."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_tables import CLASHING, awkward, empty, plain
from pyspark.sql import functions as F

from skylag.llm import substrings

LEAST = substrings.LEAST


def brute(rows: list[tuple[int | None, str | None]], width: int) -> list[tuple[int | None, int, int, str]]:
    listed = [(LEAST if d is None else d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    first: dict[tuple, int] = {}
    for d, words in listed:
        for i in range(len(words) - width + 1):
            window = tuple(words[i : i + width])
            first[window] = min(d, first.get(window, d))
    out = []
    for (given_id, _), (d, words) in zip(rows, listed, strict=True):
        gone = set()
        for i in range(len(words) - width + 1):
            if first[tuple(words[i : i + width])] < d:
                gone |= set(range(i, i + width))
        out.append((given_id, len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return sorted(out, key=str)


def made(seed: int, docs: int, letters: str) -> list[tuple[int, str]]:
    """Documents that share passages, copies, and runs of one word."""
    g = random.Random(seed)
    passages = [[g.choice(letters) for _ in range(g.randrange(3, 40))] for _ in range(6)]
    rows = []
    for i in range(docs):
        words: list[str] = []
        for _ in range(g.randrange(0, 5)):
            words += g.choice([g.choice(passages), [g.choice(letters) for _ in range(g.randrange(30))], [g.choice(letters)] * g.randrange(25)])
        rows.append((g.randrange(docs), g.choice([" ", "\n", "\t "]).join(words)))
    rows += [g.choice(rows) for _ in range(docs // 10)]
    rows += [(g.randrange(docs), g.choice(rows)[1]) for _ in range(docs // 10)]
    return rows


@pytest.mark.parametrize(("letters", "width", "size", "group"), [("ab", 8, 3, 4), ("abcdefgh", 8, 3, 32768), ("abcdefgh", 6, 5, 3), ("aA", 10, 1, 7)])
def test_equals_all_windows(spark, letters, width, size, group):
    rows = made(width + 10 * size, 120, letters) + [(None, "a b a b a b a b a b a b a b"), (None, None), (3, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = substrings.repeated_words(frame, width=width, size=size, group=group, batch_rows=50).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, width)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), min_size=0, max_size=40), min_size=1, max_size=6))
def test_equal_windows_share_their_anchor(docs):
    from skylag.llm import hashing

    width, size = 9, 4
    words = [w for d in docs for w in d]
    row = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    h = hashing.mix(np.array([ord(w) for w in words], np.uint64))
    gram, at, start, count = substrings.anchors(h, row, width, size)
    seen: dict[tuple, set] = {}
    covered = []
    for g, a, s, n in zip(gram, at, start, count, strict=True):
        for i in range(s, s + n):
            covered.append(i)
            assert i <= a <= i + width - size and row[i] == row[i + width - 1]
            seen.setdefault(tuple(words[i : i + width]), set()).add((int(g), int(a - i)))
    assert covered == [i for i in range(len(words) - width + 1) if row[i] == row[i + width - 1]]
    assert all(len(v) == 1 for v in seen.values())


def test_awkward_and_empty_tables(spark):
    docs = awkward(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = substrings.repeated_words(docs).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 50)
    out = substrings.remove_repeats(docs)
    assert out.columns == docs.columns and set(CLASHING) <= set(out.columns) and out.count() == docs.count()
    kept = {(r["doc_id"], r["kept"]) for r in got if r["n_removed"]}
    assert kept <= {(r["doc_id"], r["text"]) for r in out.collect()}
    assert substrings.repeated_words(empty(spark)).count() == 0 and substrings.remove_repeats(empty(spark)).count() == 0


def test_one_passage_in_most_documents(spark):
    """A passage that overfills its groups, and a long text of one word."""
    passage = " ".join(f"p{i}" for i in range(70))
    texts = [f"start{i} {passage} end{i}" for i in range(300)] + ["the " * 20_000, "the " * 300 + "x"]
    got = {r["doc_id"]: r for r in substrings.repeated_words(plain(spark, texts), group=50).collect()}
    assert got[0]["n_removed"] == 0 and all(got[i]["n_removed"] == 70 and got[i]["kept"] == f"start{i} end{i}" for i in range(1, 300))
    assert got[300]["n_removed"] == 0 and got[301]["n_removed"] == 300 and got[301]["kept"] == "x"


def test_columns_pass_on_and_texts_change(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, passage, [1, 2]), (2, f"a {passage}  b", None), (3, "  as  it was ", [])], "doc_id long, text string, `my.dot` array<int>")
    out = {r["doc_id"]: r for r in substrings.remove_repeats(docs.withColumn("_key", F.lit(1))).collect()}
    assert out[1]["text"] == passage and out[2]["text"] == "a b" and out[3]["text"] == "  as  it was "
    assert out[1]["my.dot"] == [1, 2]
