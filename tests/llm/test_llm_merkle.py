"""Merkle manifests against a recursive tree in plain Python."""

from __future__ import annotations

import hashlib
import random

import pytest
from llm_tables import CLASHING
from pyspark.sql import functions as F

from skylag.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row: tuple) -> str:
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree_of(leaves: list[str], fanout: int = 3) -> tuple[str, list[list[str]]]:
    """Root, and the siblings of each leaf."""
    proofs: list[list[str]] = [[] for _ in leaves]
    under = [[i] for i in range(len(leaves))]
    while len(leaves) > 1:
        above, below = [], []
        for at in range(0, len(leaves), fanout):
            run = leaves[at : at + fanout]
            for j in range(len(run)):
                for i in under[at + j]:
                    proofs[i] += run[:j] + run[j + 1 :]
            above.append(digest(*run))
            below.append([i for j in range(len(run)) for i in under[at + j]])
        leaves, under = above, below
    return leaves[0], proofs


def whole(rows: list[tuple]) -> dict[tuple, list[tuple]]:
    """(doc_id, leaf) to subroot, root and proof of every row."""
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    subs, seen = [], []
    for s in sources:
        own = sorted((r[0] is not None, r[0] or 0, leaf_of(r)) for r in rows if r[1] == s)
        subs.append(tree_of([o[2] for o in own]))
        seen.append(own)
    root, high = tree_of([s[0] for s in subs])
    out: dict[tuple, list[tuple]] = {}
    for (subroot, proofs), own, top in zip(subs, seen, high, strict=True):
        for (known, doc_id, leaf), proof in zip(own, proofs, strict=True):
            out.setdefault((doc_id if known else None, leaf), []).append((subroot, root, tuple(proof + top)))
    return out


def rows_of(sizes: list[int], seed: int = 3) -> list[tuple]:
    generator = random.Random(seed)
    out = []
    for s, n in enumerate(sizes):
        name = None if s == 0 else ["a", "é", "Z", "=", "-", ""][s % 6] + str(s)
        for i in range(n):
            out.append((generator.randrange(10**6), name, [None, "en"][i % 2], i, [None, "", "a\nb", "plain"][i % 4]))
    generator.shuffle(out)
    return out


@pytest.mark.parametrize(("sizes", "depth"), [([5, 1, 2, 3, 4, 9, 10], 1), ([2, 28, 100, 1, 27, 82], 1), ([40, 9, 10, 19], 2), ([0, 30], 7), ([0, 1], 1)])
def test_manifest_equals_recursive_trees(spark, sizes, depth):
    rows = rows_of(sizes)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got: dict[tuple, list[tuple]] = {}
    for r in merkle.manifest(frame, depth=depth).collect():
        got.setdefault((r["at"], r["leaf"]), []).append((r["subroot"], r["root"], tuple(r["proof"])))
        assert r["verified"] and r["folded_root"] == r["root"]
    want = whole(rows)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_changed_rows_are_found(spark):
    rows = rows_of([7, 50, 3])
    frame = spark.createDataFrame(rows, SCHEMA)
    seen = merkle.leaf_hash(*map(F.col, ("doc_id", "source", "lang", "n_chars")), F.translate("text", "\n", ""))
    for r in merkle.manifest(frame, observed=seen, depth=2).collect():
        row = next(x for x in rows if x[0] == r["at"])
        changed = row[4] is not None and "\n" in row[4]
        assert r["verified"] is not changed
        places = merkle.run_sizes(r["place"], r["leaves"]) + merkle.run_sizes(r["tree_place"], r["trees"])
        assert merkle.fold(r["leaf"], places, r["proof"]) == r["root"]
        assert merkle.fold(leaf_of((*row[:4], row[4].replace("\n", "") if row[4] else row[4])), places, r["proof"]) == r["folded_root"]


def test_nulls_ties_repeats_and_clashing_names(spark):
    rows = [(None, None, None, None, None)] * 4 + [(1, "s", "x", 1, "t")] * 5 + [(1, "s", "x", 1, "u"), (None, "s", None, 0, "")]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(0) for c in (*CLASHING, "tree", "place", "block", "leaf", "at")})
    got = merkle.manifest(frame, depth=1).collect()
    want = whole(rows)
    assert len(got) == len(rows) and all((r["subroot"], r["root"], tuple(r["proof"])) in want[r["at"], r["leaf"]] for r in got)
    assert merkle.manifest(frame.limit(0)).count() == 0


def test_leaves_that_were_not_changed_are_folded_too(spark):
    leaves = spark.createDataFrame([("t", i, digest(str(i))) for i in range(40)], "tree string, at long, leaf string")
    rows, blocks = merkle.trees(leaves, depth=1)
    wrong = blocks.withColumn("proof", F.transform("proof", lambda _: F.lit("0" * 64)))
    for proofs, right in ((blocks, True), (wrong, False)):
        got = merkle._completed(rows.withColumn("observed", F.lit(None).cast("string")), proofs, 3, 1).collect()
        assert len(got) == 40 and all((r["folded_root"] == r["root"]) is right for r in got)
