"""Whitening against numpy over all rows."""

from __future__ import annotations

import math

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from skylag.llm import whitening
from skylag.llm.queries import QUERIES, table

SCHEMA = "vec_id long, embedding array<float>"


def brute(vectors: list[list[float] | None], weights: str = "counts", components: int = 8):
    """x, n, S, deviation, whitened and explained, vector by vector."""
    usable = [v for v in vectors if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in usable]
    fit = x if weights == "counts" else [list(v) for v in {tuple(v) for v in x}]
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in x]
    centred = np.array([[(n * c - s) / n for c, s in zip(v, sums, strict=True)] for v in x])
    base = np.array([[(n * c - s) / n for c, s in zip(v, sums, strict=True)] for v in fit])
    values, vecs = np.linalg.eigh(base.T @ base / n)
    order = np.argsort(values)[::-1][:components]
    return n, deviation, centred @ vecs[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def test_query_equals_numpy(spark):
    rows = {}
    for r in QUERIES["op11_embedding_whitening"](spark, SF).collect():
        rows[r["vec_id"], r["component"]] = r
    given = table(spark, SF, "embeddings").collect()
    n, deviation, z, explained = brute([r["embedding"] for r in given])
    assert len(rows) == 8 * len(given) and n == len(given)
    got = np.array([[rows[r["vec_id"], c + 1]["whitened"] for c in range(8)] for r in given])
    signs = np.sign((got * z).sum(axis=0))
    assert np.abs(got - signs * z).max() < 1e-8
    for r, dev in zip(given, deviation, strict=True):
        for c in range(8):
            row = rows[r["vec_id"], c + 1]
            assert row["n"] == n and row["deviation"] == dev
            assert abs(row["explained"] / explained[c] - 1) < 1e-9 and row["identity_error"] < 1e-9


def mixed(spark):
    generator = np.random.default_rng(7)
    rows = [(i, [float(c) for c in generator.normal(size=4)]) for i in range(200)]
    rows += [(1000 + i, rows[3][1]) for i in range(100)]  # a third is one vector
    rows += [(5, rows[5][1]), (None, rows[6][1]), (7, None), (8, []), (9, [1.0, None, 2.0, 3.0])]
    rows += [(10, [1.0, math.nan, 2.0, 3.0]), (11, [1.0, math.inf, 2.0, 3.0])]
    return rows, spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("weights", ["counts", "one"])
def test_copies_nulls_and_weights(spark, weights):
    rows, frame = mixed(spark)
    clashing = {c: F.lit(1) for c in ("n", "x", "digest", "whitened", "deviation", "_often", "my.dot", "v", "c0")}
    out, model, error = whitening.whiten(frame.withColumns(clashing), components=3, weights=weights)
    got = out.collect()
    assert set(clashing) | {"vec_id", "_whitened", "_deviation"} == set(out.columns)
    n, deviation, z, explained = brute([v for _, v in rows], weights, 3)
    assert len(got) == 302 and model.rows == n and error < 1e-9
    assert np.allclose(model.explained, explained, rtol=1e-9)
    assert sorted(int(r["_deviation"]) for r in got) == sorted(deviation)
    ours = np.array(sorted(tuple(np.round(np.abs(r["_whitened"]), 7)) for r in got))
    assert np.allclose(ours, np.array(sorted(tuple(np.round(np.abs(v), 7)) for v in z)), atol=1e-6)


def test_flat_empty_huge_and_ragged_tables(spark):
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], SCHEMA)
    out, model, error = whitening.whiten(same)
    assert [r["whitened"] for r in out.collect()] == [[], []] and error is None
    assert whitening.by_component(out, model, error).count() == 0
    out, model, error = whitening.whiten(same.limit(0))
    assert model is None and out.count() == 0 and whitening.by_component(out, model, error).count() == 0
    huge = spark.createDataFrame([(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [3e38, 2.0])], SCHEMA)
    out, model, _ = whitening.whiten(huge, scale=1)
    assert out.count() == 3 and all(int(r["deviation"] is None or r["deviation"] >= 0) for r in out.collect())
    with pytest.raises(ValueError, match="entries"):
        whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], SCHEMA))


def test_deviations_are_exact():
    x = np.array([[2**51 + 3, -(2**51) - 5, 17], [1, 2, 3]], np.int64)
    assert whitening._deviations(x) == [sum(int(v) ** 2 for v in row) for row in x]
    big = np.array([[2**60, -(2**61)]], np.int64)
    assert whitening._deviations(big) == [2**120 + 2**122]
