"""Whitening of embeddings by a covariance weighted with multiplicities.

1. Every usable vector becomes whole numbers x = floor(scale * c) + shift. Equal x vectors are grouped
   and counted (combined within each task before the shuffle), and the distinct ones are stored.
2. The fit gives a distinct vector its count, or one, as weight. Sums are exact integers. The covariance
   adds up weighted products of centred vectors: one matrix per task, added cell by cell, so the driver
   sees dimension ** 2 numbers, whatever the input.
3. Each distinct vector is whitened once; the results are joined back to the rows by the digest of x.
   Vectors with a 2048th of all rows or more are broadcast (fewer than 2048), so copies never meet in one task.

Defined results: a row whose vector is null, empty, or holds a null, NaN or infinity is dropped; repeated rows
and ids, null ones too, are kept each for itself; entries whose x is beyond 64 bits are clamped; directions in which
the vectors do not differ (eigenvalue at most 1e-12 of the largest) have no component, so a table of equal vectors gives
no components; further columns are passed on; vectors of different lengths raise ValueError; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylag.llm.hot import join_counted
from skylag.llm.keys import col, fresh
from skylag.sources.scratch import materialize

SCALE, SHIFT = 1024, 100_000
_LIMIT = float(2**62)
#: Eigenvalues below this share of the largest are rounding.
FLAT = 1e-12


def _usable(vectors: pa.Array) -> np.ndarray:
    """Which vectors are there, not empty, and finite in every entry."""
    ok = pc.fill_null(pc.greater(pc.list_value_length(vectors), 0), False).to_numpy(zero_copy_only=False)
    entries = vectors.flatten()
    bad = pc.invert(pc.fill_null(pc.is_finite(entries), False)).to_numpy(zero_copy_only=False)
    parents = pc.list_parent_indices(vectors).to_numpy(zero_copy_only=False)
    ok = ok.copy()
    ok[parents[bad]] = False
    return ok


def whole(entries: np.ndarray, scale: int, shift: int) -> np.ndarray:
    """x of each entry."""
    return np.clip(np.floor(scale * entries), -_LIMIT, _LIMIT).astype(np.int64) + shift


def _quantised(scale: int, shift: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(batch.num_columns - 1)
            ok = _usable(vectors)
            keep = pa.array(ok)
            vectors = vectors.filter(keep)
            x = whole(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64), scale, shift)
            # x as bytes: a sorted, comparable key without an array per row
            offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(vectors).to_numpy(zero_copy_only=False))]).astype(np.int64)
            raw = pa.Array.from_buffers(
                pa.large_binary(), len(vectors), [None, pa.py_buffer(8 * offsets), pa.py_buffer(x.astype("<i8").tobytes())]
            ).cast(pa.binary())
            rest = [c.filter(keep) for c in batch.columns[:-1]]
            yield pa.RecordBatch.from_arrays([*rest, raw], [*batch.schema.names[:-1], "x"])

    return run


def _matrix(x: pa.Array, dimension: int) -> np.ndarray:
    return np.frombuffer(b"".join(x.to_pylist()), "<i8").reshape(len(x), dimension)


def _exact(x: np.ndarray, factor: int) -> np.ndarray:
    """x as 64-bit numbers, or as Python numbers where a product with `factor` could leave them."""
    return x if not len(x) or factor * (int(np.abs(x).max()) + 1) < 2**62 else x.astype(object)


def _deviations(centred: np.ndarray) -> list[int]:
    """Exact sum of squares of each row."""
    if centred.dtype == object or (len(centred) and int(np.abs(centred).max()) >= 2**52):
        return [sum(int(v) ** 2 for v in row) for row in centred]
    high, low = centred >> 26, centred & ((1 << 26) - 1)
    parts = [(high * high).astype(object), (high * low).astype(object), (low * low).astype(object)]
    a, b, c = (p.sum(axis=1) for p in parts) if centred.shape[1] > 1 << 10 else (
        (high * high).sum(axis=1), (high * low).sum(axis=1), (low * low).sum(axis=1)
    )
    return [(int(p) << 52) + (int(q) << 27) + int(r) for p, q, r in zip(a, b, c, strict=True)]


@dataclass
class Whitening:
    """A fit: `rows` vectors of sum `sums` (exact), covariance, and its eigenvectors by falling eigenvalue (columns)."""

    rows: int
    sums: list[int]
    covariance: np.ndarray
    eigenvalues: np.ndarray
    eigenvectors: np.ndarray

    @property
    def explained(self) -> np.ndarray:
        return self.eigenvalues / np.trace(self.covariance)

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """n * x - S, exact, and x - S / n."""
        exact = self.rows * _exact(x, 2 * self.rows) - np.array(self.sums, object if self._wide(x) else np.int64)
        return exact, (exact / self.rows).astype(np.float64)

    def _wide(self, x: np.ndarray) -> bool:
        return _exact(x, 2 * self.rows).dtype == object or max(map(abs, self.sums)) >= 2**62

    def project(self, centred: np.ndarray) -> np.ndarray:
        return centred @ self.eigenvectors / np.sqrt(self.eigenvalues)


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """x, n: the distinct vectors of quantised rows, and how often each occurs."""
    return materialize(rows.groupBy("x").agg(F.count(F.lit(1)).alias("n")), "distinct-vectors")


def fit(distinct: DataFrame, weights: str = "counts", components: int | None = None) -> Whitening | None:
    """Fit on distinct vectors (x, n) with their counts or ones as weights; None without vectors."""
    if weights not in ("counts", "one"):
        raise ValueError(f"unknown weights {weights!r}")
    weight = F.col("n") if weights == "counts" else F.lit(1).cast("long")
    weighted = distinct.select("x", weight.alias("w"))
    lengths = weighted.agg(F.min(F.octet_length("x")), F.max(F.octet_length("x")), F.sum("w")).first()
    if lengths[1] is None:
        return None
    if lengths[0] != lengths[1]:
        raise ValueError(f"vectors have from {lengths[0] // 8} to {lengths[1] // 8} entries")
    d, n = lengths[0] // 8, int(lengths[2])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(d, object)
        for batch in batches:
            if batch.num_rows:
                x, w = _matrix(batch.column(0), d), batch.column(1).to_numpy()
                x = _exact(x, int(w.sum()))
                total = total + (x * w[:, None]).sum(axis=0).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(map(str, total))], ["i", "s"])

    added = weighted.mapInArrow(sums, "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    total = {r["i"]: int(r["s"]) for r in added.collect()}  # one row per dimension
    model = Whitening(n, [total[i] for i in range(d)], np.zeros((d, d)), np.zeros(0), np.zeros((d, 0)))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = np.zeros((d, d))
        for batch in batches:
            if batch.num_rows:
                centred = model.centred(_matrix(batch.column(0), d))[1]
                matrix += (centred * batch.column(1).to_numpy()[:, None]).T @ centred
        i, j = np.triu_indices(d)
        yield pa.RecordBatch.from_arrays([pa.array(i * d + j), pa.array(matrix[i, j])], ["cell", "v"])

    cells = weighted.mapInArrow(products, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v"))
    covariance = np.zeros((d, d))
    for r in cells.collect():  # d * (d + 1) / 2 rows
        i, j = divmod(r["cell"], d)
        covariance[i, j] = covariance[j, i] = r["v"] / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    real = int((values > FLAT * max(values[0], 0.0)).sum()) if values[0] > 0 else 0
    real = real if components is None else min(real, components)
    vectors = vectors[:, :real]
    largest = np.abs(vectors).argmax(axis=0)
    vectors = vectors * np.where(vectors[largest, range(real)] < 0, -1.0, 1.0)  # one sign for all rows
    model.covariance, model.eigenvalues, model.eigenvectors = covariance, values[:real].copy(), np.ascontiguousarray(vectors)
    return model


def transform(distinct: DataFrame, model: Whitening) -> DataFrame:
    """digest, n, deviation, whitened: one row per distinct vector.

    The deviation is the sum of (rows * x - sums) ** 2, exact, and null beyond 38 digits.
    """
    d = len(model.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            exact, centred = model.centred(_matrix(batch.column(0), d))
            z = model.project(centred)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(z.reshape(-1)), z.shape[1]) if z.shape[1] else pa.array([[]] * len(z), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(2), batch.column(1), pa.array([str(v) for v in _deviations(exact)]), lists.cast(pa.list_(pa.float64()))],
                ["digest", "n", "deviation", "whitened"],
            )

    keyed = distinct.select("x", "n", F.unhex(F.sha2("x", 256)).alias("digest"))
    out = keyed.mapInArrow(run, "digest binary, n long, deviation string, whitened array<double>")
    return materialize(out.withColumn("deviation", F.expr("try_cast(deviation AS decimal(38,0))")), "whitened-vectors")


def identity_error(whitened: DataFrame, model: Whitening, weights: str = "counts") -> float | None:
    """Largest entry of |covariance of the whitened fit vectors - identity|."""
    k = len(model.eigenvalues)
    if not k:
        return None
    w = F.col("n") if weights == "counts" else F.lit(1)
    z = [F.col("whitened")[i] for i in range(k)]
    means = whitened.agg(*(F.sum(w * c) / model.rows for c in z)).first()
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    products = whitened.agg(*(F.sum(w * (z[i] - means[i]) * (z[j] - means[j])) / model.rows for i, j in pairs)).first()
    return max(abs(v - (i == j)) for v, (i, j) in zip(products, pairs, strict=True))


def whiten(
    vectors: DataFrame, components: int = 8, weights: str = "counts", column: str = "embedding", scale: int = SCALE, shift: int = SHIFT
) -> tuple[DataFrame, Whitening | None, float | None]:
    """Rows of `vectors` with `deviation` and `whitened` (an array); the fit; and its identity error.

    New columns whose names are taken get leading underscores.
    """
    names = [c for c in vectors.columns if c != column]
    new = fresh(vectors, "deviation", "whitened")
    inner = [f"c{i}" for i in range(len(names))]
    source = vectors.select(*(col(c).alias(i) for c, i in zip(names, inner, strict=True)), col(column).cast("array<double>").alias("v"))
    types = [f"{i} {vectors.schema[c].dataType.simpleString()}" for c, i in zip(names, inner, strict=True)]
    slim = source.select("v").mapInArrow(_quantised(scale, shift), "x binary")
    distinct = distinct_vectors(slim)
    model = fit(distinct, weights, components)
    kept = [F.col(i).alias(c) for c, i in zip(names, inner, strict=True)]
    if model is None:
        none = [F.lit(None).cast(t).alias(c) for c, t in zip(new, ("decimal(38,0)", "array<double>"), strict=True)]
        return source.where(F.lit(False)).select(*kept, *none), None, None
    whitened = transform(distinct, model)
    rows = source.mapInArrow(_quantised(scale, shift), ", ".join([*types, "x binary"]))
    rows = rows.withColumn("digest", F.unhex(F.sha2("x", 256))).drop("x")
    total = whitened.agg(F.sum("n")).first()[0]
    joined = join_counted(rows, whitened, ["digest"], "n", total)
    out = joined.select(*kept, F.col("deviation").alias(new[0]), F.col("whitened").alias(new[1]))
    return out, model, identity_error(whitened, model, weights)


def by_component(rows: DataFrame, model: Whitening | None, error: float | None) -> DataFrame:
    """One row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    `deviation` is null where it is beyond 64 bits.
    """
    share = [] if model is None else [float(v) for v in model.explained]
    shares = F.array(*map(F.lit, share)) if share else F.array().cast("array<double>")
    each = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(None if model is None else model.rows).cast("long").alias("n"),
        F.expr("try_cast(deviation AS bigint)").alias("deviation"),
        "whitened",
        F.get(shares, F.col("at")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
