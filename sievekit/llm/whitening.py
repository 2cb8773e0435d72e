"""Whitening of embeddings: principal directions of whole-numbered vectors, scaled to unit variance.

Covariance is one aggregation over generated SQL: a sum of centred products for each pair of dimensions, the upper triangle alone.  Vectors are centred at the
whole numbers nearest their means, so products and sums are whole numbers and the same in any order (below 2**53); what is left of the mean, under one half, is taken off
the assembled matrix.  LAPACK decomposes the matrix, whose size is the dimensions', on the driver; rows are projected where they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievekit.llm.common import forget, save, small_batches
from sievekit.llm.vectors import matrix, usable

#: Sums of one aggregation; a larger triangle (from 91 dimensions on) takes several.
EXPRESSIONS = 4096


@dataclass(frozen=True)
class Fit:
    """What whitens vectors of one number of dimensions."""

    n: int
    sums: np.ndarray  # of each dimension, whole
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # a unit eigenvector a column
    trace: float

    def scale(self, components: int) -> np.ndarray:
        """1 / sqrt(eigenvalue); none (nan) for directions without variance, to double precision."""
        e = self.values[:components]
        least = len(self.values) * np.finfo(float).eps * max(self.values[0], 0.0)
        return np.where(e > least, 1 / np.sqrt(np.where(e > least, e, 1)), np.nan)

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """n * x - S, exact, and the sum of its squares over the dimensions."""
        if float(np.abs(x).max(initial=0)) * self.n >= 2.0**62:
            raise OverflowError("components too large for exact deviations")
        d = self.n * x - self.sums
        if (np.square(d.astype(np.float64)).sum(axis=1) >= 2.0**62).any():
            raise OverflowError("a deviation is over 64 bits")
        return d, (d * d).sum(axis=1)

    def whiten(self, x: np.ndarray, components: int) -> np.ndarray:
        d, _ = self.centred(x)
        return (d / self.n) @ self.vectors[:, :components] * self.scale(components)


def whole_numbers(vector: Column, scale: int = 64, shift: int = 1_000_000) -> Column:
    """floor(scale * c) + shift of each component, as long."""
    return F.transform(vector, lambda c: F.floor(F.lit(scale) * c.cast("double")).cast("long") + F.lit(shift).cast("long"))


def triangle(rows: DataFrame, column: str, dimensions: int, group: str) -> dict[int, np.ndarray]:
    """Per group the matrix of sum(column[i] * column[j]); entries beyond a shorter array are null, which counts as 0."""
    pairs = [(i, j) for i in range(dimensions) for j in range(i, dimensions)]
    out: dict[int, np.ndarray] = {}
    for lo in range(0, len(pairs), EXPRESSIONS):
        some = pairs[lo : lo + EXPRESSIONS]
        sums = [F.expr(f"sum(get({column}, {i}) * get({column}, {j})) AS p{i}_{j}") for i, j in some]
        for row in rows.groupBy(group).agg(*sums).collect():  # a row for each number of dimensions
            m = out.setdefault(row[0], np.zeros((dimensions, dimensions)))
            for (i, j), value in zip(some, row[1:]):
                m[i, j] = m[j, i] = value or 0.0
    return out


def fit(distinct: DataFrame) -> dict[int, Fit]:
    """A fit for each number of dimensions d among rows (d, x array<long>), each of which counts once."""
    most = distinct.agg(F.max("d")).first()[0] or 0
    if not most:
        return {}
    sums = distinct.groupBy("d").agg(F.count("*").alias("n"), *(F.expr(f"sum(get(x, {i})) AS s{i}") for i in range(most))).collect()
    totals = {r["d"]: (r["n"], np.array([r[f"s{i}"] for i in range(r["d"])], object)) for r in sums}
    near = {d: [int((2 * s + n) // (2 * n)) for s in total] for d, (n, total) in totals.items()}
    centre = F.element_at(F.create_map(*(x for d, c in near.items() for x in (F.lit(d), F.array(*map(F.lit, c)).cast("array<long>")))), F.col("d"))
    centred = distinct.select("d", F.zip_with("x", centre, lambda a, b: (a - b).cast("double")).alias("c"))
    out = {}
    for d, products in triangle(centred, "c", most, "d").items():
        n, total = totals[d]
        rest = np.array([float(s - n * c) / n for s, c in zip(total, near[d])])
        covariance = products[:d, :d] / n - np.outer(rest, rest)
        values, vectors = np.linalg.eigh(covariance)
        order = np.argsort(-values, kind="stable")
        out[d] = Fit(n, np.array(total.tolist(), np.int64), values[order], vectors[:, order], float(np.trace(covariance)))
    return out


def _by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    for d in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == d)
        yield d, at, column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), d)


def identity_errors(distinct: DataFrame, fits: dict[int, Fit], components: int) -> dict[int, float]:
    """Per number of dimensions the largest entry of the whitened vectors' covariance minus the identity, measured over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, at, x in _by_length(batch.column(1)):
                w = np.nan_to_num(fits[d].whiten(x, components))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), d), pa.int32()), pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel()))], names=["d", "w"])

    out = {}
    for d, products in triangle(distinct.select("d", "x").mapInArrow(run, "d int, w array<double>"), "w", components, "d").items():
        kept = np.flatnonzero(~np.isnan(fits[d].scale(components)))
        if len(kept):
            out[d] = float(np.abs(products[np.ix_(kept, kept)] / fits[d].n - np.eye(len(kept))).max())
    return out


def whiten(rows: DataFrame, components: int = 16, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each usable vector and component, `components` at most.

    Vectors that are null, empty, or hold null or non-finite entries are left out; null ids and repeated rows are kept, and equal vectors count once in the fit.
    Vectors of different lengths are whitened apart, each among its own.  A direction without variance has no whitened value (null); equal eigenvalues come in any
    order.  Other columns are ignored; an empty table gives an empty one.  A component so large that a deviation passes 64 bits stops the job.
    """
    small_batches(rows.sparkSession)
    good = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).filter(usable(F.col("v"))).select("vec_id", whole_numbers(F.col("v"), scale, shift).alias("x"))
    distinct = save(good.select("x").distinct().withColumn("d", F.size("x")), "distinct-vectors")
    fits = fit(distinct)
    errors = identity_errors(distinct, fits, components)
    forget(distinct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, at, x in _by_length(batch.column(1)):
                own, k = fits[d], min(components, d)
                w = own.whiten(x, k).ravel()
                explained = own.values[:k] / own.trace if own.trace > 0 else np.full(k, np.nan)
                m = len(at)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(np.repeat(at, k))), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, own.n), pa.int64()), pa.array(np.repeat(own.centred(x)[1], k), pa.int64()),
                        pa.array(w, mask=np.isnan(w)), pa.array(np.tile(explained, m), mask=np.isnan(np.tile(explained, m))), pa.array([errors.get(d)] * (m * k), pa.float64()),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return good.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
