"""Whitening of embeddings by an eigendecomposition that grows row by row.

* Components ``c`` become whole numbers ``x = floor(256 * c)``. The fit list holds each distinct vector once.
* Every task keeps the spectrum of its rows by centred rank-one changes (:mod:`weft.llm.spectrum`): secular equations
  with deflation, never a decomposition of a matrix. Blocks of more rows than dimensions are reduced to their triangular
  factor first, so that a block costs as many changes as there are dimensions; ``block=1`` changes the spectrum by every row.
* Spectra are merged by successive rank-one changes, at most ``FAN`` of them in one task, level by level.
* The leading vectors are refined by Rayleigh-Ritz: one pass multiplies the covariance of the whole fit list, centred by its
  exact mean, with the basis, and the projected matrix turns the basis. Where a residual is
  above rounding error, the residuals join the basis and the pass is repeated.

Sums and counts are exact integers. What one task or the driver holds is bounded by the square of the dimension.

Defined results: rows take no part where the vector is null, empty or holds a null or non-finite entry, or one whose ``x`` is beyond
2**53, or where its length is not the most frequent one (of equally frequent ones the largest). Rows that repeat a vector or an id are
rows of the result and count once in the fit list. Null ids stay. Components whose eigenvalue is rounding error have no direction
and give no rows; so one distinct vector, or an empty table, gives none. A deviation beyond a long is null. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.spectrum import BLOCK, Spectrum
from weft.session import materialize

SCALE = 256
COMPONENTS = 4
#: Partial results that one task merges.
FAN = 32
#: Rayleigh-Ritz starts with so many vectors for each one asked for.
SPARE = 4
#: A residual or an eigenvalue below this share of the largest eigenvalue is rounding error.
ROUNDING = 1e-13

RESULT = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
)
_LONGEST = 2**63 - 1


def quantised(embeddings: DataFrame, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, x) of the rows that take part; see the module for which do."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    fits = F.forall("v", lambda c: F.coalesce(F.abs(F.floor(c * scale).cast("double")) <= 2.0**53, F.lit(False)) & ~F.isnan(c))
    rows = rows.filter(F.col("v").isNotNull() & (F.size("v") > 0) & fits)
    rows = rows.select("vec_id", F.transform("v", lambda c: F.floor(c * scale)).alias("x"))
    common = rows.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    return rows.filter(F.size("x") == (common["width"] if common else 0))


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches with their vectors as rows of long integers."""
    for batch in batches:
        if batch.num_rows:
            lists = batch.column("x")
            yield batch, lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(batch.num_rows, -1)


def _gathered(rows: DataFrame, start: Callable, merge: Callable) -> list | None:
    """One list of float arrays over all of ``rows``: ``start(matrices)`` makes one in every task, ``merge(lists)`` joins up to ``FAN``.

    Merging goes level by level, in tasks; the driver gets the last one. None where there are no rows.
    """
    shape = "part long, arrays array<array<double>>"

    def first(batches):
        if (got := start(x for _, x in _matrices(batches))) is not None:
            arrays = pa.array([[a.ravel() for a in got]], pa.list_(pa.list_(pa.float64())))
            yield pa.record_batch({"part": pa.array([TaskContext.get().partitionId()], pa.int64()), "arrays": arrays})

    def join(key, found: pd.DataFrame) -> pd.DataFrame:
        ordered = found.sort_values("part")["arrays"]
        merged = merge([[np.array(a) for a in arrays] for arrays in ordered])
        return pd.DataFrame({"part": [key[0]], "arrays": [[a.ravel() for a in merged]]})

    partial = materialize(rows.select("x").mapInArrow(first, shape), "partial-matrices")
    last = partial.agg(F.max("part")).first()[0]
    while last:
        level = partial.groupBy(F.floor(F.col("part") / FAN).alias("part")).applyInPandas(join, shape)
        partial = materialize(level, "merged-matrices")
        last //= FAN
    got = partial.first()
    return got and [np.array(a) for a in got["arrays"]]


def _spectrum(fit: DataFrame, block: int) -> Spectrum | None:
    """The spectrum of the whole fit list."""

    def start(matrices):
        found = None
        for x in matrices:
            found = found or Spectrum.empty(x.shape[1])
            found.add(x.astype(float), block)
        return found and pack(found)

    def pack(s: Spectrum) -> list[np.ndarray]:
        return [np.array([s.n], float), s.mean, s.values, s.vectors]

    def unpack(arrays) -> Spectrum:
        n, mean, values, vectors = arrays
        return Spectrum(int(n[0]), mean, values, vectors.reshape(len(mean), -1))

    def merge(lists):
        found = unpack(lists[0])
        for arrays in lists[1:]:
            found.merge(unpack(arrays))
        return pack(found)

    got = _gathered(fit, start, merge)
    return got and unpack(got)


def _sums(fit: DataFrame, of: Callable[[np.ndarray], list[np.ndarray]]) -> list[np.ndarray]:
    """Sums over the fit list of the arrays that ``of`` makes of a matrix of its rows."""

    def add(lists):
        return [sum(arrays[1:], start=arrays[0]) for arrays in zip(*lists, strict=True)]

    def start(matrices):
        total = None
        for x in matrices:
            got = [np.asarray(a, float) for a in of(x)]
            total = add([total, got]) if total else got
        return total

    return _gathered(fit, start, add)


@dataclass
class Whitening:
    """What :func:`fit` learns: row count and exact sums of the fit list, eigenvalues, falling, unit eigenvectors (columns), the trace
    of the covariance, and the largest departure of the whitened fit list's covariance from the identity."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``x - S/n``; ``n*x - S`` is a whole number, and is exact where it fits a long."""
        if self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums)) <= _LONGEST:
            return (x * self.n - np.array(self.sums, np.int64)) / self.n
        return np.array([[(v * self.n - s) / self.n for v, s in zip(row, self.sums, strict=True)] for row in x.tolist()])

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of ``(n*x - S)**2``, exact; None beyond a long."""
        largest = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums))
        if largest * largest * x.shape[1] <= _LONGEST:
            apart = x * self.n - np.array(self.sums, np.int64)
            return (apart * apart).sum(axis=1).tolist()
        exact = [sum((v * self.n - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x.tolist()]
        return [d if d <= _LONGEST else None for d in exact]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)


def fit(rows: DataFrame, components: int = COMPONENTS, block: int = BLOCK) -> Whitening | None:
    """The whitening of the distinct vectors among ``rows`` (see :func:`quantised`); None without rows."""
    distinct = materialize(rows.select("x").distinct(), "fit-list")
    start = _spectrum(distinct, block)
    if start is None:
        return None
    dimension = len(start.mean)
    exact = [F.sum(F.col("x")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dimension)]
    sums = [int(Decimal(s)) for s in distinct.agg(*exact).first()]
    found = Whitening(start.n, sums, np.zeros(0), np.zeros((dimension, 0)), 0.0, 0.0)

    basis = np.linalg.qr(start.vectors[:, ::-1][:, : SPARE * components])[0]
    while True:

        def products(x, basis=basis):
            centred = found.centred(x)
            return [centred.T @ (centred @ basis), np.square(centred).sum()]

        image, trace = _sums(distinct, products)
        image, trace = image.reshape(basis.shape) / found.n, float(trace[0]) / found.n
        projected = basis.T @ image
        values, turn = np.linalg.eigh((projected + projected.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        vectors, residual = basis @ turn, image @ turn - (basis @ turn) * values
        off = np.linalg.norm(residual[:, :components], axis=0)
        if basis.shape[1] == dimension or off.max() <= ROUNDING * values[0]:
            break
        basis = np.linalg.qr(np.hstack([vectors, residual]))[0][:, :dimension]
    real = (values > ROUNDING * dimension * max(values[0], 0)) & (np.arange(len(values)) < components)
    found.values, found.vectors, found.trace = values[real], vectors[:, real], trace

    if len(found.values):

        def moments(x):
            w = found.whitened(x)
            return [w.T @ w, w.sum(axis=0)]

        products, totals = _sums(distinct, moments)
        means = totals / found.n
        covariance = products.reshape(len(means), -1) / found.n - np.outer(means, means)
        found.identity_error = float(np.abs(covariance - np.eye(len(means))).max())
    return found


def whiten(rows: DataFrame, model: Whitening | None) -> DataFrame:
    """A row for every row of ``rows`` (see :func:`quantised`) and every component of the model."""

    def apply(batches):
        if model is None or not len(model.values):
            return
        k = len(model.values)
        explained = model.values / model.trace
        for batch, x in _matrices(batches):
            m = len(x)
            yield pa.record_batch(
                {
                    "vec_id": batch.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))),
                    "component": pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                    "n": pa.array(np.full(m * k, model.n), pa.int64()),
                    "deviation": pa.array([d for d in model.deviations(x) for _ in range(k)], pa.int64()),
                    "whitened": pa.array(model.whitened(x).ravel(), pa.float64()),
                    "explained": pa.array(np.tile(explained, m), pa.float64()),
                    "identity_error": pa.array(np.full(m * k, model.identity_error), pa.float64()),
                }
            )

    return rows.mapInArrow(apply, RESULT)


def report(embeddings: DataFrame) -> DataFrame:
    """Whitened components of every embedding, with the share of the variance that each explains."""
    rows = quantised(embeddings)
    return whiten(rows, fit(rows))
