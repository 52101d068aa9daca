"""Rank-one spectra and whitening against plain numpy."""

from __future__ import annotations

import math

import numpy as np
import pytest

from weft.llm import whitening
from weft.llm.catalog import QUERIES
from weft.llm.spectrum import Spectrum, update

SMALL = "/root/testdata/sf0.001"
RANDOM = np.random.default_rng(5)
GAUSS = np.floor(256 * RANDOM.normal(0, 0.125, (400, 24)))
DEPENDENT = GAUSS.copy()
DEPENDENT[:, 3], DEPENDENT[:, 5], DEPENDENT[:, 6] = DEPENDENT[:, 2], 0, 7
TABLES = {
    "gauss": GAUSS,
    "dependent": DEPENDENT,
    "constant": np.ones((30, 8)),
    "equal eigenvalues": np.vstack([np.eye(12), -np.eye(12)]),
    "repeated": np.repeat(GAUSS[:9], 7, axis=0),
    "graded": 10.0 ** np.arange(-6, 6) * RANDOM.normal(size=(200, 12)),
    "few": GAUSS[:3],
    "one": GAUSS[:1],
}


def scatter(rows):
    centred = rows - rows.mean(axis=0)
    return centred.T @ centred


def matches(found: Spectrum, rows):
    want = scatter(rows)
    scale = max(np.abs(want).max(), 1e-300)
    assert found.n == len(rows)
    assert np.abs(found.vectors.T @ found.vectors - np.eye(rows.shape[1])).max() < 1e-12
    assert np.abs(found.vectors * found.values @ found.vectors.T - want).max() <= 1e-11 * scale
    assert (np.diff(found.values) >= 0).all()


@pytest.mark.parametrize("block", [1, 5, 40, 1024])
@pytest.mark.parametrize("name", TABLES)
def test_rows_change_the_spectrum(name, block):
    found = Spectrum.empty(TABLES[name].shape[1])
    found.add(TABLES[name], block)
    matches(found, TABLES[name])


@pytest.mark.parametrize("name", TABLES)
def test_spectra_merge(name):
    rows = TABLES[name]
    parts = [rows[: len(rows) // 3], rows[len(rows) // 3 : len(rows) // 2], rows[len(rows) // 2 :]]
    found = Spectrum.empty(rows.shape[1])
    for part in parts:
        other = Spectrum.empty(rows.shape[1])
        other.add(part, 16)
        found.merge(other)
    matches(found, rows)


def test_one_change():
    for rho in (1e-30, 1.0, 1e12):
        d, v = np.sort(RANDOM.integers(0, 4, 10).astype(float)), RANDOM.normal(size=10)
        v[2] = 0
        values, vectors = update(d, np.eye(10), v, rho)
        want = np.diag(d) + rho * np.outer(v, v)
        assert np.abs(vectors * values @ vectors.T - want).max() <= 1e-13 * max(1, np.abs(want).max())


def plain(rows):
    """(id, component) to (n, deviation, whitened, explained), eigenvectors of numpy with their signs."""
    x = np.array([[math.floor(256 * c) for c in v] for _, v in rows], dtype=object)
    fit = np.array(sorted(set(map(tuple, x.tolist()))), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    centred = (fit * n - sums).astype(float) / n
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:4], vectors[:, ::-1][:, :4]
    apart = (x * n - sums).astype(float) / n
    return n, ((x * n - sums) ** 2).sum(axis=1), apart @ vectors / np.sqrt(values), values / np.trace(covariance)


def compare(got, rows):
    n, deviation, whitened, explained = plain(rows)
    by = {(r.vec_id, r.component): r for r in got}
    assert len(by) == len(got) == 4 * len(rows)
    for k in range(4):
        column = np.array([by[i, k + 1].whitened for i, _ in rows])
        sign = np.sign(column @ whitened[:, k])
        assert np.abs(column * sign - whitened[:, k]).max() < 1e-9
        for (i, _), d in zip(rows, deviation, strict=True):
            row = by[i, k + 1]
            assert (row.n, row.deviation) == (n, d)
            assert abs(row.explained - explained[k]) < 1e-10
            assert row.identity_error < 1e-10


@pytest.fixture(scope="module")
def small(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    return [(r.vec_id, list(r.embedding)) for r in rows]


def test_whole_table(spark, small):
    compare(QUERIES["op13_embedding_whitening"](spark, SMALL).collect(), small)


def test_many_tasks_and_single_rows(spark, small, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    shape = "vec_id long, embedding array<float>"
    table = whitening.quantised(spark.createDataFrame(small[:150], shape).repartition(7))
    model = whitening.fit(table, block=1)
    compare(whitening.whiten(table, model).collect(), small[:150])


def test_rows_that_take_no_part(spark):
    good = [(i, [float(v) / 256 for v in row]) for i, row in enumerate(GAUSS[:60, :6])]
    bad = [
        (100, None), (101, []), (102, [0.5] * 5), (103, [0.1, None, 0.2, 0.3, 0.4, 0.5]), (104, [math.nan] * 6),
        (105, [math.inf] + [0.0] * 5), (106, [-math.inf] + [0.0] * 5), (107, [1e300] + [0.0] * 5),
    ]
    extra = [(i, v, "x", 1, 2) for i, v in good + bad]
    docs = spark.createDataFrame(extra, "vec_id long, embedding array<double>, x string, n int, part int")
    compare(whitening.report(docs).collect(), good)


def test_repeated_rows_and_null_ids(spark):
    good = [(i, [float(v) / 256 for v in row]) for i, row in enumerate(GAUSS[:40, :5])]
    rows = good + good[:10] + [(None, good[0][1]), (900, [-0.0] * 5), (901, [0.0] * 5)]
    got = whitening.report(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == 4 * len(rows)
    assert {r.n for r in got} == {41}
    assert len({(r.vec_id, r.component, r.whitened) for r in got}) == 4 * (40 + 1 + 2)


def test_nothing_to_whiten(spark):
    shape = "vec_id long, embedding array<float>"
    assert whitening.report(spark.createDataFrame([], shape)).collect() == []
    assert whitening.report(spark.createDataFrame([(1, None)], shape)).collect() == []
    assert whitening.report(spark.createDataFrame([(1, [0.5, 1.0]), (2, [0.5, 1.0])], shape)).collect() == []
    line = whitening.report(spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(9)], shape)).collect()
    assert sorted({r.component for r in line}) == [1] and len(line) == 9


def test_deviations_beyond_a_long(spark):
    rows = [(1, [3e13, 0.0]), (2, [-3e13, 1.0]), (3, [0.0, 2.0])]
    got = whitening.report(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id: r.deviation for r in got}[1] is None
    assert {r.vec_id: r.deviation for r in got}[3] == (3 * 512 - 768) ** 2
