"""Mined hard negatives against all scores."""

from __future__ import annotations

import math
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.llm import hard_negatives
from weft.llm.catalog import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
SHAPE = "vec_id long, embedding array<double>, label int"
RESULT = list(hard_negatives.RESULT)


def plain(rows, is_anchor, low=80, k=5):
    """The expected rows of (id, vector, label) rows with one row an id, from all scores."""
    usable = {}
    for i, vector, label in rows:
        if i is None or label is None or vector is None or any(c is None or not math.isfinite(c) for c in vector):
            continue
        x = [math.floor(256 * c) for c in vector]
        if all(abs(c) <= math.sqrt(2.0**62 / max(len(x), 1)) for c in x):
            usable[i] = min(usable.get(i, (label, x)), (label, x))
    found = []
    for a, (label, x) in usable.items():
        if not is_anchor(a):
            continue
        scores = [(sum(p * q for p, q in zip(x, y, strict=True)), i, other == label) for i, (other, y) in usable.items() if i != a and len(y) == len(x)]
        scores.sort(key=lambda s: (-s[0], s[1]))
        for p, i, _ in [s for s in scores if s[2]][:k]:
            fits = [(n, j) for n, j, same in scores if not same and low * p <= 100 * n <= 100 * p][:k]
            found += [(a, i, rank, j, p, n) for rank, (n, j) in enumerate(fits, 1)]
    return sorted(found)


def mined(spark, rows, modulus, **settings):
    table = hard_negatives.quantised(spark.createDataFrame(rows, SHAPE).repartition(5))
    got = hard_negatives.mine(table, F.col("vec_id") % modulus == 0, **settings)
    assert got.columns == RESULT
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_query_equals_sql(spark, sf):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/{sf}/embeddings.parquet'")
    want = db.sql(ORACLES["op12_hard_negatives"]).select(", ".join(RESULT)).fetchall()
    got = QUERIES["op12_hard_negatives"](spark, f"/root/testdata/{sf}").select(*RESULT).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_ties_and_small_vectors(spark):
    random = np.random.default_rng(3)
    rows = [(i, [float(v) / 256 for v in random.integers(-2, 3, 6)], int(random.integers(0, 3))) for i in range(400)]
    want = plain(rows, lambda i: i % 10 == 0)
    assert want and mined(spark, rows, 10) == want


def test_anchors_in_several_groups(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "GROUP_BYTES", 4000)
    random = np.random.default_rng(4)
    rows = [(i, random.normal(0.05, 0.1, 12).tolist(), int(random.integers(0, 4))) for i in range(500)]
    want = plain(rows, lambda i: i % 5 == 0, low=50, k=5)
    assert want and mined(spark, rows, 5, low=50) == want


def test_rows_that_take_no_part(spark):
    random = np.random.default_rng(5)
    rows = [(i, random.integers(0, 3, 4).astype(float).tolist(), int(i % 3)) for i in range(60)]
    rows += [(100, None, 1), (110, [1.0, None, 1.0, 1.0], 1), (120, [math.nan] * 4, 1), (130, [math.inf, 1.0, 1.0, 1.0], 1), (140, [1.0] * 4, None)]
    rows += [(None, [1.0] * 4, 1), (150, [], 1), (160, [], 2), (170, [1.0] * 3, 1), (180, [1.0] * 3, 1), (181, [1.0] * 3, 2), (190, [1e300, 1.0, 1.0, 1.0], 1)]
    rows += [(20, [2.0] * 4, 2), (20, [2.0] * 4, 0), (21, [1.0] * 4, 0), (21, [1.0] * 4, 0)]
    want = plain(rows, lambda i: i % 10 == 0)
    assert {r[0] for r in want} >= {0, 10, 170}
    assert mined(spark, rows, 10) == want


@pytest.mark.parametrize("size", [1.0, 2.0**18, 2.0**21])
def test_scores_are_exact_at_any_size(spark, size):
    random = np.random.default_rng(6)
    rows = [(i, (size * random.normal(1, 0.2, 7)).tolist(), int(random.integers(0, 3))) for i in range(200)]
    want = plain(rows, lambda i: i % 20 == 0)
    assert want and mined(spark, rows, 20) == want


def test_hot_label_and_negative_scores(spark):
    random = np.random.default_rng(7)
    rows = [(i, random.normal(0, 1, 5).tolist(), 0 if i % 50 else 1 + i // 50) for i in range(500)]
    assert mined(spark, rows, 4) == plain(rows, lambda i: i % 4 == 0)


def test_nothing_to_mine(spark):
    empty = spark.createDataFrame([], SHAPE)
    assert hard_negatives.mine(hard_negatives.quantised(empty), F.lit(True)).collect() == []
    alone = [(1, [1.0], 0), (2, [1.0], 1)]
    assert mined(spark, alone, 1) == []
    extra = spark.createDataFrame([(i, [1.0], i % 2, 3, 4, 5) for i in range(8)], f"{SHAPE}, x int, rank int, id int")
    got = hard_negatives.mine(hard_negatives.quantised(extra), F.col("vec_id") == 0)
    assert sorted(map(tuple, got.collect())) == plain([(i, [1.0], i % 2) for i in range(8)], lambda i: i == 0)


def test_bounds_prune():
    """Most columns of most rows are never read where one column decides."""
    random = np.random.default_rng(8)
    x = random.integers(-3, 4, (1000, 32))
    x[:, 7] = random.permutation(1000)
    block = hard_negatives.Block.of(np.arange(1000), x)
    anchor = np.ones(32, np.int64)
    anchor[7] = 100
    left = []
    found = hard_negatives.Best(5)

    def keep(partial, least, most):
        stay = partial + most >= np.partition(partial, -5)[-5] + least
        left.append(int(stay.sum()))
        return stay

    places, scores = block.scan(anchor, keep)
    found.offer(places, scores)
    assert left[0] < 50
    assert found.ids.tolist() == np.lexsort((np.arange(1000), -(x @ anchor)))[:5].tolist()
