from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from weft.llm import quality_mil, words
from weft.llm.catalog import QUERIES

SF = "/root/testdata/sf0.01"


def encoded(texts):
    parts = [quality_mil.encode(data, bounds) for _, _, data, bounds in words.byte_chunks(pa.array(texts))]
    assert len(parts) == 1
    return parts[0]


def test_a_document_is_encoded_alike_in_any_company():
    texts = ["", "one", "two  words\n", "é " * 100, "Word! " * 200, " ", "a|b #$ " * 70, "x" * 500]
    x, first = encoded(texts)
    assert np.diff(first).tolist() == [1, 1, 1, 2, 4, 1, 3, 1]
    for i, text in enumerate(texts):
        alone, _ = encoded([text])
        assert np.allclose(alone, x[first[i] : first[i + 1]], atol=1e-6), text


def test_attention_finds_the_passage_that_matters():
    random = np.random.default_rng(0)
    bags, y = [], []
    for i in range(400):
        bag = random.normal(0, 1, (random.integers(1, 9), quality_mil.FEATURES)).astype(np.float32)
        if i % 2:
            bag[random.integers(len(bag)), 3] = 9
        bags.append(bag)
        y.append(float(i % 2))
    model = quality_mil.train(bags, np.array(y))
    right, on_it = 0, 0
    for bag, label in zip(bags, y):
        p, a = model.score(bag, np.array([0, len(bag)]))
        right += (p[0] > 0.5) == label
        on_it += bool(label) and bag[np.argmax(a), 3] == 9
    assert right >= 390 and on_it >= 180


def test_held_out_accuracy(spark):
    rows = QUERIES["op6_quality_mil"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    good = [r.predicted for r in held if r.quality == 1]
    bad = [r.predicted for r in held if r.quality == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.2 * len(bad)


def test_edge_rows(spark):
    texts = [None, "", " \n", "a", "A !! " * 30_000]
    docs = spark.createDataFrame([(i, texts[i % 5], 1) for i in range(40)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, int(i % 5 == 3)) for i in range(40)], "doc_id long, quality int")
    model = quality_mil.fit(docs, labels, F.lit(True))
    got = {r.doc_id: r for r in quality_mil.score(docs, model).collect()}
    assert len(got) == 40 and all(0 <= r.score <= 1 for r in got.values())
    assert got[0].score == got[1].score == got[2].score and got[3].score > got[4].score
    assert got[4].n_passages == -(-60_000 // quality_mil.PASSAGE_WORDS)
    assert quality_mil.score(docs.limit(0), model).count() == 0
    none = quality_mil.fit(docs, labels.limit(0), F.lit(True))
    assert {r.score for r in quality_mil.score(docs, none).collect()} == {1.0}
