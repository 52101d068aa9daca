from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from weft.llm import toxicity
from weft.llm.catalog import QUERIES
from weft.llm.labelled import fold

SF = "/root/testdata/sf0.01"


def entries(random, n, terms):
    out = []
    for i in range(n):
        places = np.sort(random.choice(terms, random.integers(1, 6), replace=False)).astype(np.int32)
        weights = random.integers(1, 4, len(places)).astype(float)
        out.append((places, weights / np.linalg.norm(weights), int(random.integers(0, 3)), 3, i))
    return out


def test_search_is_exact():
    random = np.random.default_rng(1)
    index = toxicity.BlockMaxIndex(entries(random, 900, 40), 40)
    dense = np.zeros((900, 40))
    for i, (places, weights, *_) in enumerate(index.entries):
        dense[i, places] = weights
    for places, weights, *_ in entries(random, 200, 40):
        query = np.zeros(40)
        query[places] = weights
        similar = dense @ query
        order = np.sort(similar[similar > 0])[::-1]
        filled = -(-25 // 3) - 1
        limit = order[filled] if filled < len(order) else 0.0
        want = set(np.flatnonzero((similar > 0) & (similar >= limit - 1e-9)))
        found, score = index.search(places, weights, 25)
        assert set(found) == want
        assert np.allclose(score, similar[found])


def test_held_out_accuracy(spark):
    rows = QUERIES["op2_toxicity"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    clean = [r.predicted for r in held if r.toxic == 0]
    toxic = [r.predicted for r in held if r.toxic == 1]
    assert sum(clean) <= 0.02 * len(clean) and sum(toxic) >= 0.7 * len(toxic)
    assert all(0 <= r.score <= 1 for r in rows) and any(r.evidence for r in rows)


def test_edge_rows(spark):
    texts = [None, "", "good words here", "bad word", "bad WORD!", "x " * 60_000]
    docs = spark.createDataFrame([(i, texts[i % len(texts)], 1, "y") for i in range(60)], "doc_id long, text string, score int, label string")
    labels = spark.createDataFrame([(i, int(i % len(texts) in (3, 4)), 2) for i in range(0, 55)] + [(3, None, 0), (None, 1, 1)], "doc_id long, toxic int, quality int")
    model = toxicity.fit(docs, labels, F.lit(True))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert len(got) == 60
    assert min(got[i].score for i in (3, 4, 57, 58)) > max(got[i].score for i in (0, 1, 2, 5))
    assert got[3].evidence[0].toxic == 1.0
    assert toxicity.score(docs.limit(0), model).count() == 0
    for known in (labels.limit(0), labels.filter("toxic = 0")):
        assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, known, F.lit(True))).collect()} == {0.0}


def test_labels_of_the_held_out_fold_do_not_matter(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("toxic", F.when(fold("doc_id", 3) == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.score(docs, toxicity.fit(docs, x, fold("doc_id", 3) != 1)).select("doc_id", "score") for x in (labels, turned))
    assert a.exceptAll(b).count() == 0
