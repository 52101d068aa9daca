from __future__ import annotations

import hashlib
import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_minhash import expected
from test_pii import base

from weft.llm import decontaminate, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, docs, SF).collect()
        out.append((docs.collect(), rows))
        if len(out) < 5:
            docs = spark.createDataFrame(rows, docs.schema)
            assert docs.columns == columns
    return out


def test_toxic_documents_go(spark, steps):
    before, after = steps[0]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scores = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, labels, F.lit(True))).collect()}
    assert {r.doc_id for r in after} == {r.doc_id for r in before if scores[r.doc_id] < 0.7}


def test_one_of_each_group_stays(steps):
    before, after = steps[1]
    want = expected({r.doc_id: r.text for r in before}, 5, 80)
    assert sorted(r.doc_id for r in after) == sorted(k for k, v in want.items() if v[2])


def test_leaks_go(spark, steps):
    before, after = steps[2]
    items = [decontaminate.normal(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {r.doc_id for r in after}
    for r in before:
        if any(i in decontaminate.normal(r.text) for i in items if len(i) >= decontaminate.MIN_CHARS):
            assert r.doc_id not in kept


def test_personal_data_is_replaced(steps):
    before, after = steps[3]
    texts = {r.doc_id: r for r in after}
    assert texts.keys() == {r.doc_id for r in before}
    for r in before:
        got, spans = texts[r.doc_id], base(r.text)
        assert got.n_chars == len(got.text)
        if not spans:
            assert got.text == r.text
        else:
            assert not base(re.sub(r"\[[A-Z]+\]", "|", got.text))


def test_encoding_covers_all(steps):
    before, after = steps[4]
    digests = {r.doc_id: r.decoded_sha256 for r in after}
    assert digests == {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in before}


def test_run_equals_the_stages(spark, steps):
    assert sorted(corpus_pipeline.run(spark, SF).collect()) == sorted(steps[4][1])


def test_stages_on_odd_rows(spark):
    rows = [(None, None, None, None, None), (1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "some words that stay here", "en", "s", 5), (3, "some words that stay here", "en", "s", 5)]
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        n = docs.count()
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, SF).count() in ((0,) if not n else (n, n - 1))


def test_every_row_is_judged_by_its_own_text(spark, steps):
    """Rows without an id, rows that repeat one with another text, and columns with clashing names."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in steps[0][1]}
    texts = {r.doc_id: r.text for r in docs.collect()}
    toxic = next(texts[i] for i in sorted(texts) if i not in kept)
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    plain = "plain words that nobody minds, and a few more of them"
    rows = [(None, toxic, "a", 1), (10**9, plain, "b", 2), (10**9, toxic, "c", 3), (10**9 + 1, f"{plain} {item} {plain}", "d", 4), (None, item, "e", 5), (10**9 + 2, None, "f", 6)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, _bad string, score int")
    # The model is learned from the labelled documents among them.
    odd = odd.unionByName(docs.select("doc_id", "text", F.lit("other").alias("_bad"), F.lit(0).alias("score")))
    odd = odd.withColumn("_id", F.lit("x")).withColumn("items", F.lit(1))
    left = corpus_pipeline.drop_toxic(spark, odd, SF)
    assert left.columns == odd.columns
    assert sorted(r["_bad"] for r in left.filter("_bad <> 'other'").collect()) == ["b", "d", "e", "f"]
    left = corpus_pipeline.drop_benchmark(spark, odd, SF)
    assert left.columns == odd.columns
    assert sorted(r["_bad"] for r in left.filter("_bad <> 'other'").collect()) == ["a", "b", "c", "f"]
