"""Exact duplicates against plain grouping."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from weft.llm import exact
from weft.llm.catalog import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def plain(rows):
    """The expected rows of (id, text) rows."""
    groups = defaultdict(list)
    for i, text in rows:
        groups[(text or "").translate(LOWER)].append(i)
    found = set()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        digest = hashlib.sha256(text.encode()).hexdigest()
        found |= {(i, keep, len(ids), i == keep, digest) for i in ids}
    return found


def rows_of(df):
    rows = [tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


CASES = [
    (5, "Same Text"), (9, "same text"), (9, "SAME TEXT"), (3, "same  text"), (4, None), (6, ""), (7, ""),
    (None, "same text"), (None, "alone"), (None, "ALONE"), (11, "ÄÖÜ İ ẞ Ω"), (12, "äöü i̇ ß ω"), (13, "ÄÖÜ İ ẞ Ω"), (14, "A" * 300_000),
    (15, "a" * 300_000), (16, "a" * 299_999 + "b"), (9, "other"),
]


def test_cases(spark):
    docs = spark.createDataFrame(CASES, "doc_id long, text string")
    assert rows_of(exact.report(docs)) == plain(CASES)


@pytest.mark.parametrize("width", [0, 1])
def test_whole_texts_decide_where_digests_collide(spark, width):
    rows = CASES + [(100 + i, f"Copy {i % 7}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = exact.groups(docs, digest=lambda text: F.substring(exact.sha256(text), 1, width), salts=3, hot=10)
    assert rows_of(got.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))) == plain(rows)


def test_a_hot_text_is_dealt_out(spark):
    rows = [(i, "Hot" if i % 3 else f"text {i}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert rows_of(exact.report(docs)) == plain(rows)


def test_empty_table_and_clashing_columns(spark):
    extra = "doc_id long, digest int, salt string, hot int, n long, keep_id string, group_size int, text string"
    assert exact.report(spark.createDataFrame([], extra)).collect() == []
    docs = spark.createDataFrame([(1, 2, "s", 3, 4, "k", 5, "X"), (2, 2, "s", 3, 4, "k", 5, "x")], extra)
    assert rows_of(exact.report(docs)) == plain([(1, "X"), (2, "x")])


def test_query_equals_sql(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    want = db.sql(ORACLES["op11_exact_dedup"]).fetchall()
    assert rows_of(QUERIES["op11_exact_dedup"](spark, SMALL)) == set(want)


def test_no_python_in_the_plan(spark):
    plan = QUERIES["op11_exact_dedup"](spark, SMALL)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
