"""Bounded samples of labelled documents, and folds by document id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(key: str, folds: int) -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % folds


def sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, limit: int) -> DataFrame:
    """(doc_id, text, label) of at most ``limit`` documents that are labelled and meet ``learn`` (a condition on doc_id).

    The ids with the smallest hashes are taken. They are few by that limit, so they are sent to the
    texts; the texts do not move. Several labels of one document count as the largest.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & learn)
    chosen = known.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id")
