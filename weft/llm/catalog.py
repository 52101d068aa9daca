"""The queries of the operators, over the whole tables and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import bpe, decontaminate, exact, hard_negatives, minhash, pii, quality_mil, quality_rules, secrets, substrings, toxicity, url_filter, whitening
from weft.llm.labelled import fold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document's encoding and of its decoding."""
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents"), VOCABULARY), VOCABULARY)


@query
def op8_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of two-word shingles have a similarity of 0.8 or more."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict of the weakly supervised rules."""
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    columns = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept quality".split()
    return judged.select(*columns)


@query
def op9_pii_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data and of the terms that disclose it."""
    return pii.report(table(spark, sf_dir, "documents"))


# Verdict, host and path of the rules.
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


@query
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page's URL."""
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by its nearest labelled examples; a third of the ids is held out."""
    docs = table(spark, sf_dir, "documents")
    remainder = fold("doc_id", 3)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), remainder != 1)
    scored = toxicity.score(docs, model)
    predicted = (F.col("score") >= 0.7).cast("int")
    return scored.select("doc_id", (remainder == 1).alias("held_out"), "score", predicted.alias("predicted"), "evidence")


@query
def op6_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by attention over its passages; a fifth of the ids is held out."""
    docs = table(spark, sf_dir, "documents")
    remainder = fold("doc_id", 5)
    model = quality_mil.fit(docs, table(spark, sf_dir, "labels"), remainder != 0)
    scored = quality_mil.score(docs, model)
    predicted = (F.col("score") >= 0.3).cast("int").alias("predicted")
    return scored.select("doc_id", (remainder == 0).alias("held_out"), "score", predicted, "n_passages", "top_passage", "top_weight")


@query
def op7_secret_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of credentials, by patterns and by learned formats."""
    return secrets.report(table(spark, sf_dir, "documents"))


@query
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that each document holds, within the errors allowed."""
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op4_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without strings of 50 bytes that an earlier one holds."""
    return substrings.report(table(spark, sf_dir, "documents"))


@query
def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the copy of it that stays."""
    return exact.report(table(spark, sf_dir, "documents"))


ORACLES["op11_exact_dedup"] = exact.REPORT_SQL


@query
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened leading components of every embedding."""
    return whitening.report(table(spark, sf_dir, "embeddings"))


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth embedding; every seventh has the next label."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hard_negatives.quantised(table(spark, sf_dir, "embeddings").withColumn("label", label))
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)


ORACLES["op12_hard_negatives"] = hard_negatives.MINED_SQL
