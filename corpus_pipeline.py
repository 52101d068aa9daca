"""A training corpus from raw documents: five stages, each over all documents that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read as the
next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import bpe, decontaminate, minhash, pii, toxicity
from weft.session import materialize

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: A document at least this likely to be toxic goes.
TOXIC = 0.7
#: Rows of an Arrow batch, in place of Spark's 10,000: whole texts are long, and JVM and worker both hold a batch.
BATCH_ROWS = "1000"


def bounded(spark: SparkSession) -> None:
    """Set the size of Arrow batches for the session that runs the stages."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose nearest labelled examples do not call them toxic."""
    bounded(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.below(docs, toxicity.fit(docs, labels, F.lit(True)), TOXIC)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id; repeated rows are one. Rows without an id stay."""
    bounded(spark)
    kept = minhash.near_duplicates(docs).filter("kept").select(F.col("doc_id").alias("_id")).distinct()
    named = docs.filter("doc_id is not null").join(kept, docs.doc_id == F.col("_id"), "left_semi").dropDuplicates()
    return named.union(docs.filter("doc_id is null"))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    bounded(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data generalised and disclosing terms removed; n_chars follows the text."""
    clean = pii.sanitise(docs)
    if "n_chars" not in docs.columns:
        return clean
    kind = docs.schema["n_chars"].dataType
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(kind)).otherwise(F.col("n_chars")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of what they decode to."""
    bounded(spark)
    return bpe.digests(bpe.encode(docs, VOCABULARY), VOCABULARY)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("pii", sanitise),
    ("bpe", encode),
]

#: The stages learn, search and encode beyond what SQL can state; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
