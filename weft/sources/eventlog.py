"""Keyed JSON event logs in the shape of Spark's Kafka source (SRC-5 to SRC-7, SNK-1, SNK-2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.text import is_json
from weft.operators.contract import event_key
from weft.schemas import (
    CONTRACTS,
    EDGES_TOPIC,
    ERRORS_TOPIC,
    LOG_ENVELOPE,
    METADATA_TOPIC,
    NODES_TOPIC,
    SCOPES_TOPIC,
)

# Partitions per topic.
TOPIC_PARTITIONS = {NODES_TOPIC: 3, EDGES_TOPIC: 3, METADATA_TOPIC: 3, ERRORS_TOPIC: 1}


def event_json(*columns: str) -> Column:
    """Compact JSON of the event fields, null fields kept (FN-9)."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def to_records(events: DataFrame, topic: str) -> DataFrame:
    """Events of one kind as keyed records (SNK-1): topic, key, value."""
    fields = CONTRACTS[topic].fieldNames()
    return events.select(
        F.lit(topic).alias("topic"), event_key(topic).alias("key"), event_json(*fields).alias("value")
    )


def route(**events_by_kind: DataFrame) -> DataFrame:
    """All kinds of events as one table of records (SNK-2)."""
    topics = {
        "nodes": NODES_TOPIC,
        "edges": EDGES_TOPIC,
        "metadata": METADATA_TOPIC,
        "errors": ERRORS_TOPIC,
        "scopes": SCOPES_TOPIC,
    }
    parts = [to_records(df, topics[kind]) for kind, df in events_by_kind.items()]
    records = parts[0]
    for part in parts[1:]:
        records = records.unionByName(part)
    return records


def append_log(records: DataFrame, path: str, first_offset: int = 0) -> None:
    """Append records to a file log, one folder per topic.

    Like a broker, a partition is a function of the key, so records of one key keep their
    order. Offsets rise along the input but are not dense.
    """
    partitions = F.create_map(*[F.lit(v) for kv in TOPIC_PARTITIONS.items() for v in kv])
    count = F.coalesce(partitions[F.col("topic")], F.lit(1))
    records.select(
        F.col("key").cast("binary").alias("key"),
        F.col("value").cast("binary").alias("value"),
        F.pmod(F.hash("key"), count).alias("partition"),
        (F.monotonically_increasing_id() + first_offset).alias("offset"),
        F.current_timestamp().alias("timestamp"),
        "topic",
    ).write.mode("append").option("compression", "zstd").partitionBy("topic").parquet(path)


def write_kafka(records: DataFrame, servers: str) -> None:
    """Publish records to a broker, where the Kafka connector is on the class path."""
    records.write.format("kafka").option("kafka.bootstrap.servers", servers).save()


def read_log(spark: SparkSession, path: str, topic: str | None = None) -> DataFrame:
    log = spark.read.schema(LOG_ENVELOPE).parquet(path)
    return log if topic is None else log.where(F.col("topic") == topic)


def stream_log(spark: SparkSession, path: str, *topics: str, **options: str) -> DataFrame:
    """Topics of a file log as a stream from its beginning; other topics' folders are not read."""
    reader = spark.readStream.schema(LOG_ENVELOPE).options(**options)
    return reader.parquet(path).where(F.col("topic").isin(*topics))


def stream_kafka(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """One broker topic as a stream from its earliest offset (SRC-5, SRC-6)."""
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .load()
    )


# The fields an event sample may carry.
SAMPLE_FIELDS = (
    "schema_version",
    "repo_name",
    "file_path",
    "node_id",
    "edge_id",
    "metadata_id",
    "error_type",
    "node_type",
    "edge_type",
    "status",
)


def sample_events(lines: DataFrame) -> DataFrame:
    """Samples ``(topic, line)`` as typed rows (SRC-7).

    A line is a JSON value, optionally behind ``key<TAB>``. An undecodable line keeps a row with
    ``parse_error``; a null line stands for a missing sample.
    """
    body = F.trim(F.regexp_replace("line", "^[^\t]*\t", ""))
    data = F.from_json(body, ", ".join(f"{f} string" for f in SAMPLE_FIELDS))
    return lines.select(
        "topic",
        F.col("line").isNotNull().alias("exists"),
        (F.col("line").isNotNull() & ~is_json(body)).alias("parse_error"),
        data.alias("data"),
    ).select("topic", "exists", "parse_error", "data.*")


def read_samples(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """One row per expected sample file; files that do not exist give a null line."""
    listed = spark.createDataFrame(list(paths.items()), "topic string, path string")
    found = None
    for topic, path in paths.items():
        try:
            whole = spark.read.text(path, wholetext=True)
            part = whole.select(F.lit(topic).alias("topic"), F.trim("value").alias("line"))
        except Exception as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            continue
        found = part if found is None else found.unionByName(part)
    if found is None:
        return listed.select("topic", F.lit(None).cast("string").alias("line"))
    return listed.select("topic").join(found, "topic", "left")
