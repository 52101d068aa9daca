"""Typing, validating and projecting events (PRJ-5 to PRJ-16)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.functions.identity import file_key, metadata_id
from weft.schemas import CONTRACTS, DEFAULT_STATUS, SCHEMA_VERSION, reject_reason

# Spark's name for the column that receives unreadable values.
_UNREAD = "_corrupt_record"


def decode(log: DataFrame, schema: T.StructType, keep: tuple[str, ...] = ()) -> DataFrame:
    """The typed fields of the JSON value column (PRJ-5). Malformed JSON gives nulls.

    The one-element ``inline`` makes Spark parse each value once. As a plain projection the
    parse would be repeated for every field that a later filter mentions.
    """
    data = F.from_json(F.col("value").cast("string"), schema)
    return log.select(*keep, F.inline(F.array(data)))


def with_required_key(events: DataFrame) -> DataFrame:
    return events.where("repo_name IS NOT NULL AND file_path IS NOT NULL")


def backfill_metadata_id(events: DataFrame) -> DataFrame:
    """Give events of older producers the identity they would have today (PRJ-7)."""
    return events.withColumn("metadata_id", F.coalesce("metadata_id", metadata_id()))


def stamp_ingestion(batch: DataFrame, batch_id: int) -> DataFrame:
    return batch.withColumns(
        {"ingested_at": F.current_timestamp(), "spark_batch_id": F.lit(batch_id).cast("bigint")}
    )


def envelope(rows: DataFrame, event_time: Column) -> DataFrame:
    """Put version and time in front of the rows of a table (PRJ-9)."""
    return rows.select(
        F.lit(SCHEMA_VERSION).alias("schema_version"), event_time.alias("event_time"), "*"
    )


def validate(log: DataFrame, topic: str) -> DataFrame:
    """Typed events of one topic with ``reject_reason``, null where valid (PRJ-11)."""
    schema = CONTRACTS[topic]
    keep = tuple(c for c in log.columns if c != "topic")
    # The parser keeps the text of a value it could not read, wholly or in part, aside.
    typed = decode(log, T.StructType([*schema.fields, T.StructField(_UNREAD, T.StringType())]), keep)
    nothing_read = F.coalesce(*[F.col(f).cast("string") for f in schema.fieldNames()]).isNull()
    broken = F.col("value").isNull() | (F.col(_UNREAD).isNotNull() & nothing_read)
    reason = F.when(broken, "malformed json").otherwise(reject_reason(schema))
    typed = typed.withColumn("reject_reason", reason).drop(_UNREAD)
    return with_default_status(typed, topic)


def with_default_status(events: DataFrame, topic: str) -> DataFrame:
    """The status that events of the topic have where they state none (PRJ-15)."""
    if topic not in DEFAULT_STATUS:
        return events
    return events.withColumn("status", F.coalesce("status", F.lit(DEFAULT_STATUS[topic])))


def name_of(*columns: str) -> Column:
    """The first of the columns that is there, else empty (PRJ-15)."""
    return F.coalesce(*columns, F.lit(""))


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows within their contract, and the others with their reason (PRJ-12)."""
    return (
        validated.where("reject_reason IS NULL").drop("reject_reason"),
        validated.where("reject_reason IS NOT NULL"),
    )


def error_events(failures: DataFrame, event_time: Column) -> DataFrame:
    """Error records of failed files (PRJ-10)."""
    return envelope(failures, event_time).withColumn("status", F.lit("failed"))


def find_metadata(metadata: DataFrame, repo: str, file: str) -> DataFrame:
    """The document of one file (PRJ-13); equality filters reach the scan."""
    return metadata.where((F.col("repo_name") == repo) & (F.col("file_path") == file)).limit(1)


# The fields shown for one metadata document.
DISPLAY_FIELDS = (
    "metadata_id",
    "file_path",
    "file_hash",
    "event_time",
    "ingested_at",
    "spark_batch_id",
    "node_count",
    "edge_count",
)
FOCUS_FIELDS = (
    "repo_name",
    "file_path",
    "line_count",
    "function_count",
    "class_count",
    "import_count",
    "node_count",
    "edge_count",
    "status",
)


def display(metadata: DataFrame, fields: tuple[str, ...] = DISPLAY_FIELDS) -> DataFrame:
    """Those of the display fields the table has (PRJ-14)."""
    return metadata.select(*[f for f in fields if f in metadata.columns])


def summarize_events(events: DataFrame) -> DataFrame:
    """One uniform row per event of any topic (PRJ-16).

    ``events`` is the union of the topics by name; absent columns count as null.
    """

    def first(*names: str) -> Column:
        present = [F.nullif(F.col(n), F.lit("")) for n in names if n in events.columns]
        return F.coalesce(*present) if present else F.lit(None).cast("string")

    return events.select(
        "topic",
        "schema_version",
        "repo_name",
        "file_path",
        first("node_id", "edge_id", "metadata_id", "error_type").alias("identity"),
        first("node_type", "edge_type", "status", "error_type").alias("event_type"),
        F.coalesce(first("status"), F.lit("ok")).alias("status"),
    )


def event_key(topic: str) -> Column:
    """The log key of an event: its identity, or repo and file for an error."""
    identity = [n for n in CONTRACTS[topic].fieldNames() if n in ("node_id", "edge_id", "metadata_id")]
    return F.col(identity[0]) if identity else file_key()
