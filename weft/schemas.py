"""Event contracts: one StructType per kind, used by producers and consumers alike."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the event contracts.
SCHEMA_VERSION = "1.0"
NODES_TOPIC = "cpg.nodes.v1"
EDGES_TOPIC = "cpg.edges.v1"
METADATA_TOPIC = "cpg.metadata.v1"
ERRORS_TOPIC = "cpg.errors.v1"
# An own topic: files whose stored graph goes, in the order of the log.
SCOPES_TOPIC = "weft.scopes.v1"
EDGE_TYPES = ("AST", "CFG", "DFG", "CALL")


def _text(name: str, required: bool = True) -> T.StructField:
    return T.StructField(name, T.StringType(), True, {"required": required})


def _number(name: str) -> T.StructField:
    return T.StructField(name, T.IntegerType(), True, {"required": True})


def _flag(name: str) -> T.StructField:
    return T.StructField(name, T.BooleanType(), True, {"required": True})


# Fields of the events in order; those not required may be null.
_ENVELOPE = [_text("schema_version"), _text("event_time"), _text("repo_name"), _text("file_path")]
_PLACE = [_number("lineno"), _number("col_offset"), _number("end_lineno"), _number("end_col_offset")]

NODE = T.StructType(
    [
        *_ENVELOPE,
        _text("file_hash"),
        _text("node_id"),
        _text("node_type"),
        _text("name", required=False),
        _text("structural_path"),
        *_PLACE,
    ]
)
EDGE = T.StructType(
    [*_ENVELOPE, _text("file_hash"), _text("edge_id"), _text("edge_type"), _text("source_id"), _text("target_id")]
)
METADATA = T.StructType(
    [
        *_ENVELOPE,
        _text("metadata_id"),
        _text("file_hash"),
        _number("line_count"),
        _number("function_count"),
        _number("class_count"),
        _number("import_count"),
        _number("node_count"),
        _number("edge_count"),
        _text("status", required=False),
    ]
)
ERROR = T.StructType([*_ENVELOPE, _text("error_type"), _text("error_message"), _text("status", required=False)])
SCOPE = T.StructType(_ENVELOPE)

# Tables of the graph store.
GRAPH_REPOSITORY = T.StructType([_text("name")])
GRAPH_FILE = T.StructType([_text("id"), _text("repo_name"), _text("path"), _text("file_hash")])
GRAPH_NODE = T.StructType(
    [
        _text("id"),
        _text("repo_name"),
        _text("file_path"),
        _text("file_hash"),
        _text("type"),
        _text("name", required=False),
        _text("structural_path"),
        *_PLACE,
        _text("schema_version"),
        _text("updated_at"),
        _flag("placeholder"),
    ]
)
GRAPH_EDGE = T.StructType(
    [
        _text("id"),
        _text("source_id"),
        _text("target_id"),
        _text("type"),
        _text("repo_name"),
        _text("file_path"),
        _text("file_hash"),
        _text("schema_version"),
        _text("updated_at"),
    ]
)
# Stored metadata: the event and its ingestion stamp.
STORED_METADATA = T.StructType(
    [
        *METADATA.fields,
        T.StructField("ingested_at", T.TimestampType()),
        T.StructField("spark_batch_id", T.LongType()),
    ]
)

CONTRACTS = {
    NODES_TOPIC: NODE,
    EDGES_TOPIC: EDGE,
    METADATA_TOPIC: METADATA,
    ERRORS_TOPIC: ERROR,
    SCOPES_TOPIC: SCOPE,
}
DEFAULT_STATUS = {METADATA_TOPIC: "parsed", ERRORS_TOPIC: "failed"}

# The column names and types Spark's Kafka source produces.
LOG_ENVELOPE = T.StructType(
    [
        T.StructField("key", T.BinaryType()),
        T.StructField("value", T.BinaryType()),
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
    ]
)


def required_fields(schema: T.StructType) -> list[str]:
    return [f.name for f in schema.fields if f.metadata.get("required")]


def reject_reason(schema: T.StructType) -> Column:
    """Why a typed row breaks its contract; null for a valid row (PRJ-11).

    Values of a wrong type arrive as null from ``from_json``, so one null check covers
    both missing and mistyped fields.
    """
    reason = F.lit(None).cast("string")
    if "edge_type" in schema.fieldNames():
        reason = F.when(~F.col("edge_type").isin(*EDGE_TYPES), F.lit("bad edge_type"))
    return reduce(
        lambda rest, name: F.when(F.col(name).isNull(), F.lit(f"missing {name}")).otherwise(rest),
        reversed(required_fields(schema)),
        reason,
    )
