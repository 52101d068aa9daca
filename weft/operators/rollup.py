"""Aggregations over node, edge and metadata tables (AG-1 to AG-11, SL-2 to SL-6)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.text import event_timestamp
from weft.operators.duplicates import duplicate_count, duplicate_groups  # noqa: F401
from weft.operators.edges import EDGE_ENDS, FILE, FUNCTION_TYPES
from weft.schemas import EDGES_TOPIC, METADATA_TOPIC, NODES_TOPIC

# Node types counted per file, and the cut of duplicate listings.
CLASS_TYPES = ("ClassDef",)
IMPORT_TYPES = ("Import", "ImportFrom")
GRAPH_SAMPLE = 20
DOCUMENT_SAMPLE = 10
EDGE_SAMPLE = 5


def file_metadata(linked: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """Counts per file (AG-1) of nodes with the ends of their edges, as ``linked_nodes`` gives them.

    One aggregate counts nodes and edges. ``carried`` columns hold one value per file.
    """

    def kinds(types: Sequence[str], name: str) -> Column:
        return F.count_if(F.col("node_type").isin(*types)).cast("int").alias(name)

    ends = sum((F.count(c) for c in EDGE_ENDS[1:]), start=F.count(EDGE_ENDS[0]))
    return linked.groupBy(*FILE).agg(
        *[F.max(c).alias(c) for c in carried],
        kinds(FUNCTION_TYPES, "function_count"),
        kinds(CLASS_TYPES, "class_count"),
        kinds(IMPORT_TYPES, "import_count"),
        F.count("*").cast("int").alias("node_count"),
        ends.cast("int").alias("edge_count"),
    )


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Total nodes and edges in one row (AG-2); counts need no column of either table.

    Each table has a count of its own, so a plan that counts one of them twice computes it once.
    """
    counted = nodes.agg(F.count("*").alias("n")).select("n", F.lit(0).alias("e")).unionByName(
        edges.agg(F.count("*").alias("e")).select(F.lit(0).alias("n"), "e")
    )
    return counted.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("node_count"),
        F.coalesce(F.sum("e"), F.lit(0)).alias("edge_count"),
    )


def duplicate_summary(df: DataFrame, keys: Sequence[str], name: str, within: Sequence[str] = ()) -> DataFrame:
    """The exact number of duplicate groups (AG-4, AG-5, AG-7)."""
    return duplicate_count(df, keys, within).withColumnRenamed("n", name)


def duplicate_documents(metadata: DataFrame, limit: int | None = DOCUMENT_SAMPLE) -> DataFrame:
    """Repeated metadata ids, a row for each of their distinct files (AG-6).

    Rows instead of one array per id: an id may stand for any number of files. ``limit`` cuts
    the list of ids, not of files.
    """
    pairs = metadata.groupBy("metadata_id", "file_path").agg(F.count("*").alias("n"))
    groups = pairs.groupBy("metadata_id").agg(F.sum("n").alias("count")).where("count > 1")
    listed = groups if limit is None else groups.orderBy("metadata_id").limit(limit)
    return pairs.join(listed, "metadata_id").select("metadata_id", "count", "file_path")


def run_summary(outcomes: DataFrame) -> DataFrame:
    """Successful and failed files of a run (AG-9), from one row per file."""
    return outcomes.agg(
        F.count_if("ok").alias("successful"), F.count_if(~F.col("ok")).alias("failed")
    )


def parse_report(log: DataFrame) -> DataFrame:
    """Nodes, edges and metadata events per file (AG-10), from topic-tagged events."""

    def of(topic: str, name: str) -> Column:
        return F.count_if(F.col("topic") == topic).alias(name)

    return log.groupBy(*FILE).agg(
        of(NODES_TOPIC, "nodes"), of(EDGES_TOPIC, "edges"), of(METADATA_TOPIC, "metadata")
    )


def top_files(nodes: DataFrame, limit: int = 10) -> DataFrame:
    """Files with the most nodes (SL-2); ties go by repository and path."""
    counted = nodes.groupBy(*FILE).agg(F.count("*").alias("node_count"))
    return counted.orderBy(F.desc("node_count"), *FILE).limit(limit)


def recent_documents(metadata: DataFrame, limit: int = 10) -> DataFrame:
    """Most recently updated documents (SL-3), by time rather than by its text."""
    return (
        metadata.select(*FILE, "event_time")
        .orderBy(event_timestamp(F.col("event_time")).desc_nulls_last(), *FILE)
        .limit(limit)
    )


def first_per_topic(log: DataFrame) -> DataFrame:
    """First record of each topic (SL-5), by partition and offset; an aggregate, no window."""
    order = F.struct("partition", "offset")
    first = log.groupBy("topic").agg(F.min_by(F.struct("key", "value"), order).alias("_first"))
    return first.select("topic", "_first.key", "_first.value")
