"""Stream jobs that keep the stores current (SS-1 to SS-8, SNK-3 to SNK-7).

Each job is project, filter and ``foreachBatch`` with a keyed write. The checkpoint owns the
offsets; a batch that is retried gives the same rows again, so at-least-once delivery gives
exactly-once tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weft.operators.contract import (
    backfill_metadata_id,
    decode,
    split_valid,
    stamp_ingestion,
    validate,
    with_required_key,
)
from weft.operators.file_table import FileTable
from weft.operators.keyed_table import KeyedTable
from weft.operators.merge import (
    FILE,
    graph_edges,
    graph_files,
    graph_nodes,
    graph_repositories,
    incident_edges,
    newest_rows,
    placeholders,
)
from weft.schemas import (
    EDGES_TOPIC,
    GRAPH_EDGE,
    GRAPH_FILE,
    GRAPH_NODE,
    GRAPH_REPOSITORY,
    METADATA,
    NODES_TOPIC,
    SCOPES_TOPIC,
    STORED_METADATA,
)
from weft.session import materialize

# Within one key records share a partition, so the offset orders them.
LOG_ORDER = ("offset", "partition")

# Options of a document-store connector for replace-with-upsert by metadata_id.
DOCUMENT_UPSERT_OPTIONS = {
    "operationType": "replace",
    "idFieldList": "metadata_id",
    "upsertDocument": "true",
    "ordered": "false",
}


def metadata_table(spark: SparkSession, path: str) -> KeyedTable:
    return KeyedTable(spark, path, STORED_METADATA, ["metadata_id"])


def metadata_records(log: DataFrame) -> DataFrame:
    """All metadata records, typed as far as they can be read, with their log order and text."""
    return decode(log, METADATA, (*LOG_ORDER, "value"))


def usable(records: DataFrame) -> DataFrame:
    """The records that name their file, each with an identity (PRJ-6, PRJ-7)."""
    return backfill_metadata_id(with_required_key(records))


def metadata_events(log: DataFrame) -> DataFrame:
    """Typed metadata events with their log order, usable ones only (PRJ-5 to PRJ-7)."""
    return usable(metadata_records(log)).drop("value")


def rejected_metadata(records: DataFrame) -> DataFrame:
    """The other records, with their text and the reason (SNK-7)."""
    fields = F.coalesce(*[F.col(f).cast("string") for f in METADATA.fieldNames()])
    reason = (
        F.when(fields.isNull(), "malformed json")
        .when(F.col("repo_name").isNull(), "missing repo_name")
        .when(F.col("file_path").isNull(), "missing file_path")
    )
    rows = records.withColumn("reject_reason", reason).where("reject_reason IS NOT NULL")
    return rows.select(*LOG_ORDER, "value", "reject_reason")


def upsert_metadata(table: KeyedTable) -> Callable[[DataFrame, int], None]:
    """Batch function: stamp, then replace by ``metadata_id`` (SNK-3). Records that cannot be used are kept aside."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        if "value" not in batch.columns:
            table.upsert(stamp_ingestion(batch, batch_id), batch_id, LOG_ORDER)
            return
        batch = batch.persist()
        try:
            rejected_metadata(batch).write.mode("overwrite").parquet(f"{table.rejects}/{batch_id}")
            table.upsert(stamp_ingestion(usable(batch).drop("value"), batch_id), batch_id, LOG_ORDER)
        finally:
            batch.unpersist()

    return apply


def document_store_writer(options: dict[str, str]) -> Callable[[DataFrame, int], None]:
    """Batch function that writes through a document-store connector instead of a table.

    ``options`` name the connector's format, connection, database and collection.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        settings = {**DOCUMENT_UPSERT_OPTIONS, **options}
        source = settings.pop("format")
        stamped = stamp_ingestion(batch, batch_id).drop(*LOG_ORDER)
        stamped.write.format(source).mode("append").options(**settings).save()

    return apply


def start(
    rows: DataFrame,
    apply: Callable[[DataFrame, int], None],
    checkpoint: str,
    available_now: bool = False,
):
    """Start a ``foreachBatch`` query in append mode with the default trigger (SS-2)."""
    writer = rows.writeStream.foreachBatch(apply).outputMode("append")
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def start_metadata(log: DataFrame, table: KeyedTable, available_now: bool = False):
    """The metadata job (SS-1)."""
    return start(metadata_records(log), upsert_metadata(table), table.checkpoint, available_now)


class GraphStore:
    """Keyed tables of the graph below one folder.

    The node and the edge job write different tables, so events may arrive in any order;
    placeholder nodes are the read-time difference of edge ends and nodes.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.path = path.rstrip("/")
        self.repositories = KeyedTable(spark, f"{path}/repositories", GRAPH_REPOSITORY, ["name"])
        self.files = KeyedTable(spark, f"{path}/files", GRAPH_FILE, ["id"])
        self.nodes = FileTable(spark, f"{path}/nodes", GRAPH_NODE)
        self.edges = FileTable(spark, f"{path}/edges", GRAPH_EDGE)
        self.rejects = f"{path}/rejects"

    def placeholders(self) -> DataFrame:
        return placeholders(self.nodes.read(), self.edges.read())

    @contextmanager
    def _valid(self, batch: DataFrame, topic: str, batch_id: int | str) -> Iterator[DataFrame]:
        """Valid events of a batch; rejected records go to a table of their own (SNK-7).

        Several tables are written from one batch, so its parsed rows are kept meanwhile.
        """
        checked = validate(batch, topic).persist()
        try:
            valid, rejected = split_valid(checked)
            rejected.select(*LOG_ORDER, "value", "reject_reason").write.mode("overwrite").parquet(
                f"{self.rejects}/{topic}/{batch_id}"
            )
            yield valid
        finally:
            checked.unpersist()

    def _merge(self, batch: DataFrame, topic: str, batch_id: int, write: Callable[[DataFrame, DataFrame], None]) -> None:
        """Hand the valid events of a batch and the files that it clears to ``write``.

        A scope record clears what stands before it in the log, within the batch too (SS-6).
        """
        is_scope = F.col("topic") == SCOPES_TOPIC
        with self._valid(batch.where(is_scope), SCOPES_TOPIC, f"{topic}-{batch_id}") as scopes:
            cleared = scopes.groupBy(*FILE).agg(F.max(F.struct(*LOG_ORDER)).alias("_since")).persist()
            try:
                with self._valid(batch.where(~is_scope), topic, batch_id) as events:
                    later = events.join(cleared, list(FILE), "left")
                    later = later.where(F.col("_since").isNull() | (F.struct(*LOG_ORDER) > F.col("_since"))).drop("_since")
                    write(later, cleared)
            finally:
                cleared.unpersist()

    def apply_nodes(self, batch: DataFrame, batch_id: int) -> None:
        """Merge node events: repository, file, node (SNK-4, DM-2)."""

        def write(events: DataFrame, cleared: DataFrame) -> None:
            newest = newest_rows(graph_nodes(events, LOG_ORDER), ["id"], LOG_ORDER)
            self.nodes.apply(newest.drop(*LOG_ORDER), cleared)
            self.files.upsert(graph_files(events, LOG_ORDER), batch_id)
            self.repositories.upsert(graph_repositories(events), batch_id)

        self._merge(batch, NODES_TOPIC, batch_id, write)

    def apply_edges(self, batch: DataFrame, batch_id: int) -> None:
        """Merge edge events (SNK-5, DM-3). A scope clears a file's own edges, whose ends are nodes of that file."""

        def write(events: DataFrame, cleared: DataFrame) -> None:
            newest = newest_rows(graph_edges(events, LOG_ORDER), ["id"], LOG_ORDER)
            self.edges.apply(newest.drop(*LOG_ORDER), cleared)

        self._merge(batch, EDGES_TOPIC, batch_id, write)

    def delete_files(self, scope: DataFrame) -> DataFrame:
        """Delete the nodes of files and all edges at them, from other files too (DM-4), between two batches.

        Returns the deleted nodes. What a later batch merges stays.
        """
        gone = materialize(self.nodes.read_files(scope), "deleted")
        self.edges.delete(materialize(incident_edges(self.edges.read(), gone), "deleted-edges"))
        self.nodes.delete(gone)
        return gone


def start_graph(
    node_log: DataFrame, edge_log: DataFrame, store: GraphStore, available_now: bool = False
):
    """The two graph jobs (SS-8). Either log may hold scope records besides its own events."""
    nodes = start(node_log, store.apply_nodes, f"{store.path}/checkpoints/nodes", available_now)
    edges = start(edge_log, store.apply_edges, f"{store.path}/checkpoints/edges", available_now)
    return nodes, edges


#: Ids are dealt to so many groups of state by a hash. Python is called once per group and batch, and a group is written as a whole when
#: one of its ids comes; a checkpoint holds for one number.
STATE_GROUPS = 1 << 13


def _resolve(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """What becomes of the ids of a group: those whose nodes were seen, and those reported as placeholders."""
    nodes, reported = map(set, state.get) if state.exists else (set(), set())
    ends = set()
    for part in parts:
        is_node = part["is_node"].to_numpy(dtype=bool)
        nodes.update(part["id"][is_node])
        ends.update(part["id"][~is_node])
    resolved, new = reported & nodes, ends - nodes - reported
    state.update((sorted(nodes), sorted(reported - resolved | new)))
    if resolved or new:
        yield pd.DataFrame({"id": [*resolved, *new], "change": ["resolved"] * len(resolved) + ["placeholder"] * len(new)})


def placeholder_changes(graph_log: DataFrame) -> DataFrame:
    """Placeholders as they come and go (JN-6, SS-5): (id, change) of a log with node and edge events.

    An end of an edge whose node no batch has brought yet is a ``placeholder``; when its node comes, it is
    ``resolved``. The ids of both kinds are kept as state, in groups by a hash of the id; ends and nodes of a batch may arrive in
    any order, and an end that follows its node gives nothing.
    """
    text = F.col("value").cast("string")
    is_node = F.col("topic") == NODES_TOPIC
    ends = F.array(F.get_json_object(text, "$.source_id"), F.get_json_object(text, "$.target_id"))
    ids = F.when(is_node, F.array(F.get_json_object(text, "$.node_id"))).otherwise(ends)
    rows = graph_log.where(F.col("topic").isin(NODES_TOPIC, EDGES_TOPIC)).select(is_node.alias("is_node"), F.explode(ids).alias("id"))
    named = rows.where("id IS NOT NULL").withColumn("state_group", F.pmod(F.xxhash64("id"), F.lit(STATE_GROUPS))).groupBy("state_group")
    shape, kept = "id string, change string", "nodes array<string>, reported array<string>"
    return named.applyInPandasWithState(_resolve, shape, kept, "append", GroupStateTimeout.NoTimeout)


def start_placeholders(graph_log: DataFrame, path: str, available_now: bool = False):
    """Append the changes of placeholders below ``path``, with a checkpoint beside them."""
    writer = placeholder_changes(graph_log).writeStream.format("parquet").outputMode("append")
    writer = writer.option("path", f"{path}/changes").option("checkpointLocation", f"{path}/checkpoint")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
