"""All stores of one deployment below one folder: event log, metadata table, graph tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators.contract import envelope
from weft.plans.build import Build, build
from weft.plans.reports import checkpoint_artifacts, file_state, replay_summary
from weft.schemas import EDGES_TOPIC, METADATA_TOPIC, NODES_TOPIC, SCOPES_TOPIC
from weft.session import materialize
from weft.sources.eventlog import append_log, read_log, route, stream_log
from weft.jobs.stream_jobs import GraphStore, metadata_table, start_graph, start_metadata


class ReplayError(ValueError):
    """The file of a replay has no graph to put in place of the stored one."""


@dataclass
class Workspace:
    spark: SparkSession
    path: str

    def __post_init__(self) -> None:
        self.log = f"{self.path.rstrip('/')}/log"
        self.metadata = metadata_table(self.spark, f"{self.path}/metadata")
        self.graph = GraphStore(self.spark, f"{self.path}/graph")

    def publish(self, files: DataFrame) -> Build:
        """Parse files and append their events to the log."""
        run = build(files)
        self.append(run)
        return run

    def append(self, run: Build) -> None:
        run.publish(self.log, self._next_offset())

    def clear(self, scope: DataFrame) -> None:
        """Log that the graph of the files in ``scope`` (repo_name, file_path) goes; the jobs do it in their turn."""
        now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
        append_log(route(scopes=envelope(scope.select("repo_name", "file_path"), now)), self.log, self._next_offset())

    def _next_offset(self) -> int:
        try:
            last = read_log(self.spark, self.log).agg(F.max("offset")).first()[0]
        except Exception as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            last = None
        return 0 if last is None else last + 1

    def ingest(self) -> None:
        """Run all three jobs over what the log holds beyond their checkpoints."""
        nodes, edges = (stream_log(self.spark, self.log, topic, SCOPES_TOPIC) for topic in (NODES_TOPIC, EDGES_TOPIC))
        metadata = stream_log(self.spark, self.log, METADATA_TOPIC)
        jobs = [
            *start_graph(nodes, edges, self.graph, available_now=True),
            start_metadata(metadata, self.metadata, available_now=True),
        ]
        for job in jobs:
            job.awaitTermination()

    def tables(self) -> dict[str, DataFrame]:
        return {
            "nodes": self.graph.nodes.read(),
            "edges": self.graph.edges.read(),
            "metadata": self.metadata.read(),
        }

    def replay(self, files: DataFrame, repo: str, file: str, replace: bool = True) -> DataFrame:
        """Parse one file again, replace its graph, and report the state before and after (VR-5).

        Nothing is published before the file is read and parsed: a file that is absent or
        broken is an error and leaves the stores as they are. The deletion is a record of the log like the
        events behind it. The jobs are run to completion, so the report needs no waiting time.
        """
        run = build(files)
        parsed = materialize(run.metadata, "replayed").select("repo_name", "file_path", "file_hash").take(2)
        if [(r.repo_name, r.file_path) for r in parsed] != [(repo, file)]:
            failed = run.errors.select("error_type", "error_message").first()
            reason = f"{failed.error_type}: {failed.error_message}" if failed else "no such file in the scan"
            raise ReplayError(f"{repo}:{file} cannot be replayed: {reason}")
        before = materialize(file_state(self.tables(), repo, file), "before")
        if replace:
            scope = self.spark.createDataFrame([(repo, file)], "repo_name string, file_path string")
            self.clear(scope)
        self.append(run)
        self.ingest()
        summary = replay_summary(before, self.tables(), repo, file, F.lit(parsed[0].file_hash))
        checkpoint = self.metadata.checkpoint
        return summary.select(
            F.lit("a scope record and the events behind it go through the log and the jobs").alias("protocol"),
            "*",
            F.lit(checkpoint).alias("checkpoint_location"),
            F.lit(not checkpoint_artifacts(self.spark, checkpoint).isEmpty()).alias("checkpoint_exists"),
        )
