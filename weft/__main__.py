"""Command line: python -m weft <command> --help."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators.contract import display, find_metadata
from weft.operators.graph import edge_sample, one_file_counts
from weft.operators.rollup import GRAPH_SAMPLE, duplicate_documents, duplicate_groups
from weft.plans import reports
from weft.plans.build import build
from weft.sources.files import list_sources, read_listed, read_manifest, scan_files, write_manifest
from weft.workspace import ReplayError, Workspace


def _show(df: DataFrame, rows: int = 40) -> None:
    """A table of a few rows, or the beginning of one; what must be whole goes through ``_show_all``."""
    df.show(rows, truncate=False)


def _show_all(df: DataFrame) -> None:
    """Every row as a line, a partition at a time."""
    for row in df.toLocalIterator():
        print(" ".join(f"{k}={'' if v is None else v}" for k, v in row.asDict().items()))


def _scan(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    if getattr(args, "manifest", None):
        listed = read_manifest(spark, args.manifest).select("file")
        if args.file:
            listed = listed.where(F.col("file") == args.file)
        return read_listed(spark, args.root, args.repo, listed)
    return scan_files(spark, args.root, args.repo, args.include_excluded, only=args.file)


def discover(spark: SparkSession, args: argparse.Namespace) -> int:
    files = list_sources(spark, args.root, args.repo, args.include_excluded)
    write_manifest(files, args.root, args.output)
    # Fixed value: a line that run-log reports look for.
    print(f"Discovered {files.count()} Python files")
    _show(files.select("file_path").orderBy("file_path"), 10)
    return 0


def parse(spark: SparkSession, args: argparse.Namespace) -> int:
    files = _scan(spark, args)
    run = build(files) if args.dry_run else Workspace(spark, args.workspace).publish(files)
    _show_all(run.report().orderBy("file_path"))
    _show_all(run.errors.select("file_path", "error_type", "error_message").orderBy("file_path"))
    # Fixed value: a line that run-log reports look for.
    print(f"Finished: successful={run.parsed['successful']} failed={run.parsed['failed']}")
    return 3 if args.file and not run.parsed["successful"] else 0


def ingest(spark: SparkSession, args: argparse.Namespace) -> int:
    Workspace(spark, args.workspace).ingest()
    return 0


def verify_graph(spark: SparkSession, args: argparse.Namespace) -> int:
    store = Workspace(spark, args.workspace).graph
    nodes, edges = store.nodes.read(), store.edges.read()
    health = reports.graph_health(nodes, edges)
    _show(health)
    for table in (nodes, edges):
        _show(duplicate_groups(table, ["id"]).orderBy("id"), GRAPH_SAMPLE)
    if args.file:
        _show(one_file_counts(store.nodes.read(args.repo, args.file), edges, args.repo, args.file))
        _show(edge_sample(edges, nodes, args.repo, args.file))
    return 0 if health.first().passed else 1


def verify_metadata(spark: SparkSession, args: argparse.Namespace) -> int:
    metadata = Workspace(spark, args.workspace).metadata.read()
    health = reports.metadata_health(metadata)
    _show(health)
    _show_all(duplicate_documents(metadata))
    if args.file:
        _show(display(find_metadata(metadata, args.repo, args.file)))
    return 0 if health.first().passed else 1


def stats(spark: SparkSession, args: argparse.Namespace) -> int:
    stores = Workspace(spark, args.workspace)
    _show(reports.graph_statistics(stores.graph.nodes.read(), stores.graph.edges.read()))
    _show(reports.metadata_statistics(stores.metadata.read()))
    return 0


def cleanup(spark: SparkSession, args: argparse.Namespace) -> int:
    scope = spark.createDataFrame([(args.repo, args.file)], "repo_name string, file_path string")
    deleted = Workspace(spark, args.workspace).graph.delete_files(scope).count()
    print(f"File cleanup: repo={args.repo} file={args.file} nodes_deleted={deleted}")
    return 0


def replay(spark: SparkSession, args: argparse.Namespace) -> int:
    if args.dry_run:
        return parse(spark, args)
    stores = Workspace(spark, args.workspace)
    try:
        summary = stores.replay(_scan(spark, args), args.repo, args.file, replace=not args.keep_graph)
    except ReplayError as failure:
        print(failure)
        return 3
    if args.output:
        reports.write_evidence(summary, args.output)
    _show(reports.evidence_lines(summary).orderBy("position").select("line"))
    return 0 if summary.first().passed else 3


def resume_check(spark: SparkSession, args: argparse.Namespace) -> int:
    """Documents and checkpoint files before and after another run of the jobs."""
    stores = Workspace(spark, args.workspace)
    checkpoint = stores.metadata.checkpoint
    artifacts_before = reports.checkpoint_artifacts(spark, checkpoint).count()
    before = stores.metadata.read().count()
    time.sleep(args.seconds)
    stores.ingest()
    after = stores.metadata.read().count()
    artifacts = reports.checkpoint_artifacts(spark, checkpoint).count()
    verdict = reports.resume_verdict(before, after, artifacts)
    lines = [
        f"checkpoint_location={checkpoint}",
        f"checkpoint_exists={artifacts > 0}",
        f"checkpoint_artifacts_before={artifacts_before}",
        f"checkpoint_artifacts_after={artifacts}",
        f"metadata_count_before={before}",
        f"metadata_count_after={after}",
        verdict,
    ]
    print("\n".join(lines))
    if args.output:
        rows = spark.createDataFrame(list(enumerate(lines)), "position int, line string").coalesce(1)
        rows.sortWithinPartitions("position").select("line").write.mode("overwrite").text(args.output)
    return 0 if "PASSED" in verdict else 1


def compact(spark: SparkSession, args: argparse.Namespace) -> int:
    """Merge the batches of every table into a new base."""
    stores = Workspace(spark, args.workspace)
    for table in (stores.metadata, stores.graph.files, stores.graph.repositories):
        table.compact()
    return 0


def reset(spark: SparkSession, args: argparse.Namespace) -> int:
    Workspace(spark, args.workspace).metadata.reset()
    print("Metadata table is empty; the graph was not changed.")
    return 0


_COMMANDS = {
    "discover": (discover, "root repo output include_excluded"),
    "parse": (parse, "workspace? root repo file? manifest? include_excluded dry_run"),
    "ingest": (ingest, "workspace"),
    "verify-graph": (verify_graph, "workspace repo? file?"),
    "verify-metadata": (verify_metadata, "workspace repo? file?"),
    "stats": (stats, "workspace"),
    "cleanup": (cleanup, "workspace repo file"),
    "replay": (replay, "workspace root repo file include_excluded dry_run keep_graph output?"),
    "resume-check": (resume_check, "workspace seconds output?"),
    "compact": (compact, "workspace"),
    "reset": (reset, "workspace"),
}
_FLAGS = ("include_excluded", "dry_run", "keep_graph")


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="weft")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, (_, words) in _COMMANDS.items():
        command = commands.add_parser(name)
        for word in words.split():
            option = "--" + word.rstrip("?").replace("_", "-")
            if word in _FLAGS:
                command.add_argument(option, action="store_true")
            elif word == "seconds":
                command.add_argument(option, type=float, default=10.0)
            else:
                command.add_argument(option, required=not word.endswith("?"))
    return parser


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"weft-{args.command}").getOrCreate()
    return _COMMANDS[args.command][0](spark, args)


if __name__ == "__main__":
    sys.exit(main())
