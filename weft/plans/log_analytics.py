"""Reports over run logs, evidence files and JSON dumps (LA-1 to LA-8)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.sources.files import list_files

# Fixed value: the form of a per-file parse line.
PARSED_LINE = r"Parsed\s+(.+?):\s+nodes=(\d+)\s+edges=(\d+)\s+metadata=(\d+)"


def parsed_rows(lines: DataFrame) -> DataFrame:
    """Per-file counts out of log lines ``(log, line)`` (LA-1); a line may hold several."""
    hits = F.explode(F.regexp_extract_all("line", F.lit(PARSED_LINE), F.lit(0))).alias("hit")
    found = lines.where(F.contains("line", F.lit("Parsed"))).select("log", hits)

    def group(number: int) -> Column:
        return F.regexp_extract("hit", PARSED_LINE, number)

    return found.select(
        "log",
        F.trim(group(1)).alias("file_path"),
        *[group(n).cast("int").alias(c) for n, c in ((2, "nodes"), (3, "edges"), (4, "metadata"))],
    )


def last_ints(lines: DataFrame, patterns: dict[str, str], order: str = "line_no") -> DataFrame:
    """The last integer each pattern captures in each log, ignoring case (LA-2).

    Reduced to one candidate per log and partition before the shuffle.
    """

    def last(pattern: str, name: str) -> Column:
        hits = F.regexp_extract_all("line", F.lit(f"(?i){pattern}"), F.lit(1))
        value = F.when(F.size(hits) > 0, F.element_at(hits, -1).cast("bigint"))
        return F.max_by(value, F.when(value.isNotNull(), F.col(order))).alias(name)

    return lines.groupBy("log").agg(*[last(p, name) for name, p in patterns.items()])


def key_values(lines: DataFrame, order: str = "line_no") -> DataFrame:
    """``key=value`` lines as rows, split at the first ``=``; a repeated key keeps its last (LA-3)."""
    at = F.instr("line", "=")
    pairs = lines.where(F.contains("line", F.lit("="))).select(
        "log",
        F.trim(F.substr("line", F.lit(1), at - 1)).alias("key"),
        F.trim(F.substr("line", at + 1)).alias("value"),
        order,
    )
    return pairs.groupBy("log", "key").agg(F.max_by("value", order).alias("value"))


def presence_flags(lines: DataFrame, needles: dict[str, str | tuple[str, ...]]) -> DataFrame:
    """Whether any line of a log holds a text, or one of several (LA-4)."""

    def holds(needle: str | tuple[str, ...]) -> Column:
        texts = (needle,) if isinstance(needle, str) else needle
        return reduce(lambda a, b: a | b, [F.contains("line", F.lit(t)) for t in texts])

    return lines.groupBy("log").agg(*[F.bool_or(holds(n)).alias(name) for name, n in needles.items()])


def discovery_summary(manifest_rows: DataFrame, shown: int = 10) -> DataFrame:
    """Files per root and how many a report would show (LA-5)."""
    return manifest_rows.groupBy("repo_path").agg(
        F.count("file").alias("total_files"),
        F.least(F.lit(shown).cast("bigint"), F.count("file")).alias("sample_count_displayed"),
    )


def assessment(row: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """All checks over a one-row table, and whether every one holds (LA-6)."""
    verdicts = {name: F.coalesce(check, F.lit(False)) for name, check in checks.items()}
    everything = reduce(lambda a, b: a & b, verdicts.values())
    return row.select(*[v.alias(n) for n, v in verdicts.items()], everything.alias("all_passed"))


def artifact_inventory(spark: SparkSession, root: str, required: DataFrame) -> DataFrame:
    """Required files ``(artifact)`` below a root: present, and how large (LA-7).

    Only names and sizes are read.
    """
    prefix = root.rstrip("/") + "/"
    found = list_files(spark, root, "*").select(
        F.substr("path", F.lit(len(prefix) + 1)).alias("artifact"), F.col("length").alias("size_bytes")
    )
    return required.join(found, "artifact", "left").select(
        "artifact", F.col("size_bytes").isNotNull().alias("exists"), "size_bytes"
    )


def index_rows(texts: DataFrame) -> DataFrame:
    """Index definitions ``(log, text)`` as rows, ``unique`` false by default (LA-8).

    A text that is no JSON array keeps one row with ``parse_error``.
    """
    shape = "array<struct<name: string, key: map<string, int>, unique: boolean>>"
    parsed = F.from_json("text", shape)
    rows = texts.select("log", parsed.isNull().alias("parse_error"), F.explode_outer(parsed).alias("i"))
    return rows.select(
        "log",
        "parse_error",
        "i.name",
        F.to_json("i.key").alias("key"),
        F.coalesce("i.unique", F.lit(False)).alias("unique"),
    )
