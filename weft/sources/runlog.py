"""Run logs as text lines (SRC-8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the colour codes of terminal output.
COLOUR_CODE = "\x1b\\[[0-9;]*m"


def clean_line(text: Column) -> Column:
    """Text without colour codes and with white space collapsed."""
    return F.regexp_replace(F.regexp_replace(text, COLOUR_CODE, ""), r"\s+", " ")


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    """Cleaned log lines: log (file name), line."""
    lines = spark.read.text(path)
    return lines.select(
        F.element_at(F.split(F.input_file_name(), "/"), -1).alias("log"),
        clean_line(F.col("value")).alias("line"),
    )
