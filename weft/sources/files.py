"""Source files and discovery manifests (SRC-1 to SRC-4)."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable, Iterator
from fnmatch import fnmatch
from functools import reduce

import pandas as pd
import pyarrow.fs as fs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from weft.functions.text import is_excluded_path, relative_path
from weft.session import materialize

# Ship the walking and reading functions themselves, see weft.operators.extract.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


_LISTING = "path string, length bigint, is_folder boolean"
_FOLDERS_PER_TASK = 64


def _filesystem(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)


def _lister(root: str, pattern: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def below(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, _ = _filesystem(root)
        local = isinstance(store, fs.LocalFileSystem)
        for batch in batches:
            for folder in batch["path"]:
                found = []
                for entry in store.get_file_info(fs.FileSelector(folder)):
                    if entry.type == fs.FileType.Directory:
                        # A link to a folder is not a part of the tree, and may lead back into it.
                        if not (local and os.path.islink(entry.path)):
                            found.append((entry.path, None, True))
                    elif fnmatch(entry.base_name, pattern):
                        found.append((entry.path, entry.size, False))
                yield pd.DataFrame(found, columns=["path", "length", "is_folder"]).astype({"length": "Int64", "is_folder": bool})

    return below


def list_files(spark: SparkSession, root: str, pattern: str = "*.py") -> DataFrame:
    """Files below ``root`` whose name matches: path, length. No file is opened, links to folders are not followed.

    Spark's own file sources leave out empty files and names that start with ``_`` or ``.``,
    and source trees are full of both (``__init__.py``). So tasks list the folders, one level of
    the tree after the other; a level is a table, and the driver only sees how many folders it has.
    """
    store, top = _filesystem(root)
    if store.get_file_info(top).type != fs.FileType.Directory:
        raise FileNotFoundError(f"no such folder: {root}")
    levels = []
    folders, count = spark.createDataFrame([(top,)], "path string"), 1
    while count:
        tasks = max(1, -(-count // _FOLDERS_PER_TASK))
        level = materialize(folders.repartition(tasks).mapInPandas(_lister(root, pattern), _LISTING), "level")
        levels.append(level.where("NOT is_folder").select("path", "length"))
        folders = level.where("is_folder").select("path")
        count = folders.count()
    return reduce(DataFrame.unionAll, levels)


def _reader(root: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, _ = _filesystem(root)
        for batch in batches:
            names = [*batch.columns, "content", "error_type", "error_message"]
            rows, size = [], 0
            for row in batch.itertuples(index=False):
                content, kind, message = None, None, None
                try:
                    with store.open_input_stream(row.path) as source:
                        content = source.read()
                except Exception as failure:  # one file that cannot be read is one error row
                    kind, message = type(failure).__name__, str(failure)
                rows.append((*row, content, kind, message))
                size += len(content or b"")
                if size >= _READ_BYTES:
                    yield pd.DataFrame(rows, columns=names)
                    rows, size = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=names)

    return read


_READ_BYTES = 32 << 20
_TASK_BYTES = 64 << 20
_TASK_FILES = 5_000


def read_contents(listed: DataFrame, root: str) -> DataFrame:
    """Add the ``content`` of every listed ``path``, or ``error_type`` and ``error_message`` where it cannot be read.

    The listing, names and sizes only, is written once; its totals set how many tasks share the
    reading. A fixed number of partitions keeps Spark from packing the tiny rows together.
    """
    spark = listed.sparkSession
    stored = materialize(listed, "listing")
    files, size = stored.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    tasks = max(spark.sparkContext.defaultParallelism, files // _TASK_FILES, size // _TASK_BYTES)
    spread = stored.repartition(int(tasks), "path")
    return spread.mapInPandas(_reader(root), StructType([*stored.schema.fields, *_CONTENT]))


_CONTENT = (
    StructField("content", BinaryType()),
    StructField("error_type", StringType()),
    StructField("error_message", StringType()),
)


def list_sources(
    spark: SparkSession,
    root: str,
    repo_name: str,
    include_excluded: bool = False,
    pattern: str = "*.py",
) -> DataFrame:
    """Source files below ``root`` without their content (SRC-1): repo_name, file_path, path, length.

    A missing root is an error.
    """
    _, top = _filesystem(root)
    files = list_files(spark, root, pattern).select(
        F.lit(repo_name).alias("repo_name"),
        relative_path(F.col("path"), top).alias("file_path"),
        "path",
        "length",
    )
    return files if include_excluded else files.where(~is_excluded_path(F.col("file_path")))


def scan_files(
    spark: SparkSession,
    root: str,
    repo_name: str,
    include_excluded: bool = False,
    pattern: str = "*.py",
    only: str | None = None,
) -> DataFrame:
    """Source files with their content. ``only`` opens one file by its path, without listing or rules (SRC-4)."""
    if only is not None:
        return read_listed(spark, root, repo_name, spark.createDataFrame([(only,)], "file string"))
    return read_contents(list_sources(spark, root, repo_name, include_excluded, pattern), root).drop("path")


def read_listed(spark: SparkSession, root: str, repo_name: str, listed: DataFrame) -> DataFrame:
    """The files that ``listed`` (file, relative to ``root``) names, such as a manifest's; one that is absent is an error row."""
    _, top = _filesystem(root)
    named = listed.select(
        F.lit(repo_name).alias("repo_name"),
        F.col("file").alias("file_path"),
        F.concat(F.lit(top.rstrip("/") + "/"), F.col("file")).alias("path"),
        F.lit(None).cast("bigint").alias("length"),
    )
    read = read_contents(named, root).drop("path")
    return read.withColumn("length", F.length("content").cast("bigint"))


def manifest(files: DataFrame, repo_path: Column | str) -> DataFrame:
    """Discovery rows (SRC-2): root, number of files below it, one row per file.

    A row per file instead of one array keeps every row small whatever the size of a root.
    """
    root = F.lit(repo_path) if isinstance(repo_path, str) else repo_path
    rows = files.select(root.alias("repo_path"), F.col("file_path").alias("file"))
    totals = rows.groupBy("repo_path").agg(F.count("*").alias("total_files"))
    return rows.join(totals, "repo_path").select("repo_path", "total_files", "file")


def write_manifest(files: DataFrame, repo_path: str, path: str) -> None:
    """Write discovery rows as JSON lines in order of the file names."""
    manifest(files, repo_path).orderBy("file").write.mode("overwrite").json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a written manifest: repo_path, file."""
    return spark.read.schema("repo_path string, total_files bigint, file string").json(path)


def read_manifest_object(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a single-object manifest with a ``files`` array (SRC-3).

    A ``files`` entry that is missing or not an array of texts is an error.
    """
    text = spark.read.text(path, wholetext=True)
    # The array as its own text: written again, texts give the same and other values do not.
    shape = F.from_json("value", "repo_path string, files string")
    listed = text.select(shape["repo_path"].alias("repo_path"), shape["files"].alias("raw"))
    listed = listed.withColumn("files", F.from_json("raw", "array<string>"))
    valid = F.col("files").isNotNull() & (F.to_json("files") == F.col("raw")) & ~F.exists("files", lambda x: x.isNull())
    broken = F.raise_error("invalid discovery manifest").cast("array<string>")
    checked = F.when(F.coalesce(valid, F.lit(False)), F.col("files")).otherwise(broken)
    return listed.select("repo_path", F.explode(checked).alias("file"))


def files_of_manifest(scan: DataFrame, listed: DataFrame, repo_name: str) -> DataFrame:
    """Scanned files the manifest lists, plus a row without content for each missing one."""
    names = listed.select(F.col("file").alias("file_path"), F.lit(repo_name).alias("repo_name"))
    return names.join(scan, ["repo_name", "file_path"], "left")
