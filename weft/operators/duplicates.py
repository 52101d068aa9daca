"""Keys that occur more than once, counted by hash before they are moved."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from weft.session import materialize

# More than the rows that share a hash.
ALSO_THERE = 1 << 40


def _noted(df: DataFrame, keys: Sequence[str], within: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with their ``count`` and ``_hash``, counted ``within`` first, and the hashes of keys that may repeat, written, with a number ``_n``.

    ``_n`` tells both how many rows share a hash (modulo ``ALSO_THERE``) and whether one of them stands for several.
    """
    rows = df.select(*within, *keys)
    if within:
        # Nulls are dropped by a count: a filter would move below the aggregate and compute the key once more for every row.
        rows = rows.groupBy(*within, *keys).agg(F.count("*").alias("count"), F.count(keys[0]).alias("_known"))
        rows = (rows.where("_known > 0") if len(keys) == 1 else rows).drop("_known")
    else:
        rows = rows.where(F.col(keys[0]).isNotNull()) if len(keys) == 1 else rows
        rows = rows.withColumn("count", F.lit(1).cast("bigint"))
    hashed = rows.withColumn("_hash", F.xxhash64(*keys))
    several = F.when(F.col("count") > 1, F.lit(ALSO_THERE)).otherwise(0)
    noted = hashed.groupBy("_hash").agg(F.sum(several + 1).alias("_n")).where("_n > 1")
    return hashed, materialize(noted, "repeated-hashes")


def _shared(noted: DataFrame) -> DataFrame:
    """The hashes of several rows, which may be one key or some."""
    return noted.where(F.col("_n") % ALSO_THERE > 1).select("_hash")


def _counted(hashed: DataFrame, shared: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys of those hashes that have more than one row."""
    return hashed.join(shared, "_hash", "left_semi").groupBy(*keys).agg(F.sum("count").alias("count")).where("count > 1")


def duplicate_count(df: DataFrame, keys: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """The number ``n`` of the groups that :func:`duplicate_groups` gives, in one row.

    A hash of one row that stands for several is one group, whatever its key is: ``df`` is read twice only where different rows share a hash.
    """
    hashed, noted = _noted(df, keys, within)
    shared = _shared(noted)
    groups = noted.where(F.col("_n") % ALSO_THERE == 1).select(F.lit(1).alias("_group"))
    if not shared.isEmpty():
        groups = groups.unionAll(_counted(hashed, shared, keys).select(F.lit(1)))
    return groups.agg(F.count("*").alias("n"))


def duplicate_groups(df: DataFrame, keys: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """Keys with more than one row and their row count; null keys are skipped for single keys.

    Two phases: 64-bit hashes of the keys are counted at once, and only rows whose hash repeats are counted by
    their keys. A clean table moves one number per row, whatever its keys are. ``df`` is read twice where it is not.
    Rows that lie together by the columns ``within`` are counted there first: then only keys that repeat across them are moved.
    A clean table is read once.
    """
    kinds = df.select(*keys).schema.fields
    hashed, noted = _noted(df, keys, within)
    if noted.isEmpty():
        return df.sparkSession.createDataFrame([], StructType([*kinds, StructField("count", LongType())]))
    there = hashed.where("count > 1").select(*keys, "count")
    shared = _shared(noted)
    if shared.isEmpty():
        return there
    counted = _counted(hashed, shared, keys)
    if not within:
        return counted
    alone = hashed.where("count > 1").join(shared, "_hash", "left_anti")
    return counted.unionByName(alone.select(*keys, "count"))
