"""Ordered neighbours within groups of any size.

A window over a group sorts that group in one task, and a group may hold a third of a table. So groups that
are too large for one task are cut into blocks of consecutive rows, windows run per block, and what a block
needs of its neighbours is carried over the borders from one row per block (or per block and key).

:func:`blocked` measures the groups and draws the borders from a sample of each large one, so that blocks
hold about equally many rows whatever the order looks like. Where a group is large it adds

* ``block``: number of the block, never decreasing along the order;
* ``is_split``: the group has more than one block.

Without these columns, groups are whole and nothing is carried.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weft.session import materialize

#: Groups of more rows are cut into blocks of about so many.
BLOCK_ROWS = 1 << 18
#: A partition holds about so many rows of the dealt out table, and no fewer than the least if there are fewer partitions than Spark's setting.
PARTITION_ROWS = 1 << 17
LEAST_ROWS = 1 << 12
#: About so many borders at most, so that they can be sent to every task; blocks grow beyond.
MAX_BLOCKS = 20_000
#: Rows drawn for each block.
DRAWN = 8


def blocked(df: DataFrame, group: Sequence[str], order: Sequence[str], rows: int | None = None, dealt: bool = False) -> DataFrame:
    """Deal ``df`` out by group, and groups of more than ``rows`` rows by blocks along ``order``.

    ``dealt`` tells that the rows of a group lie together already, in partitions of a fit size: without large groups
    nothing is moved then. If they do not, the windows move them.

    Runs an aggregate over ``df`` at once, and two more passes only where a group is large. The rows counted set
    the number of partitions too. Rows with a null in ``group`` stay whole, rows equal in the whole order stay in one block.
    """
    rows = BLOCK_ROWS if rows is None else rows
    counted = df.groupBy(*group).agg(F.count("*").alias("_rows"))
    total, in_large = counted.agg(F.sum("_rows"), F.sum(F.when(F.col("_rows") > rows, F.col("_rows")))).first()
    few = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = total or 0
    partitions = max(total // PARTITION_ROWS, min(few, total // LEAST_ROWS)) + 1
    if not in_large:
        return df if dealt else df.repartition(partitions, *group)
    # Less than MAX_BLOCKS groups exceed that size, and they have about as many borders.
    size = max(rows, in_large // MAX_BLOCKS)
    large = F.broadcast(counted.where(F.col("_rows") > size).drop("_rows"))
    drawn = df.join(large, list(group)).where(F.pmod(F.xxhash64(*order), F.lit(max(1, size // DRAWN))) == 0)
    sample = drawn.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct(*order))).alias("_drawn"))
    border = F.filter("_drawn", lambda _, at: (at > 0) & (at % DRAWN == 0))
    borders = materialize(sample.select(*group, border.alias("_borders")).where(F.size("_borders") > 0), "borders")
    laid_out = df.join(F.broadcast(borders), list(group), "left")
    here = F.struct(*order)
    # Binary search: the number of borders up to this row.
    steps = F.array(*[F.lit(1 << bit) for bit in reversed(range(MAX_BLOCKS.bit_length() + 2))])
    passed = F.aggregate(
        steps,
        F.lit(0),
        lambda found, step: F.when(F.get("_borders", found + step - 1) <= here, found + step).otherwise(found),
    )
    is_split = F.col("_borders").isNotNull()
    laid_out = laid_out.withColumn("block", F.when(is_split, passed).otherwise(0)).withColumn("is_split", is_split)
    return laid_out.drop("_borders").repartition(partitions, *group, "block")


def _layout(df: DataFrame, group: Sequence[str]) -> list[str]:
    return [*group, "block"] if "block" in df.columns else list(group)


def _within(layout: Sequence[str], *order: str) -> WindowSpec:
    """A window over ``layout``. Its hash leads the sort: most comparisons then end at one number."""
    return Window.partitionBy(F.xxhash64(*layout), *layout).orderBy(*order)


def with_next(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    value: str,
    out: str,
) -> DataFrame:
    """Add ``out``: ``value`` of the following row of the group, null on the last (WN-1).

    The heads of the next blocks come from the split groups alone.
    """
    layout = _layout(df, group)
    rows = df.withColumn(out, F.lead(value).over(_within(layout, *order)))
    if "block" not in layout:
        return rows
    heads = (
        df.where("is_split")
        .groupBy(*layout)
        .agg(F.min_by(value, F.struct(*order)).alias("_head"))
    )
    across = Window.partitionBy(*group).orderBy("block")
    following = heads.select(*layout, F.lead("_head").over(across).alias("_next_head"))
    return (
        rows.join(following, layout, "left")
        .withColumn(out, F.coalesce(out, "_next_head"))
        .drop("_next_head")
    )


def with_last(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    value: Column,
    out: str,
) -> DataFrame:
    """Add ``out``: the latest non-null ``value`` on an earlier row of the group (WN-2).

    The blocks may be those of a wider group, such as the file of a name.
    """
    layout = _layout(df, group)
    before = _within(layout, *order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("_value", value).withColumn(
        out, F.last("_value", ignorenulls=True).over(before)
    )
    if "block" not in layout:
        return rows.drop("_value")
    latest = F.max(F.when(value.isNotNull(), F.struct(*order, value.alias("_value"))))
    tails = df.where("is_split").groupBy(*layout).agg(latest["_value"].alias("_tail"))
    earlier = (
        Window.partitionBy(*group).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = tails.select(
        *layout, F.last("_tail", ignorenulls=True).over(earlier).alias("_carried")
    )
    return (
        rows.join(carried, layout, "left")
        .withColumn(out, F.coalesce(out, "_carried"))
        .drop("_value", "_carried")
    )


def with_first(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    value: Column,
    out: str,
) -> DataFrame:
    """Add ``out``: the first non-null ``value`` of the group, on all of its rows (WN-3).

    Shares exchange and sort with :func:`with_last` over the same group.
    """
    layout = _layout(df, group)
    whole = _within(layout, *order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = df.withColumn("_value", value)
    rows = rows.withColumn(out, F.first("_value", ignorenulls=True).over(whole)).drop("_value")
    if "block" not in layout:
        return rows
    split = df.where("is_split").withColumn("_value", value).where("_value IS NOT NULL")
    first = split.groupBy(*group).agg(F.min_by("_value", F.struct(*order)).alias("_first"))
    rows = rows.join(first.withColumn("is_split", F.lit(True)), [*group, "is_split"], "left")
    found = F.when(F.col("is_split"), F.col("_first")).otherwise(F.col(out))
    return rows.withColumn(out, found).drop("_first")


def with_above(df: DataFrame, group: Sequence[str], key: str, above: Column, value: str, out: str) -> DataFrame:
    """Add ``out``: ``value`` of the row of the group whose ``key`` is this row's ``above`` (JN-1).

    Keys are unique within a group; of repeated ones the smallest value counts. Every row of a block takes
    both parts, the one that is looked up and the one that looks up, and a sort of the block brings them together. Only what a block of a split group does not find in itself is looked up
    in the whole group, once per block.
    """
    layout = _layout(df, group)
    carried = [c for c in df.columns if c not in layout]
    row, kind = F.struct(*carried), StructType([df.schema[c] for c in carried])
    nothing, no_row = F.lit(None).cast(df.schema[value].dataType), F.lit(None).cast(kind)
    itself = F.struct(F.lit(0).alias("part"), F.col(key).alias("key"), F.col(value).alias("value"), no_row.alias("row"))
    looking = F.struct(F.lit(1).alias("part"), above.alias("key"), nothing.alias("value"), row.alias("row"))
    parts = df.select(*layout, F.explode(F.array(itself, looking)).alias("_p"))
    parts = parts.select(*layout, "_p.part", "_p.key", "_p.value", "_p.row")
    found = _within([*layout, "key"], "part", "value").rowsBetween(Window.unboundedPreceding, 0)
    rows = parts.withColumn("_found", F.first("value", ignorenulls=True).over(found)).where("part = 1")
    rows = rows.select(*layout, F.col("key").alias("_above"), "_found", "row.*")
    if "block" not in layout:
        return rows.withColumn(out, F.when(F.col("_above").isNotNull(), F.col("_found"))).select(*df.columns, out)
    missing = rows.where("is_split AND _found IS NULL AND _above IS NOT NULL").select(*layout, "_above").distinct()
    there = df.where("is_split").groupBy(*group, F.col(key).alias("_above")).agg(F.min(value).alias("_far"))
    far = missing.join(there, [*group, "_above"])
    rows = rows.join(far, [*layout, "_above"], "left").withColumn(out, F.coalesce("_found", "_far"))
    return rows.withColumn(out, F.when(F.col("_above").isNotNull(), F.col(out))).select(*df.columns, out)
