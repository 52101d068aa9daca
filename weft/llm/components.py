"""Connected components of a table of links, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.session import materialize


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in ``links`` (a, b): component is the smallest id reachable.

    Each round moves every node to one of its neighbours or leaves it, and drops the links that have
    become loops. Rounds order nodes by id and by a hash in turn: the first ends stars around
    their smallest node at once, the second halves chains. No node's links meet in one row, and counts
    and minima are reduced before each shuffle. No links give no rows.
    """
    links = materialize(
        links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links"
    )
    labels = materialize(links.select("a").union(links.select("b")).distinct().select(F.col("a").alias("id"), F.col("a").alias("root")), "labels")
    turn = 0
    while not links.isEmpty():
        ends = links.select(F.col("a").alias("id"), F.col("b").alias("other")).union(links.select("b", "a"))
        order = (lambda c: F.col(c)) if turn % 2 == 0 else (lambda c: F.xxhash64(F.col(c), F.lit(turn)))
        best = ends.groupBy("id").agg(F.min_by("other", order("other")).alias("other"))
        moved = materialize(
            best.select("id", F.when(order("other") < order("id"), F.col("other")).otherwise(F.col("id")).alias("to")), "moved"
        )
        labels = materialize(
            labels.join(moved, labels.root == moved.id, "left").select(labels.id, F.coalesce("to", "root").alias("root")), "labels"
        )
        at_a, at_b = (moved.select(F.col("id").alias(c), F.col("to").alias(f"{c}_to")) for c in "ab")
        links = links.join(at_a, "a").join(at_b, "b").filter("a_to <> b_to")
        links = materialize(links.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct(), "links")
        turn += 1
    smallest = labels.groupBy("root").agg(F.min("id").alias("component"))
    return labels.join(smallest, "root").select("id", "component")
