"""Near-duplicates by min-max hashing.

Each hash function is evaluated once per shingle and gives two signature values, its smallest and its
largest one. Bands of values select candidates, full shingle sets confirm them.

* Documents with equal sets become one node (its id: the smallest document id), so copies cost one row each.
* A shingle that one node alone holds is shared with nobody. So the numbers of common shingles bound the similarity
  of every pair from above, without its sets; pairs below the limit are never formed.
* Within a band's bucket every node is compared with one leader only, the node with the largest share of common
  shingles, never all with all. Links give components. Nodes of one leader that are still in different
  components can only be linked if they have enough of their differences from the leader in common; those differences are joined,
  the rare ones first and no more of them than needed. So a bucket loses no link between different components.
* A pair of similarity s shares no band with probability (1 - s**rows)**bands: 3e-6 at 0.8 with the
  defaults of 24 bands of 4 values.

Defined results: null and empty texts, and texts without words, have no shingles and stay alone; texts with
fewer words than a shingle are one shingle; rows with one id count as one document; rows with a null id
are kept and never named as a component unless nothing else is in it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm import words
from weft.llm.arrow import parts
from weft.llm.components import components
from weft.session import materialize

SHINGLE_WORDS = 5
PERCENT = 80
HASHES = 48
BAND_ROWS = 4


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def _sets(column: pa.Array, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Shingle hashes of stretches of documents, and where each document begins."""
    for _, _, data, bounds in words.byte_chunks(column):
        data = words.lower(data)
        found = words.find(data, bounds)
        yield words.shingles(found, words.hashes(data, found), size)


def signatures(docs: DataFrame, size: int, hashes: int = HASHES, rows: int = BAND_ROWS) -> DataFrame:
    """(doc_id, n_shingles, key, bands): the key tells equal sets, equal bands make candidates."""
    random = np.random.default_rng(7)
    factor = random.integers(1, 2**63, hashes, dtype=np.uint64) | np.uint64(1)
    shift = random.integers(1, 2**63, hashes, dtype=np.uint64)
    place = random.integers(1, 2**63, rows, dtype=np.uint64) | np.uint64(1)
    bands = 2 * hashes // rows

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(source):
            counts, keys, values = [], [], []
            for found, first in _sets(batch.column(1), size):
                lengths = np.diff(first)
                held = np.flatnonzero(lengths)
                sketch = np.zeros((2 * hashes, len(lengths)), dtype=np.uint64)
                for i in range(hashes if len(held) else 0):
                    each = found * factor[i] + shift[i]
                    sketch[i, held] = np.minimum.reduceat(each, first[:-1][held])
                    sketch[hashes + i, held] = np.maximum.reduceat(each, first[:-1][held])
                grouped = sketch.reshape(bands, rows, -1) * place[None, :, None]
                mixed = words.mix(grouped.sum(axis=1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64)[:, None])
                values.append(mixed.T.astype(np.int64, copy=False).view(np.int64).reshape(-1))
                for begin, end in zip(first[:-1], first[1:]):
                    own = np.unique(found[begin:end])
                    counts.append(len(own))
                    keys.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
            flat = np.concatenate(values) if values else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(np.arange(len(counts) + 1, dtype=np.int32) * bands, pa.array(flat))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), lists]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "key", "bands"])

    return _rows(docs).mapInArrow(batches, "doc_id bigint, n_shingles bigint, key binary, bands array<bigint>")


def shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, shingles): the sorted distinct hashes, eight bytes each."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(source):
            sets = [
                np.unique(found[begin:end]).tobytes()
                for found, first in _sets(batch.column(1), size)
                for begin, end in zip(first[:-1], first[1:])
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["doc_id", "shingles"])

    return _rows(docs).mapInArrow(batches, "doc_id bigint, shingles binary")


def _shared(pairs: DataFrame) -> DataFrame:
    """(a, b, shared, n_a, n_b) of pairs with both sets."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(source):
            shared = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                shared.append(int(np.count_nonzero(both[1:] == both[:-1])))
            sizes = [pa.array([v.as_buffer().size // 8 for v in batch.column(i)], pa.int64()) for i in (2, 3)]
            columns = [batch.column(0), batch.column(1), pa.array(shared, pa.int64()), *sizes]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", "shared", "n_a", "n_b"])

    return pairs.select("a", "b", "set_a", "set_b").mapInArrow(
        batches, "a bigint, b bigint, shared bigint, n_a bigint, n_b bigint"
    )


def _compare(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Exact counts for ``pairs`` (a, b): the shared shingles, both sizes and the size of the union."""
    set_a, set_b = (sets.select(F.col("doc_id").alias(c), F.col("shingles").alias(f"set_{c}")) for c in "ab")
    shared = _shared(pairs.join(set_a, "a").join(set_b, "b"))
    return materialize(shared.withColumn("union", F.expr("n_a + n_b - shared")), "compared")


def _common(sets: DataFrame) -> DataFrame:
    """(id, common): how many shingles of each node any other node of ``sets`` has too."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(source):
            found = [np.frombuffer(v.as_buffer(), np.int64) for v in batch.column(1)]
            owner = np.repeat(batch.column(0).to_numpy(), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(np.concatenate(found))], ["id", "shingle"])

    each = sets.mapInArrow(batches, "id bigint, shingle bigint")
    single = each.groupBy("shingle").agg(F.count("*").alias("nodes"), F.min("id").alias("id")).filter("nodes = 1")
    single = single.groupBy("id").agg(F.count("*").alias("single"))
    sized = sets.select(F.col("doc_id").alias("id"), (F.length("shingles") / 8).cast("bigint").alias("n_"))
    common = sized.join(single, "id", "left").select("id", (F.col("n_") - F.coalesce("single", F.lit(0))).alias("common"))
    return materialize(common, "common")


def _mixed(members: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of ``members`` with their components, of buckets that hold several components."""
    known = members.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    several = known.groupBy("bucket").agg(F.min("component").alias("least"), F.max("component").alias("most")).filter("least < most")
    return known.join(several.select("bucket"), "bucket")


def near_duplicates(docs: DataFrame, size: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``."""
    signed = materialize(signatures(docs, size), "signatures")
    nodes = materialize(
        signed.filter("n_shingles > 0 and doc_id is not null")
        .groupBy("key")
        .agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")),
        "nodes",
    )
    placed = nodes.select("id", "n", F.explode("bands").alias("bucket"))
    sizes = placed.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    shared = materialize(placed.join(sizes, "bucket"), "placed")
    # A merge join whatever the size: texts move once, in proportion to the input.
    chosen = _rows(docs).join(shared.select(F.col("id").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi")
    sets = materialize(shingle_sets(chosen.dropDuplicates(["doc_id"]), size), "sets")
    members = shared.join(_common(sets), "id")
    # The leader is the node with the largest share of common shingles: in a group of edited copies, the text they come from.
    leaders = members.groupBy("bucket").agg(F.max_by(F.struct("id", "n", "common"), F.struct(F.col("common") / F.col("n"), -F.col("id"))).alias("lead"))
    members = members.join(leaders, "bucket").select(
        "bucket", "id", "n", "common", "size", *(F.col(f"lead.{c}").alias(f"{c}_lead") for c in ("id", "n", "common"))
    )
    members = materialize(members.withColumnRenamed("id_lead", "leader"), "members")

    def fits(a: str, b: str) -> str:
        """Whether the common shingles allow a link: at most the smaller number is shared."""
        most = f"least({a.format('common')}, {b.format('common')})"
        return f"100 * {most} >= {percent} * ({a.format('n')} + {b.format('n')} - {most})"

    linked = f"100 * shared >= {percent} * union"
    first = members.filter(f"id <> leader and {fits('{}', '{}_lead')}")
    pairs = first.select(F.greatest("id", "leader").alias("a"), F.least("id", "leader").alias("b")).distinct()
    compared = _compare(sets, materialize(pairs, "pairs"))
    links = compared.filter(linked).select("a", "b")
    found = materialize(components(links), "components")

    rest = materialize(_rest(members.filter("size > 2"), compared, found, sets, fits, percent), "rest")
    if not rest.isEmpty():
        links = links.union(_compare(sets, rest).filter(linked).select("a", "b"))
        found = materialize(components(links), "components")

    named = nodes.join(found, "id", "left").select("key", F.coalesce("component", "id").alias("component_id"))
    named = named.withColumn("has", F.lit(True))
    joined = signed.join(named, "key", "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("has"), F.col("component_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def _differences(members: DataFrame, sets: DataFrame) -> DataFrame:
    """``members`` (leader, id, ...) with ``differences``: the shingles that only one of the node and its leader has."""
    kept = members.columns
    own, lead = (sets.select(F.col("doc_id").alias(c), F.col("shingles").alias(f"set_{c}")) for c in ("id", "leader"))

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(source):
            found = []
            for x, y in zip(batch.column(0), batch.column(1)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                found.append(np.setxor1d(x, y, assume_unique=True).view(np.int64))
            bounds = np.cumsum([0, *map(len, found)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(bounds, pa.array(np.concatenate([np.zeros(0, np.int64), *found])))
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], lists], [*kept, "differences"])

    schema = ", ".join(f"{c} {t}" for c, t in members.dtypes)
    return members.join(own, "id").join(lead, "leader").select("set_id", "set_leader", *kept).mapInArrow(batches, f"{schema}, differences array<bigint>")


def _rest(members: DataFrame, compared: DataFrame, found: DataFrame, sets: DataFrame, fits, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes with one leader in several components that may still be links.

    With x and y the differences of two nodes from their leader, and o those they have in common, the nodes differ in x + y - 2 o
    shingles. So a link needs 2 * (100 + percent) * o >= the sum of both weights, (100 + percent) * x - (100 - percent) * n each.
    The sum is positive unless both nodes are linked to the leader, which puts them in one component. Differences are ordered from rare
    to frequent; nodes with o of them in common share one of the first x - o + 1 of each, and have o - 1 more to come behind the first.
    """
    linked = F.expr(f"100 * shared >= {percent} * union").alias("linked")
    ends = compared.select(F.col("a").alias("id"), F.col("b").alias("leader"), linked).union(compared.select("b", "a", linked))
    known = _mixed(members.filter("id <> leader"), found).select("leader", "id", "n", "common", "component").distinct()
    # Not compared with the leader because of the sizes: no link.
    known = known.join(ends, ["id", "leader"], "left").withColumn("linked", F.coalesce("linked", F.lit(False)))
    known = _differences(known, sets).withColumn("size", F.size("differences"))
    known = materialize(known.withColumn("weight", F.expr(f"{100 + percent} * size - {100 - percent} * n")), "differences")
    least = known.groupBy("leader").agg(F.min("weight").alias("least"), F.min(F.when(~F.col("linked"), F.col("weight"))).alias("least_apart"))
    other = F.when(F.col("linked"), F.col("least_apart")).otherwise(F.col("least"))
    needed = F.greatest(F.lit(1), F.ceil((F.col("weight") + other) / (2 * (100 + percent))))
    each = known.join(least.filter("least_apart is not null"), "leader").withColumn("needed", needed).filter("needed <= size")
    each = each.withColumn("difference", F.explode("differences")).drop("differences")
    holders = each.groupBy("leader", "difference").agg(F.count("*").alias("holders")).filter("holders > 1")
    own = Window.partitionBy("leader", "id")
    # Differences of one node alone come first, and are not joined.
    place = F.col("size") - F.count("*").over(own) + F.row_number().over(own.orderBy("holders", "difference"))
    placed = each.join(holders, ["leader", "difference"]).withColumn("place", place).filter("place <= size - needed + 1")
    placed = materialize(placed.drop("least", "least_apart", "needed", "holders"), "differences-placed")
    a, b = placed.alias("a"), placed.alias("b")
    pairs = a.join(
        b,
        F.expr(
            "a.leader = b.leader and a.difference = b.difference and a.id < b.id and a.component <> b.component and not (a.linked and b.linked) "
            f"and {2 * (100 + percent)} * (1 + least(a.size - a.place, b.size - b.place)) >= a.weight + b.weight and {fits('a.{}', 'b.{}')}"
        ),
    )
    asked = pairs.select(F.col("b.id").alias("a"), F.col("a.id").alias("b")).distinct()
    return asked.join(compared.select("a", "b"), ["a", "b"], "left_anti")
