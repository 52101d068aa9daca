"""Hard negatives by a vertical scan of embeddings (branch and bound on decomposed data, BOND).

Components ``c`` become whole numbers ``floor(256 * c)``; a score is their inner product with the anchor's, exact. Of the rows of
the anchor's label the ``positives`` best are its positives. Of the other labels' rows the best ``negatives`` within
``low`` to 100 per cent of a positive's score are that positive's hard negatives. Ties go to the smaller id.

Tasks hold blocks of rows by column. For each anchor they read the columns in falling order of its own components' size, a few at a time. What the
columns to come can still add lies between sums of their smallest and largest contributions, known from the block's
minima and maxima. Rows that these bounds put below the last place, or outside all windows, leave the candidates; scores that are complete decide the
rest. What a task found so far bounds its later blocks. Every row meets every anchor: anchors, a stated share of the rows, go to the tasks in groups
of at most ``GROUP_BYTES``, and a task returns a few rows for each anchor.

Defined results: rows without an id, a label or a vector, or with a null or non-finite component, take no part; nor do those whose components
are so large that a score could exceed a long. Of rows that repeat an id, the one with the smallest label and then vector counts.
Rows meet anchors of their own length only. Empty vectors score 0. An anchor without positives or negatives has no rows, nor has a positive with a
negative score, as its window is empty. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.session import materialize, scratch_path

SCALE = 256
POSITIVES = 5
NEGATIVES = 5
LOW = 80
#: Bytes of anchor vectors that tasks hold at once.
GROUP_BYTES = 16 << 20
#: Columns between two looks at the bounds.
STEP = 8

FOUND = "anchor_id long, positive_score long, id long, score long"
RESULT = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def quantised(rows: DataFrame, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, label, x) of the rows that take part, one for each id."""
    rows = rows.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v")
    )
    limit = F.sqrt(F.lit(2.0**62) / F.greatest(F.size("v"), F.lit(1)))
    fits = F.forall("v", lambda c: F.coalesce(F.abs(F.floor(c * scale).cast("double")) <= limit, F.lit(False)) & ~F.isnan(c))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & fits)
    rows = rows.select("vec_id", "label", F.transform("v", lambda c: F.floor(c * scale)).alias("x"))
    first = rows.groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("first"))
    return first.select("vec_id", "first.label", "first.x")


class Block:
    """Rows of one length by column, with the bounds of each column."""

    def __init__(self, ids: np.ndarray, columns: np.ndarray):
        self.ids, self.columns = ids, columns
        self.low, self.high = (f(axis=1) if columns.size else np.zeros(len(columns)) for f in (columns.min, columns.max))

    @classmethod
    def of(cls, ids: np.ndarray, x: np.ndarray) -> Block:
        columns = np.ascontiguousarray(x.T)
        # Sums of products stay exact in floating point, which is faster, up to 2**53.
        small = len(columns) * float(np.abs(columns).max(initial=0)) ** 2 < 2**52
        return cls(ids, columns.astype(float) if small else columns)

    def part(self, rows: np.ndarray) -> Block:
        return Block(self.ids[rows], np.ascontiguousarray(self.columns[:, rows]))

    def scan(self, anchor: np.ndarray, keep, rows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the candidates that are left once all columns have been read.

        ``keep(partial, least, most)`` tells which stay, given that the columns to come add from ``least`` to ``most``.
        """
        if self.columns.dtype == float and len(anchor) * float(np.abs(anchor).max(initial=0)) ** 2 >= 2**52:
            return Block(self.ids, self.columns.astype(np.int64)).scan(anchor, keep, rows)
        anchor = anchor.astype(self.columns.dtype)
        order = np.argsort(-np.abs(anchor), kind="stable")
        ends = np.stack([anchor * self.low, anchor * self.high])[:, order]
        least, most = (np.append(np.cumsum(side[::-1])[::-1], 0) for side in (ends.min(axis=0), ends.max(axis=0)))
        places = np.arange(len(self.ids)) if rows is None else rows
        partial = np.zeros(len(places), self.columns.dtype)
        for first in range(0, len(order), STEP):
            dims = order[first : first + STEP]
            read = self.columns[dims] if len(places) == len(self.ids) else self.columns[dims[:, None], places]
            partial = partial + anchor[dims] @ read
            end = first + len(dims)
            stay = keep(partial, least[end], most[end])
            if not stay.all():
                places, partial = places[stay], partial[stay]
            if not len(places):
                break
        return places, partial.astype(np.int64)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``k`` by falling score, then rising id."""
    if len(ids) > k:
        last = np.partition(scores, len(scores) - k)[len(scores) - k]
        ids, scores = ids[scores >= last], scores[scores >= last]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


class Best:
    """The first ``k`` of all rows offered so far."""

    def __init__(self, k: int):
        self.k, self.ids, self.scores = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def offer(self, ids: np.ndarray, scores: np.ndarray) -> None:
        if len(ids):
            self.ids, self.scores = best(np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores]), self.k)

    def last(self) -> int | None:
        """A score below this one has no place any more; None while places are free."""
        return int(self.scores[-1]) if len(self.scores) == self.k else None


def _kth(values: np.ndarray, k: int):
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else None


def offer_positives(found: Best, block: Block, anchor_id: int, anchor: np.ndarray) -> None:
    """The best rows of ``block``, which holds rows of the anchor's label; the anchor itself is none of them."""
    others = np.flatnonzero(block.ids != anchor_id)

    def keep(partial, least, most):
        limits = [found.last()]
        if (kth := _kth(partial, found.k)) is not None:
            limits.append(kth + least)
        limits = [x for x in limits if x is not None]
        return partial + most >= max(limits) if limits else np.ones(len(partial), bool)

    places, scores = block.scan(anchor, keep, None if len(others) == len(block.ids) else others)
    found.offer(*best(block.ids[places], scores, found.k))


def window(positive: int, low: int = LOW) -> tuple[int, int]:
    """Lowest and highest score of a hard negative; empty below zero."""
    return -(-low * positive // 100), positive


def offer_negatives(found: dict[int, Best], block: Block, others: np.ndarray, anchor: np.ndarray, low: int = LOW) -> None:
    """The best rows among ``others`` within each positive's window (the keys of ``found``)."""
    windows = {p: window(p, low) for p in found}
    lowest, highest = min(a for a, _ in windows.values()), max(b for _, b in windows.values())
    # The lowest window's first rows beat all rows below them in the other windows too: those reach lower nowhere.
    smallest = min(windows)
    start, end = windows[smallest]

    def keep(partial, least, most):
        limit = lowest
        if (last := found[smallest].last()) is not None:
            limit = max(limit, last)
        inside = partial[(partial + least >= start) & (partial + most <= end)]
        if (kth := _kth(inside, found[smallest].k)) is not None:
            limit = max(limit, kth + least)
        return (partial + most >= limit) & (partial + least <= highest)

    places, scores = block.scan(anchor, keep, others)
    for positive, (start, end) in windows.items():
        inside = (scores >= start) & (scores <= end)
        found[positive].offer(*best(block.ids[places[inside]], scores[inside], found[positive].k))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, Block]]:
    """(length of the vectors, labels, block) of the rows of each batch."""
    for batch in batches:
        lengths = pc.list_value_length(batch.column("x")).to_numpy()
        for length in np.unique(lengths):
            part = batch if (lengths == length).all() else batch.filter(pa.array(lengths == length))
            x = part.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(part.num_rows, length)
            yield int(length), part.column("label").to_numpy(), Block.of(part.column("vec_id").to_numpy(), x)


def _rows(found: list[tuple[int, int | None, Best]]) -> Iterator[pa.RecordBatch]:
    anchors = [a for a, _, b in found for _ in b.ids]
    positives = [p for _, p, b in found for _ in b.ids]
    ids, scores = ([int(v) for _, _, b in found for v in getattr(b, name)] for name in ("ids", "scores"))
    yield pa.record_batch([pa.array(v, pa.int64()) for v in (anchors, positives, ids, scores)], names=["anchor_id", "positive_score", "id", "score"])


def _first(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first ``k`` rows of each key, numbered. Spark cuts each task's rows to ``k`` a key before it deals them out."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id"))
    return rows.withColumn("rank", place).filter(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW) -> DataFrame:
    """Hard negatives for the positives of every anchor, a row of ``rows`` (see :func:`quantised`) that meets ``is_anchor``."""
    vectors = materialize(rows, "vectors")
    anchors = vectors.filter(is_anchor).withColumn("bytes", 8 * F.size("x") + 64)
    total = anchors.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    # Half full on average: hashes then overfill no group.
    groups = 1 + 2 * total // GROUP_BYTES
    anchors = anchors.withColumn("turn", F.pmod(F.xxhash64("vec_id"), F.lit(groups)))
    out = scratch_path(rows.sparkSession, "hard-negatives")
    for turn in range(groups):
        found = _mine(vectors, anchors.filter(F.col("turn") == turn), positives, negatives, low)
        found.write.parquet(f"{out}/turn={turn}")
    return rows.sparkSession.read.parquet(out).select(*RESULT)


def _mine(vectors: DataFrame, anchors: DataFrame, positives: int, negatives: int, low: int) -> DataFrame:
    """The same for one group of anchors."""
    group = [(r.vec_id, r.label, np.array(r.x, np.int64)) for r in anchors.select("vec_id", "label", "x").collect()]

    def search_positives(batches):
        found = {a: Best(positives) for a, _, _ in group}
        for length, labels, block in _blocks(batches):
            by_label = {int(label): block.part(np.flatnonzero(labels == label)) for label in np.unique(labels)}
            for anchor_id, label, x in group:
                if len(x) == length and label in by_label:
                    offer_positives(found[anchor_id], by_label[label], anchor_id, x)
        yield from _rows([(a, None, b) for a, b in found.items()])

    best_rows = _first(vectors.mapInArrow(search_positives, FOUND), ["anchor_id"], positives)
    chosen = materialize(best_rows.select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # A few scores for each anchor of the group.
    wanted = {}
    for row in chosen.filter("positive_score >= 0").select("anchor_id", "positive_score").distinct().collect():
        wanted.setdefault(row.anchor_id, []).append(row.positive_score)

    def search_negatives(batches):
        found = {a: {p: Best(negatives) for p in scores} for a, scores in wanted.items()}
        for length, labels, block in _blocks(batches):
            others = {int(label): np.flatnonzero(labels != label) for label in {label for _, label, _ in group}}
            for anchor_id, label, x in group:
                if len(x) == length and anchor_id in found and len(others[label]):
                    offer_negatives(found[anchor_id], block, others[label], x, low)
        yield from _rows([(a, p, b) for a, windows in found.items() for p, b in windows.items()])

    ranked = _first(vectors.mapInArrow(search_negatives, FOUND), ["anchor_id", "positive_score"], negatives)
    ranked = materialize(ranked.select("anchor_id", "positive_score", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")), "negatives")
    return chosen.join(ranked, ["anchor_id", "positive_score"]).select(*RESULT)


#: What the query returns, in SQL, for ids that differ.
MINED_SQL = f"""
WITH vectors AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda c: floor({SCALE} * c::DOUBLE)) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
         list_dot_product(a.x, b.x)::BIGINT AS score
  FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES}),
ranked AS (
  SELECT anchor_id, positive_id, id AS negative_id, positive_score, score AS negative_score,
         row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank
  FROM positives JOIN scores USING (anchor_id)
  WHERE NOT same AND {LOW} * positive_score <= 100 * score AND score <= positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score
FROM ranked WHERE rank <= {NEGATIVES}
"""
