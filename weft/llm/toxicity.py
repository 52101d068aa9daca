"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are the words, and beginnings of words, whose presence tells toxic from other examples: their
likelihood ratio (G squared) must pass a limit that allows for the number of terms tried. Examples become unit vectors of log term
frequency times inverse document frequency; equal vectors are one entry with its counts of both labels. The
entries lie in blocks of an inverted index that holds, for every term and block, the largest weight. A
search takes blocks by their upper bound and ends when no block can reach the k-th best similarity, so it is exact;
entries that tie with it count too. Votes are weighted by distance, with the examples' base
rate as a prior, and mapped to probabilities by a logistic curve fitted to the examples' own votes, each without
itself.

Bounds: ``MAX_EXAMPLES`` examples and ``MAX_TERMS`` terms are all that the driver and the tasks hold.

Defined results: a text without terms (empty and null ones too) has no neighbours and gets the rate of such
examples; without examples of both labels every score is the share of toxic examples (0 if none); repeated rows
get equal scores; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm import words
from weft.llm.arrow import parts
from weft.llm.labelled import sample
from weft.session import materialize

MAX_EXAMPLES = 20_000
MAX_TERMS = 4096
MIN_EXAMPLES = 3
ERROR_RATE = 0.05
NEIGHBOURS = 25
BLOCK = 64
EVIDENCE = 3
# Beginnings of words, of so many bytes, stand for their forms.
STEMS = (4, 6, 7, 8)


def _terms(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the lower-cased words of stretches of documents and of the beginnings of longer ones, and where each document's start."""
    for _, _, data, bounds in words.byte_chunks(column):
        data = words.lower(data)
        found = words.find(data, bounds, words.PUNCTUATION)
        hashed, docs = [words.hashes(data, found)], [found.doc]
        for size in STEMS:
            longer = np.flatnonzero(found.end - found.start > size)
            start = found.start[longer]
            stems = words.Words(found.doc[longer], start, start + size, found.first)
            hashed.append(words.mix(words.hashes(data, stems) + np.uint64(size)))
            docs.append(stems.doc)
        owner = np.concatenate(docs)
        order = np.argsort(owner, kind="stable")
        first = np.searchsorted(owner[order], np.arange(len(bounds)))
        yield np.concatenate(hashed)[order].view(np.int64), first


def term_sets(docs: DataFrame) -> DataFrame:
    """(label, terms): the distinct word hashes of each row."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(source):
            sets = [np.unique(found[a:b]) for found, first in _terms(batch.column(1)) for a, b in zip(first[:-1], first[1:])]
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*sets, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["label", "terms"])

    return docs.select("label", "text").mapInArrow(batches, "label int, terms array<bigint>")


def choose_terms(sets: DataFrame, toxic: int, other: int) -> list[tuple[int, int]]:
    """(term, examples with it) of the telling terms, the strongest first."""
    counts = sets.select("label", F.explode("terms").alias("term")).groupBy("term")
    counts = counts.agg(F.sum("label").alias("in_toxic"), F.count("*").alias("both")).filter(F.col("both") >= MIN_EXAMPLES)
    counts = materialize(counts, "terms")
    limit = 2 * math.log(max(counts.count(), 1) / ERROR_RATE)
    part = F.col("both") / (toxic + other)

    def cell(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    a, b = F.col("in_toxic"), F.col("both") - F.col("in_toxic")
    gain = 2 * (
        cell(a, part * toxic) + cell(b, part * other) + cell(toxic - a, (1 - part) * toxic) + cell(other - b, (1 - part) * other)
    )
    strong = counts.withColumn("gain", gain).filter((F.col("gain") >= limit) & (a > part * toxic))
    return [(r.term, r.both) for r in strong.orderBy(F.desc("gain"), "term").limit(MAX_TERMS).collect()]


@dataclass
class Vectors:
    """The terms in order and their inverse document frequencies."""

    terms: np.ndarray
    idf: np.ndarray

    def of(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, weights) of the unit vector of a text's words."""
        at = np.minimum(np.searchsorted(self.terms, found), max(len(self.terms) - 1, 0))
        places, times = np.unique(at[self.terms[at] == found] if len(self.terms) else at[:0], return_counts=True)
        weights = (1 + np.log(times)) * self.idf[places] if len(places) else np.zeros(0)
        norm = np.sqrt(np.sum(weights * weights))
        return places.astype(np.int32), weights / norm if norm else weights


class BlockMaxIndex:
    """Entries (places, weights, toxic, all, id) in blocks, with the largest weight by term and block."""

    def __init__(self, entries: list[tuple], terms: int):
        # Entries with the same strongest term lie together, so that the bounds are tight.
        self.entries = sorted(entries, key=lambda e: (int(e[0][np.argmax(e[1])]), tuple(e[0]), tuple(e[1])))
        n = len(self.entries)
        self.blocks = -(-n // BLOCK)
        self.toxic = np.array([e[2] for e in self.entries], dtype=np.float64)
        self.all = np.array([e[3] for e in self.entries], dtype=np.float64)
        self.id = np.array([e[4] for e in self.entries], dtype=np.int64)
        self.most = np.zeros((terms, self.blocks))
        lists: list[list[tuple[int, int, float]]] = [[] for _ in range(self.blocks)]
        for i, (places, weights, *_) in enumerate(self.entries):
            for t, w in zip(places, weights):
                lists[i // BLOCK].append((int(t), i % BLOCK, float(w)))
                self.most[t, i // BLOCK] = max(self.most[t, i // BLOCK], w)
        # Each block's inverted lists, term after term.
        self.lists = []
        for found in lists:
            term, entry, weight = zip(*sorted(found)) if found else ((), (), ())
            self.lists.append((np.array(term, np.int32), np.array(entry, np.int32), np.array(weight, float)))

    def search(self, places: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(entries, similarities) of the nearest entries that hold ``k`` examples, ties with the last included."""
        if not len(places) or not self.blocks:
            return np.zeros(0, np.int64), np.zeros(0)
        bound = weights @ self.most[places]
        asked = np.zeros(len(self.most))
        asked[places] = weights
        found, score, least = np.zeros(0, np.int64), np.zeros(0), 0.0
        for block in np.argsort(-bound, kind="stable"):
            if bound[block] <= 0 or bound[block] < least - 1e-9:
                break
            term, entry, weight = self.lists[block]
            own = np.bincount(entry, asked[term] * weight, BLOCK)
            if own.max() < least - 1e-9:
                continue
            hit = np.flatnonzero(own > 0)
            found, score = np.concatenate([found, hit + block * BLOCK]), np.concatenate([score, own[hit]])
            order = np.argsort(-score, kind="stable")
            found, score = found[order], score[order]
            filled = np.searchsorted(np.cumsum(self.all[found]), k)
            if filled < len(found):
                least = score[filled]
                keep = score >= least - 1e-9
                found, score = found[keep], score[keep]
        return found, score


@dataclass
class Model:
    vectors: Vectors
    index: BlockMaxIndex
    base: float
    none: float
    slope: float = 1.0
    shift: float = 0.0

    def vote(self, places: np.ndarray, weights: np.ndarray, without: int | None = None) -> tuple[float, np.ndarray, np.ndarray]:
        """(toxic share of the weighted votes, entries, similarities); ``without``: one example of this label is left out."""
        found, score = self.index.search(places, weights, NEIGHBOURS + (without is not None))
        strength = 1 / (1.05 - np.minimum(score, 1.0))
        toxic, every = self.index.toxic[found].copy(), self.index.all[found].copy()
        if without is not None and len(found):
            toxic[0] -= without
            every[0] -= 1
        return (float(strength @ toxic) + self.base) / (float(strength @ every) + 1), found, score

    def score(self, places: np.ndarray, weights: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        if not len(places):
            return self.none, np.zeros(0, np.int64), np.zeros(0)
        raw, found, similar = self.vote(places, weights)
        return 1 / (1 + math.exp(-(self.slope * _logit(raw) + self.shift))), found, similar


def _logit(p: float) -> float:
    p = min(max(p, 1e-4), 1 - 1e-4)
    return math.log(p / (1 - p))


def _curve(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve, by Newton's method with a small penalty towards (1, 0)."""
    a, b = 1.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = n * p * (1 - p)
        g = np.array([np.sum((n * p - y) * x) + (a - 1), np.sum(n * p - y) + 0.1 * b])
        h = np.array([[np.sum(w * x * x) + 1, np.sum(w * x)], [np.sum(w * x), np.sum(w) + 0.1]])
        step = np.linalg.solve(h, g)
        a, b = a - float(step[0]), b - float(step[1])
        if np.abs(step).max() < 1e-8:
            break
    return max(a, 0.05), b


def fit(docs: DataFrame, labels: DataFrame, learn: Column, limit: int = MAX_EXAMPLES) -> Model:
    """Learn from at most ``limit`` documents labelled ``toxic`` whose ids meet ``learn``."""
    examples = materialize(sample(docs, labels, "toxic", learn, limit), "examples")
    sizes = {r.label: r["count"] for r in examples.groupBy("label").count().collect()}
    toxic, other = sizes.get(1, 0), sizes.get(0, 0)
    chosen = choose_terms(term_sets(examples), toxic, other) if toxic and other else []
    chosen.sort()
    vectors = Vectors(
        np.array([t for t, _ in chosen], dtype=np.int64), np.array([math.log(1 + (toxic + other) / n) for _, n in chosen])
    )

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(source):
            found = [vectors.of(f[a:b]) for f, first in _terms(batch.column(2)) for a, b in zip(first[:-1], first[1:])]
            places = pa.array([p.tolist() for p, _ in found], pa.list_(pa.int32()))
            weights = pa.array([w.tolist() for _, w in found], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), places, weights], ["doc_id", "label", "places", "weights"])

    placed = examples.select("doc_id", "label", "text").mapInArrow(batches, "doc_id bigint, label int, places array<int>, weights array<double>")
    grouped = placed.groupBy("places", "weights").agg(F.sum("label").alias("toxic"), F.count("*").alias("all"), F.min("doc_id").alias("id"))
    rows = [(np.array(r.places, np.int32), np.array(r.weights), r.toxic, r["all"], r.id) for r in grouped.collect()]
    base = toxic / max(toxic + other, 1)
    empty = [(t, n) for p, _, t, n, _ in rows if not len(p)]
    # A text without terms: the rate among such examples, with two examples of the base rate.
    none = (sum(t for t, _ in empty) + 2 * base) / (sum(n for _, n in empty) + 2)
    model = Model(vectors, BlockMaxIndex([r for r in rows if len(r[0])], len(chosen)), base, none)
    x, y, n = [], [], []
    for places, weights, t, every, _ in rows:
        if len(places):
            for label, times in ((1, t), (0, every - t)):
                if times:
                    x.append(_logit(model.vote(places, weights, label)[0]))
                    y.append(times * label)
                    n.append(times)
    if x:
        model.slope, model.shift = _curve(np.array(x), np.array(y, float), np.array(n, float))
    return model


class Scorer:
    """Scores and evidence of texts. Results of equal vectors are remembered, up to ``limit`` bytes."""

    def __init__(self, model: Model, limit: int = 16 << 20):
        self.model, self.limit, self.size = model, limit, 0
        self.known: dict[bytes, tuple[float, np.ndarray, np.ndarray]] = {}

    def __call__(self, texts: pa.Array) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        for found, first in _terms(texts):
            for a, b in zip(first[:-1], first[1:]):
                places, weights = self.model.vectors.of(found[a:b])
                name = places.tobytes() + weights.tobytes()
                if name not in self.known:
                    if self.size > self.limit:
                        self.known.clear()
                        self.size = 0
                    value, near, similar = self.model.score(places, weights)
                    self.known[name] = value, near[:EVIDENCE].copy(), similar[:EVIDENCE].copy()
                    # An entry's arrays and objects take about so much besides its name.
                    self.size += len(name) + 700
                yield self.known[name]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, evidence): evidence are the nearest examples with similarity and label rate."""
    item = pa.struct([("example", pa.int64()), ("similarity", pa.float64()), ("toxic", pa.float64())])

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, index = Scorer(model), model.index
        for batch in parts(source):
            scores, evidence = [], []
            for value, near, similar in scorer(batch.column(1)):
                scores.append(value)
                evidence.append(
                    [
                        {"example": int(index.id[i]), "similarity": float(s), "toxic": float(index.toxic[i] / index.all[i])}
                        for i, s in zip(near, similar)
                    ]
                )
            columns = [batch.column(0), pa.array(scores, pa.float64()), pa.array(evidence, pa.list_(item))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "evidence"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    schema = "doc_id bigint, score double, evidence array<struct<example:bigint,similarity:double,toxic:double>>"
    return rows.mapInArrow(batches, schema)


def below(docs: DataFrame, model: Model, limit: float) -> DataFrame:
    """The rows of ``docs`` whose score is below ``limit``. Each row is judged by its own text, where it is; nothing is joined."""
    at = docs.columns.index("text")

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in parts(source):
            texts = batch.column(at).fill_null("")
            yield batch.filter(pa.array([value < limit for value, _, _ in scorer(texts)], pa.bool_()))

    return docs.mapInArrow(batches, docs.schema)
