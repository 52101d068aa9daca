"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE_WORDS`` words. Each passage is encoded (character classes, hashed
character pairs, word lengths, repetition), a hidden layer makes its representation, gated attention gives its
weight in the document, and a logistic unit scores the weighted sum. Only documents have labels; the
attention learns which passages speak for them. Training runs on the driver over at most ``MAX_DOCUMENTS``
labelled documents with ``MAX_PASSAGES`` passages each, spread over the text; scoring takes all
passages of all documents.

Defined results: a null or empty text, or one without words, is one passage of zeros; without examples of both
labels every score is the share of good examples (1 if none); repeated rows get equal scores; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm import words
from weft.llm.labelled import sample
from weft.session import materialize

PASSAGE_WORDS = 64
MAX_DOCUMENTS = 3000
MAX_PASSAGES = 24
PAIRS = 32
HIDDEN, GATE = 32, 16
EPOCHS, BATCH, RATE, DECAY = 40, 64, 3e-3, 1e-4

_CLASSES = [
    [c for c in range(256) if chr(c).isupper() and c < 0x80],
    [c for c in range(256) if chr(c).islower() and c < 0x80],
    [*range(ord("0"), ord("9") + 1)],
    [0x20],
    [0x0A],
    [*b"#*$%&<>"],
    [*b"|"],
    [*b"!"],
    [*b".,;:?"],
    [*b"\"'()[]{}@/\\=+-_~^`"],
    [*range(0x80, 0x100)],
]
_CLASS = np.full(256, len(_CLASSES), dtype=np.int64)
for _i, _members in enumerate(_CLASSES):
    _CLASS[_members] = _i
FEATURES = len(_CLASSES) + 1 + PAIRS + 8


def _first_of_runs(owner: np.ndarray, key: np.ndarray) -> np.ndarray:
    """True where (owner, key) has not occurred before, in order of place."""
    order = np.lexsort((key, owner))
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (owner[order][1:] != owner[order][:-1]) | (key[order][1:] != key[order][:-1])
    out = np.empty(len(order), dtype=bool)
    out[order] = fresh
    return out


def encode(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(passages by features, first passage of each document) of a stretch of documents; every document has a passage."""
    found = words.find(data, bounds)
    counts = np.diff(found.first)
    per_doc = np.maximum(-(-counts // PASSAGE_WORDS), 1)
    first = np.concatenate(([0], np.cumsum(per_doc)))
    n = int(first[-1])
    x = np.zeros((n, FEATURES), dtype=np.float32)
    if not len(found.start):
        return x, first
    hashed = words.hashes(data, found)
    place = np.arange(len(hashed)) - found.first[found.doc]
    passage = first[found.doc] + place // PASSAGE_WORDS
    # A passage's bytes go from its first word to the next passage or the document's end.
    heads = np.flatnonzero(place % PASSAGE_WORDS == 0)
    held = passage[heads]
    stops = np.where(np.append(found.doc[heads][1:], -1) == found.doc[heads], np.append(found.start[heads][1:], 0), bounds[found.doc[heads] + 1])
    lengths = stops - found.start[heads]
    owner = np.repeat(held, lengths)
    at = np.arange(len(owner)) + np.repeat(found.start[heads] - (np.cumsum(lengths) - lengths), lengths)
    own = data[at]
    width = len(_CLASSES) + 1
    size = np.zeros(n)
    size[held] = lengths
    size = np.maximum(size, 1)[:, None]
    x[:, :width] = np.bincount(owner * width + _CLASS[own], minlength=n * width).reshape(n, width) / size
    code = (own[:-1].astype(np.int64) * 37 + own[1:].astype(np.int64) * 101) % PAIRS
    inside = owner[:-1] == owner[1:]
    x[:, width : width + PAIRS] = np.bincount((owner[:-1] * PAIRS + code)[inside], minlength=n * PAIRS).reshape(n, PAIRS) / size

    times = np.bincount(passage, minlength=n).astype(np.float64)
    each = np.maximum(times, 1)

    def mean(values: np.ndarray) -> np.ndarray:
        return np.bincount(passage, weights=values, minlength=n) / each

    length = (found.end - found.start).astype(np.float64)
    same = np.zeros(len(hashed))
    same[1:] = (hashed[1:] == hashed[:-1]) & (found.doc[1:] == found.doc[:-1])
    runs = hashed.copy()
    for step in (1, 2, 3):
        if len(runs) > step:
            later = hashed[step:] * np.uint64(2 * step + 1) * (found.doc[step:] == found.doc[:-step])
            runs[:-step] = words.mix(runs[:-step] + later)
    columns = [
        mean(length) / 10,
        np.sqrt(np.maximum(mean(length**2) - mean(length) ** 2, 0)) / 10,
        mean(same),
        mean(_first_of_runs(passage, hashed)),
        mean(_first_of_runs(found.doc, runs)),
        mean(_first_of_runs(found.doc, hashed)),
        times / PASSAGE_WORDS,
        np.log1p(np.repeat(counts, per_doc)) / 10,
    ]
    x[:, width + PAIRS :] = np.stack(columns, axis=1)
    return x, first


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    """Scaling of the features and the weights of encoder, gated attention and score."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]
    constant: float | None = None

    def forward(self, x: np.ndarray, first: np.ndarray) -> tuple:
        w = self.weights
        h = np.tanh(x @ w["W"] + w["b"])
        t, g = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
        e = (t * g) @ w["w"]
        sizes = np.diff(first)
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first[:-1]), sizes))
        a = e / np.repeat(np.add.reduceat(e, first[:-1]), sizes)
        z = np.add.reduceat(a[:, None] * h, first[:-1], axis=0)
        return h, t, g, a, z, _sigmoid(z @ w["c"] + w["d"])

    def score(self, x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(score of each document, attention of each passage)."""
        if self.constant is not None:
            return np.full(len(first) - 1, self.constant), np.repeat(1 / np.diff(first), np.diff(first))
        *_, a, _, p = self.forward((x - self.mean) / self.scale, first)
        return p, a


def train(bags: list[np.ndarray], y: np.ndarray, seed: int = 11) -> Model:
    """Adam on the logistic loss, with gradients written out."""
    if not len(bags) or y.min() == y.max():
        return Model(np.zeros(FEATURES), np.ones(FEATURES), {}, float(y[0]) if len(y) else 1.0)
    every = np.concatenate(bags).astype(np.float64)
    model = Model(every.mean(axis=0), every.std(axis=0) + 1e-3, {})
    bags = [(b - model.mean) / model.scale for b in bags]
    random = np.random.default_rng(seed)
    shapes = {"W": (FEATURES, HIDDEN), "b": (HIDDEN,), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "w": (GATE,), "c": (HIDDEN,), "d": (1,)}
    w = model.weights = {k: random.normal(0, 1 / np.sqrt(s[0]), s) if k not in "bd" else np.zeros(s) for k, s in shapes.items()}
    moments = {k: [np.zeros(s), np.zeros(s)] for k, s in shapes.items()}
    step = 0
    for _ in range(EPOCHS):
        order = random.permutation(len(bags))
        for begin in range(0, len(order), BATCH):
            chosen = order[begin : begin + BATCH]
            x = np.concatenate([bags[i] for i in chosen])
            sizes = np.array([len(bags[i]) for i in chosen])
            first = np.concatenate(([0], np.cumsum(sizes)))
            h, t, g, a, z, p = model.forward(x, first)
            dl = (p - y[chosen]) / len(chosen)
            dz = np.repeat(dl[:, None] * w["c"], sizes, axis=0)
            da = np.sum(dz * h, axis=1)
            de = a * (da - np.repeat(np.add.reduceat(a * da, first[:-1]), sizes))
            dt, dg = de[:, None] * w["w"] * g * (1 - t**2), de[:, None] * w["w"] * t * g * (1 - g)
            dh = (a[:, None] * dz + dt @ w["V"].T + dg @ w["U"].T) * (1 - h**2)
            grads = {"W": x.T @ dh, "b": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de, "c": z.T @ dl, "d": np.array([dl.sum()])}
            step += 1
            for k, grad in grads.items():
                grad = grad + DECAY * w[k]
                m, v = moments[k]
                m += 0.1 * (grad - m)
                v += 0.001 * (grad**2 - v)
                w[k] -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return model


def _bags(batch: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for _, _, data, bounds in words.byte_chunks(batch):
        yield encode(data, bounds)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, limit: int = MAX_DOCUMENTS) -> Model:
    """Learn from at most ``limit`` documents labelled ``quality`` whose ids meet ``learn``."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            bags = []
            for x, first in _bags(batch.column(2)):
                for begin, end in zip(first[:-1], first[1:]):
                    taken = np.unique(np.linspace(begin, end - 1, min(end - begin, MAX_PASSAGES)).astype(int))
                    bags.append(x[taken].astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bags, pa.binary())], ["doc_id", "label", "bag"])

    examples = sample(docs, labels, "quality", learn, limit).select("doc_id", "label", "text")
    found = materialize(examples.mapInArrow(batches, "doc_id bigint, label int, bag binary"), "bags")
    rows = sorted(found.collect(), key=lambda r: r.doc_id)
    bags = [np.frombuffer(r.bag, "<f4").reshape(-1, FEATURES) for r in rows]
    return train(bags, np.array([float(r.label) for r in rows]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, n_passages, top_passage, top_weight): the passage with the most attention is the evidence."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            scores, counts, top, weight = [], [], [], []
            for x, first in _bags(batch.column(1)):
                p, a = model.score(x, first)
                best = [int(np.argmax(a[b:e])) for b, e in zip(first[:-1], first[1:])]
                scores += p.tolist()
                counts += np.diff(first).tolist()
                top += best
                weight += [float(a[b + i]) for b, i in zip(first[:-1], best)]
            columns = [batch.column(0), pa.array(scores, pa.float64()), pa.array(counts, pa.int64()), pa.array(top, pa.int64()), pa.array(weight, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "n_passages", "top_passage", "top_weight"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(batches, "doc_id bigint, score double, n_passages bigint, top_passage bigint, top_weight double")
