"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared in lower case with every run of other characters than letters and digits as one space. An item
of n characters may differ by ``ERROR_RATE`` n insertions, deletions and substitutions. It is cut into one piece more than it has
errors: any occurrence then holds one piece unchanged, in nearly its place. One automaton finds all
pieces in one pass over a text; each place it proposes is verified once with Myers' bit-parallel distance.

Bounds: items are sent to the tasks in slices of about ``SLICE_CHARS`` characters, with one pass over the texts for each
slice; benchmarks are small, so there is one as a rule.

Defined results: null and empty texts hold nothing; items under ``MIN_CHARS`` characters are too short to tell
from ordinary text and match nothing, as do null ones; items with equal text all count; repeated rows
give repeated results; an empty table on either side gives no matches; other columns are ignored. Every row is judged
by its own text, rows without an id too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.arrow import parts

ERROR_RATE = 0.08
MIN_CHARS = 24
SLICE_CHARS = 4_000_000
_OTHER = re.compile(r"[\W_]+")


def normal(text: str | None) -> str:
    return _OTHER.sub(" ", (text or "").lower()).strip()


def masks(pattern: str) -> dict[str, int]:
    """For each character, the places of ``pattern`` that hold it, as bits."""
    found: dict[str, int] = {}
    for i, c in enumerate(pattern):
        found[c] = found.get(c, 0) | 1 << i
    return found


def best_end(peq: dict[str, int], size: int, text: str) -> tuple[int, int]:
    """(least distance of the pattern to any part of ``text``, the first end of such a part), by Myers' recurrence."""
    full, top = (1 << size) - 1, 1 << (size - 1)
    plus, minus, score = full, 0, size
    best, end = size, 0
    for i, c in enumerate(text, 1):
        equal = peq.get(c, 0)
        vertical = equal | minus
        across = (((equal & plus) + plus) ^ plus) | equal
        up, down = minus | ~(across | plus), plus & across
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = up << 1, down << 1
        plus, minus = (down | ~(vertical | up)) & full, up & vertical & full
        if score < best:
            best, end = score, i
    return best, end


class Items:
    """The pieces of all items in one automaton."""

    def __init__(self, items: list[tuple[int, str]], rate: float = ERROR_RATE):
        self.texts: list[str] = []
        self.ids: list[list[int]] = []
        by_text: dict[str, list[int]] = {}
        for key, text in items:
            text = normal(text)
            if len(text) >= MIN_CHARS:
                by_text.setdefault(text, []).append(key)
        self.pieces: dict[str, list[tuple[int, int]]] = {}
        for i, text in enumerate(sorted(by_text)):
            self.texts.append(text)
            self.ids.append(sorted(by_text[text]))
            parts = int(rate * len(text)) + 1
            for part in range(parts):
                begin, end = part * len(text) // parts, (part + 1) * len(text) // parts
                self.pieces.setdefault(text[begin:end], []).append((i, begin))
        self.errors = [int(rate * len(t)) for t in self.texts]
        self.masks = [masks(t) for t in self.texts]
        self.automaton = ahocorasick.Automaton()
        for piece in self.pieces:
            self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(item, distance, end in the normalised text) of the best occurrence of each item within its errors."""
        if not self.texts:
            return []
        text = normal(text)
        best: dict[int, tuple[int, int]] = {}
        seen: set[tuple[int, int]] = set()
        for last, piece in self.automaton.iter(text):
            for i, offset in self.pieces[piece]:
                errors, size = self.errors[i], len(self.texts[i])
                # Places within one step of each other are verified by one window.
                step = (last + 1 - len(piece) - offset) // (errors + 1)
                if (i, step) in seen or best.get(i, (1,))[0] == 0:
                    continue
                seen.add((i, step))
                begin = max(step * (errors + 1) - errors, 0)
                window = text[begin : (step + 1) * (errors + 1) + size + errors]
                distance, end = best_end(self.masks[i], size, window)
                if distance <= errors and distance < best.get(i, (size,))[0]:
                    best[i] = distance, begin + end
        return [(i, d, e) for i, (d, e) in sorted(best.items())]


_MATCHES = "array<struct<item_id:bigint,distance:int,end:int>>"
_KIND = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("end", pa.int32())]))


def _slices(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in parts of about ``SLICE_CHARS`` characters."""
    sized = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id is not null and text is not null")
    total = sized.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    slices = -(-total // SLICE_CHARS) or 1
    for part in range(slices):
        own = sized.filter(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == part).orderBy("item_id", "text").collect()
        yield [tuple(r) for r in own]


def matches(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """(doc_id, items): for each row of ``docs``, the ids of the items it holds, with distance and end."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("items", F.array().cast(_MATCHES))
    # Each pass adds to the list that the row carries.
    for part in _slices(items):
        rows = rows.mapInArrow(_adding(part, rate), f"doc_id bigint, text string, items {_MATCHES}")
    return rows.select("doc_id", "items")


def _adding(part: list[tuple[int, str]], rate: float):
    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Items(part, rate)
        for batch in parts(source):
            found = [
                before + [{"item_id": k, "distance": d, "end": e} for i, d, e in known.find(text) for k in known.ids[i]]
                for text, before in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, _KIND)], ["doc_id", "text", "items"])

    return batches


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, contaminated, n_items, item_ids) for each row of ``docs``."""
    found = matches(docs, items)
    ids = F.sort_array(F.transform("items", lambda x: x.item_id))
    return found.select("doc_id", (F.size("items") > 0).alias("contaminated"), F.size("items").cast("bigint").alias("n_items"), ids.alias("item_ids"))


def clean(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """The rows of ``docs`` that hold no item. Each row is judged by its own text, where it is; nothing is joined."""
    at = docs.columns.index("text")

    def without(part: list[tuple[int, str]]):
        def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = Items(part, rate)
            for batch in parts(source):
                texts = batch.column(at).fill_null("").to_pylist()
                yield batch.filter(pa.array([not known.find(text) for text in texts], pa.bool_()))

        return batches

    for part in _slices(items):
        docs = docs.mapInArrow(without(part), docs.schema)
    return docs
