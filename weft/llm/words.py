"""Words of Arrow text columns as arrays: bounds, 64-bit hashes and shingle hashes, without a Python string per word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# Documents are taken together up to so many bytes; a longer one is taken alone.
CHUNK_BYTES = 1 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: ASCII other than letters and digits.
PUNCTUATION = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

_random = np.random.default_rng(20240501)
_BYTE = _random.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_PLACE = _random.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_powers = {}


def _power(base: np.uint64, size: int) -> np.ndarray:
    known = _powers.get(int(base))
    if known is None or len(known) < size:
        steps = np.full(max(size, CHUNK_BYTES + 1), base, dtype=np.uint64)
        steps[0] = 1
        known = np.cumprod(steps)
        if size <= CHUNK_BYTES + 1:
            _powers[int(base)] = known
    return known[:size]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, bounds within the bytes) of stretches of ``column``."""
    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, bounds, data = column.buffers()
    bounds = np.frombuffer(bounds, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        end = max(first + 1, int(np.searchsorted(bounds, bounds[first] + CHUNK_BYTES, "right")) - 1)
        yield first, end, data[bounds[first] : bounds[end]], bounds[first : end + 1] - bounds[first]
        first = end


@dataclass
class Words:
    """Words of a stretch of documents: document (from 0) and byte bounds of each, and the first word of each document."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


def find(data: np.ndarray, bounds: np.ndarray, separator: np.ndarray = SPACE) -> Words:
    """Runs of bytes that are no separators: U+0020 and U+0009 to U+000D, if not told otherwise."""
    inside = ~separator[data]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    cuts = bounds[:-1][bounds[:-1] < len(data)]
    before[cuts] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    after[cuts[cuts > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(start, bounds)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    return Words(doc, start, end, first)


def lower(data: np.ndarray) -> np.ndarray:
    """A to Z in lower case."""
    return _LOWER[data]


def hashes(data: np.ndarray, words: Words) -> np.ndarray:
    """A hash of each word that depends on its bytes alone."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * _power(_BASE, len(data)), out=sums[1:])
    return mix((sums[words.end] - sums[words.start]) * _power(_INVERSE, len(data) + 1)[words.start])


def shingles(words: Words, hashed: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``size`` words and the first of each document; a shorter document is one run as a whole."""
    counts = np.diff(words.first)
    short = np.flatnonzero((counts > 0) & (counts < size))
    n = len(hashed) - size + 1
    if n > 0:
        total = np.zeros(n, dtype=np.uint64)
        for place in range(size):
            total += hashed[place : place + n] * _PLACE[place]
        whole = words.doc[:n] == words.doc[size - 1 :]
        found, owner = mix(total[whole] + _PLACE[size]), words.doc[:n][whole]
    else:
        found, owner = np.zeros(0, np.uint64), np.zeros(0, words.doc.dtype)
    if len(short):
        extra = [
            np.sum(hashed[words.first[d] : words.first[d + 1]] * _PLACE[: counts[d]], dtype=np.uint64) + _PLACE[counts[d]]
            for d in short
        ]
        found, owner = np.concatenate([found, mix(np.array(extra, dtype=np.uint64))]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        found, owner = found[order], owner[order]
    return found, np.searchsorted(owner, np.arange(len(counts) + 1))
