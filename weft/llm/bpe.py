"""Byte-level BPE encoding with offsets, and decoding.

The vocabulary is a file of ranks (base64 token, rank). Its merges go to the ``tokenizers`` library
as text: each byte stands for one printable character, so that any byte sequence is a valid string.
Every pair of tokens whose concatenation has a rank is a merge, in the order of those ranks, which
is the merge rule of rank files. Text is cut by the split pattern first; pieces repeat, so each
worker keeps the ids of pieces it has met (a bounded memory, emptied when full).

Defined results: null text counts as empty and has no tokens; repeated rows give repeated results;
an id outside of the vocabulary fails the decoder; a null list of ids decodes to empty bytes.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import models

from weft.llm.arrow import parts

# Characters that the rank files' pattern calls white space (Unicode White_Space).
_SPACE = r"\t-\r \x85\xa0  -     　"
# Pieces remembered by one worker.
CACHE_PIECES = 100_000
# The tokens' bytes are gathered in steps of so many ids, so that memory stays bounded.
_DECODE_IDS = 1 << 20


def byte_characters() -> list[str]:
    """A printable character for every byte: itself where it is one, else the next from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class Pieces(dict):
    """Ids of pieces as little-endian 32-bit integers, computed when first asked for."""

    def __init__(self, model: models.BPE, limit: int = CACHE_PIECES):
        super().__init__()
        self.model, self.limit = model, limit
        self.table = dict(enumerate(byte_characters()))

    def tokens(self, piece: str) -> list:
        return self.model.tokenize(piece.encode("utf-8").decode("latin-1").translate(self.table))

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        found = np.array([t.id for t in self.tokens(piece)], dtype="<u4").tobytes()
        if len(piece) <= 64:
            self[piece] = found
        return found


class ByteBpe:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        table = byte_characters()

        def shown(token: bytes) -> str:
            return "".join(table[b] for b in token)

        merges = []
        for token in sorted(ranks, key=ranks.__getitem__):
            for cut in range(1, len(token)):
                left, right = token[:cut], token[cut:]
                if left in ranks and right in ranks:
                    merges.append((shown(left), shown(right)))
        vocab = {shown(token): rank for token, rank in ranks.items()}
        # A piece that is a token as a whole stays whole.
        self.pieces = Pieces(models.BPE(vocab=vocab, merges=merges, ignore_merges=True))
        self.pattern = regex.compile(pattern.replace(r"[^\s", f"[^{_SPACE}").replace(r"\S", f"[^{_SPACE}]").replace(r"\s", f"[{_SPACE}]"))
        self.lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)))
        ordered = sorted((rank, token) for token, rank in ranks.items())
        self.table = np.frombuffer(b"".join(token for _, token in ordered), dtype=np.uint8)

    def encode(self, text: str) -> bytes:
        """The ids of ``text``, four bytes each."""
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text)))

    def offsets(self, text: str) -> list[tuple[int, int, int]]:
        """(id, start, end) of each token in characters. Tokens that hold parts of one character all cover it."""
        out = []
        for match in self.pattern.finditer(text):
            owner = [match.start() + i for i, c in enumerate(match[0]) for _ in c.encode("utf-8")]
            at = 0
            for token in self.pieces.tokens(match[0]):
                last = at + int(self.lengths[token.id])
                out.append((token.id, owner[at], owner[last - 1] + 1))
                at = last
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the tokens; characters whose bytes lie in several tokens become whole again."""
        pieces = []
        for begin in range(0, len(ids), _DECODE_IDS):
            part = ids[begin : begin + _DECODE_IDS].astype(np.int64)
            lengths = self.lengths[part]
            ends = np.cumsum(lengths)
            shift = np.repeat(self.starts[part] - (ends - lengths), lengths)
            pieces.append(self.table[shift + np.arange(len(shift))].tobytes())
        return b"".join(pieces)


@functools.cache
def coder(path: str) -> ByteBpe:
    """One per worker and file."""
    return ByteBpe(path)


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and the token ids of ``text``, a row for each row of ``docs``."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for batch in parts(source):
            found = [bpe.encode(t) for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *(len(f) // 4 for f in found)]).astype(np.int32)
            ids = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(found))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, ids)], ["id", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(batches, f"id {kind}, ids array<int>").withColumnRenamed("id", key)


def encode_with_offsets(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``tokens``: id, start and end (code points) of every token of ``text``."""
    token = pa.struct([("id", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for batch in parts(source):
            found = [[dict(zip(("id", "start", "end"), t)) for t in bpe.offsets(text)] for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(token))], ["id", "tokens"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = f"id {kind}, tokens array<struct<id:int,start:int,end:int>>"
    return rows.mapInArrow(batches, schema).withColumnRenamed("id", key)


def _lists(column: pa.Array) -> Iterator[np.ndarray]:
    ends, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    for begin, end in zip(ends[:-1], ends[1:]):
        yield values[begin:end]


def decode(tokens: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key``, the decoded ``bytes`` and, as ``text``, these read as UTF-8 (U+FFFD for broken sequences)."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for batch in parts(source):
            found = [bpe.decode(x) for x in _lists(batch.column(1))]
            shown = pa.array([f.decode("utf-8", "replace") for f in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()), shown], ["id", "bytes", "text"])

    kind = tokens.schema[key].dataType.simpleString()
    rows = tokens.select(F.col(key).alias("id"), F.coalesce(F.col(ids), F.array().cast("array<int>")).alias("ids"))
    return rows.mapInArrow(batches, f"id {kind}, bytes binary, text string").withColumnRenamed("id", key)


def digests(tokens: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``n_tokens``, the digest of the ids and that of the bytes they decode to."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for batch in parts(source):
            counts, of_ids, of_bytes = [], [], []
            for x in _lists(batch.column(1)):
                counts.append(len(x))
                of_ids.append(hashlib.sha256(x.astype("<u4").tobytes()).hexdigest())
                of_bytes.append(hashlib.sha256(bpe.decode(x)).hexdigest())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = tokens.schema[key].dataType.simpleString()
    rows = tokens.select(F.col(key).alias("id"), F.coalesce(F.col(ids), F.array().cast("array<int>")).alias("ids"))
    schema = f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return rows.mapInArrow(batches, schema).withColumnRenamed("id", key)
