from __future__ import annotations

import base64
import hashlib
import random
import struct

import public_tokenizers
import tiktoken

from weft.llm import bpe
from weft.llm.catalog import QUERIES, VOCABULARY

RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
EXACT = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
SMALL = "/root/testdata/sf0.001"


def test_same_ids_as_the_rank_library_on_random_text():
    random.seed(5)
    letters = [chr(c) for c in range(0x250)] + [*" \n\t'  \x1c\x85\xa0　中😀́²Ⅰ"] * 20
    own = bpe.ByteBpe(VOCABULARY)
    for _ in range(3000):
        text = "".join(random.choices(letters, k=random.randrange(40)))
        want = EXACT.encode_ordinary(text)
        assert own.encode(text) == struct.pack(f"<{len(want)}I", *want)
        assert [t[0] for t in own.offsets(text)] == want


def test_offsets_cover_the_text_and_split_characters():
    own = bpe.ByteBpe(VOCABULARY)
    text = "naïve 中文 \U0001f9ea\U0001f9ea end"
    tokens = own.offsets(text)
    assert tokens[0][1] == 0 and tokens[-1][2] == len(text)
    for (_, _, end), (_, start, _) in zip(tokens, tokens[1:]):
        assert start in (end, end - 1)
    assert any(a[1:] == b[1:] for a, b in zip(tokens, tokens[1:])), "the sample has a character in several tokens"


def test_edge_rows(spark):
    texts = [None, "", "a", "a", "x" * 300_000, " \n\n ", "퟿\u0000"]
    docs = spark.createDataFrame([(i, t, "clash", 7) for i, t in enumerate(texts)], "doc_id long, text string, ids string, n_tokens int")
    encoded = bpe.encode(docs, VOCABULARY)
    got = {r.doc_id: r for r in bpe.digests(encoded, VOCABULARY).collect()}
    back = {r.doc_id: r for r in bpe.decode(encoded, VOCABULARY).collect()}
    spans = {r.doc_id: r.tokens for r in bpe.encode_with_offsets(docs, VOCABULARY).collect()}
    for i, text in enumerate(texts):
        ids = EXACT.encode_ordinary(text or "")
        assert got[i].n_tokens == len(ids) == len(spans[i])
        assert got[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
        assert back[i].text == (text or "")
    assert bpe.digests(bpe.encode(docs.limit(0), VOCABULARY), VOCABULARY).count() == 0


def test_null_ids_and_broken_characters(spark):
    half = RANKS["中".encode()[:1]] if "中".encode()[:1] in RANKS else RANKS[b"\xe4"]
    rows = spark.createDataFrame([(1, None), (2, [half])], "doc_id long, ids array<int>")
    got = {r.doc_id: r for r in bpe.decode(rows, VOCABULARY).collect()}
    assert bytes(got[1].bytes) == b"" and got[2].text == "�"


def test_query_over_the_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op1_byte_bpe"](spark, SMALL).collect()}
    assert got.keys() == texts.keys()
    for key, text in texts.items():
        ids = EXACT.encode_ordinary(text or "")
        assert got[key].n_tokens == len(ids)
        assert got[key].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[key].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
