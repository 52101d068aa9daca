from __future__ import annotations

import random
import re

from weft.llm import minhash
from weft.llm.catalog import QUERIES
from weft.llm.components import components

SMALL = "/root/testdata/sf0.001"


def shingles(text: str | None, size: int) -> frozenset:
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if 0 < len(words) < size:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def expected(texts: dict, size: int, percent: int) -> dict:
    sets = {k: shingles(t, size) for k, t in texts.items()}
    parent = {k: k for k in texts}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                ra, rb = sorted((root(a), root(b)))
                parent[rb] = ra
    return {k: (len(sets[k]), root(k), root(k) == k) for k in keys}


def result(df) -> dict:
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert result(QUERIES["op8_minmax_near_dedup"](spark, SMALL)) == expected(texts, 2, 80)


def test_chains_copies_and_edge_rows(spark):
    random.seed(3)
    texts = [None, "", " \n", "One", "one", "two words", "TWO words", "É one", "é one", "x " * 50_000]
    base = [f"w{i}" for i in range(120)]
    # Each step changes one word more: the ends of the chain are far apart.
    for step in range(40):
        texts.append(" ".join([*(f"c{i}" for i in range(step)), *base[step:]]))
    for _ in range(60):
        other = list(base)
        for at in random.sample(range(120), random.choice([1, 3, 6, 9])):
            other[at] = f"r{random.random()}"
        texts.append(" ".join(other))
    texts += ["copy of the same words " * 5] * 30
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, key string, bands int")
    assert result(minhash.near_duplicates(docs, 2)) == expected(dict(enumerate(texts)), 2, 80)
    assert result(minhash.near_duplicates(docs)) == expected(dict(enumerate(texts)), 5, 80)
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "a b c"), (1, "a b c"), (None, "a b c"), (None, "lonely text"), (2, "a b c")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [
        (0, 0, True), (0, 1, False), (1, 1, True), (1, 1, True), (2, 1, False),
    ]


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 300)] + [(250, 400), (5, 5)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 7: 7, 400: 7, **{i: 7 for i in range(200, 300)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_edited_copies_below_the_limit_are_not_compared_all_with_all(spark, monkeypatch):
    """Copies at 0.6 to 0.95 of their source, a few of them edited again: the links among those below the limit are found by few comparisons."""
    random.seed(11)
    vocabulary = [f"v{i}" for i in range(60)]
    base = [f"w{i}" for i in range(150)]

    def edited(source, edits):
        other = list(source)
        for at in random.sample(range(len(other)), edits):
            other[at] = random.choice(vocabulary)
        return other

    copies = [edited(base, random.choice([2, 3, 5, 7, 9, 12, 14, 16])) for _ in range(400)]
    copies += [edited(c, 3) for c in copies[:40]]
    texts = {i: " ".join(t) for i, t in enumerate([base, *copies])}
    asked = []
    compare = minhash._compare
    monkeypatch.setattr(minhash, "_compare", lambda sets, pairs: asked.append(pairs.count()) or compare(sets, pairs))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert result(minhash.near_duplicates(docs, 2)) == expected(texts, 2, 80)
    assert len(asked) == 2 and asked[1] < 5 * len(texts)
