from __future__ import annotations

import random

from weft.llm import decontaminate
from weft.llm.catalog import QUERIES

SMALL = "/root/testdata/sf0.001"


def least_distance(pattern: str, text: str) -> int:
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i] + 1, new[i - 1] + 1, row[i - 1] + (p != c)))
        row = new
        best = min(best, row[-1])
    return best


def test_bit_parallel_distance():
    random.seed(4)
    for _ in range(300):
        pattern = "".join(random.choices("abc ", k=random.randint(1, 90)))
        text = "".join(random.choices("abc ", k=random.randint(0, 120)))
        assert decontaminate.best_end(decontaminate.masks(pattern), len(pattern), text)[0] == least_distance(pattern, text)


def expected(docs: dict, items: dict) -> dict:
    texts = {k: decontaminate.normal(t) for k, t in items.items()}
    texts = {k: t for k, t in texts.items() if len(t) >= decontaminate.MIN_CHARS}
    return {
        d: sorted(k for k, t in texts.items() if least_distance(t, decontaminate.normal(text)) <= int(decontaminate.ERROR_RATE * len(t)))
        for d, text in docs.items()
    }


def test_edited_passages_and_edge_rows(spark):
    random.seed(6)
    letters = "abcdefghijklmnop    "
    items = {i: "".join(random.choices(letters, k=random.choice([30, 60, 150, 300]))) for i in range(12)}
    items |= {20: items[3], 21: None, 22: "", 23: "too short", 24: "Ünïcode PASSAGE, with signs -- and (more) words"}
    docs = {0: None, 1: "", 2: "UNICODE", 3: "x " + items[24].upper().replace(",", " ; ")}
    for i in range(4, 60):
        text = list("".join(random.choices(letters, k=120)) + items[i % 12] + "".join(random.choices(letters, k=120)))
        size = len(decontaminate.normal(items[i % 12]))
        for _ in range(random.choice([0, 1, int(0.06 * size), int(0.1 * size), int(0.2 * size)])):
            at = random.randrange(120, len(text) - 120)
            text[at] = random.choice(["", "zz", "q"])
        docs[i] = "".join(text)
    docs[60] = "".join(random.choices(letters, k=100_000)) + items[5]
    left = spark.createDataFrame([(k, t, 1) for k, t in docs.items()], "doc_id long, text string, items int")
    right = spark.createDataFrame([(k, t, "x") for k, t in items.items()], "item_id long, text string, doc_id string")
    got = {r.doc_id: r.item_ids for r in decontaminate.report(left, right).collect()}
    want = expected({k: t for k, t in docs.items() if k < 60}, items)
    assert {k: v for k, v in got.items() if k < 60} == want and 5 in got[60]
    assert sum(map(bool, want.values())) > 25
    kept = {r.doc_id for r in decontaminate.clean(left, right).collect()}
    assert kept == {k for k, v in got.items() if not v}
    assert not any(r.contaminated for r in decontaminate.report(left, right.limit(0)).collect())
    assert decontaminate.report(left.limit(0), right).count() == 0


def test_several_slices_give_the_same(spark, monkeypatch):
    docs, items = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    one = {r.doc_id: r.item_ids for r in decontaminate.report(docs, items).collect()}
    monkeypatch.setattr(decontaminate, "SLICE_CHARS", 1000)
    assert one == {r.doc_id: r.item_ids for r in decontaminate.report(docs, items).collect()}


def test_whole_table(spark):
    docs, items = (
        {r[0]: r.text for r in spark.read.parquet(f"{SMALL}/{t}.parquet").collect()} for t in ("documents", "benchmark")
    )
    got = {r.doc_id: set(r.item_ids) for r in QUERIES["op3_decontamination"](spark, SMALL).collect()}
    assert got.keys() == docs.keys()
    for key, text in docs.items():
        assert got[key] >= {k for k, t in items.items() if decontaminate.normal(t) in decontaminate.normal(text)}
    some = {k: docs[k] for k in sorted(docs, key=lambda k: len(docs[k] or ""))[:40]} | {k: docs[k] for k, v in got.items() if v and len(docs[k]) < 1500}
    assert {k: set(v) for k, v in expected(some, items).items()} == {k: got[k] for k in some}
