from __future__ import annotations

import math
import re
from collections import Counter

from weft.llm import quality_rules
from weft.llm.catalog import QUERIES

SMALL = "/root/testdata/sf0.001"


def expected(text: str | None) -> dict:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, r = len(words), len(covered)
    return {
        "n_words": n,
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": r,
        "base_failed": n < 10 or 100 * r > 20 * n,
    }


def compare(rows, texts):
    assert len(rows) == len(texts)
    for row in rows:
        want = expected(texts[row.doc_id])
        assert {k: row[k] for k in want} == want, texts[row.doc_id][:200]
        assert not (row.base_failed and row.kept)


def test_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    compare(QUERIES["op10_quality_rules"](spark, SMALL).collect(), texts)


def test_edge_rows(spark):
    run = "one two three four five six "
    texts = [
        None, "", " \n\t\x0b", "a b c d e", "a b c d e f", "a b c d e a b c d e", run * 3, "x\n\n x\nx\ny\ny", "a a a a a a a",
        "é # ü\x0c$ |", "nul\x00word here", "w" * 300_000, ("word " * 40_000), "a\rb", "1 2 3 4 5 6 1 2 3 4 5 7 2 3 4 5 6",
    ]
    docs = spark.createDataFrame([(i, t, 5, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_words int, words string")
    compare(quality_rules.judge(docs).collect(), dict(enumerate(texts)))
    assert quality_rules.judge(docs.limit(0)).count() == 0
    twice = quality_rules.judge(docs.union(docs)).collect()
    assert len(twice) == 2 * len(texts) and len({(r.doc_id, r.kept) for r in twice}) == len(texts)


def test_learning_trusts_rules_by_their_agreement():
    # Rules 0 and 1 agree on the bad documents, rule 2 says "bad" at random.
    counts = [((1, 1, 1), 500), ((1, 1, 0), 300), ((0, 0, 1), 90), ((0, 0, 0), 10)]
    share, chance = quality_rules.learn(counts, 3)
    assert 0.7 < share < 0.95
    trust = [chance[r][0][0] / chance[r][1][0] for r in range(3)]
    assert trust[0] == trust[1] > 1.3 * trust[2] > 1.3


def quality(learned, pattern):
    """The posterior of a good document by Bayes' rule over all classes."""
    share, chance = learned
    good = share * math.prod(chance[r][1][v] for r, v in enumerate(pattern))
    bad = (1 - share - sum(c[2][0] for c in chance)) * math.prod(chance[r][0][v] for r, v in enumerate(pattern))
    own = sum(good * chance[r][2][0] / (share * chance[r][1][0]) for r, v in enumerate(pattern) if v == 0)
    return good / (good + bad + own)


def test_a_random_rule_does_not_drop_what_all_others_pass():
    # Rules 0 and 1 agree on a tenth; rule 2 says "bad" of a third, at random. Verdicts do not depend on the size of the table.
    for times in (1, 100):
        counts = [((1, 1, 1), 600 * times), ((1, 1, 0), 300 * times), ((0, 0, 1), 66 * times), ((0, 0, 0), 34 * times)]
        learned = quality_rules.learn(counts, 3)
        assert min(quality(learned, (1, 1, 1)), quality(learned, (1, 1, 0))) > quality_rules.KEEP
        assert max(quality(learned, (0, 0, 1)), quality(learned, (0, 0, 0))) < 0.1
    alone = [quality(quality_rules.learn([((1,) * 7, 1000 - n), ((0,) + (1,) * 6, n)], 7), (0,) + (1,) * 6) for n in (80, 330, 500, 999)]
    assert alone[0] < quality_rules.KEEP < min(alone[1:])


def test_priors_wash_out():
    counts = [((1, 1, 1, 1), 4000), ((0, 0, 0, 1), 3000), ((0, 0, 1, 1), 3000)]
    small, large = (quality_rules.learn([(p, n * times // 100) for p, n in counts], 4) for times in (1, 10000))
    assert abs(large[0] - 0.4) < 0.001 < abs(small[0] - 0.4) and abs(large[1][2][0][0] - 0.5) < 0.001


def test_verdicts_follow_the_labels(spark):
    judged = quality_rules.judge(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").withColumnRenamed("doc_id", "id")
    rows = judged.select("doc_id", "kept").join(labels.select("id", "quality"), judged.doc_id == labels.id).collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.1 * len(bad)
