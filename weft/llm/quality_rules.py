"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation learns how far to trust each.

Everything per document is a column expression. The votes' patterns are counted over all documents; at most
3 to the number of rules exist, so the counts fit on the driver, where expectation-maximisation
estimates how often each rule votes "good", "bad" or not at all for good and for bad documents, and how many
documents have a fault that one rule alone sees. The posterior probability of a good document then is a sum per row.

Defined results: null text counts as empty; texts without words fail the base rules; an empty table gives no rows;
repeated rows are judged alike; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5
KEEP = 0.5
#: Chances that a good and that a bad document fails a rule that votes, and share of good documents, as they are
#: expected; each weighs as much as ``PRIOR`` rows, whatever the table holds.
FALSE_ALARM, HIT, SHARE, PRIOR = 0.01, 0.5, 0.8, 10.0
#: Largest share of documents that are believed to have a fault that one rule alone sees.
LONE = (1 - SHARE) * HIT
ROUNDS = 60
GOOD, BAD, NONE = 1, 0, 2


def features(docs: DataFrame) -> DataFrame:
    """doc_id and counts of each text. A step's arrays are read by the next step's lambdas more than once, so none is computed again."""
    t, words, windows, lines, order = (F.col(c) for c in ("t", "words", "windows", "lines", "ordered"))
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    df = df.withColumns(
        {"words": F.regexp_extract_all("t", F.lit(WORD), F.lit(0)), "lines": F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD))}
    )

    def window(i: Column) -> Column:
        return F.xxhash64(*(F.get(words, i + k) for k in range(WINDOW)))

    df = df.select(
        "doc_id",
        F.size("words").alias("n_words"),
        F.length(F.array_join("words", "")).alias("word_chars"),
        (F.length(t) - F.length(F.regexp_replace(t, SYMBOLS + "+", ""))).alias("n_symbols"),
        (F.length(t) - F.length(F.regexp_replace(t, "[A-Z]+", ""))).alias("n_capitals"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.size(F.array_distinct("words")).alias("n_distinct"),
        F.when(F.size("words") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("words") - WINDOW), window))
        .otherwise(F.array().cast("array<bigint>"))
        .alias("windows"),
    )
    # Only texts with a repeated window sort their windows; equal ones are then neighbours.
    df = df.withColumn(
        "ordered",
        F.when(
            F.size(F.array_distinct(windows)) < F.size(windows),
            F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    ).drop("windows")
    repeated = F.filter(
        order, lambda x, k: (x.h == F.get(order, k - 1).h) | F.coalesce(x.h == F.get(order, k + 1).h, F.lit(False))
    )
    starts = F.sort_array(F.transform(repeated, lambda x: x.i))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("total"), F.lit(-WINDOW).alias("last")),
        lambda a, i: F.struct((a.total + F.least(F.lit(WINDOW), i - a.last)).alias("total"), i.alias("last")),
        lambda a: a.total,
    )
    counts = ("n_words", "word_chars", "n_symbols", "n_capitals", "n_lines", "n_dup_lines", "n_distinct")
    return df.select(
        "doc_id", *(F.col(c).cast("bigint").alias(c) for c in counts), F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words")
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def votes() -> dict[str, Column]:
    """Rule to vote. The limits are shares of words, characters or lines."""

    def rule(bad: Column, good: Column) -> Column:
        return F.when(bad, BAD).when(good, GOOD).otherwise(NONE)

    n, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    lines = F.greatest("n_lines", F.lit(1))
    symbols, capitals, mean = F.col("n_symbols") / n, F.col("n_capitals") / chars, F.col("word_chars") / n
    repeats, same, distinct = F.col("n_repeat_words") / n, F.col("n_dup_lines") / lines, F.col("n_distinct") / n
    return {
        "symbols": rule(symbols > 0.15, symbols < 0.05),
        "capitals": rule(capitals > 0.3, capitals < 0.1),
        "word_length": rule((mean < 2.5) | (mean > 12), (mean >= 3) & (mean <= 9)),
        "repeats": rule(repeats > 0.2, repeats < 0.1),
        "same_lines": rule((same > 0.3) & (F.col("n_lines") > 2), same < 0.1),
        "distinct": rule((distinct < 0.2) & (n > 20), distinct > 0.35),
        "length": rule(n < 10, n > 30),
    }


def _weights(chance: list[list[float]]) -> list[float]:
    """Log-odds of a good document by vote; not voting says nothing."""
    bad, good, _ = chance
    return [math.log(good[BAD] / bad[BAD]), math.log(good[GOOD] / bad[GOOD]), 0.0]


def _lone(share: float, chance: list[list[float]]) -> float:
    """Odds that a rule's "bad" vote on an otherwise good document is a fault that only this rule sees."""
    return chance[2][0] / (share * chance[1][BAD])


def learn(counts: list[tuple[tuple[int, ...], int]], rules: int, rounds: int = ROUNDS) -> tuple[float, list[list[list[float]]]]:
    """(share of good documents, for each rule the chances of its votes for bad and for good documents and, as a third list, the
    share of documents with a fault that it alone sees) from counted vote patterns.

    Documents are good, bad as several rules see it, or good but for a fault of one rule. Votes cannot tell the last from false
    alarms, so the expectations that EM begins with and ``LONE`` decide between these two; all else follows the counts.
    """
    share, common = SHARE, 1 - SHARE - LONE
    chance = [[[HIT, 1 - HIT, 0.0], [FALSE_ALARM, 1 - FALSE_ALARM, 0.0], [LONE]] for _ in range(rules)]
    for _ in range(rounds):
        goods, bads = SHARE * PRIOR, (1 - SHARE - LONE) * PRIOR
        lone = [0.0] * rules
        mass = [[[0.0, 0.0], [0.0, 0.0]] for _ in range(rules)]
        voted = [0] * rules
        weights, odds = [_weights(c) for c in chance], [_lone(share, c) for c in chance]
        for p, n in counts:
            fit = math.log(common / share) - sum(weights[r][v] for r, v in enumerate(p))
            parts = [math.exp(min(500.0, fit)), *(odds[r] if v == BAD else 0.0 for r, v in enumerate(p))]
            bad, *own = (n * x / (1 + sum(parts)) for x in parts)
            goods, bads = goods + n - bad - sum(own), bads + bad
            for r, v in enumerate(p):
                if v != NONE:
                    voted[r] += n
                    lone[r] += own[r]
                    mass[r][0][v] += bad
                    mass[r][1][v] += n - bad - own[r]
        for r in range(rules):
            # What a rule sees alone beyond ``LONE`` is false alarms.
            excess = max(0.0, lone[r] - LONE * voted[r])
            lone[r] += LONE * PRIOR / rules - excess
            goods += excess
            mass[r][1][BAD] += excess
            bad, fine = mass[r]
            # A "bad" vote never speaks for a document.
            if fine[BAD] * sum(bad) > bad[BAD] * sum(fine):
                both = [(a + b) / (sum(bad) + sum(fine)) for a, b in zip(bad, fine)]
                bad, fine = ([sum(m) * x for x in both] for m in (bad, fine))
            for y, (m, expected) in enumerate(((bad, HIT), (fine, FALSE_ALARM))):
                rate = (m[BAD] + expected * PRIOR) / (sum(m) + PRIOR)
                chance[r][y] = [rate, 1 - rate, 0.0]
        every = goods + bads + sum(lone)
        share, common = goods / every, bads / every
        for r in range(rules):
            chance[r][2] = [lone[r] / every]
    return share, chance


def judge(docs: DataFrame) -> DataFrame:
    """The base counts, ``base_failed``, the votes, ``quality`` (posterior probability) and ``kept``."""
    rules = votes()
    voted = materialize(features(docs).withColumns(rules), "votes")
    counted = [(tuple(r[:-1]), r[-1]) for r in voted.groupBy(*rules).count().collect()]
    share, chance = learn(sorted(counted), len(rules))
    common = 1 - share - sum(c[2][0] for c in chance)
    fit, own = F.lit(math.log(common / share)), F.lit(0.0)
    for name, c in zip(rules, chance):
        weights = _weights(c)
        fit -= F.when(F.col(name) == BAD, weights[BAD]).when(F.col(name) == GOOD, weights[GOOD]).otherwise(0.0)
        own += F.when(F.col(name) == BAD, _lone(share, c)).otherwise(0.0)
    scored = voted.withColumn("quality", 1 / (1 + F.exp(fit) + own)).withColumn("base_failed", base_failed())
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= KEEP))
