"""Secret scans: patterns, and formats learned by grammar inference.

Patterns find credentials of three kinds. All different ones, labelled by their kind, are what format
automata are inferred from: credentials of a kind make a prefix tree over
character classes, and states whose ending and following frequencies agree within Hoeffding's bound are
merged (with their subtrees), which gives a deterministic probabilistic automaton. Then every candidate
token of every text is scored: its likelihood per character under the automata, against that of characters drawn from
all different ordinary tokens. Candidates beyond the limit that no pattern covers become ``format`` spans.

Bounds: tokens, prefixes and pairs of characters are counted by Spark. A tree is ``DEPTH`` characters deep: a longer credential goes back to the
root with the next one, and is counted there in a further piece. The driver holds the prefixes that at least one in ``SHARE`` of a
kind's pieces begin with, all of them up to ``SHARE`` pieces. What follows a rarer one is too rare to be told from any state: it is
merged with the root, and counted there from its next character on, so that every character of every credential of any length
counts once.

Defined results: null text counts as empty and has no spans; repeated rows give repeated results; without
credentials to learn from nothing is added; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.session import materialize

KINDS = ("assign", "access", "hex")
#: The patterns of the kinds and the least lengths.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{24,}")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20

ORDINARY = re.compile("[A-Za-z]{6,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
SHARE = 2000
#: Alphabet of the automata: character classes, each with its size.
CLASSES = {"0": 10, "g": 6, "z": 20, "A": 26, "-": 6}
#: Confidence of the merge test, and bits per character that a candidate must gain over ordinary tokens.
ALPHA = 0.05
MIN_GAIN = 0.75
#: No bound on the characters of a credential that count; a prefix tree is so deep, and what is longer goes on at its root.
MAX_STEPS = None
DEPTH = 48


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, credential) in order."""
    found = []
    if re.search("(?ai)passw|secret|token|api_?key", text):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= LEAST_ASSIGN:
                found.append((m.start(), 0, m.end(), m[2]))
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def symbols(token: str) -> str:
    """The class of each character: digit, letter a to f, other small letter, capital, sign."""
    return "".join("0" if c.isdigit() else "g" if c in "abcdef" else "z" if c.islower() else "A" if c.isupper() else "-" for c in token)


@dataclass
class State:
    ends: int = 0
    next: dict[str, int] = field(default_factory=dict)
    count: Counter = field(default_factory=Counter)

    @property
    def total(self) -> int:
        return self.ends + sum(self.count.values())


class Automaton:
    """A probabilistic automaton from examples, by merging compatible states of their prefix tree."""

    def __init__(self, examples: list[str]):
        through, ends, back = Counter(), Counter(), Counter()
        for word in map(symbols, examples):
            for begin in range(0, len(word) or 1, DEPTH + 1):
                piece, c = word[begin : begin + DEPTH], word[begin + DEPTH : begin + DEPTH + 1]
                through.update(piece[:at] for at in range(1, len(piece) + 1))
                if c:
                    back[piece, c] += 1
                if begin + DEPTH + 1 >= len(word):
                    ends["" if c else piece] += 1
        self._infer(through, ends, back)

    @classmethod
    def counted(cls, through: Counter, ends: Counter, back: Counter) -> Automaton:
        """From numbers of examples: through and at the end of each prefix, and back to the root at (prefix, next class)."""
        automaton = cls.__new__(cls)
        automaton._infer(through, ends, back)
        return automaton

    def _infer(self, through: Counter, ends: Counter, back: Counter) -> None:
        self.states, at = [State()], {"": 0}
        for prefix in sorted(through, key=lambda p: (len(p), p)):
            at[prefix] = len(self.states)
            self.states.append(State())
            source = self.states[at[prefix[:-1]]]
            source.next[prefix[-1]] = at[prefix]
            source.count[prefix[-1]] += through[prefix]
        for prefix, n in ends.items():
            self.states[at[prefix]].ends += n
        for (prefix, c), n in back.items():
            source = self.states[at[prefix]]
            source.next.setdefault(c, 0)
            source.count[c] += n
        self._merge()

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        if not n1 or not n2:
            return False
        return abs(f1 / n1 - f2 / n2) > math.sqrt(0.5 * math.log(2 / ALPHA)) * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, a: int, b: int, depth: int = 0) -> bool:
        if a == b:
            return True
        x, y = self.states[a], self.states[b]
        if self._differ(x.ends, x.total, y.ends, y.total):
            return False
        for c in CLASSES:
            if self._differ(x.count[c], x.total, y.count[c], y.total):
                return False
            if depth < 8 and c in x.next and c in y.next and not self._compatible(x.next[c], y.next[c], depth + 1):
                return False
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the subtree at ``b`` to the automaton at ``a``."""
        pairs = [(a, b)]
        while pairs:
            a, b = pairs.pop()
            x, y = self.states[a], self.states[b]
            x.ends += y.ends
            for c, to in y.next.items():
                x.count[c] += y.count[c]
                if c not in x.next:
                    x.next[c] = to
                elif to:
                    # What goes back to the root is counted there.
                    pairs.append((x.next[c], to))

    def _merge(self) -> None:
        kept, blue = [0], [(0, c) for c in sorted(self.states[0].next)]
        while blue:
            source, c = blue.pop(0)
            target = self.states[source].next[c]
            if target in kept:
                continue
            for state in kept:
                if self._compatible(state, target):
                    self.states[source].next[c] = state
                    self._fold(state, target)
                    break
            else:
                kept.append(target)
            blue = [(s, c) for s in kept for c in sorted(self.states[s].next) if self.states[s].next[c] not in kept]
        self.size = len(kept)

    def bits(self, token: str) -> float:
        """Bits per character of ``token``, classes spelled out to characters."""
        at, total = 0, 0.0
        for c in symbols(token):
            state = self.states[at]
            if c not in state.next:
                return math.inf
            total -= math.log2((state.count[c] + 0.01) / (state.total + 0.05) / CLASSES[c])
            at = state.next[c]
        return total / max(len(token), 1)


@dataclass
class Formats:
    automata: dict[str, Automaton]
    ordinary: dict[str, float]
    shortest: dict[str, int]

    def gain(self, token: str) -> float:
        """Bits per character that the best automaton saves against ordinary text with the same characters."""
        plain = sum(self.ordinary[a + b] for a, b in zip("^" + token, token)) / max(len(token), 1) if token else 0.0
        fitting = [a.bits(token) for k, a in self.automata.items() if len(token) >= self.shortest[k]]
        return plain - min(fitting, default=math.inf)


class Pairs(dict):
    """Bits of a character after another one, as ordinary tokens have it; unseen pairs share what is left, and unseen first
    characters count as typical ones."""

    def __init__(self, pairs: Counter):
        heads = Counter()
        for pair, n in pairs.items():
            heads[pair[0]] += n
        self.heads = heads
        self.typical = sum(heads.values()) / max(len(heads), 1)
        super().__init__({p: -math.log2((n + 0.1) / (heads[p[0]] + 7.0)) for p, n in pairs.items()})

    def __missing__(self, pair: str) -> float:
        return -math.log2(0.1 / (max(self.heads[pair[0]], self.typical) + 7.0))


def _tokens(docs: DataFrame) -> DataFrame:
    """(kind, token): the different credentials and ordinary tokens of all texts."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            rows = set()
            for text in batch.column(0).to_pylist():
                rows |= {(KINDS[k], token) for _, k, _, token in base_spans(text)}
                rows |= {("ordinary", token) for token in ORDINARY.findall(text)}
            found = sorted(rows)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in found], pa.string()), pa.array([r[1] for r in found], pa.string())], ["kind", "token"])

    texts = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return materialize(texts.mapInArrow(batches, "kind string, token string").distinct(), "tokens")


def _pairs(tokens: DataFrame) -> Counter:
    """How often each character follows another one, or begins a token."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            found = Counter(a + b for t in batch.column(0).to_pylist() for a, b in zip("^" + t, t))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["pair", "n"])

    counted = tokens.select("token").mapInArrow(batches, "pair string, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    return Counter({r.pair: r.n for r in counted.collect()})


def _prefix_counts(words: DataFrame, least: dict[str, int]) -> dict[str, tuple[Counter, Counter, Counter]]:
    """By kind what :meth:`Automaton.counted` takes, of ``words`` (kind, word, is_last, n), for prefixes of at least ``least`` words.

    A word has ``DEPTH`` + 1 classes at most and is followed as long as its prefixes are that frequent; what is left behind the next class is a
    word of the next round. One that is not the last of its credential always ends by a class that goes back to the root.
    """
    trees = {kind: (Counter(), Counter(), Counter()) for kind in least}
    limit = F.create_map(*(x for kind, n in least.items() for x in (F.lit(kind), F.lit(n))))
    while not words.isEmpty():
        steps = F.least(F.length("word") - F.when(F.col("is_last"), 0).otherwise(1), F.lit(DEPTH))
        each = words.withColumn("steps", steps).where("steps > 0").select("kind", "word", "is_last", "n", F.explode(F.expr("sequence(1, steps)")).alias("at"))
        each = each.withColumn("prefix", F.substring("word", F.lit(1), F.col("at")))
        frequent = each.groupBy("kind", "prefix").agg(F.sum("n").alias("n")).filter(F.col("n") >= limit[F.col("kind")])
        frequent = materialize(frequent, "prefixes")
        known = each.join(frequent.select("kind", "prefix"), ["kind", "prefix"]).groupBy("kind", "word", "is_last").agg(F.max("at").alias("depth"))
        followed = words.join(known, ["kind", "word", "is_last"], "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
        cut = followed.select("kind", "is_last", "n", F.expr("substr(word, 1, depth)").alias("prefix"), F.expr("substr(word, depth + 1, 1)").alias("c"), F.expr("substr(word, depth + 2)").alias("word"))
        cut = materialize(cut, "followed")
        for r in frequent.collect():
            trees[r.kind][0][r.prefix] += r.n
        for r in cut.groupBy("kind", "prefix", "c").agg(F.sum("n").alias("n"), F.sum(F.when(F.expr("is_last AND word = ''"), F.col("n"))).alias("last")).collect():
            _, ends, back = trees[r.kind]
            if r.c == "":
                ends[r.prefix] += r.n
                continue
            back[r.prefix, r.c] += r.n
            ends[""] += r["last"] or 0
        words = materialize(cut.filter("word <> ''").groupBy("kind", "word", "is_last").agg(F.sum("n").alias("n")), "words")
    return trees


def learn(docs: DataFrame, share: int = SHARE) -> Formats:
    """From all credentials and ordinary tokens of ``docs``."""
    tokens = _tokens(docs)
    credentials = tokens.filter("kind <> 'ordinary'")
    last = F.expr(f"(length(token) - 1) div {DEPTH + 1}")
    known = credentials.groupBy("kind").agg(F.sum(last + 1).alias("n"), F.min(F.length("token")).alias("shortest")).collect()
    known = sorted(known, key=lambda r: KINDS.index(r.kind))
    if not known:
        return Formats({}, Pairs(Counter()), {})
    small, capitals = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    classes = F.translate("token", "0123456789" + small + capitals + "+/_.=-", symbols("0123456789" + small + capitals + "+/_.=-"))
    pieces = credentials.select("kind", classes.alias("whole"), last.alias("last"), F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece"))
    word = F.substr("whole", (F.col("piece") * (DEPTH + 1) + 1).cast("int"), F.lit(DEPTH + 1))
    words = pieces.select("kind", word.alias("word"), F.expr("piece = last").alias("is_last")).groupBy("kind", "word", "is_last").agg(F.count("*").alias("n"))
    trees = _prefix_counts(materialize(words, "words"), {r.kind: -(-r.n // share) for r in known})
    automata = {r.kind: Automaton.counted(*trees[r.kind]) for r in known}
    return Formats(automata, Pairs(_pairs(tokens.filter("kind = 'ordinary'"))), {r.kind: r.shortest for r in known})


def spans(text: str, formats: Formats) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, float]]]:
    """(base spans, added spans with their gains)."""
    base = [(start, kind, end) for start, kind, end, _ in base_spans(text)]
    added = []
    if formats.automata:
        for m in CANDIDATE.finditer(text):
            token = m[0].strip(".=-_")
            if not any(c.isdigit() for c in token) or token.isdigit():
                continue
            start = m.start() + m[0].index(token)
            end = start + len(token)
            if any(s < end and start < e for s, _, e in base):
                continue
            gain = formats.gain(token)
            if gain >= MIN_GAIN:
                added.append((start, end, gain))
    return base, added


def scan(docs: DataFrame, formats: Formats) -> DataFrame:
    """(doc_id, base, added): spans as arrays; kinds by their place in ``KINDS``."""
    one = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    two = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("gain", pa.float64())]))

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            base, added = [], []
            for text in batch.column(1).to_pylist():
                b, a = spans(text, formats)
                base.append([dict(zip(("start", "kind", "end"), s)) for s in b])
                added.append([dict(zip(("start", "end", "gain"), s)) for s in a])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, one), pa.array(added, two)], ["doc_id", "base", "added"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(
        batches, "doc_id bigint, base array<struct<start:int,kind:int,end:int>>, added array<struct<start:int,end:int,gain:double>>"
    )


def report(docs: DataFrame) -> DataFrame:
    """Counts by kind, the digest of the base spans and all spans as text."""
    found = scan(docs, learn(docs))
    names = F.array(*(F.lit(k) for k in (*KINDS, "format")))
    added = F.transform("added", lambda s: F.struct(s.start.alias("start"), F.lit(len(KINDS)).alias("kind"), s.end.alias("end")))

    def shown(s):
        return F.concat_ws(":", F.get(names, s.kind), s.start.cast("string"), s.end.cast("string"))

    def count(kind: int):
        return F.size(F.filter("base", lambda s: s.kind == kind)).cast("bigint")

    return found.select(
        "doc_id",
        *(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)),
        F.sha2(F.array_join(F.transform("base", shown), ","), 256).alias("base_sha256"),
        F.array_join(F.transform(F.sort_array(F.concat("base", added)), shown), ",").alias("spans"),
    )
