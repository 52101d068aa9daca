"""Personal data by patterns, and information-theoretic sanitisation of the words that give it away.

Patterns find protected entities (e-mail, ip, card and phone numbers). A word that occurs in the documents of an
entity reveals it as far as seeing the word makes the entity likelier: with document counts over
the whole corpus, P(entity | word) = c(word, entity) / c(word), smoothed, and the disclosure in bits is
log2(P(entity | word) / P(entity)). Where both reach their limits, the word becomes a ``term`` span at all its places in
all documents. ``sanitise`` generalises entities to their kind and removes terms.

Everything is a column expression or an aggregate. Positions come from the lengths of what a pattern
matches and of what lies between (code points, end exclusive). The patterns are written so that no run of characters is
tried from each of its places and no repeated group recurses over a long text; an e-mail's domain ends
after 1000 labels. Words are counted in documents as hashes, reduced before the shuffle.

Defined results: null text counts as empty and has no spans; repeated rows give repeated results; an
empty table gives no rows; other columns are ignored (``sanitise`` keeps them, and null stays null there).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.session import materialize

KINDS = ("email", "ip", "card", "phone")
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: Each matches what the plain pattern matches from the left; runs are entered at their beginning only.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++){{1,1000}}+",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # Whole runs of digits with single separators, of the right size only: other runs would fail as a whole.
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
WORD = r"[^\x20\x09-\x0D]+"
#: Characters on each side of an entity that tell its different contexts from copies.
NEAR_CHARS = 80
#: Limits of a term: chance of the entity given the word, and bits of disclosure. The chance is estimated with so many documents
#: more that hold the word, and the entity as often as any.
MIN_CHANCE = 0.5
MIN_BITS = 5.0
PRIOR = 2.0


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _holds(kind: str, hit: Column) -> Column:
    return {
        "email": lambda: F.lit(True),
        "ip": lambda: hit.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"),
        "card": lambda: F.call_function("luhn_check", _digits(hit)),
        "phone": lambda: F.length(_digits(hit)).between(10, 15),
    }[kind]()


def _may(kind: str, text: Column) -> Column:
    """A cheap test that is true for every text with a match."""
    return {
        "email": text.contains("@"),
        "ip": text.rlike(r"[0-9]\.[0-9]++\.[0-9]"),
        "card": text.rlike(r"[0-9](?:[ -]?[0-9]){13}"),
        "phone": text.contains("+"),
    }[kind]


SPAN = "array<struct<start:int,kind:int,end:int,value:string,left:string,right:string>>"
_BLOCK = 256


def _appended(a: Column, item: Column) -> list[Column]:
    """``a.block`` and ``a.blocks`` with one item more: a full block goes to the blocks, so that long lists are not copied for each item."""
    full = F.size(a.block) >= _BLOCK
    return [
        F.when(full, F.array(item)).otherwise(F.concat(a.block, F.array(item))).alias("block"),
        F.when(full, F.concat(a.blocks, F.array(a.block))).otherwise(a.blocks).alias("blocks"),
    ]


def _gathered(items: Column, kind: str, step) -> Column:
    """The array (``kind``) of what ``step`` (position, item) keeps; it returns the next position, the condition and the value."""

    def merge(a: Column, x: Column) -> Column:
        at, held, value = step(a.at, x)
        block, blocks = _appended(a, value)
        return F.struct(
            at.alias("at"),
            F.when(held, block).otherwise(a.block).alias("block"),
            F.when(held, blocks).otherwise(a.blocks).alias("blocks"),
        )

    start = F.struct(
        F.lit(0).alias("at"), F.array().cast(kind).alias("block"), F.array().cast(f"array<{kind}>").alias("blocks")
    )
    return F.aggregate(items, start, merge, lambda a: F.concat(F.flatten(a.blocks), a.block))


def _matches(text: Column, pattern: str) -> Column:
    """Matches in order: the text since the last one (0), the match (1) and the text up to the next one (2)."""
    between, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    after = F.slice(between, 2, F.greatest(F.size(between), F.lit(1)))
    return F.filter(F.arrays_zip(between.alias("0"), hits.alias("1"), after.alias("2")), lambda x: x["1"].isNotNull())


def _spans(order: int, kind: str, text: Column) -> Column:
    """Spans of one kind with the text beside them, up to the next match: the lengths add up to positions."""

    def step(at: Column, x: Column) -> tuple[Column, Column, Column]:
        start = at + F.length(x["0"])
        end = start + F.length(x["1"])
        left, right = F.substring(x["0"], -NEAR_CHARS, NEAR_CHARS), F.substring(x["2"], 1, NEAR_CHARS)
        span = F.struct(
            start.alias("start"), F.lit(order).alias("kind"), end.alias("end"), x["1"].alias("value"), left.alias("left"), right.alias("right")
        )
        return end, _holds(kind, x["1"]), span

    found = _gathered(_matches(text, PATTERNS[kind]), SPAN, step)
    return F.coalesce(F.when(_may(kind, text), found), F.array().cast(SPAN))


def _base(text: Column) -> Column:
    """The spans of all kinds by start, then kind."""
    return F.sort_array(F.concat(*(_spans(i, kind, text) for i, kind in enumerate(KINDS))))


def _masked(base: Column, text: Column) -> Column:
    """``text`` with blanks in place of its spans: its words stand where they stood."""

    def step(at: Column, s: Column) -> tuple[Column, Column, Column]:
        blank = F.repeat(F.lit(" "), s.end - F.greatest(at, s.start))
        end = F.greatest(at, s.end)
        return end, s.end > at, F.struct(F.concat(F.substring(text, at + 1, s.start - at), blank).alias("piece"), end.alias("end"))

    pieces = _gathered(base, "array<struct<piece:string,end:int>>", step)
    joined = F.concat(F.array_join(F.transform(pieces, lambda x: x.piece), ""), F.substring(text, F.array_max(base.end) + 1, F.length(text)))
    return F.when(F.size(base) > 0, joined).otherwise(text)


def _hash(word: Column) -> Column:
    return F.xxhash64(F.lower(word))


def _key(text: Column) -> Column:
    """Tells texts apart. What is found in a text depends on nothing else of its row."""
    return F.md5(text)


def _read(docs: DataFrame) -> DataFrame:
    """(key, entities, words) of each row: different entities with one context each, and the hashes of different words outside spans."""
    t, base, named = F.col("t"), F.col("base"), F.col("named")
    rows = docs.select(F.coalesce("text", F.lit("")).alias("t")).withColumn("base", _base(t)).withColumn("masked", _masked(base, t))
    entities = F.transform(
        base, lambda s: F.struct(F.xxhash64(s.kind, F.lower(s.value)).alias("entity"), F.xxhash64(s.left, s.right).alias("context"))
    )
    words = F.array_distinct(F.transform(F.regexp_extract_all("masked", F.lit(WORD), F.lit(0)), _hash))
    rows = rows.select(_key(t).alias("key"), F.sort_array(entities).alias("named"), words.alias("words"))
    first = F.filter(named, lambda x, i: (i == 0) | (F.get(named, i - 1).entity != x.entity))
    return rows.select("key", first.alias("entities"), "words")


def terms_of(docs: DataFrame) -> DataFrame:
    """(key, revealing): for each text that holds any, the hashes of its words that reveal an entity anywhere in the corpus."""
    rows = materialize(_read(docs), "words")
    total = rows.count()
    counted = rows.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("with_word"))
    held = rows.filter(F.size("entities") > 0)
    # Copies of a text are one row from here on, with their number.
    named = held.select("key", F.explode("entities").alias("e")).groupBy("key", "e.entity", "e.context").agg(F.count("*").alias("copies"))
    entities = named.groupBy("entity").agg(F.sum("copies").alias("with_entity"))
    # Both limits bound the counts of a pair. One document alone can never reach the first if it reaches the second.
    entities = entities.filter((F.col("with_entity") > 1) & (F.log2(total / F.col("with_entity")) >= MIN_BITS))
    named = materialize(named.join(entities, "entity"), "entities")
    most = named.groupBy("key").agg(F.max("with_entity").alias("most"))
    seen = held.select("key", F.explode("words").alias("word")).join(most, "key").distinct()
    seen = seen.join(counted.filter("with_word > 1"), "word").filter(F.col("with_word") * MIN_CHANCE <= F.col("most"))
    pairs = seen.select("key", "word", "with_word").join(named, "key").filter(F.col("with_word") * MIN_CHANCE <= F.col("with_entity"))
    pairs = pairs.groupBy("word", "entity", "context").agg(
        F.sum("copies").alias("copies"), F.first("with_word").alias("with_word"), F.first("with_entity").alias("with_entity")
    )
    pairs = pairs.groupBy("word", "entity").agg(
        F.count("*").alias("different"), F.sum("copies").alias("both"), F.first("with_word").alias("with_word"), F.first("with_entity").alias("with_entity")
    )
    usual = F.col("with_entity") / total
    # Copies with the same text beside the entity count once.
    chance = (F.col("different") + PRIOR * usual) / (F.col("with_word") - F.col("both") + F.col("different") + PRIOR)
    revealing = pairs.filter((chance >= MIN_CHANCE) & (F.log2(chance / usual) >= MIN_BITS)).select("word").distinct()
    revealing = materialize(revealing, "revealing")
    places = rows.select("key", F.explode("words").alias("word")).join(revealing, "word", "left_semi")
    return places.groupBy("key").agg(F.collect_set("word").alias("revealing"))


def find(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_base`` and ``_terms``, the spans of its text; terms are arrays of (start, end) in order."""
    lists = materialize(terms_of(docs), "terms").withColumnsRenamed({"key": "_key", "revealing": "_revealing"})
    t, base, masked, revealing = F.coalesce(F.col("text"), F.lit("")), F.col("_base"), F.col("_masked"), F.col("_revealing")
    rows = docs.withColumn("_text_key", _key(t)).join(lists, F.col("_text_key") == F.col("_key"), "left").drop("_text_key", "_key")
    rows = rows.withColumn("_base", _base(t)).withColumn("_masked", F.when(revealing.isNotNull(), _masked(base, t)))

    def step(at: Column, x: Column) -> tuple[Column, Column, Column]:
        start = at + F.length(x["0"])
        end = start + F.length(x["1"])
        return end, F.array_contains(revealing, _hash(x["1"])), F.struct(start.alias("start"), end.alias("end"))

    kind = "array<struct<start:int,end:int>>"
    terms = F.coalesce(_gathered(_matches(masked, WORD), kind, step), F.array().cast(kind))
    return rows.withColumn("_terms", terms).drop("_masked", "_revealing")


def _count(kind: int) -> Column:
    return F.size(F.filter("_base", lambda s: s.kind == kind)).cast("bigint")


def report(docs: DataFrame) -> DataFrame:
    """Counts by kind, the digest of the base spans and all spans as text."""
    found = find(docs.select("doc_id", "text"))
    names = F.array(*(F.lit(k) for k in (*KINDS, "term")))

    def shown(s: Column) -> Column:
        return F.concat_ws(":", F.get(names, s.kind), s.start.cast("string"), s.end.cast("string"))

    plain = F.transform("_base", lambda s: F.struct(s.start.alias("start"), s.kind.alias("kind"), s.end.alias("end")))
    added = F.transform("_terms", lambda s: F.struct(s.start.alias("start"), F.lit(len(KINDS)).alias("kind"), s.end.alias("end")))
    return found.select(
        "doc_id",
        *(_count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)),
        F.sha2(F.array_join(F.transform(plain, shown), ","), 256).alias("base_sha256"),
        F.array_join(F.transform(F.sort_array(F.concat(plain, added)), shown), ",").alias("spans"),
    )


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with entities replaced by their kind, in brackets, and revealing terms removed; ids are not used."""
    labels = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS), F.lit(""))
    base = F.transform("_base", lambda s: F.struct(s.start.alias("start"), s.kind.alias("kind"), s.end.alias("end")))
    added = F.transform("_terms", lambda s: F.struct(s.start.alias("start"), F.lit(len(KINDS)).alias("kind"), s.end.alias("end")))
    joined = find(docs).withColumn("_cuts", F.sort_array(F.concat(base, added)))

    def step(a: Column, s: Column) -> Column:
        label = F.get(labels, s.kind)
        free = F.concat(a.out, F.substring("text", a.at + 1, s.start - a.at), label)
        return F.struct(
            F.greatest(a.at, s.end).alias("at"), F.when(s.start >= a.at, free).otherwise(a.out).alias("out")
        )

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate("_cuts", start, step, lambda a: F.concat(a.out, F.substring("text", a.at + 1, F.length("text"))))
    text = F.when(F.size("_cuts") > 0, clean).otherwise(F.col("text"))
    return joined.select(*(text.alias(c) if c == "text" else F.col(c) for c in docs.columns))
