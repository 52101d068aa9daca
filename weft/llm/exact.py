"""Exact duplicates, by combining in three steps that a text with very many copies cannot slow down.

Texts are equal when they are identical after A to Z are lower-cased; nothing else is changed.

1. Each task combines its own equal rows (the map side of the aggregate), so that at most one row of a text leaves a task.
2. Rows are merged by digest, salt and whole text. Digests that hold more than one row in ``HOT`` are dealt out
   over ``salts`` by document id; all others have one salt, so that their merge is final and no text moves twice. Less than ``HOT``
   digests can be that frequent, whatever the size of the table, and so they are sent to the scan.
3. The winners of the salts, at most ``salts`` rows of a text, are combined by digest and whole text.

The digest only deals rows out. Every step compares whole texts, and so a digest that stands for several texts costs one more
pass over the documents and changes no result.

Defined results: null counts as empty, and all empty texts are equal. Rows that repeat an id with equal texts are one document: one
row, though ``group_size`` counts them all; with other texts they are documents of their own. Null ids lose to all others, and
a group of null ids alone has a null ``keep_id`` and is kept, as one row. No rows give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.session import materialize

#: A digest that holds more than one in so many rows is dealt out over salts.
HOT = 1000
SALTS = 64


def normalised(text: Column) -> Column:
    """A to Z in lower case; null is empty. Without characters beyond ASCII, the faster function does the same."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def groups(docs: DataFrame, digest: Callable[[Column], Column] = sha256, salts: int = SALTS, hot: int = HOT) -> DataFrame:
    """(doc_id, keep_id, group_size, text_sha256): every document with the one of its group that stays.

    ``digest`` deals texts out and may be any function of the text.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("text"))
    rows = rows.withColumn("digest", digest(F.col("text")))
    # Rows of a document, without its text. Where another digest deals, the text's own is noted as well.
    own = F.col("digest") if digest is sha256 else sha256(F.col("text"))
    known = rows.groupBy("doc_id", "digest", own.alias("text_sha256")).agg(F.count(F.lit(1)).alias("n"))
    known = materialize(known, "documents-of-digests")
    total = known.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    frequent = known.groupBy("digest").agg(F.sum("n").alias("n")).filter(F.col("n") * hot > total).select("digest", F.lit(True).alias("hot"))

    dealt = rows.join(F.broadcast(frequent), "digest", "left")
    dealt = dealt.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id"), F.lit(salts))).otherwise(-1))
    winners = dealt.groupBy("digest", "salt", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # The texts of the few frequent digests alone are read again.
    winners = materialize(winners.withColumn("text", F.when(F.col("salt") >= 0, F.col("text"))), "winners-of-salts")
    merged = winners.filter("salt >= 0").groupBy("digest", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    final = winners.filter("salt < 0").select("digest", "keep_id", "group_size").unionByName(merged.select("digest", "keep_id", "group_size"))
    final = materialize(final, "groups-of-texts")

    several = final.groupBy("digest").agg(F.count(F.lit(1)).alias("contents")).filter("contents > 1").select("digest")
    if several.isEmpty():
        return _joined(known, final, ["digest"], salts, hot, total)
    several = materialize(several, "ambiguous-digests")
    plain = _joined(known.join(several, "digest", "left_anti"), final.join(several, "digest", "left_anti"), ["digest"], salts, hot, total)
    return plain.unionByName(_by_content(rows.join(several, "digest", "left_semi"), salts))


def _joined(known: DataFrame, final: DataFrame, keys: list[str], salts: int, hot: int, total: int) -> DataFrame:
    """Documents with their groups. Those of large groups are dealt out over salts, and their group is repeated for each salt."""
    large = F.col("group_size") * hot > total
    spread = final.withColumn("salt", F.explode(F.when(large, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(-1)))))
    frequent = final.filter(large).select(*keys).distinct().withColumn("hot", F.lit(True))
    dealt = known.join(F.broadcast(frequent), keys, "left")
    dealt = dealt.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")).otherwise(-1))
    return dealt.join(spread, [*keys, "salt"]).select("doc_id", "keep_id", "group_size", "text_sha256")


def _by_content(rows: DataFrame, salts: int) -> DataFrame:
    """The same for digests that stand for several texts: whole texts decide, again by salts first."""
    rows = rows.groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("n"))
    rows = materialize(rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")), "texts-of-digests")
    winners = rows.groupBy("salt", "text").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size"))
    final = winners.groupBy("text").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    back = winners.select("salt", "text").join(final, "text")
    return rows.join(back, ["salt", "text"]).select("doc_id", "keep_id", "group_size", sha256(F.col("text")).alias("text_sha256"))


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every document."""
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept")
    return groups(docs).select("doc_id", "keep_id", "group_size", kept, "text_sha256")


#: The same in SQL, for documents whose ids differ.
REPORT_SQL = f"""
WITH texts AS (
  SELECT doc_id, translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM texts WINDOW same AS (PARTITION BY t)
"""
