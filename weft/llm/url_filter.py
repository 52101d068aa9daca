"""URL verdicts by host and path rules, and by logistic regression where no rule fits.

The model sees hashed character n-grams of host and path. Its labelled table are the URLs that rules
decide: at most ``MAX_LABELLED`` different ones, those with the smallest hashes, so that the same
table always gives the same sample. Features, training and scoring stay in the JVM.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits no rule and is scored
as such; repeated rows give repeated results; without labelled URLs of both verdicts the only one
seen (or else "allow") is given; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.session import materialize

MAX_LABELLED = 20_000
FEATURES = 1 << 14
GRAMS = (2, 3, 4)
ROUNDS = 40
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring({0}, instr({0}, '://') + 3)".format("url"))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def fitting_rule(rules: list[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits ``host`` and ``path``, or null. ``rules``: verdict, host, path."""
    choice = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        on_host = (F.col("host") == host) | F.col("host").endswith("." + host)
        fits = on_host & F.col("path").startswith(path)
        choice = F.when(fits, F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(choice)
    return choice


def _runs(mark: str, text: Column, n: int) -> Column:
    starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.concat(F.lit(mark), F.substring(text, i, F.lit(n))))


def _grams() -> Column:
    """n-grams of the host, between marks, and of the path, told apart by their first character."""
    host, path = F.concat(F.lit("^"), F.col("host"), F.lit("$")), F.concat(F.col("path"), F.lit("$"))
    return F.concat(*(_runs("h", host, n) for n in GRAMS), *(_runs("p", path, n) for n in GRAMS))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(page_id, host, path, rule, verdict, p_block) for each row of ``pages`` (page_id, url)."""
    url = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"))
    host, path = host_and_path(F.col("url"))
    known = url.select("page_id", host.alias("host"), path.alias("path"))
    known = known.withColumn("fit", fitting_rule(rules))
    hashed = HashingTF(numFeatures=FEATURES, binary=True, inputCol="grams", outputCol="features")

    labelled = known.filter("fit is not null").select("host", "path", (F.col("fit.verdict") == "block").cast("double").alias("label"))
    labelled = labelled.distinct().orderBy(F.xxhash64("host", "path"), "host", "path").limit(max_labelled)
    labelled = materialize(labelled, "labelled")
    seen = {r.label: r["count"] for r in labelled.groupBy("label").count().collect()}
    rows = hashed.transform(known.withColumn("grams", _grams()))
    if len(seen) == 2:
        # Both verdicts weigh alike.
        weight = F.when(F.col("label") == 1, 0.5 / seen[1.0]).otherwise(0.5 / seen[0.0]) * sum(seen.values())
        train = hashed.transform(labelled.withColumn("weight", weight).withColumn("grams", _grams()))
        fitter = LogisticRegression(maxIter=ROUNDS, regParam=1e-3, weightCol="weight")
        model = fitter.fit(train.select("features", "label", "weight").coalesce(8))
        scored = model.transform(rows).withColumn("p_block", vector_to_array("probability")[1])
    else:
        scored = rows.withColumn("p_block", F.lit(1.0 if 1.0 in seen else 0.0))
    method = F.when(F.col("p_block") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", method).alias("verdict"), "p_block")
