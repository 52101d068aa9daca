import hashlib
import json

import pytest
from pyspark.sql import functions as F

from weft.functions import identity as I
from weft.functions import text as X
from weft.schemas import EDGE, ERROR, METADATA, NODE, required_fields

# Captured inputs and the identities they must give.
REPO, FILE = "accelerate", "benchmarks/big_model_inference/big_model_inference.py"


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_captured_identities(spark):
    row = spark.createDataFrame(
        [(REPO, FILE, "alias", "module.body[0].names[0]", 15, 7, 15, 15, None)],
        "repo_name string, file_path string, node_type string, structural_path string, lineno int, "
        "col_offset int, end_lineno int, end_col_offset int, name string",
    )
    found = row.select(I.node_id().alias("node"), I.metadata_id().alias("meta"), I.file_key().alias("key")).first()
    assert found.node == "38e41e11cb41c8fe7ec4ceb45a3aaa640e5639df205125aea4282b6d9e0e4a10"
    assert found.meta == "193be55d48d094dd2dabd8f933ffc82c76bef578804d6aa63503a24c22bb11d5"
    assert found.key == f"{REPO}:{FILE}"
    ends = (
        "008c0dcb1c46c6c0b1b186735756ee692ae164bc14969b7d3b6d4c8fcd3469f3",
        "40946bc411075d50a641a36f4c9b42f94bebf70c08bde71ecf39862d873f5c99",
    )
    edge = spark.createDataFrame(
        [(REPO, FILE, "AST", *ends)],
        "repo_name string, file_path string, edge_type string, source_id string, target_id string",
    )
    assert edge.select(I.edge_id()).first()[0] == (
        "e5077591dc0c165d2a86d3476884c1127a3aed08154d380e8d0de8342ce4f376"
    )


@pytest.mark.parametrize(
    "text",
    ["plain", 'say "hi"', "back\\slash", "tab\tline\nfeed\rform\fbell\b", "caf\u00e9 \u4e2d\u6587 \U0001f600",
     "\x1f\x1b\x0b\x00\x0e", "\\u001F", "\\\\u001F\x1f", "\x1f\\u001F\x1a\x1a", "\u2028\x7f", ""],
)
def test_canonical_json_equals_the_standard_form(spark, text):
    want = json.dumps({"n": 7, "text": text}, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    got = one(spark, I.canonical_json({"n": F.lit(7)}, {"text": F.lit(text)}))
    assert got == want
    digest = one(spark, I.stable_hash({"n": F.lit(7)}, {"text": F.lit(text)}))
    assert digest == hashlib.sha256(want.encode()).hexdigest()


@pytest.mark.parametrize(
    "path, excluded",
    [
        ("package/tests/helpers.py", True),
        ("package/test_utils/helpers.py", True),
        ("package/test_feature.py", True),
        ("package/latest_release/contest.py", False),
        ("package/deep/setup.py", True),
        ("setup.py", True),
        ("tests", False),
        ("package/test_data.txt", False),
        ("docs/a.py", True),
        ("a/.venv/lib/b.py", True),
        ("alpha.py", False),
    ],
)
def test_path_exclusion(spark, path, excluded):
    assert one(spark, X.is_excluded_path(F.lit(path))) is excluded


def test_relative_and_display_paths(spark):
    assert one(spark, X.relative_path(F.lit("file:///data/repo/a/b.py"), "/data/repo")) == "a/b.py"
    assert one(spark, X.relative_path(F.lit("a/b.py"), "/data/repo")) == "a/b.py"
    assert one(spark, X.display_path(F.lit("/data/repo2/b.py"), "/data/repo")) == "/data/repo2/b.py"
    with pytest.raises(Exception, match="outside of the root"):
        one(spark, X.relative_path(F.lit("/data/repo2/b.py"), "/data/repo"))


def test_event_time_text_and_order(spark):
    times = spark.sql(
        "SELECT * FROM VALUES (timestamp_ntz'2024-01-02 03:04:05'), (timestamp_ntz'2024-01-02 03:04:05.5') t(ts)"
    ).select(X.iso_utc(F.col("ts")).alias("text"))
    whole, half = [r.text for r in times.orderBy("text").collect()][::-1]
    assert (whole, half) == ("2024-01-02T03:04:05Z", "2024-01-02T03:04:05.500000Z")
    # As text the whole second sorts after its own half second; as time it does not.
    ordered = times.orderBy(X.event_timestamp(F.col("text"))).collect()
    assert [r.text for r in ordered] == [whole, half]


def test_small_text_functions(spark):
    assert one(spark, X.parent_path(F.lit("module.body[0].value.ctx"))) == "module.body[0].value"
    assert one(spark, X.last_segment(F.lit("a.b.c"))) == "c"
    assert [one(spark, X.signed(F.lit(v))) for v in (0, 3, -2)] == ["+0", "+3", "-2"]
    key, value = X.split_key_value(F.lit('k|{"a":"x|y"}'))
    assert (one(spark, key), one(spark, value)) == ("k", '{"a":"x|y"}')
    assert [one(spark, X.is_json(F.lit(t))) for t in ('{"a":1}', "[1]", "{", '{"a":1} x', "1,2", "1],[2", "")] == [
        True, True, False, False, False, False, False,
    ]


def test_contract_fields():
    common = {"schema_version", "event_time", "repo_name", "file_path"}
    for schema in (NODE, EDGE, METADATA, ERROR):
        assert common <= set(required_fields(schema))
    assert [len(s.fields) for s in (NODE, EDGE, METADATA, ERROR)] == [13, 9, 13, 7]
    assert "name" not in required_fields(NODE)
    assert "status" not in required_fields(METADATA)


def test_is_json_beyond_16_mib(spark):
    rows = spark.range(1).select(F.concat(F.lit('{"a":"'), F.repeat(F.lit("x"), 20 << 20), F.lit('"}')).alias("t"))
    assert rows.select(X.is_json(F.col("t")), X.is_json(F.concat("t", F.lit(" y")))).first() == (True, False)


def test_packed_identities_stay_different(spark):
    digest = hashlib.sha256(b"x").hexdigest()
    ids = [digest, digest.upper(), digest[:-1], "", "a", "ab", "AB", "0a", "\x0a", "\n", "g1", "\u00e9", "01ab", "zz" * 40]
    rows = spark.createDataFrame([(i,) for i in ids], "id string").withColumn("p", I.packed(F.col("id")))
    got = rows.select("id", "p", I.unpacked(F.col("p")).alias("back")).collect()
    assert all(r.id == r.back for r in got)
    assert len({bytes(r.p) for r in got}) == len(set(ids))
    assert {r.id: len(r.p) for r in got}[digest] == 33
    assert one(spark, I.packed(F.lit(None).cast("string"))) is None
