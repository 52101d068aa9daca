import json

import pytest
from pyspark.sql import functions as F

from weft.plans import log_analytics as L
from weft.plans import reports as V
from weft.plans.build import build
from weft.sources import eventlog as K
from weft.sources import files as S
from weft.sources.runlog import read_run_log


@pytest.fixture
def repo(tmp_path):
    root = tmp_path / "tests" / "repo"
    for name, text in {
        "zeta.py": "z = 1\n", "alpha.py": "a = 1\n", "nested/middle.py": "m = 1\n", "with space+é%41.py": "s = 1\n",
        "setup.py": "", "__init__.py": "", "_private/.hidden.py": "h = 1\n", "pkg/tests/helper.py": "", "pkg/test_feature.py": "", "notes.txt": "",
    }.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return str(root)


def names(df):
    return [r.file_path for r in df.select("file_path").orderBy("file_path").collect()]


KEPT = ["__init__.py", "_private/.hidden.py", "alpha.py", "nested/middle.py", "with space+é%41.py", "zeta.py"]


def test_scan(spark, repo):
    """A root below a folder named tests keeps its files: rules see relative paths."""
    assert names(S.list_sources(spark, repo, "r")) == KEPT
    everything = names(S.list_sources(spark, repo, "r", include_excluded=True))
    assert everything == sorted([*KEPT, "pkg/test_feature.py", "pkg/tests/helper.py", "setup.py"])
    contents = {r.file_path: (r.length, bytes(r.content)) for r in S.scan_files(spark, repo, "r").collect()}
    assert sorted(contents) == KEPT
    assert contents["alpha.py"] == (6, b"a = 1\n") and contents["__init__.py"] == (0, b"")
    one = S.scan_files(spark, f"file://{repo}", "r", only="alpha.py").collect()
    assert [(r.file_path, r.length) for r in one] == [("alpha.py", 6)]


def test_links_to_folders_are_not_followed(spark, repo, tmp_path):
    (tmp_path / "tests" / "repo" / "nested" / "back").symlink_to(repo)
    assert names(S.list_sources(spark, repo, "r")) == KEPT


def test_one_file_is_opened_by_its_path(spark, repo):
    """No rule leaves out a file that is asked for by name; an absent one is an error event."""
    assert names(S.scan_files(spark, repo, "r", only="pkg/tests/helper.py")) == ["pkg/tests/helper.py"]
    errors = build(S.scan_files(spark, repo, "r", only="gone.py")).errors.collect()
    assert [(r.repo_name, r.file_path, r.error_type) for r in errors] == [("r", "gone.py", "FileNotFoundError")]


def test_listed_files(spark, repo):
    listed = spark.createDataFrame([("alpha.py",), ("gone.py",)], "file string")
    run = build(S.read_listed(spark, repo, "r", listed))
    assert [r.file_path for r in run.metadata.collect()] == ["alpha.py"]
    assert [(r.repo_name, r.file_path, r.error_type) for r in run.errors.collect()] == [("r", "gone.py", "FileNotFoundError")]
    scan = S.files_of_manifest(S.scan_files(spark, repo, "r"), listed, "r")
    assert [(r.repo_name, r.file_path, r.error_type) for r in build(scan).errors.collect()] == [("r", "gone.py", "FileNotFoundError")]


def test_manifest_beyond_16_mib(spark, tmp_path):
    path = tmp_path / "large.json"
    path.write_text(json.dumps({"repo_path": "r", "files": [f"folder/{'x' * 200}{i}.py" for i in range(95_000)]}))
    assert path.stat().st_size > 19 << 20
    assert S.read_manifest_object(spark, str(path)).count() == 95_000


def test_scan_to_graph(spark, repo):
    report = {r.file_path: r.nodes for r in build(S.scan_files(spark, repo, "r")).report().collect()}
    assert report == {name: 1 if name == "__init__.py" else 5 for name in KEPT}


def test_missing_root(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        S.scan_files(spark, str(tmp_path / "absent"), "r")


def test_manifest_round_trip(spark, repo, tmp_path):
    path = str(tmp_path / "manifest")
    S.write_manifest(S.list_sources(spark, repo, "r"), repo, path)
    rows = S.read_manifest(spark, path).collect()
    assert {r.total_files for r in rows} == {len(KEPT)} and {r.repo_path for r in rows} == {repo}
    listed = S.read_manifest(spark, path).select("repo_path", "file")
    again = S.files_of_manifest(S.scan_files(spark, repo, "r"), listed, "r")
    assert again.where("content IS NOT NULL").count() == len(KEPT)


def test_manifest_object(spark, tmp_path):
    good = tmp_path / "good.json"
    good.write_text(json.dumps({"repo_path": "data/r", "total_files": 2, "files": ["b.py", "a.py"]}, indent=2))
    rows = S.read_manifest_object(spark, str(good)).collect()
    assert [(r.repo_path, r.file) for r in rows] == [("data/r", "b.py"), ("data/r", "a.py")]
    for content in ({"files": "a.py"}, {"files": [1]}, {"other": []}, {"files": ["a.py", None]}):
        bad = tmp_path / "bad.json"
        bad.write_text(json.dumps(content))
        with pytest.raises(Exception, match="invalid discovery manifest"):
            S.read_manifest_object(spark, str(bad)).collect()


def test_samples(spark, tmp_path):
    value = json.dumps({"schema_version": "1.0", "node_id": "n", "node_type": "alias"})
    (tmp_path / "keyed.txt").write_text(f"key\t{value}\n")
    (tmp_path / "plain.json").write_text(value)
    (tmp_path / "broken.json").write_text("{oops")
    paths = {n: str(tmp_path / f) for n, f in
             {"keyed": "keyed.txt", "plain": "plain.json", "broken": "broken.json", "absent": "none"}.items()}
    rows = {r.topic: r for r in K.sample_events(K.read_samples(spark, paths)).collect()}
    assert rows["keyed"].node_id == rows["plain"].node_id == "n"
    assert (rows["broken"].exists, rows["broken"].parse_error) == (True, True)
    assert (rows["absent"].exists, rows["absent"].parse_error) == (False, False)


def test_run_log_reports(spark, tmp_path):
    log = tmp_path / "run.log"
    # Lines in the form that run logs have.
    log.write_text(
        "Discovered 3 Python files\n"
        "\x1b[32mINFO\x1b[0m Parsed  a/b.py:   nodes=10 edges=18 metadata=1\n"
        "Parsed c.py: nodes=14 edges=26 metadata=1 Parsed d.py: nodes=1 edges=0 metadata=1\n"
        "duplicate node ids: 7\nDuplicate node IDs: 0\nFinished: successful=3 failed=0\n"
        'x = a=b\nx=last\n{"state":"RUNNING"}\n'
    )
    lines = read_run_log(spark, str(log)).withColumn("line_no", F.monotonically_increasing_id())
    parsed = {r.file_path: (r.nodes, r.edges) for r in L.parsed_rows(lines).collect()}
    assert parsed == {"a/b.py": (10, 18), "c.py": (14, 26), "d.py": (1, 0)}
    found = L.last_ints(lines, {"dup": r"Duplicate node IDs:\s*(\d+)", "none": r"Totals: (\d+)"}).first()
    assert (found.dup, found.none) == (0, None)
    pairs = {r.key: r.value for r in L.key_values(lines).collect()}
    assert pairs["x"] == "last"
    flags = L.presence_flags(lines, {"running": ('"state":"RUNNING"', '"state": "RUNNING"'), "gone": "FAILED"}).first()
    assert (flags.running, flags.gone) == (True, False)


def test_index_rows(spark):
    dump = json.dumps([{"v": 2, "key": {"_id": 1}, "name": "_id_"}, {"key": {"m": 1}, "name": "m_1", "unique": True}])
    rows = L.index_rows(spark.createDataFrame([("a", dump), ("b", "none")], "log string, text string")).collect()
    assert {(r.log, r.name, r.key, r.unique, r.parse_error) for r in rows} == {
        ("a", "_id_", '{"_id":1}', False, False),
        ("a", "m_1", '{"m":1}', True, False),
        ("b", None, None, False, True),
    }


def test_artifact_inventory(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.log").write_text("12345")
    required = spark.createDataFrame([("logs/a.log",), ("logs/b.log",)], "artifact string")
    rows = {r.artifact: (r.exists, r.size_bytes) for r in L.artifact_inventory(spark, str(tmp_path), required).collect()}
    assert rows == {"logs/a.log": (True, 5), "logs/b.log": (False, None)}


def test_evidence_file(spark, tmp_path):
    row = spark.sql("SELECT 'src/probe.py' AS target_file, 14L AS nodes, '+0' AS delta, true AS passed, string(null) AS old")
    V.write_evidence(row, str(tmp_path / "evidence"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "evidence")).collect()]
    assert lines == ["target_file=src/probe.py", "nodes=14", "delta=+0", "passed=true", "old=<missing>"]
    pairs = L.key_values(
        spark.read.text(str(tmp_path / "evidence")).select(
            F.lit("e").alias("log"), F.col("value").alias("line"), F.monotonically_increasing_id().alias("line_no")
        )
    )
    assert {r.key: r.value for r in pairs.collect()}["nodes"] == "14"
