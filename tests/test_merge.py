import random

import pytest
from pyspark.sql import functions as F

from golden import BASELINE, HASHES, MODIFIED
from weft.operators import graph as G
from weft.operators import merge as M
from weft.operators import rollup as R
from weft.plans import reports as V
from weft.plans.build import build

FILE = "src/probe.py"


@pytest.fixture(scope="module")
def states(sources):
    other = b"y = 1\nprint(y)\n"
    old = build(sources({FILE: BASELINE, "other.py": other}))
    new = build(sources({FILE: MODIFIED}))
    return {
        "old": (M.graph_nodes(old.nodes), M.graph_edges(old.edges)),
        "new": (M.graph_nodes(new.nodes), M.graph_edges(new.edges)),
        "old_metadata": old.metadata,
        "new_metadata": new.metadata,
    }


def scope(spark, file=FILE):
    return spark.createDataFrame([("example", file)], "repo_name string, file_path string")


def counts(tables):
    return tuple(G.one_file_counts(*tables, "example", FILE).first())


def merged(states):
    return tuple(M.replace_upsert(o, n, ["id"]) for o, n in zip(states["old"], states["new"]))


def test_merge_keeps_the_stale_edge_and_replace_does_not(spark, states):
    assert counts(states["old"]) == (10, 18)
    assert counts(merged(states)) == (14, 27)
    replaced = M.replace_scope(*states["old"], scope(spark), *states["new"])
    assert counts(replaced) == (14, 26)
    stale = M.stale_rows(merged(states)[1], replaced[1]).collect()
    assert [r.type for r in stale] == ["CFG"]


def test_current_generation_equals_replace(spark, states):
    metadata = M.replace_upsert(states["old_metadata"], states["new_metadata"], ["metadata_id"])
    views = tuple(M.current_generation(t, metadata) for t in merged(states))
    assert counts(views) == (14, 26)
    assert views[0].where("file_path = 'other.py'").count() > 0


def test_scoped_delete(spark, states):
    nodes, edges, gone = M.delete_scope(*states["old"], scope(spark))
    assert gone.count() == 10
    assert {r.file_path for r in nodes.select("file_path").distinct().collect()} == {"other.py"}
    assert {r.file_path for r in edges.select("file_path").distinct().collect()} == {"other.py"}
    _, _, nothing = M.delete_scope(*states["old"], scope(spark, "absent.py"))
    assert nothing.count() == 0


def test_edges_of_other_files_into_the_scope_go_too(spark):
    nodes = spark.createDataFrame(
        [("1", "r", "a"), ("2", "r", "b"), ("3", "r", "b")], "id string, repo_name string, file_path string"
    )
    edges = spark.createDataFrame(
        [("e1", "2", "1"), ("e2", "2", "3"), ("e3", "1", "1")], "id string, source_id string, target_id string"
    )
    target = spark.createDataFrame([("r", "a")], "repo_name string, file_path string")
    _, kept, _ = M.delete_scope(nodes, edges, target)
    assert [r.id for r in kept.collect()] == ["e2"]
    incident = M.incident_edges(edges, nodes.where("id = '1'"))
    assert sorted(r.id for r in incident.collect()) == ["e1", "e3"]
    per_file = {r.file_path: (r.node_count, r.edge_count) for r in G.file_graph_counts(nodes, edges).collect()}
    assert per_file == {"a": (1, 2), "b": (2, 2)}


def test_placeholders_resolve(spark, states):
    nodes, edges = states["new"]
    none_yet = nodes.where("false")
    assert M.placeholders(none_yet, edges).count() == 14
    assert M.placeholders(nodes, edges).count() == 0


def test_upsert_against_a_model(spark):
    rng = random.Random(11)
    model = {k: ("old", k) for k in range(30)}
    target = spark.createDataFrame([(k, *v) for k, v in model.items()], "k int, a string, b int")
    batch = [(rng.randrange(60), f"n{i}", i, i) for i in range(200)]
    rng.shuffle(batch)
    for k, a, b, offset in sorted(batch, key=lambda r: r[3]):
        model[k] = (a, b)
    rows = spark.createDataFrame(batch, "k int, a string, b int, offset int")
    got = M.replace_upsert(target, rows, ["k"], ["offset"])
    assert {r.k: (r.a, r.b) for r in got.collect()} == model


def test_changed_files(spark):
    schema = "repo_name string, file_path string, file_hash string"
    old = spark.createDataFrame([("r", "same", "1"), ("r", "edited", "1")], schema)
    new = spark.createDataFrame([("r", "same", "1"), ("r", "edited", "2"), ("r", "added", "3")], schema)
    changed = {r.file_path: r.changed for r in M.changed_files(old, new).collect()}
    assert changed == {"same": False, "edited": True, "added": True}


def test_replay_summary(spark, states):
    metadata = M.replace_upsert(states["old_metadata"], states["new_metadata"], ["metadata_id"])
    replaced = M.replace_scope(*states["old"], scope(spark), *states["new"])
    tables = dict(zip(("nodes", "edges"), merged(states)), metadata=states["old_metadata"])
    before = V.file_state(tables, "example", FILE)
    after = dict(zip(("nodes", "edges"), replaced), metadata=metadata)
    row = V.replay_summary(before, after, "example", FILE, F.lit(HASHES["modified.py"])).first()
    assert (row.node_count_before, row.edge_count_before) == (14, 27)
    assert (row.node_count_after, row.edge_count_after) == (14, 26)
    assert (row.documents_delta, row.file_hash_changed, row.passed) == ("+0", True, True)
    wrong = V.replay_summary(before, after, "example", FILE, F.lit("other")).first()
    assert (wrong.hash_matches_replay, wrong.passed) == (False, False)


def test_graph_health(states, spark):
    nodes, edges = states["new"]
    clean = V.graph_health(nodes, edges).first()
    assert clean.passed and (clean.node_count, clean.edge_count) == (14, 26)
    doubled = V.graph_health(nodes.unionByName(nodes.limit(2)), edges).first()
    assert (doubled.passed, doubled.duplicate_node_ids) == (False, 2)
    lacking = V.graph_health(nodes.where("type <> 'Return'"), edges).first()
    assert (lacking.passed, lacking.unresolved) == (False, 2)


def test_one_file_counts_of_an_absent_file(states):
    assert tuple(G.one_file_counts(*states["old"], "example", "absent.py").first()) == (0, 0)


def test_duplicates_are_counted_by_hash_first(spark):
    """Clean tables move hashes only; repeated keys, hashes that collide and null keys give exact counts."""
    rows = [(f"k{i}", i % 7) for i in range(200)]
    clean = spark.createDataFrame(rows, "k string, v int")
    assert R.duplicate_groups(clean, ["k"]).collect() == []
    assert R.duplicate_summary(clean, ["k"], "n").first().n == 0
    dirty = clean.unionByName(clean.where("v = 3")).unionByName(spark.createDataFrame([(None, 1)] * 3, "k string, v int"))
    got = {r.k: r["count"] for r in R.duplicate_groups(dirty, ["k"]).collect()}
    assert got == {k: 2 for k, v in rows if v == 3}
    assert R.duplicate_summary(dirty, ["k", "v"], "n").first().n == len(got) + 1


def test_placeholders_of_any_ids(spark):
    edges = spark.createDataFrame([("a", "0a"), ("0A", "0a"), ("b" * 64, "a"), (None, "x y")], "source_id string, target_id string")
    nodes = spark.createDataFrame([("0a",), ("c" * 64,)], "id string")
    found = {r.id for r in M.placeholders(nodes, edges).collect() if r.id is not None}
    assert found == {"a", "0A", "b" * 64, "x y"}


@pytest.mark.parametrize("sent", [0, 100])
def test_only_files_that_differ_are_compared(spark, monkeypatch, sent):
    monkeypatch.setattr(M, "SENT_FILES", sent)
    shape = "id string, repo_name string, file_path string, v int"
    rows = [(f"{f}/{i}", "r", f"f{f}", i) for f in range(20) for i in range(10)]
    old = spark.createDataFrame(rows, shape).repartition(3)
    # One file lost a row, one got one, one is new, one is gone, one swapped a row; one has its rows in another order.
    changed = [r for r in rows if r[0] not in ("3/4", "8/1") and r[2] != "f5"]
    changed += [("4/x", "r", "f4", 0), ("99/0", "r", "f99", 0), ("8/y", "r", "f8", 1)]
    new = spark.createDataFrame(changed[::-1], shape)
    left, right = M.differing(old, new)
    assert {r.file_path for r in left.collect()} == {"f3", "f4", "f5", "f8"}
    assert {r.file_path for r in right.collect()} == {"f3", "f4", "f8", "f99"}
    stale = {r.id for r in M.stale_rows(old, new).collect()}
    assert stale == {"3/4", "8/1", *(f"5/{i}" for i in range(10))}
    drift = {(r.id, r.in_first) for r in V.identity_drift(old, new).collect()}
    assert drift == {(i, True) for i in stale} | {("4/x", False), ("99/0", False), ("8/y", False)}
    if sent:
        plan = left._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_only_repeated_keys_are_moved(spark, monkeypatch):
    """A batch whose keys occur once is returned as it is; repeated and null keys give their latest rows."""
    batch = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("a", 3, "z"), (None, 4, "n"), (None, 5, "m")], "k string, offset long, v string")
    want = sorted(map(tuple, M.latest_per_key(batch, ["k"], ["offset"]).collect()), key=repr)
    assert sorted(map(tuple, M.newest_rows(batch, ["k"], ["offset"]).collect()), key=repr) == want
    once = batch.where("offset IN (2, 3)")
    assert M.newest_rows(once, ["k"], ["offset"]) is once
    monkeypatch.setattr(M, "SENT_KEYS", 0)
    assert sorted(map(tuple, M.newest_rows(batch, ["k"], ["offset"]).collect()), key=repr) == want


def test_new_files_are_stored_without_a_join(spark, tmp_path, monkeypatch):
    """Rows that replace nothing are added; the others replace theirs."""
    from pyspark.sql.types import StringType, StructField, StructType

    from weft.operators import file_table

    schema = StructType([StructField(c, StringType()) for c in ("id", "repo_name", "file_path", "v")])
    joins = []
    plain = file_table.replace_upsert
    monkeypatch.setattr(file_table, "replace_upsert", lambda *a: joins.append(1) or plain(*a))
    stored = file_table.FileTable(spark, str(tmp_path / "t"), schema, buckets=3)
    for part in ([("a", "r", "f", "1"), ("b", "r", "g", "1")], [("c", "r", "h", "1"), ("d", "r", "f", "1")], [("a", "r", "f", "2"), ("e", "r", "g", "2")]):
        stored.apply(spark.createDataFrame(part, schema))
    assert {(r.id, r.v) for r in stored.read().collect()} == {("a", "2"), ("b", "1"), ("c", "1"), ("d", "1"), ("e", "2")}
    assert len(joins) == 1
