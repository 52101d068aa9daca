import ast
import json

import pytest
from pyspark.sql import functions as F

from golden import BASELINE, BROKEN, GRAPHS, HASHES, MODIFIED
from weft.functions.identity import node_id
from weft.operators import edges as E
from weft.operators import extract as P
from weft.operators import sequence as S
from weft.plans.build import build
from weft.plans.reports import identity_drift
from weft.session import materialize
from weft.sources.eventlog import read_log


@pytest.fixture(scope="module")
def built(sources):
    files = {name: g[0] for name, g in GRAPHS.items()} | {name: b[0] for name, b in BROKEN.items()}
    return build(sources(files))


def test_golden_graphs(built):
    nodes = {r.file_path: r["count"] for r in built.nodes.groupBy("file_path").count().collect()}
    assert nodes == {name: g[1] for name, g in GRAPHS.items()}
    edges = {(r.file_path, r.edge_type): r["count"] for r in built.edges.groupBy("file_path", "edge_type").count().collect()}
    want = {
        (name, kind): count
        for name, g in GRAPHS.items()
        for kind, count in zip(("AST", "CFG", "DFG", "CALL"), g[2:])
        if count
    }
    assert edges == want


def test_failed_files_give_only_an_error(built):
    errors = {r.file_path: r for r in built.errors.collect()}
    assert {name: r.error_type for name, r in errors.items()} == {n: b[1] for n, b in BROKEN.items()}
    assert errors["open.py"].error_message == "'(' was never closed (open.py, line 1)"
    assert all(r.status == "failed" and r.event_time.endswith("Z") for r in errors.values())
    others = built.nodes.select("file_path").union(built.metadata.select("file_path")).distinct()
    assert {r.file_path for r in others.collect()} == set(GRAPHS)


def test_metadata_and_report(built):
    metadata = {r.file_path: r for r in built.metadata.collect()}
    for name, graph in GRAPHS.items():
        row = metadata[name]
        assert (row.node_count, row.edge_count, row.status) == (graph[1], sum(graph[2:]), "parsed")
    for name, digest in HASHES.items():
        assert metadata[name].file_hash == digest
    calls = metadata["calls.py"]
    assert (calls.line_count, calls.function_count, calls.class_count, calls.import_count) == (9, 2, 1, 0)
    report = {r.file_path: (r.nodes, r.edges, r.metadata) for r in built.report().collect()}
    assert report == {name: (g[1], sum(g[2:]), 1) for name, g in GRAPHS.items()}


def test_counts_come_with_the_tables(built):
    """Nothing is scanned again for the summary of a run."""
    nodes, edges = built.nodes.count(), built.edges.count()
    assert built.seen == {"successful": len(GRAPHS), "failed": len(BROKEN), "nodes": nodes, "edges": edges}


def test_jvm_identity_equals_extracted_identity(built):
    assert built.nodes.where(node_id() != F.col("node_id")).count() == 0


def test_recorded_parents_and_contexts_equal_the_joins(sources):
    rows = P.parsed_nodes(P.extract(sources({n: g[0] for n, g in GRAPHS.items()})))
    assert E.tree_edges(rows).exceptAll(E.recorded_tree_edges(rows)).count() == 0
    assert E.recorded_tree_edges(rows).exceptAll(E.tree_edges(rows)).count() == 0
    joined = E.with_context(rows.drop("ctx")).where("node_type = 'Name'").select("node_id", "ctx")
    assert joined.exceptAll(rows.where("node_type = 'Name'").select("node_id", "ctx")).count() == 0


def test_positions_names_and_paths(sources):
    source = (
        "import os.path as p, sys\nfrom . import a\nfrom m.n import b as c\n"
        "async def go(arg, *rest):\n    await x.y.z(arg)\n    (lambda: 0)()\n    f()(1).g()\n"
        "class K(Base): pass\ns = '\u00e9'; del s\n"
    )
    rows = P.extract(sources({"names.py": source.encode()})).collect()
    named = {(r.node_type, r.name) for r in rows if r.name is not None}
    assert {
        ("Import", "os.path,sys"), ("ImportFrom", ":a"), ("ImportFrom", "m.n:b"),
        ("AsyncFunctionDef", "go"), ("arg", "arg"), ("arg", "rest"), ("Call", "x.y.z"),
        ("Attribute", "z"), ("ClassDef", "K"), ("Name", "Base"), ("Call", "g"), ("Call", "f"),
    } <= named
    # A call of a lambda has no name.
    assert sum(r.node_type == "Call" and r.name is None for r in rows) == 2
    assert {r.ctx for r in rows if r.node_type == "Name"} == {"Load", "Store", "Del"}
    # Every node of the tree has exactly one row, in pre-order with its parent before it.
    assert len(rows) == sum(1 for _ in ast.walk(ast.parse(source)))
    at = {r.node_id: r.preorder for r in rows}
    assert all(r.parent_id is None or at[r.parent_id] < r.preorder for r in rows)
    load = next(r for r in rows if r.node_type == "Load")
    assert (load.lineno, load.col_offset, load.end_lineno, load.end_col_offset) == (0, 0, 0, 0)
    paths = {r.structural_path for r in rows}
    assert "module.body[3].body[0].value.value.func.value.value.ctx" in paths


@pytest.mark.parametrize(
    "content, lines",
    [(b"a = 1\r\nb = 2\r\n", 2), (b"x = '\x0c'\ny = 1\n", 3), (b"", 0), (b"x = 1", 1),
     ("x = '\u2028'\n".encode(), 2), (b"a = 1\rb = 2\r", 2)],
)
def test_line_counts(sources, content, lines):
    rows = P.extract(sources({"lines.py": content})).collect()
    assert {r.line_count for r in rows} == {lines}


def test_deep_trees_need_no_recursion(sources):
    deep = "x = " + "-" * 150 + "1\n" + "y = a" + ".b" * 900 + "\n"
    rows = P.extract(sources({"deep.py": deep.encode()})).collect()
    assert {r.error_type for r in rows} == {None}
    assert max(r.structural_path.count(".value") for r in rows) > 890


def test_too_deep_for_the_parser_is_a_file_error(sources):
    files = {"hopeless.py": ("(" * 5000 + ")" * 5000).encode(), "fine.py": b"x = 1\n"}
    rows = P.extract(sources(files)).collect()
    assert {r.file_path for r in rows if r.error_type} == {"hopeless.py"}
    assert sum(r.file_path == "fine.py" for r in rows) == 5


def test_same_content_gives_the_same_ids(sources):
    one = build(sources({"a.py": MODIFIED}))
    two = build(sources({"a.py": MODIFIED}))
    assert identity_drift(one.nodes, two.nodes, "node_id").count() == 0
    assert identity_drift(one.edges, two.edges, "edge_id").count() == 0
    other = build(sources({"a.py": BASELINE}))
    assert identity_drift(one.nodes, other.nodes, "node_id").count() > 0


def test_literals_do_not_change_ids(sources):
    one = build(sources({"a.py": b"x + 1\n"}))
    two = build(sources({"a.py": b"x + 2\n"}))
    assert identity_drift(one.nodes, two.nodes, "node_id").count() == 0


def test_split_files_give_the_same_edges(sources, monkeypatch):
    """Every file but the smallest is cut into many blocks."""
    files = {n: g[0] for n, g in GRAPHS.items()}
    files["wide.py"] = b"; ".join(b"w%d = w%d" % (i % 5, (i * 2) % 5) for i in range(60)) + b"\n"
    files["long.py"] = b"".join(b"v%d = v%d\n" % (i % 7, (i * 3) % 7) for i in range(300))
    files["calls_below.py"] = b"".join(b"f%d()\n" % (i % 9) for i in range(90)) + b"".join(b"def f%d(): f0()\n" % i for i in range(9))
    rows = materialize(P.parsed_nodes(P.extract(sources(files))), "rows")
    want = {tuple(r) for r in E.typed_edges(rows).collect()}
    monkeypatch.setattr(S, "BLOCK_ROWS", 12)
    laid_out = S.blocked(rows, E.FILE, E.ORDER)
    assert laid_out.select(*E.FILE, "block").distinct().count() > 50
    for recorded in (False, True):
        got = E.typed_edges(rows, recorded).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_published_records(spark, sources, tmp_path):
    run = build(sources({"ok.py": b"value = source + 1\n", "bad.py": b"def ("}))
    run.publish(str(tmp_path / "log"))
    log = read_log(spark, str(tmp_path / "log")).collect()
    by_topic = {}
    for record in log:
        by_topic.setdefault(record.topic, []).append((record.key.decode(), json.loads(record.value)))
    assert {t: len(v) for t, v in by_topic.items()} == {
        "cpg.nodes.v1": 9, "cpg.edges.v1": 16, "cpg.metadata.v1": 1, "cpg.errors.v1": 1,
    }
    assert all(key == event["node_id"] for key, event in by_topic["cpg.nodes.v1"])
    assert all(key == event["edge_id"] for key, event in by_topic["cpg.edges.v1"])
    assert by_topic["cpg.errors.v1"][0][0] == "example:bad.py"
    # Null fields stay in the JSON.
    assert any(event["name"] is None for _, event in by_topic["cpg.nodes.v1"])
    assert len({r.offset for r in log}) == len(log)


def test_ids_are_neither_written_nor_moved(sources, monkeypatch):
    """One table is written, without ids, and edges are linked behind one exchange that carries none."""
    from weft.plans import build as module

    written = []
    monkeypatch.setattr(module, "materialize", lambda df, label: written.append(df.columns) or materialize(df, label))
    run = build(sources({n: g[0] for n, g in GRAPHS.items()}))
    assert len(written) == 1 and not {"node_id", "parent_id"} & set(written[0])
    plan = run.edges._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert "sha2" in plan[: plan.index("Exchange")] and "sha2" not in plan[plan.index("Exchange") :]
