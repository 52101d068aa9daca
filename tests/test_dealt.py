"""Work that stays within files: nothing but texts is moved, and results are those of the plain joins."""

import pytest
from conftest import SF_DIR

import __spark_entry__ as entry
from weft.operators import graph as G
from weft.operators import merge as M
from weft.operators import rollup as R
from weft.operators.duplicates import duplicate_groups
from weft.plans.reports import identity_drift

NODE = "id string, repo_name string, file_path string, type string"
EDGE = "id string, source_id string, target_id string, type string, repo_name string, file_path string"


@pytest.fixture(scope="module")
def graph(spark):
    """An id in two files, an id that repeats in one, a null id, ends in other files, missing and null ends."""
    nodes = [("a", "r", "f", "A"), ("b", "r", "f", "B"), ("b", "r", "f", "C"), ("s", "r", "f", "S"), ("s", "r", "g", "T")]
    nodes += [("g", "r", "g", "G"), (None, "r", "g", "N"), ("n", None, "g", None), ("lone", "r", "h", "L")]
    ends = [("a", "b"), ("a", "s"), ("a", "g"), ("g", "missing"), ("g", None), ("s", "s"), ("gone", "away"), ("b", "b"), ("n", "a")]
    edges = [(f"e{i}", s, t, "K", "r", "f" if s in ("a", "b", "s") else "g") for i, (s, t) in enumerate(ends)]
    return spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE)


def rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def test_ends_within_files_equal_plain_joins(graph):
    nodes, edges = graph
    assert rows(G.edges_with_ends(edges, nodes, dealt=True)) == rows(G.edges_with_ends(edges, nodes))
    assert rows(G.file_graph_counts(nodes, edges, dealt=True)) == rows(G.file_graph_counts(nodes, edges))
    assert rows(M.placeholders(nodes, edges, dealt=True)) == rows(M.placeholders(nodes, edges))


def test_duplicates_within_files_equal_plain_ones(graph):
    nodes, _ = graph
    within = duplicate_groups(nodes, ["id"], M.FILE)
    assert rows(within) == rows(duplicate_groups(nodes, ["id"])) == ["Row(count=2, id='b')", "Row(count=2, id='s')"]
    assert duplicate_groups(nodes.where("id IN ('a', 'g')"), ["id"], M.FILE).count() == 0


def test_drift_is_found_by_file(graph):
    nodes, _ = graph
    got = identity_drift(nodes, nodes.where("id <> 'lone' OR id IS NULL"))
    assert rows(got) == ["Row(id='lone', in_first=True)"]


@pytest.mark.parametrize("name", ["wn1_sequence_edges", "wn2_definition_edges", "jn1_tree_edges", "st1_typed_edges", "ag1_file_metadata", "sl1_node_order"])
def test_texts_alone_are_moved(spark, name):
    """One exchange, of texts: it comes before the generators."""
    plan = entry.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert plan.index("Generate") < plan.index("Exchange")


@pytest.mark.parametrize("name", ["ag2_graph_counts", "jn9_metric_comparison", "vr2_graph_statistics"])
def test_the_call_graph_is_not_written(spark, name, monkeypatch):
    from weft import session
    from weft.plans.catalog import graph as catalog

    def refuse(*_):
        raise AssertionError("written")

    monkeypatch.setattr(session, "materialize", refuse)
    monkeypatch.setattr(catalog, "materialize", refuse, raising=False)
    assert entry.queries()[name](spark, SF_DIR).columns


def by_file(*tables):
    return [df.repartition(3, *M.FILE) for df in tables]


def test_scopes_are_deleted_within_files(spark, graph):
    """Ends in other files, ids in two files and null ends take the joins; without them, nothing is moved."""
    nodes, edges = graph
    home = edges.where("source_id IN ('a', 'b') AND target_id = 'b'").unionByName(
        spark.createDataFrame([("null", None, None, "K", "r", "f"), ("half", "a", None, "K", "r", "f"), ("own", "g", "g", "K", "r", "g")], EDGE)
    )
    alone = nodes.where("id IS NULL OR id <> 's'")
    scopes = [spark.createDataFrame([("r", f), ("r", "absent"), (None, "g")], "repo_name string, file_path string") for f in "fgh"]
    for some_nodes, some_edges in ((nodes, edges), (alone, home)):
        for scope in scopes:
            dealt = by_file(some_nodes, some_edges, scope)
            for got, want in zip(M.delete_scope(*dealt, dealt=True), M.delete_scope(some_nodes, some_edges, scope)):
                assert rows(got) == rows(want)
            new = [df.where("file_path = 'f' OR id = 'lone'") for df in (some_nodes.dropDuplicates(["id"]), some_edges)]
            got = M.replace_scope(*dealt, *by_file(*new), dealt=True)
            for one, other in zip(got, M.replace_scope(some_nodes, some_edges, scope, *new)):
                assert rows(one) == rows(other)


def test_upserts_within_files_equal_plain_ones(spark, graph):
    nodes, _ = graph
    batch = spark.createDataFrame([("a", "r", "f", "new"), ("s", "r", "g", "new"), ("lone", "r", "elsewhere", "new"), (None, "r", "g", "new"), ("n", None, "g", "new")], NODE)
    target, rows_in = by_file(nodes, batch)
    assert rows(M.replace_upsert(target, rows_in, ["id"], within=M.FILE)) == rows(M.replace_upsert(nodes, batch, ["id"]))


@pytest.mark.parametrize("name", ["dm4_delete_scope", "dm5_replace_scope"])
def test_orders_are_moved_without_ids(spark, name):
    """No identity is made before an exchange."""
    plan = entry.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and "sha2" in plan
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    above = None
    for line in plan.splitlines():
        above = None if above is not None and depth(line) <= above else above
        if "Exchange" in line and above is None:
            above = depth(line)
        assert above is None or "sha2" not in line


def test_order_graph_with_a_hot_customer_and_repeated_orders(spark, tmp_path, monkeypatch):
    """A file too large for a task is not dealt out; an order that comes twice gives its edges twice, as the join did."""
    from weft.plans import adapters

    spark.read.parquet(f"{SF_DIR}/customer.parquet").write.parquet(str(tmp_path / "customer.parquet"))
    orders = spark.read.parquet(f"{SF_DIR}/orders.parquet")
    orders.unionAll(orders.where("o_orderkey % 5 = 0")).write.parquet(str(tmp_path / "orders.parquet"))
    whole = adapters.order_graph(spark, str(tmp_path))
    monkeypatch.setattr(adapters, "BLOCK_ROWS", 3)
    split = adapters.order_graph(spark, str(tmp_path))
    assert whole["dealt"] and not split["dealt"]
    for name in ("nodes", "edges", "new_nodes", "new_edges", "scope"):
        assert rows(whole[name]) == rows(split[name])
    per_source = {r.n for r in whole["edges"].groupBy("source_id").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    assert 4 in per_source


def test_sorted_edges_move_packed_ids(spark):
    """Half the bytes are moved, in the same total order."""
    from pyspark.sql import functions as F

    found = entry.queries()["sl4_sorted_edges"](spark, SF_DIR)
    plan = found._jdf.queryExecution().executedPlan().toString()
    sort = plan.index("rangepartitioning")
    assert "unhex" in plan[sort:]
    keys = found.select("edge_type", "source_id", "target_id").where("file_path < 'doc/3'").collect()
    assert len(keys) > 1000 and keys == sorted(keys) and {len(r.source_id) for r in keys} == {64}
    assert found.where(~F.col("target_id").rlike("^[0-9a-f]{64}$")).count() == 0


def test_ends_at_home_take_no_second_look(spark, graph, monkeypatch):
    """Where every end is a node of its own file or no node at all, one pass over hashes settles it; results are those of the plain joins."""
    nodes, edges = graph
    nodes, edges = nodes.where("id IS NULL OR id <> 's'"), edges.where("(source_id <> 's' OR target_id IS NULL) AND coalesce(target_id, '') NOT IN ('g', 's') AND source_id <> 'n'")
    assert M.all_at_home(nodes, edges) and edges.count() == 5
    many_nulls = nodes.unionByName(spark.createDataFrame([(None, "r", "f", "N")], NODE))
    assert M.all_at_home(many_nulls, edges)
    assert not M.all_at_home(*graph)
    want = [rows(f(*args)) for f, args in ((G.edges_with_ends, (edges, nodes)), (G.file_graph_counts, (nodes, edges)))]

    def refuse(*_):
        raise AssertionError("looked up again")

    monkeypatch.setattr(G, "of_one_file", refuse)
    monkeypatch.setattr(G, "rows_of", refuse)
    assert rows(G.edges_with_ends(edges, nodes, dealt=True)) == want[0]
    assert rows(G.file_graph_counts(nodes, edges, dealt=True)) == want[1]


def test_a_clean_table_is_read_once_for_duplicates(spark, graph):
    """Nothing is left to compute once the hashes tell that no key repeats; keys that repeat in a file alone are found."""
    nodes, _ = graph
    clean = duplicate_groups(nodes.where("id IN ('a', 'g', 'lone')"), ["id"], M.FILE)
    assert "Aggregate" not in clean._jdf.queryExecution().optimizedPlan().toString()
    assert rows(clean) == []
    assert rows(duplicate_groups(nodes.where("id <> 's'"), ["id"], M.FILE)) == ["Row(count=2, id='b')"]
    pairs = duplicate_groups(nodes, ["id", "type"], M.FILE)
    assert rows(pairs) == rows(duplicate_groups(nodes, ["id", "type"])) == []


def test_edges_come_in_the_order_of_their_file(spark):
    """Equal ends of edges lie near each other: a task's edges follow the order of the nodes."""
    from weft.operators.edges import typed_edges

    nodes = [("r", "f", f"n{i:03}", f"module.body[{i}]", "Name", f"v{i % 7}", "Store" if i % 3 else "Load", i, 0) for i in range(1, 200)]
    df = spark.createDataFrame(nodes, "repo_name string, file_path string, node_id string, structural_path string, node_type string, name string, ctx string, lineno int, col_offset int")
    found = typed_edges(df.repartition(1, *M.FILE), dealt=True).where("edge_type = 'CFG'").collect()
    assert [r.source_id for r in found] == [f"n{i:03}" for i in range(1, 199)]


def test_duplicates_are_counted_in_one_reading(spark, tmp_path):
    """Keys that repeat in one file are groups by their hash; rows are read again only where several share one."""
    file = [("r", "a"), ("r", "a"), ("r", "a"), ("r", "b"), ("r", "b"), ("r", "b")]
    here = spark.createDataFrame([(*f, k) for f, k in zip(file, ["x", "x", "y", "z", None, None])], "repo_name string, file_path string, id string")
    here.write.parquet(f"{tmp_path}/here")
    stored = spark.read.parquet(f"{tmp_path}/here").repartition(3, *M.FILE)
    counted = R.duplicate_summary(stored, ["id"], "n", M.FILE)
    assert counted.collect()[0].n == 1 == R.duplicate_groups(stored, ["id"], M.FILE).count()
    assert not any("here" in path for path in counted.inputFiles())
    across = stored.unionByName(spark.createDataFrame([("r", "c", "y"), ("r", "c", "x"), ("r", "c", "z"), ("r", "d", "z")], stored.schema))
    for keys in (["id"], ["id", "repo_name"]):
        want = R.duplicate_groups(across, keys).count()
        assert R.duplicate_summary(across, keys, "n", M.FILE).collect()[0].n == want == R.duplicate_summary(across, keys, "n").collect()[0].n
    assert R.duplicate_summary(stored.where("id = 'y'"), ["id"], "n", M.FILE).collect()[0].n == 0


def test_drift_of_dealt_runs_reads_each_once(spark, graph, monkeypatch):
    """No digests are taken first where the rows of a file lie together; the drift is the same."""
    from weft.plans import reports

    nodes, _ = graph
    less = nodes.where("id NOT IN ('lone', 's') OR file_path = 'g' OR id IS NULL")
    want = rows(identity_drift(nodes, less))

    def refuse(*_):
        raise AssertionError("read before")

    monkeypatch.setattr(reports, "differing", refuse)
    dealt = [df.repartition(3, *M.FILE) for df in (nodes, less)]
    assert rows(identity_drift(*dealt, dealt=True)) == want == [f"Row(id='{i}', in_first=True)" for i in ("lone", "s")]
    assert rows(identity_drift(dealt[1], dealt[0], dealt=True)) == [f"Row(id='{i}', in_first=False)" for i in ("lone", "s")]


def test_edges_of_two_states_are_counted_once(spark):
    """The edges are the same before and after: their count is shared."""
    found = entry.queries()["jn9_metric_comparison"](spark, SF_DIR)
    assert {r.metric: r.delta for r in found.collect()}["edge_count"] == "+0"
    assert "ReusedExchange" in found._jdf.queryExecution().executedPlan().toString()
