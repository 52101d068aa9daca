import random

import pytest
from pyspark.sql import functions as F

from conftest import SF_DIR
from weft.operators import edges as E
from weft.operators import sequence as S
from weft.operators.merge import latest_per_key
from weft.operators.sequence import blocked, with_above, with_first, with_last, with_next
from weft.plans import adapters as A
from weft.session import materialize


def rows(seed):
    """Groups of very different size; the first holds most rows."""
    rng = random.Random(seed)
    out = []
    for group, size in (("hot", 400), ("warm", 40), ("one", 1), ("two", 2)):
        places = sorted(rng.sample(range(1000), size))
        out += [(group, p, f"{group}{p}", rng.choice("abc"), rng.random() < 0.3) for p in places]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("block", [1, 16, 50, 5000])
@pytest.mark.parametrize("seed", [1, 2])
def test_next_last_and_first_equal_brute_force(spark, block, seed):
    data = rows(seed)
    df = spark.createDataFrame(data, "g string, pos int, id string, name string, store boolean")
    # Small groups stay whole: both paths run in one query.
    laid_out = blocked(df, ["g"], ["pos", "id"], block)
    stored = F.when(F.col("store"), F.col("id"))
    got_next = {r.id: r.nx for r in with_next(laid_out, ["g"], ["pos", "id"], "id", "nx").collect()}
    got_last = {r.id: r.d for r in with_last(laid_out, ["g", "name"], ["pos", "id"], stored, "d").collect()}
    got_first = {r.id: r.f for r in with_first(laid_out, ["g", "name"], ["pos", "id"], stored, "f").collect()}
    want_next, want_last, want_first = {}, {}, {}
    for group in {r[0] for r in data}:
        ordered = sorted((r for r in data if r[0] == group), key=lambda r: r[1])
        for row, after in zip(ordered, [*ordered[1:], None]):
            want_next[row[2]] = after[2] if after else None
        last, first = {}, {}
        for _, _, ident, name, store in ordered:
            want_last[ident] = last.get(name)
            if store:
                last[name] = ident
                first.setdefault(name, ident)
        want_first |= {r[2]: first.get(r[3]) for r in ordered}
    assert got_next == want_next
    assert got_last == want_last
    assert got_first == want_first


@pytest.mark.parametrize("block", [1, 20, 5000])
def test_parents_equal_brute_force(spark, block):
    """A hot tree, deep and wide, with paths that share prefixes and rows whose parent is not there."""
    rng = random.Random(block)
    paths = ["m"]
    while len(paths) < 500:
        paths.append(f"{rng.choice(paths[-40:] + paths[:3])}.{rng.choice(['b', 'b-', 'b[1]'])}{len(paths)}")
    gone = set(rng.sample(paths[1:], 40))
    data = [("hot", p, f"h{i}") for i, p in enumerate(paths) if p not in gone]
    data += [("one", "m", "o0"), ("one", "m.b", "o1"), ("one", "m.b.c", "o2"), ("two", None, "t0")]
    df = spark.createDataFrame(data, "g string, path string, id string")
    laid_out = blocked(df, ["g"], ["path", "id"], block)
    above = F.when(F.contains("path", F.lit(".")), F.regexp_replace("path", "[.][^.]*$", ""))
    got = {r.id: r.up for r in with_above(laid_out, ["g"], "path", above, "id", "up").collect()}
    ids = {(g, p): i for g, p, i in data}
    assert got == {i: ids.get((g, p.rsplit(".", 1)[0])) if p and "." in p else None for g, p, i in data}


def test_whole_groups_carry_nothing(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "g string, pos int, id string")
    laid_out = blocked(df, ["g"], ["pos"])
    assert laid_out.columns == df.columns
    plan = with_next(laid_out, ["g"], ["pos"], "id", "nx")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Join") == 0


def _position_less(count: int) -> list[tuple]:
    """Nodes without a position, as nested code has by the thousand; their paths share a long prefix."""
    prefix = "module.body[0].body[0].body[0].body[0].body[0]"
    return [("r", "f.py", 0, 0, f"{prefix}.targets[{i}].ctx", f"n{i:05d}") for i in range(count)]


def test_blocks_of_position_less_nodes_are_bounded(spark):
    shape = "repo_name string, file_path string, lineno int, col_offset int, structural_path string, node_id string"
    data = _position_less(15_000)
    nodes = spark.createDataFrame(data, shape)
    laid_out = blocked(nodes, E.FILE, E.ORDER, 1000)
    sizes = [r["count"] for r in laid_out.groupBy("block").count().collect()]
    assert len(sizes) >= 8 and max(sizes) < 4000 and sum(sizes) == 15_000
    linked = with_next(laid_out, E.FILE, E.ORDER, "node_id", "next_id").collect()
    ordered = [r[5] for r in sorted(data, key=lambda r: r[4])]
    assert {r.node_id: r.next_id for r in linked} == dict(zip(ordered, [*ordered[1:], None]))


def test_linked_nodes_share_one_exchange(spark):
    nodes = materialize(A.token_nodes(spark, SF_DIR), "tokens")
    plan = E.linked_nodes(nodes)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    tree = E.tree_edges(nodes)._jdf.queryExecution().executedPlan().toString()
    assert tree.count("Exchange") == 1 and "Join" not in tree


def test_latest_per_key_and_distinct_edges(spark):
    data = [("k", i % 5, i, f"v{i}") for i in range(50)]
    random.Random(3).shuffle(data)
    df = spark.createDataFrame(data, "a string, b int, offset long, v string")
    newest = {r.b: r.v for r in latest_per_key(df, ["a", "b"], ["offset"]).collect()}
    assert newest == {i: f"v{45 + i}" for i in range(5)}
    edges = spark.createDataFrame(
        [("r", "f", "AST", "1", "2")] * 3 + [("r", "f", "CFG", "1", "2")],
        "repo_name string, file_path string, edge_type string, source_id string, target_id string",
    )
    assert E.distinct_edges(edges).count() == 2


def test_uniqueness_assertion(spark):
    schema = "repo_name string, file_path string, node_id string, structural_path string"
    clean = spark.createDataFrame([("r", "f", "1", "a"), ("r", "f", "2", "b")], schema)
    assert E.assert_unique(clean).first().violations == 0
    broken = spark.createDataFrame([("r", "f", "1", "a"), ("r", "f", "2", "a")], schema)
    with pytest.raises(Exception, match="1 repeated node identities"):
        E.assert_unique(broken).collect()


def test_token_nodes_give_the_same_edges_when_split(spark, monkeypatch):
    """All documents cut into small blocks, against the same documents left whole."""
    nodes = materialize(A.token_nodes(spark, SF_DIR), "tokens")

    def sets():
        return [E.typed_edges(nodes), E.sequence_edges(nodes), E.definition_edges(nodes), E.tree_edges(nodes)]

    want = [{tuple(r) for r in df.collect()} for df in sets()]
    assert [len(w) for w in want[1:]] == [sum(e[2] == k for e in want[0]) for k in ("CFG", "DFG", "AST")]
    monkeypatch.setattr(S, "BLOCK_ROWS", 50)
    assert "block" in blocked(nodes, E.FILE, E.ORDER).columns
    for df, expected in zip(sets(), want):
        got = df.collect()
        assert len(got) == len(expected) and {tuple(r) for r in got} == expected
