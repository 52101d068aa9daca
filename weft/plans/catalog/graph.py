"""Edges, joins, roll-ups and reports over token graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.identity import packed, unpacked
from weft.operators import edges as E
from weft.operators import graph as G
from weft.operators import merge as M
from weft.operators import rollup as R
from weft.plans import reports as V
from weft.plans.adapters import TOKEN_NODES_SQL, TURNS_SQL, token_nodes, turns
from weft.plans.catalog import query

_WITH = f"WITH {TOKEN_NODES_SQL}"
_AST = """
  SELECT c.repo_name, c.file_path, 'AST' AS edge_type, p.node_id AS source_id, c.node_id AS target_id
  FROM nodes c JOIN nodes p ON c.repo_name = p.repo_name AND c.file_path = p.file_path
   AND regexp_replace(c.structural_path, '\\.[^.]*$', '') = p.structural_path
  WHERE contains(c.structural_path, '.')"""
_CFG = """
  SELECT repo_name, file_path, 'CFG' AS edge_type, node_id AS source_id, target_id FROM (
    SELECT *, lead(node_id) OVER (PARTITION BY repo_name, file_path
      ORDER BY lineno, col_offset, structural_path, node_id) AS target_id FROM nodes)
  WHERE target_id IS NOT NULL"""
_DFG = """
  SELECT repo_name, file_path, 'DFG' AS edge_type, def_id AS source_id, node_id AS target_id FROM (
    SELECT *, last_value(CASE WHEN ctx = 'Store' THEN node_id END IGNORE NULLS) OVER (
      PARTITION BY repo_name, file_path, name
      ORDER BY lineno, col_offset, structural_path, node_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS def_id
    FROM nodes WHERE ctx IN ('Store', 'Load') AND name IS NOT NULL)
  WHERE ctx = 'Load' AND def_id IS NOT NULL"""
_FUNCTIONS = """
  SELECT repo_name, file_path, name, node_id AS function_id FROM nodes
  WHERE node_type IN ('FunctionDef', 'AsyncFunctionDef') AND name IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY repo_name, file_path, name
    ORDER BY lineno, col_offset, structural_path, node_id) = 1"""
_CALL = f"""
  SELECT c.repo_name, c.file_path, 'CALL' AS edge_type, c.node_id AS source_id,
         f.function_id AS target_id
  FROM nodes c JOIN ({_FUNCTIONS}) f ON c.repo_name = f.repo_name AND c.file_path = f.file_path
   AND string_split(c.name, '.')[-1] = f.name
  WHERE c.node_type = 'Call'"""
_EDGES = f"""
edges AS (
  SELECT *, sha256(concat_ws(chr(31), repo_name, file_path, edge_type, source_id, target_id))
    AS edge_id
  FROM ({_AST} UNION ALL {_CFG} UNION ALL {_DFG} UNION ALL {_CALL}))"""
_GRAPH = f"{_WITH}, {_EDGES}"


def _call_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Stored nodes of everything but functions, and all stored edges, both dealt out by file.

    The functions are the ends that stay unresolved. Neither table is written: their ids alone are
    some fifty times as large as the texts, and each reader needs a few columns.
    """
    tokens = token_nodes(spark, sf_dir)
    edges = _store_edges(E.typed_edges(tokens, dealt=True))
    return _store_nodes(tokens.where("node_type <> 'FunctionDef'")), edges


def _store_nodes(tokens: DataFrame) -> DataFrame:
    return tokens.select(
        F.col("node_id").alias("id"), "repo_name", "file_path", "file_hash", F.col("node_type").alias("type")
    )


def _store_edges(edges: DataFrame) -> DataFrame:
    return E.identified(edges).select(
        F.col("edge_id").alias("id"), "source_id", "target_id", F.col("edge_type").alias("type"), "repo_name", "file_path"
    )


_CALL_GRAPH = f"""{_WITH},
graph_nodes AS (
  SELECT node_id AS id, repo_name, file_path, file_hash, node_type AS type FROM nodes
  WHERE node_type <> 'FunctionDef'),
graph_edges AS (
  SELECT sha256(concat_ws(chr(31), repo_name, file_path, edge_type, source_id, target_id)) AS id,
         source_id, target_id, edge_type AS type, repo_name, file_path
  FROM ({_AST} UNION ALL {_CFG} UNION ALL {_DFG} UNION ALL {_CALL})),
ends AS (
  SELECT source_id AS id FROM graph_edges UNION SELECT target_id FROM graph_edges)"""


@query("fn4_node_identity", f"{_WITH} SELECT node_id, repo_name, file_path, structural_path, name FROM nodes")
def fn4(spark, sf_dir):
    return token_nodes(spark, sf_dir).select("node_id", "repo_name", "file_path", "structural_path", "name")


@query("wn1_sequence_edges", f"{_WITH} {_CFG}")
def wn1(spark, sf_dir):
    return E.sequence_edges(token_nodes(spark, sf_dir), dealt=True)


@query("wn2_definition_edges", f"{_WITH} {_DFG}")
def wn2(spark, sf_dir):
    return E.definition_edges(token_nodes(spark, sf_dir), dealt=True)


@query("wn3_first_functions", f"{_WITH} {_FUNCTIONS}")
def wn3(spark, sf_dir):
    return E.first_functions(token_nodes(spark, sf_dir))


@query("jn1_tree_edges", f"{_WITH} {_AST}")
def jn1(spark, sf_dir):
    return E.tree_edges(token_nodes(spark, sf_dir), dealt=True)


@query("jn3_call_edges", f"{_WITH} {_CALL}")
def jn3(spark, sf_dir):
    return E.call_edges(token_nodes(spark, sf_dir))


@query(
    "st1_typed_edges",
    f"{_GRAPH} SELECT edge_id, edge_type, source_id, target_id, repo_name, file_path FROM edges",
)
def st1(spark, sf_dir):
    edges = E.identified(E.typed_edges(token_nodes(spark, sf_dir), dealt=True))
    return edges.select("edge_id", "edge_type", "source_id", "target_id", "repo_name", "file_path")


@query(
    "wn1_turn_sequence",
    f"""WITH {TURNS_SQL}
    SELECT repo_name, file_path, 'NEXT' AS edge_type, id AS source_id, target_id FROM (
      SELECT *, lead(id) OVER (PARTITION BY file_path ORDER BY turn) AS target_id FROM turns)
    WHERE target_id IS NOT NULL""",
)
def wn1_turns(spark, sf_dir):
    """Conversations of any length: the sequence is cut into chunks and stitched."""
    return E.sequence_edges(turns(spark, sf_dir), order=("turn",), id_col="id", edge_type="NEXT")


@query(
    "wn2_turn_answers",
    f"""WITH {TURNS_SQL}
    SELECT repo_name, file_path, 'ANSWERS' AS edge_type, def_id AS source_id, id AS target_id FROM (
      SELECT *, last_value(CASE WHEN role = 'user' THEN id END IGNORE NULLS) OVER (
        PARTITION BY file_path ORDER BY turn
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS def_id FROM turns)
    WHERE role <> 'user' AND def_id IS NOT NULL""",
)
def wn2_turns(spark, sf_dir):
    """The latest user turn before each other turn."""
    rows = turns(spark, sf_dir).withColumn("thread", F.lit("turns"))
    return E.definition_edges(
        rows, "role = 'user'", "role <> 'user'", order=("turn",), id_col="id", name="thread", edge_type="ANSWERS"
    )


@query(
    "st2_distinct_edges",
    f"""WITH {TURNS_SQL}
    SELECT DISTINCT repo_name, file_path, 'ROLE' AS edge_type, role AS source_id, target_id FROM (
      SELECT *, lead(role) OVER (PARTITION BY file_path ORDER BY turn) AS target_id FROM turns)
    WHERE target_id IS NOT NULL""",
)
def st2(spark, sf_dir):
    """Transitions between roles repeat within a conversation."""
    rows = E.sequence_edges(turns(spark, sf_dir), order=("turn",), id_col="role", edge_type="ROLE")
    return E.distinct_edges(rows)


@query("st3_unique_identities", f"{_WITH} SELECT (count(*) - count(DISTINCT node_id))::BIGINT AS violations FROM nodes")
def st3(spark, sf_dir):
    return E.assert_unique(token_nodes(spark, sf_dir))


@query(
    "st3_repeated_identities",
    f"""{_WITH}, named AS (
      SELECT repo_name, file_path, coalesce(name, '') AS node_id, 'line ' || lineno AS structural_path
      FROM nodes)
    SELECT 'node_id' AS kind, node_id AS value, count(*) AS count FROM named GROUP BY 2
    HAVING count(*) > 1
    UNION ALL
    SELECT 'structural_path', repo_name || ':' || file_path || ':' || structural_path, count(*)
    FROM named GROUP BY repo_name, file_path, structural_path HAVING count(*) > 1""",
)
def st3_listing(spark, sf_dir):
    """With names as ids and lines as paths nearly everything repeats."""
    named = token_nodes(spark, sf_dir).select(
        "repo_name",
        "file_path",
        F.coalesce("name", F.lit("")).alias("node_id"),
        F.concat(F.lit("line "), "lineno").alias("structural_path"),
    )
    return E.uniqueness_violations(named)


@query(
    "ag1_file_metadata",
    f"""{_GRAPH},
    n AS (
      SELECT repo_name, file_path,
             count(*) FILTER (node_type IN ('FunctionDef', 'AsyncFunctionDef'))::INT AS function_count,
             count(*) FILTER (node_type = 'ClassDef')::INT AS class_count,
             count(*) FILTER (node_type IN ('Import', 'ImportFrom'))::INT AS import_count,
             count(*)::INT AS node_count, max(file_hash) AS file_hash
      FROM nodes GROUP BY 1, 2),
    e AS (SELECT repo_name, file_path, count(*)::INT AS edge_count FROM edges GROUP BY 1, 2)
    SELECT n.*, coalesce(e.edge_count, 0) AS edge_count
    FROM n LEFT JOIN e ON n.repo_name = e.repo_name AND n.file_path = e.file_path""",
)
def ag1(spark, sf_dir):
    scope = (*E.FILE, "file_hash")
    return R.file_metadata(E.linked_nodes(token_nodes(spark, sf_dir), scope=scope, dealt=True), carried=("file_hash",))


@query(
    "ag2_graph_counts",
    f"""{_CALL_GRAPH} SELECT (SELECT count(*) FROM graph_nodes) AS node_count,
    (SELECT count(*) FROM graph_edges) AS edge_count""",
)
def ag2(spark, sf_dir):
    return R.graph_counts(*_call_graph(spark, sf_dir))


@query(
    "ag3_file_graph_counts",
    f"""{_CALL_GRAPH},
    incident AS (
      SELECT DISTINCT n.repo_name, n.file_path, e.id AS edge_id FROM graph_nodes n
      JOIN (SELECT id, source_id AS e FROM graph_edges UNION ALL
            SELECT id, target_id FROM graph_edges) e ON n.id = e.e)
    SELECT n.repo_name, n.file_path, n.node_count, coalesce(i.edge_count, 0) AS edge_count
    FROM (SELECT repo_name, file_path, count(*) AS node_count FROM graph_nodes GROUP BY 1, 2) n
    LEFT JOIN (SELECT repo_name, file_path, count(*) AS edge_count FROM incident GROUP BY 1, 2) i
      ON n.repo_name = i.repo_name AND n.file_path = i.file_path""",
)
def ag3(spark, sf_dir):
    return G.file_graph_counts(*_call_graph(spark, sf_dir), dealt=True)


@query(
    "jn5_one_file_counts",
    f"""{_CALL_GRAPH}, mine AS (SELECT * FROM graph_nodes WHERE repo_name = 'src1' AND file_path = 'doc/1')
    SELECT (SELECT count(*) FROM mine) AS node_count,
           (SELECT count(*) FROM graph_edges WHERE source_id IN (SELECT id FROM mine)
              OR target_id IN (SELECT id FROM mine)) AS edge_count""",
)
def jn5(spark, sf_dir):
    return G.one_file_counts(*_call_graph(spark, sf_dir), "src1", "doc/1")


_TWICE = "SELECT node_id FROM nodes UNION ALL SELECT node_id FROM nodes WHERE node_type = 'Call'"


def _twice(rows: DataFrame, kind: str, value: str) -> DataFrame:
    """The rows, those whose ``kind`` is ``value`` twice; they are made once and stay where they are."""
    copies = F.when(F.col(kind) == value, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("*", F.explode(copies).alias("_copy")).drop("_copy")


def _calls_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes with a fault: every call is there twice."""
    return _twice(token_nodes(spark, sf_dir).select(*E.FILE, "node_id", "node_type"), "node_type", "Call")


@query(
    "ag4_duplicate_node_ids",
    f"{_WITH} SELECT count(*) AS duplicate_node_ids FROM (SELECT node_id FROM ({_TWICE}) GROUP BY 1 HAVING count(*) > 1)",
)
def ag4(spark, sf_dir):
    return R.duplicate_summary(_calls_twice(spark, sf_dir), ["node_id"], "duplicate_node_ids", E.FILE)


@query(
    "ag4_duplicate_node_listing",
    f"{_WITH} SELECT node_id, count(*) AS count FROM ({_TWICE}) GROUP BY 1 HAVING count(*) > 1 ORDER BY node_id LIMIT 20",
)
def ag4_listing(spark, sf_dir):
    groups = R.duplicate_groups(_calls_twice(spark, sf_dir), ["node_id"], E.FILE)
    return groups.orderBy("node_id").limit(R.GRAPH_SAMPLE)


@query(
    "ag5_duplicate_edge_ids",
    f"""{_CALL_GRAPH} SELECT count(*) AS duplicate_edge_ids FROM (SELECT id FROM (
      SELECT id FROM graph_edges UNION ALL SELECT id FROM graph_edges WHERE type = 'CALL') GROUP BY 1 HAVING count(*) > 1)""",
)
def ag5(spark, sf_dir):
    """All edges, with a fault: every call edge is there twice."""
    _, edges = _call_graph(spark, sf_dir)
    ids = _twice(edges.select(*E.FILE, "id", "type"), "type", "CALL")
    return R.duplicate_summary(ids, ["id"], "duplicate_edge_ids", E.FILE)


@query(
    "ag11_unresolved_count",
    f"{_CALL_GRAPH} SELECT count(*) AS unresolved FROM ends WHERE id NOT IN (SELECT id FROM graph_nodes)",
)
def ag11(spark, sf_dir):
    return M.placeholders(*_call_graph(spark, sf_dir), dealt=True).agg(F.count("*").alias("unresolved"))


@query(
    "jn4_file_contains_node",
    f"{_WITH} SELECT repo_name || ':' || file_path AS file_id, node_id FROM nodes",
)
def jn4(spark, sf_dir):
    nodes = _store_nodes(token_nodes(spark, sf_dir))
    # Files from their module rows: one per file, no distinct over all nodes.
    return G.file_contains_node(G.file_ids(nodes.where("type = 'Module'")), nodes)


@query(
    "jn6_placeholders",
    f"{_CALL_GRAPH} SELECT id, true AS placeholder FROM ends WHERE id NOT IN (SELECT id FROM graph_nodes)",
)
def jn6(spark, sf_dir):
    return M.placeholders(*_call_graph(spark, sf_dir), dealt=True)


_ENDS = """
    SELECT e.source_id, a.type AS source_type, e.id AS edge_id, e.type AS edge_type, e.target_id,
           b.type AS target_type
    FROM graph_edges e JOIN graph_nodes a ON e.source_id = a.id JOIN graph_nodes b ON e.target_id = b.id"""


@query("jn7_edges_with_ends", f"{_CALL_GRAPH} {_ENDS}")
def jn7(spark, sf_dir):
    nodes, edges = _call_graph(spark, sf_dir)
    return G.edges_with_ends(edges, nodes, dealt=True)


@query(
    "sl6_edge_sample",
    f"{_CALL_GRAPH} {_ENDS} WHERE a.repo_name = 'src1' AND a.file_path = 'doc/1' ORDER BY edge_id LIMIT 5",
)
def sl6(spark, sf_dir):
    nodes, edges = _call_graph(spark, sf_dir)
    return G.edge_sample(edges, nodes, "src1", "doc/1")


@query(
    "jn8_repository_contains_file",
    f"{_WITH} SELECT DISTINCT repo_name, repo_name || ':' || file_path AS file_id FROM nodes",
)
def jn8(spark, sf_dir):
    nodes = _store_nodes(token_nodes(spark, sf_dir).where("node_type = 'Module'"))
    return G.repository_contains_file(M.graph_repositories(nodes), G.file_ids(nodes))


@query(
    "jn9_metric_comparison",
    f"""{_CALL_GRAPH}, before AS (SELECT count(*) AS n FROM graph_nodes),
    after AS (SELECT count(*) AS n FROM nodes), same AS (SELECT count(*) AS n FROM graph_edges)
    SELECT 'node_count' AS metric, before.n AS before, after.n AS after,
           printf('%+d', after.n - before.n) AS delta FROM before, after
    UNION ALL SELECT 'edge_count', n, n, '+0' FROM same""",
)
def jn9(spark, sf_dir):
    nodes, edges = _call_graph(spark, sf_dir)
    after = R.graph_counts(_store_nodes(token_nodes(spark, sf_dir)), edges)
    return G.compare_metrics(G.metrics(R.graph_counts(nodes, edges)), G.metrics(after))


@query(
    "sl1_node_order",
    f"{_WITH} SELECT repo_name, file_path, lineno, col_offset, structural_path, node_id FROM nodes",
)
def sl1(spark, sf_dir):
    """The total order: files are dealt out by ranges, and their rows sorted where they are."""
    columns = [*E.FILE, *E.ORDER]
    return token_nodes(spark, sf_dir, by_range=True).select(*columns).orderBy(*columns)


_TOP = "SELECT repo_name, file_path, count(*) AS node_count FROM nodes GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 10"


@query("sl2_top_files", f"{_WITH} {_TOP}")
def sl2(spark, sf_dir):
    return R.top_files(token_nodes(spark, sf_dir))


@query(
    "sl4_sorted_edges",
    f"{_GRAPH} SELECT repo_name, file_path, edge_type, source_id, target_id FROM edges ORDER BY edge_type, source_id, target_id",
)
def sl4(spark, sf_dir):
    """The order of all typed edges, as a range-partitioned sort. Ids are hashes, which have the same order as bytes, at half the size."""
    edges = E.typed_edges(token_nodes(spark, sf_dir), dealt=True)
    ids = ("source_id", "target_id")
    moved = edges.select(*E.FILE, "edge_type", *[packed(F.col(c)).alias(c) for c in ids]).orderBy("edge_type", *ids)
    return moved.select(*E.FILE, "edge_type", *[unpacked(F.col(c)).alias(c) for c in ids])


@query(
    "vr1_graph_health",
    f"""{_CALL_GRAPH} SELECT *, duplicate_node_ids = 0 AND duplicate_edge_ids = 0 AND unresolved = 0 AS passed
    FROM (SELECT (SELECT count(*) FROM graph_nodes) AS node_count,
      (SELECT count(*) FROM graph_edges) AS edge_count,
      (SELECT count(*) - count(DISTINCT id) FROM graph_nodes) AS duplicate_node_ids,
      (SELECT count(*) - count(DISTINCT id) FROM graph_edges) AS duplicate_edge_ids,
      (SELECT count(*) FROM ends WHERE id NOT IN (SELECT id FROM graph_nodes)) AS unresolved)""",
)
def vr1(spark, sf_dir):
    return V.graph_health(*_call_graph(spark, sf_dir), dealt=True)


@query(
    "vr2_graph_statistics",
    f"""{_CALL_GRAPH} SELECT 'node_count' AS item, count(*) AS value FROM graph_nodes
    UNION ALL SELECT 'edge_count', count(*) FROM graph_edges
    UNION ALL SELECT 'file ' || repo_name || ':' || file_path, n FROM (
      SELECT repo_name, file_path, count(*) AS n FROM graph_nodes GROUP BY 1, 2
      ORDER BY 3 DESC, 1, 2 LIMIT 10)""",
)
def vr2(spark, sf_dir):
    return V.graph_statistics(*_call_graph(spark, sf_dir))


@query("vr7_identity_drift", f"{_WITH} SELECT node_id AS id, true AS in_first FROM nodes WHERE node_type = 'Call'")
def vr7(spark, sf_dir):
    """Two runs over the same content, the second without its calls: only those drift."""
    tokens = token_nodes(spark, sf_dir)
    return V.identity_drift(_store_nodes(tokens), _store_nodes(tokens.where("node_type <> 'Call'")), dealt=True)
