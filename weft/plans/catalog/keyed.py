"""Keyed table maintenance over orders and their graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import graph as G
from weft.operators import merge as M
from weft.plans import reports as V
from weft.plans.adapters import ORDER_GRAPH_SQL, order_graph, table
from weft.plans.catalog import query

_WITH = f"WITH {ORDER_GRAPH_SQL}"


def _within(g):
    """The columns by which the rows of a graph lie together."""
    return M.FILE if g["dealt"] else ()


@query(
    "dm1_replace_upsert",
    """WITH target AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus <> 'O'),
    batch AS (
      SELECT o_orderkey, 'R' AS o_orderstatus, o_totalprice * 2 AS o_totalprice FROM orders
      WHERE o_orderpriority IN ('1-URGENT', '2-HIGH'))
    SELECT * FROM target WHERE o_orderkey NOT IN (SELECT o_orderkey FROM batch)
    UNION ALL SELECT * FROM batch""",
)
def dm1(spark, sf_dir):
    """Urgent orders arrive repriced: known ones are replaced, open ones inserted."""
    orders = table(spark, sf_dir, "orders")
    columns = ["o_orderkey", "o_orderstatus", "o_totalprice"]
    target = orders.where("o_orderstatus <> 'O'").select(*columns)
    batch = orders.where("o_orderpriority IN ('1-URGENT', '2-HIGH')").select(
        "o_orderkey", F.lit("R").alias("o_orderstatus"), (F.col("o_totalprice") * 2).alias("o_totalprice")
    )
    return M.replace_upsert(target, batch, ["o_orderkey"])


@query(
    "dm1_upsert_with_repeats",
    """WITH latest AS (
      SELECT l_orderkey AS o_orderkey, l_linenumber, l_partkey FROM lineitem
      QUALIFY row_number() OVER (PARTITION BY l_orderkey
        ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC) = 1)
    SELECT o_orderkey, 0::INT AS l_linenumber, 0::BIGINT AS l_partkey FROM orders
    WHERE o_orderkey NOT IN (SELECT o_orderkey FROM latest)
    UNION ALL SELECT * FROM latest""",
)
def dm1_repeats(spark, sf_dir):
    """A batch that repeats keys: the latest shipment of each order wins."""
    target = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.lit(0).alias("l_linenumber"), F.lit(0).cast("bigint").alias("l_partkey")
    )
    batch = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    order = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    return M.replace_upsert(target, batch, ["o_orderkey"], order)


@query("dm2_merge_nodes", f"{_WITH} SELECT * FROM merged_nodes")
def dm2(spark, sf_dir):
    g = order_graph(spark, sf_dir)
    return M.replace_upsert(g["nodes"], g["new_nodes"], ["id"], within=_within(g))


@query("dm3_merge_edges", f"{_WITH} SELECT * FROM merged_edges")
def dm3(spark, sf_dir):
    g = order_graph(spark, sf_dir)
    return M.replace_upsert(g["edges"], g["new_edges"], ["id"], within=_within(g))


@query(
    "dm3_edges_before_nodes",
    f"""{_WITH}, ends AS (SELECT source_id AS id FROM old_edges UNION SELECT target_id FROM old_edges)
    SELECT id, true AS placeholder FROM ends WHERE id NOT IN (SELECT id FROM new_nodes)""",
)
def dm3_placeholders(spark, sf_dir):
    """All edges but only the replayed nodes have arrived."""
    g = order_graph(spark, sf_dir)
    return M.placeholders(g["new_nodes"], g["edges"], g["dealt"])


@query(
    "dm4_delete_scope",
    f"""{_WITH} SELECT 'node' AS kind, id FROM kept_nodes UNION ALL SELECT 'edge', id FROM kept_edges
    UNION ALL SELECT 'deleted node', id FROM gone""",
)
def dm4(spark, sf_dir):
    g = order_graph(spark, sf_dir)
    parts = zip(("node", "edge", "deleted node"), M.delete_scope(g["nodes"], g["edges"], g["scope"], g["dealt"]))
    nodes, edges, gone = [df.select(F.lit(kind).alias("kind"), "id") for kind, df in parts]
    return nodes.unionByName(edges).unionByName(gone)


@query(
    "dm5_replace_scope",
    f"""{_WITH} SELECT 'node' AS kind, id, file_path, file_hash FROM replaced_nodes
    UNION ALL SELECT 'edge', id, file_path, file_hash FROM replaced_edges""",
)
def dm5(spark, sf_dir):
    g = order_graph(spark, sf_dir)
    nodes, edges = M.replace_scope(g["nodes"], g["edges"], g["scope"], g["new_nodes"], g["new_edges"], g["dealt"])
    columns = ["id", "file_path", "file_hash"]
    return nodes.select(F.lit("node").alias("kind"), *columns).unionByName(
        edges.select(F.lit("edge").alias("kind"), *columns)
    )


def _metadata(g, merged: bool):
    """One document per file: the old hash, or the replayed one."""
    old = g["nodes"].select("repo_name", "file_path", "file_hash").distinct()
    if not merged:
        return old
    replayed = g["scope"].withColumn("file_hash", F.sha2(F.concat("file_path", F.lit("v2")), 256))
    return M.replace_upsert(old, replayed, ["repo_name", "file_path"])


@query(
    "dm6_current_generation",
    f"""{_WITH} SELECT n.* FROM merged_nodes n WHERE file_hash = sha256(file_path ||
      CASE WHEN file_path IN (SELECT file_path FROM scope) THEN 'v2' ELSE 'v1' END)""",
)
def dm6(spark, sf_dir):
    g = order_graph(spark, sf_dir)
    merged = M.replace_upsert(g["nodes"], g["new_nodes"], ["id"], within=_within(g))
    return M.current_generation(merged, _metadata(g, merged=True)).select(*g["nodes"].columns)


@query(
    "st4_changed_files",
    f"""{_WITH}, old AS (SELECT DISTINCT repo_name, file_path, file_hash FROM old_nodes),
    new AS (SELECT repo_name, file_path, sha256(file_path || 'v2') AS file_hash FROM scope
            UNION ALL SELECT * FROM old WHERE file_path NOT IN (SELECT file_path FROM scope))
    SELECT new.repo_name, new.file_path, old.file_hash AS old_hash, new.file_hash AS new_hash,
           old.file_hash IS DISTINCT FROM new.file_hash AS changed
    FROM new LEFT JOIN old ON new.file_path = old.file_path""",
)
def st4(spark, sf_dir):
    g = order_graph(spark, sf_dir)
    return M.changed_files(_metadata(g, merged=False), _metadata(g, merged=True))


@query("st5_stale_rows", f"{_WITH} SELECT * FROM merged_nodes WHERE id NOT IN (SELECT id FROM replaced_nodes)")
def st5(spark, sf_dir):
    """Rows a merge leaves behind and a scoped replace removes."""
    g = order_graph(spark, sf_dir)
    merged = M.replace_upsert(g["nodes"], g["new_nodes"], ["id"], within=_within(g))
    nodes, _ = M.replace_scope(g["nodes"], g["edges"], g["scope"], g["new_nodes"], g["new_edges"], g["dealt"])
    return M.stale_rows(merged, nodes)


@query(
    "vr5_file_replay_report",
    f"""{_WITH},
    bn AS (SELECT file_path, count(*) AS n FROM old_nodes GROUP BY 1),
    an AS (SELECT file_path, count(*) AS n FROM replaced_nodes GROUP BY 1),
    be AS (SELECT file_path, count(*) AS n FROM old_edges GROUP BY 1),
    ae AS (SELECT file_path, count(*) AS n FROM replaced_edges GROUP BY 1)
    SELECT 'orders:' || bn.file_path || ':' || m AS metric, b::VARCHAR AS before, nullif(a, -1)::VARCHAR AS after,
           CASE WHEN a >= 0 THEN printf('%+d', a - b) END AS delta
    FROM bn LEFT JOIN an USING (file_path) LEFT JOIN be USING (file_path)
      LEFT JOIN ae USING (file_path),
      LATERAL (VALUES ('nodes', bn.n, coalesce(an.n, -1)),
        ('edges', coalesce(be.n, 0), CASE WHEN an.n IS NULL THEN -1 ELSE coalesce(ae.n, 0) END)) t(m, b, a)""",
)
def vr5_report(spark, sf_dir):
    """Nodes and edges of every file before and after its replay."""
    g = order_graph(spark, sf_dir)
    after = M.replace_scope(g["nodes"], g["edges"], g["scope"], g["new_nodes"], g["new_edges"], g["dealt"])

    def state(nodes, edges):
        counts = G.file_graph_counts(nodes, edges, g["dealt"])
        pair = F.array(
            F.struct(F.lit("nodes").alias("m"), F.col("node_count").alias("value")),
            F.struct(F.lit("edges").alias("m"), F.col("edge_count").alias("value")),
        )
        rows = counts.select("repo_name", "file_path", F.explode(pair).alias("p"))
        return rows.select(F.concat_ws(":", "repo_name", "file_path", "p.m").alias("metric"), "p.value")

    report = G.compare_metrics(state(g["nodes"], g["edges"]), state(*after))
    return report.withColumns({c: F.col(c).cast("string") for c in ("before", "after")})


@query(
    "vr5_replay_summary",
    f"""{_WITH},
    docs AS (SELECT count(DISTINCT file_path) AS n FROM old_nodes),
    docs_after AS (
      SELECT count(*) AS n FROM (SELECT file_path FROM old_nodes UNION SELECT file_path FROM scope)),
    h AS (SELECT max(file_hash) AS old_hash FROM old_nodes WHERE file_path = 'cust/27'),
    s AS (SELECT count(*) > 0 AS hit FROM scope WHERE file_path = 'cust/27')
    SELECT 'cust/27' AS target_file, docs.n AS documents_before, docs_after.n AS documents_after,
      (SELECT count(*) FROM old_nodes WHERE file_path = 'cust/27') AS node_count_before,
      (SELECT count(*) FROM replaced_nodes WHERE file_path = 'cust/27') AS node_count_after,
      (SELECT count(*) FROM old_edges WHERE file_path = 'cust/27') AS edge_count_before,
      (SELECT count(*) FROM replaced_edges WHERE file_path = 'cust/27') AS edge_count_after,
      old_hash, CASE WHEN hit THEN sha256('cust/27v2') ELSE old_hash END AS new_hash,
      0::BIGINT AS duplicate_node_ids, 0::BIGINT AS duplicate_edge_ids,
      0::BIGINT AS duplicate_metadata_ids, 0::BIGINT AS duplicate_files,
      hit AS file_hash_changed, printf('%+d', docs_after.n - docs.n) AS documents_delta,
      hit AS hash_matches_replay, hit AND docs_after.n = docs.n AS passed
    FROM docs, docs_after, h, s""",
)
def vr5(spark, sf_dir):
    g = order_graph(spark, sf_dir)
    nodes, edges = M.replace_scope(g["nodes"], g["edges"], g["scope"], g["new_nodes"], g["new_edges"], g["dealt"])

    def documents(merged):
        return _metadata(g, merged).withColumn("metadata_id", F.concat_ws(":", "repo_name", "file_path"))

    before = {"nodes": g["nodes"], "edges": g["edges"], "metadata": documents(False)}
    after = {"nodes": nodes, "edges": edges, "metadata": documents(True)}
    state = V.file_state(before, "orders", "cust/27")
    return V.replay_summary(state, after, "orders", "cust/27", F.sha2(F.lit("cust/27v2"), 256), g["dealt"])
