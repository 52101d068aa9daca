"""Typed edges from a node table (WN-1 to WN-3, JN-1 to JN-3, ST-1 to ST-3).

Every operator takes its scope, order and id columns as parameters and so works on any table
of ordered records; the defaults fit the node contract. Large scopes are cut into blocks by
:mod:`weft.operators.sequence`. ``dealt`` tells that the rows of a scope lie together already, as behind a
``repartition`` by its columns: then they stay where they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.identity import edge_id
from weft.functions.text import last_segment, parent_path
from weft.operators.duplicates import duplicate_groups
from weft.operators.sequence import blocked, with_above, with_first, with_last, with_next

FILE = ("repo_name", "file_path")
ORDER = ("lineno", "col_offset", "structural_path", "node_id")
# The columns of linked nodes that name the other end of an edge.
EDGE_ENDS = ("parent_id", "next_id", "def_id", "function_id")
# The node types that define a function.
FUNCTION_TYPES = ("FunctionDef", "AsyncFunctionDef")


def _edge(scope: Sequence[str], edge_type: str, source: str, target: str) -> list[Column]:
    return [
        *[F.col(c) for c in scope],
        F.lit(edge_type).alias("edge_type"),
        F.col(source).alias("source_id"),
        F.col(target).alias("target_id"),
    ]


def _parent_of(path: Column) -> Column:
    """The path above, null for a root, whose path has no dot."""
    return F.when(F.contains(path, F.lit(".")), parent_path(path))


def tree_edges(nodes: DataFrame, scope: Sequence[str] = FILE, dealt: bool = False) -> DataFrame:
    """Parent to child by structural path (JN-1). The root has no dot in its path."""
    rows = nodes.select(*scope, "structural_path", "node_id")
    laid_out = blocked(rows, scope, ("structural_path", "node_id"), dealt=dealt)
    linked = with_above(laid_out, scope, "structural_path", _parent_of(F.col("structural_path")), "node_id", "parent_id")
    return recorded_tree_edges(linked, scope)


def recorded_tree_edges(nodes: DataFrame, scope: Sequence[str] = FILE) -> DataFrame:
    """The same edges without a join, where the extractor noted each node's parent."""
    return nodes.where("parent_id IS NOT NULL").select(*_edge(scope, "AST", "parent_id", "node_id"))


def sequence_edges(
    nodes: DataFrame,
    scope: Sequence[str] = FILE,
    order: Sequence[str] = ORDER,
    id_col: str = "node_id",
    edge_type: str = "CFG",
    dealt: bool = False,
) -> DataFrame:
    """Each record to the next one of its scope (WN-1)."""
    rows = blocked(nodes.select(*dict.fromkeys([*scope, *order, id_col])), scope, order, dealt=dealt)
    linked = with_next(rows, scope, order, id_col, "next_id").where("next_id IS NOT NULL")
    return linked.select(*_edge(scope, edge_type, id_col, "next_id"))


def definition_edges(
    nodes: DataFrame,
    is_store: Column | str = "ctx = 'Store'",
    is_load: Column | str = "ctx = 'Load'",
    scope: Sequence[str] = FILE,
    order: Sequence[str] = ORDER,
    id_col: str = "node_id",
    name: str = "name",
    edge_type: str = "DFG",
    dealt: bool = False,
) -> DataFrame:
    """Latest earlier store of a name to each load of it (WN-2).

    Only stores and loads are shuffled.
    """
    store, load = (F.expr(c) if isinstance(c, str) else c for c in (is_store, is_load))
    rows = nodes.where((store | load) & F.col(name).isNotNull() & (F.col(name) != "")).select(
        *dict.fromkeys([*scope, name, *order, id_col]),
        store.alias("_store"),
    )
    stored = F.when(F.col("_store"), F.col(id_col))
    # No name has more rows than its file, and files are fewer to count.
    laid_out = blocked(rows, scope, order, dealt=dealt)
    read = with_last(laid_out, [*scope, name], order, stored, "def_id")
    linked = read.where("NOT _store AND def_id IS NOT NULL")
    return linked.select(*_edge(scope, edge_type, "def_id", id_col))


def first_functions(
    nodes: DataFrame, scope: Sequence[str] = FILE, order: Sequence[str] = ORDER
) -> DataFrame:
    """The first function of each name (WN-3), pre-aggregated before the shuffle."""
    return (
        nodes.where(F.col("node_type").isin(*FUNCTION_TYPES) & (F.col("name") != ""))
        .groupBy(*scope, "name")
        .agg(F.min_by("node_id", F.struct(*order)).alias("function_id"))
    )


def call_edges(
    nodes: DataFrame, scope: Sequence[str] = FILE, order: Sequence[str] = ORDER
) -> DataFrame:
    """Call to the first function its last name segment stands for (JN-3)."""
    calls = nodes.where((F.col("node_type") == "Call") & (F.col("name") != "")).select(
        *scope, last_segment(F.col("name")).alias("name"), "node_id"
    )
    linked = calls.join(first_functions(nodes, scope, order), [*scope, "name"])
    return linked.where("node_id <> function_id").select(
        *_edge(scope, "CALL", "node_id", "function_id")
    )


def with_context(nodes: DataFrame, scope: Sequence[str] = FILE) -> DataFrame:
    """Add ``ctx`` (Load, Store, Del) to a stored node table from the ``.ctx`` child rows (JN-2)."""
    contexts = nodes.where(F.col("structural_path").endswith(".ctx")).select(
        *scope,
        parent_path(F.col("structural_path")).alias("structural_path"),
        F.col("node_type").alias("ctx"),
    )
    return nodes.join(contexts, [*scope, "structural_path"], "left")


def linked_nodes(
    nodes: DataFrame,
    recorded_parents: bool = False,
    scope: Sequence[str] = FILE,
    order: Sequence[str] = ORDER,
    dealt: bool = False,
    identity: Column | None = None,
    made_of: Sequence[str] = (),
) -> DataFrame:
    """Every node with the ends of its edges: ``parent_id``, ``next_id``, ``def_id`` and ``function_id``.

    One layout and one exchange serve all four: rows are dealt out by (scope, block), and each edge set
    is a sort of a block. Columns added to ``scope`` that depend on the file, such as its hash, come along.
    With ``identity``, the expression of ``node_id`` out of the columns ``made_of``, ids are made where the rows were dealt to and are not moved.
    """
    known = ["parent_id"] if recorded_parents else []
    if identity is None:
        rows = nodes.select(*dict.fromkeys([*scope, *order, "node_type", "name", "ctx", *known]))
        rows = blocked(rows, scope, order, dealt=dealt)
    else:
        # Rows equal in the rest of the order stay in one block, so the borders need no id.
        before = [c for c in order if c != "node_id"]
        rows = nodes.select(*dict.fromkeys([*scope, *before, "node_type", "name", "ctx", *made_of, *known]))
        rows = blocked(rows, scope, before, dealt=dealt).withColumn("node_id", identity)
        rows = rows.drop(*set(made_of) - {*scope, *order, "node_type", "name", "ctx"})
    if not recorded_parents:
        above = _parent_of(F.col("structural_path"))
        rows = with_above(rows, scope, "structural_path", above, "node_id", "parent_id")

    kind, named = F.col("node_type"), F.col("name").isNotNull() & (F.col("name") != "")
    variable = (kind == "Name") & named & F.col("ctx").isin("Store", "Load")
    function, call = kind.isin(*FUNCTION_TYPES) & named, (kind == "Call") & named
    # Variables and functions share the sort by name; a prefix keeps them apart.
    symbol = (
        F.when(variable, F.concat(F.lit("v "), "name"))
        .when(function, F.concat(F.lit("f "), "name"))
        .when(call, F.concat(F.lit("f "), last_segment(F.col("name"))))
    )
    rows = rows.withColumn("_symbol", symbol)
    stored = F.when(variable & (F.col("ctx") == "Store"), F.col("node_id"))
    rows = with_last(rows, [*scope, "_symbol"], order, stored, "def_id")
    rows = with_first(rows, [*scope, "_symbol"], order, F.when(function, F.col("node_id")), "function_id")
    # The order of the file comes last and stays: equal ends of edges are then near each other, which halves them in a compressed result.
    rows = with_next(rows, scope, order, "node_id", "next_id")
    return rows.select(
        *dict.fromkeys([*scope, "node_type", "node_id", "parent_id", "next_id"]),
        F.when(variable & (F.col("ctx") == "Load"), F.col("def_id")).alias("def_id"),
        F.when(call & (F.col("function_id") != F.col("node_id")), F.col("function_id")).alias("function_id"),
    )


def edges_of(linked: DataFrame, scope: Sequence[str] = FILE) -> DataFrame:
    """The four edge sets of :func:`linked_nodes` as rows."""

    def edge(kind: str, source: str, target: str, end: str) -> Column:
        ends = F.struct(F.lit(kind).alias("edge_type"), F.col(source).alias("source_id"), F.col(target).alias("target_id"))
        return F.when(F.col(end).isNotNull(), ends)

    sets = F.array(
        edge("AST", "parent_id", "node_id", "parent_id"),
        edge("CFG", "node_id", "next_id", "next_id"),
        edge("DFG", "def_id", "node_id", "def_id"),
        edge("CALL", "node_id", "function_id", "function_id"),
    )
    found = linked.select(*scope, F.explode(sets).alias("_edge")).where("_edge IS NOT NULL")
    return found.select(*scope, "_edge.*")


def typed_edges(
    nodes: DataFrame, recorded_parents: bool = False, scope: Sequence[str] = FILE, dealt: bool = False
) -> DataFrame:
    """Union of the four edge sets (ST-1).

    With unique node ids no edge can occur twice: the target of an AST, CFG or DFG edge and
    the source of a CALL edge each occur once per type. Tables without that guarantee go
    through :func:`distinct_edges`.
    """
    return edges_of(linked_nodes(nodes, recorded_parents, scope, dealt=dealt), scope)


def distinct_edges(edges: DataFrame, scope: Sequence[str] = FILE) -> DataFrame:
    """One row per (scope, type, source, target) (ST-2)."""
    return edges.dropDuplicates([*scope, "edge_type", "source_id", "target_id"])


def identified(edges: DataFrame) -> DataFrame:
    return edges.withColumn("edge_id", edge_id())


def uniqueness_violations(nodes: DataFrame, scope: Sequence[str] = FILE) -> DataFrame:
    """Node ids and structural paths that occur more than once (ST-3)."""
    # Ids are settled by file, then by hashes: a clean table moves one number per row.
    repeated = duplicate_groups(nodes, ["node_id"], scope)
    nulls = nodes.agg(F.max(F.lit(None).cast("string")).alias("node_id"), F.count_if(F.col("node_id").isNull()).alias("count")).where("count > 1")
    by_id = repeated.unionByName(nulls).select(F.lit("node_id").alias("kind"), F.col("node_id").alias("value"), "count")
    by_path = (
        nodes.groupBy(
            *scope, F.lit("structural_path").alias("kind"), F.col("structural_path").alias("value")
        )
        .count()
        .where("count > 1")
        .select("kind", F.concat_ws(":", *scope, "value").alias("value"), "count")
    )
    return by_id.unionByName(by_path)


def assert_unique(nodes: DataFrame, scope: Sequence[str] = FILE) -> DataFrame:
    """Fail the query where an identity repeats; return one row when none does."""
    found = uniqueness_violations(nodes, scope).agg(F.count("*").alias("violations"))
    failure = F.raise_error(F.format_string("%d repeated node identities", F.col("violations")))
    return found.select(
        F.when(F.col("violations") > 0, failure.cast("bigint"))
        .otherwise(F.col("violations"))
        .alias("violations")
    )
