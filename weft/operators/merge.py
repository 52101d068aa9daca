"""Keyed table maintenance as DataFrame operators (WN-4, DM-1 to DM-6, ST-4, ST-5)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.identity import file_key, packed, unpacked
from weft.operators.duplicates import ALSO_THERE, duplicate_groups
from weft.session import materialize

FILE = ("repo_name", "file_path")
#: So many hashes of repeated keys are sent to the rows.
SENT_KEYS = 100_000


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The row with the highest ``order`` of each key (WN-4).

    An aggregate, not a window: rows of a hot key are reduced before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    ordering = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), ordering).alias("_row"))
    return newest.select(*keys, "_row.*").select(*df.columns)


def newest_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The same rows; only keys that repeat, as a count of 64-bit hashes tells, are moved, unless they are many."""
    hashed = df.withColumn("_hash", F.xxhash64(*keys))
    repeated = materialize(hashed.groupBy("_hash").agg(F.count("*").alias("n")).where("n > 1").select("_hash"), "repeated-keys")
    many = repeated.limit(SENT_KEYS + 1).count()
    if many == 0:
        return df
    if many > SENT_KEYS:
        return latest_per_key(df, keys, order)
    alone, several = (hashed.join(F.broadcast(repeated), "_hash", how).select(*df.columns) for how in ("left_anti", "left_semi"))
    return alone.unionByName(latest_per_key(several, keys, order))


def replace_upsert(
    target: DataFrame,
    batch: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column] = (),
    within: Sequence[str] = (),
    among: Sequence[DataFrame] = (),
) -> DataFrame:
    """Target with the batch's keys replaced whole-row or inserted (DM-1).

    ``order`` picks the winner where the batch repeats a key; without it the batch holds
    each key once. Where the rows of both lie together by the columns ``within``, they meet in a sort and no row is moved,
    unless a key is found under several values of those columns; ``among`` names other tables to look for such keys in,
    which hold all the keys and take less to compute.
    """
    rows = latest_per_key(batch, keys, order) if order else batch
    if within:
        kept = _without(target, rows, keys, within, keys_across(among or (target, rows), keys, within))
    else:
        kept = target.join(rows.select(*keys), list(keys), "left_anti")
    return kept.unionByName(rows.select(*target.columns))


def keys_across(tables: Sequence[DataFrame], keys: Sequence[str], within: Sequence[str]) -> DataFrame | None:
    """Hashes (``_key``) of the keys found under several values of ``within``, or None if there are none. Two numbers per row are moved."""
    hashes = [F.xxhash64(*keys).alias("_key"), F.xxhash64(*within).alias("_in")]
    rows = reduce(DataFrame.unionByName, [df.dropna(subset=list(keys)).select(*hashes) for df in tables])
    places = rows.groupBy("_key").agg(F.min("_in").alias("_least"), F.max("_in").alias("_most"))
    across = materialize(places.where("_least <> _most").select("_key"), "keys-across")
    return None if across.isEmpty() else across


def _without(rows: DataFrame, others: DataFrame, keys: Sequence[str], within: Sequence[str], across: DataFrame | None) -> DataFrame:
    """Rows whose keys no row of ``others`` has. Those that lie together by ``within`` meet in a sort, keys of ``across`` in a join."""
    layout = [*within, *keys]
    rest = [c for c in rows.columns if c not in layout]
    here = rows.select(*layout, F.struct(F.lit(True).alias("_is"), *rest).alias("_row"))
    parts = here.unionByName(others.select(*layout), allowMissingColumns=True)
    there = F.max(F.col("_row").isNull()).over(Window.partitionBy(F.xxhash64(*layout), *layout))
    known = reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])
    left = parts.withColumn("_there", there & known).where("_row IS NOT NULL AND NOT _there").select(*layout, "_row.*").select(*rows.columns)
    if across is None:
        return left
    elsewhere = others.select(*keys, F.xxhash64(*keys).alias("_key")).join(across, "_key", "left_semi").select(*keys)
    return left.join(elsewhere, list(keys), "left_anti").select(*rows.columns)


def graph_nodes(node_events: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Node rows as the graph store keeps them (DM-2), behind the ``keep`` columns."""
    return node_events.select(
        *keep,
        F.col("node_id").alias("id"),
        *FILE,
        "file_hash",
        F.col("node_type").alias("type"),
        "name",
        "structural_path",
        "lineno",
        "col_offset",
        "end_lineno",
        "end_col_offset",
        "schema_version",
        F.col("event_time").alias("updated_at"),
        F.lit(False).alias("placeholder"),
    )


def graph_edges(edge_events: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Edge rows as the graph store keeps them (DM-3), behind the ``keep`` columns."""
    return edge_events.select(
        *keep,
        F.col("edge_id").alias("id"),
        "source_id",
        "target_id",
        F.col("edge_type").alias("type"),
        *FILE,
        "file_hash",
        "schema_version",
        F.col("event_time").alias("updated_at"),
    )


def graph_files(node_events: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """One row per source file, with the hash of its latest node event (DM-2)."""
    newest = latest_per_key(node_events.select(*FILE, "file_hash", *order), FILE, order)
    return newest.select(
        file_key().alias("id"), "repo_name", F.col("file_path").alias("path"), "file_hash"
    )


def graph_repositories(node_events: DataFrame) -> DataFrame:
    return node_events.select(F.col("repo_name").alias("name")).distinct()


def placeholders(nodes: DataFrame, edges: DataFrame, dealt: bool = False) -> DataFrame:
    """Endpoints no node event has filled yet (JN-6, DM-3), each once.

    A view, not stored rows: a merged node leaves it, and the node and edge streams never
    write the same table. Ids are packed, since that is what the shuffles move. Where the rows of a file lie together
    in both tables (``dealt``), only ends that are no nodes of the edge's own file are looked up elsewhere.
    """
    ends = F.explode(F.array(packed(F.col("source_id")), packed(F.col("target_id"))))
    if dealt:
        missing = foreign_ends(nodes, edges)
        found = rows_of(nodes, missing.select(unpacked(F.col("_end")).alias("id"))).select(packed(F.col("id")).alias("_end"))
        missing = missing.join(found, "_end", "left_anti")
    else:
        there = nodes.select(packed(F.col("id")).alias("_end"))
        missing = edges.select(ends.alias("_end")).distinct().join(there, "_end", "left_anti")
    return missing.select(unpacked(F.col("_end")).alias("id"), F.lit(True).alias("placeholder"))


def foreign_ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Ends (``_end``, packed) that are no nodes of their edge's own file, each once and written. The rows of a file lie together in both tables."""
    own = nodes.select(*FILE, F.col("id").alias("_end"), F.lit(1).alias("_own"))
    both = F.explode(F.array("source_id", "target_id"))
    parts = edges.select(*FILE, both.alias("_end"), F.lit(0).alias("_own")).unionByName(own)
    found = parts.groupBy(*FILE, "_end").agg(F.max("_own").alias("_own"), F.min("_own").alias("_node"), F.count("_end").alias("_known"))
    # Without a node of that id; a null end is never one.
    foreign = found.where("_own = 0 OR (_known = 0 AND _node = 0)")
    return materialize(foreign.select(packed(F.col("_end")).alias("_end")).distinct(), "foreign-ends")


def all_at_home(nodes: DataFrame, edges: DataFrame) -> bool:
    """Whether no end of an edge is a node of another file and no id is found in several files; ends that are no nodes at all may be there.

    The rows of a file lie together in both tables. One 64-bit hash per node and the foreign ends are moved, in one pass over the nodes; a hash that
    two ids share may give no for a yes, never yes for a no.
    """
    foreign = foreign_ends(nodes, edges).select(unpacked(F.col("_end")).alias("id")).where("id IS NOT NULL")
    # A null id is no node's; it is counted as none instead of filtered, since a filter would make every id once more.
    there = nodes.select(*FILE, F.xxhash64("id").alias("_hash"), F.col("id").isNotNull().cast("bigint").alias("_n")).distinct()
    wanted = foreign.select(F.xxhash64("id").alias("_hash"), F.lit(ALSO_THERE).alias("_n"))
    noted = there.select("_hash", "_n").unionByName(wanted).groupBy("_hash").agg(F.sum("_n").alias("_n"))
    return noted.where((F.col("_n") > 1) & (F.col("_n") != ALSO_THERE)).isEmpty()


def rows_of(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """Nodes whose id is among ``ids``, a table that was written.

    64-bit hashes are looked up first: if none is there, which is the rule for ends that are no nodes of their own
    file, one number per node is moved and no row.
    """
    hashed = nodes.withColumn("_hash", F.xxhash64("id"))
    wanted = ids.where("id IS NOT NULL").withColumn("_hash", F.xxhash64("id"))
    if wanted.isEmpty():
        return nodes.limit(0)
    hits = materialize(hashed.select("_hash").join(wanted.select("_hash"), "_hash", "left_semi").distinct(), "hits")
    if hits.isEmpty():
        return nodes.limit(0)
    return hashed.join(hits, "_hash", "left_semi").join(wanted.select("id"), "id", "left_semi").select(*nodes.columns)


def scope_nodes(nodes: DataFrame, scope: DataFrame) -> DataFrame:
    """Nodes of the files listed in ``scope`` (repo_name, file_path)."""
    return nodes.join(scope.select(*FILE), list(FILE), "left_semi")


def incident_edges(edges: DataFrame, node_ids: DataFrame) -> DataFrame:
    """Edges with at least one end among ``node_ids`` (id), each once."""
    ids = node_ids.select(F.col("id").alias("_id"))
    ends = edges.select("id", F.explode(F.array("source_id", "target_id")).alias("_id"))
    touched = ends.join(ids, "_id", "left_semi").select("id").distinct()
    return edges.join(touched, "id", "left_semi")


def with_own(rows: DataFrame, end: str, nodes: DataFrame, value: Column, out: str) -> DataFrame:
    """Add ``out``: the ``value`` of every node of the row's own file whose id is its ``end``, as an array.

    Nodes and rows of a file meet in a sort, so nothing is moved where they lie together by file.
    """
    kept = [c for c in rows.columns if c not in FILE]
    there = F.when(F.col("_end").isNotNull(), F.struct(value.alias("value")))
    own = nodes.withColumnRenamed("id", "_end").select(*FILE, "_end", there.alias("_own"))
    parts = rows.select(*FILE, F.col(end).alias("_end"), F.struct(*kept).alias("_row")).unionByName(own, allowMissingColumns=True)
    layout = [*FILE, "_end"]
    # The hash leads the sort: most comparisons then end at one number.
    whole = Window.partitionBy(F.xxhash64(*layout), *layout)
    found = parts.withColumn(out, F.collect_list("_own").over(whole)).where("_row IS NOT NULL")
    return found.select(*FILE, "_row.*", F.transform(out, lambda n: n.value).alias(out))


def of_one_file(nodes: DataFrame) -> DataFrame:
    """Nodes without those whose id is found in several files."""
    shared = duplicate_groups(nodes.select(*FILE, "id").distinct(), ["id"], within=FILE)
    shared = materialize(shared.select("id"), "shared-ids")
    return nodes if shared.isEmpty() else nodes.join(shared, "id", "left_anti").select(*nodes.columns)


def delete_scope(
    nodes: DataFrame, edges: DataFrame, scope: DataFrame, dealt: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes and edges without the scope's nodes and their incident edges (DM-4).

    The third table is the nodes deleted; repository and file rows are not touched. Where the rows of a file lie together
    in all three tables (``dealt``), nothing is moved if every end of an edge is a node of the edge's own file alone.
    """
    if dealt:
        left, gone = _split_by_file(nodes, scope)
        if ends_at_home(nodes, edges):
            has_end = F.coalesce("_row.source_id", "_row.target_id").isNotNull()
            return left, _split_by_file(edges, scope, has_end)[0], gone
    else:
        gone = scope_nodes(nodes, scope)
        left = nodes.join(scope.select(*FILE), list(FILE), "left_anti")
    kept = edges
    for end in ("source_id", "target_id"):
        kept = kept.join(gone.select(F.col("id").alias(end)), end, "left_anti")
    return left, kept.select(*edges.columns), gone


def _split_by_file(rows: DataFrame, scope: DataFrame, counts: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows outside and inside the files of ``scope``, where the rows of a file lie together in both. Rows that ``counts`` does not hold for are outside."""
    rest = [c for c in rows.columns if c not in FILE]
    parts = rows.select(*FILE, F.struct(*rest).alias("_row")).unionByName(scope.select(*FILE), allowMissingColumns=True)
    inside = F.max(F.col("_row").isNull()).over(Window.partitionBy(F.xxhash64(*FILE), *FILE))
    known = F.col("repo_name").isNotNull() & F.col("file_path").isNotNull()
    known = known if counts is None else known & counts
    marked = parts.withColumn("_inside", inside & known).where("_row IS NOT NULL")
    outside, within = (marked.where(c).select(*FILE, "_row.*").select(*rows.columns) for c in ("NOT _inside", "_inside"))
    return outside, within


def ends_at_home(nodes: DataFrame, edges: DataFrame) -> bool:
    """Whether every end of an edge is a node of the edge's own file and of no other, by two 64-bit hashes of the ids.

    The rows of a file lie together in both tables; two numbers per node are moved.
    """
    if keys_across([nodes], ["id"], FILE) is not None:
        return False
    hashes = [F.xxhash64("id").alias("_one"), F.xxhash64("id", F.lit(1)).alias("_two")]
    ends = edges.select(*FILE, F.explode(F.array("source_id", "target_id")).alias("id"), F.lit(False).alias("_is"))
    parts = ends.unionByName(nodes.select(*FILE, "id", F.lit(True).alias("_is"))).where("id IS NOT NULL")
    found = parts.select(*FILE, *hashes, "_is").groupBy(*FILE, "_one", "_two").agg(F.max("_is").alias("_is"))
    return found.agg(F.count_if(~F.col("_is"))).first()[0] == 0


def replace_scope(
    nodes: DataFrame,
    edges: DataFrame,
    scope: DataFrame,
    new_nodes: DataFrame,
    new_edges: DataFrame,
    dealt: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Delete the scope, then merge its new rows (DM-5). ``dealt``: the rows of a file lie together in all five tables."""
    left, kept, _ = delete_scope(nodes, edges, scope, dealt)
    if not dealt:
        return replace_upsert(left, new_nodes, ["id"]), replace_upsert(kept, new_edges, ["id"])
    all_nodes, all_edges = ([df.select(*FILE, "id") for df in pair] for pair in ((nodes, new_nodes), (edges, new_edges)))
    return (
        replace_upsert(left, new_nodes, ["id"], within=FILE, among=all_nodes),
        replace_upsert(kept, new_edges, ["id"], within=FILE, among=all_edges),
    )


def current_generation(rows: DataFrame, metadata: DataFrame) -> DataFrame:
    """Rows that carry their file's latest hash (DM-6): a replace without a delete."""
    current = metadata.select(*FILE, "file_hash")
    return rows.join(current, [*FILE, "file_hash"], "left_semi")


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new hash of each new file and whether the content changed (ST-4)."""
    before = old.select(*FILE, F.col("file_hash").alias("old_hash"))
    after = new.select(*FILE, F.col("file_hash").alias("new_hash"))
    return after.join(before, list(FILE), "left").select(
        *FILE,
        "old_hash",
        "new_hash",
        (~F.col("old_hash").eqNullSafe(F.col("new_hash"))).alias("changed"),
    )


#: So many changed files are sent to the rows; more are joined by a shuffle.
SENT_FILES = 100_000


def file_digests(rows: DataFrame, key: str = "id") -> DataFrame:
    """A digest of the keys of each file that no order changes: their number, and sums over two 64-bit hashes by halves."""
    hashes = [F.xxhash64(F.col(key)), F.xxhash64(F.col(key), F.lit(1))]
    halves = [half for h in hashes for half in (F.shiftright(h, 32), h.bitwiseAND(F.lit((1 << 32) - 1)))]
    sums = [F.sum(half).alias(f"s{i}") for i, half in enumerate(halves)]
    return rows.groupBy(*FILE).agg(F.count("*").alias("n"), *sums)


def differing(old: DataFrame, new: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """The rows of both states that belong to files whose keys are not the same in both.

    Only digests are shuffled, one row per file. Rows of unchanged files go no further than their scan. Every row names its file.
    """
    sides = [file_digests(rows, key).select(*FILE, F.struct("n", "s0", "s1", "s2", "s3").alias("digest")) for rows in (old, new)]
    both = sides[0].unionByName(sides[1]).groupBy(*FILE)
    both = both.agg(F.count("*").alias("sides"), F.min("digest").alias("least"), F.max("digest").alias("most"))
    changed = materialize(both.where("sides = 1 OR least <> most").select(*FILE), "changed-files")
    if changed.limit(SENT_FILES + 1).count() <= SENT_FILES:
        changed = F.broadcast(changed)
    return tuple(rows.join(changed, list(FILE), "left_semi").select(*rows.columns) for rows in (old, new))


def stale_rows(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of the old state whose identity the new state no longer has (ST-5), out of the files that differ.

    An identity belongs to one file for ever.
    """
    old, new = differing(old, new, key)
    return old.join(new.select(key), key, "left_anti").select(*old.columns)
