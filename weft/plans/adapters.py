"""Graph and event tables derived from the generic sample tables.

They give every operator whole-table input whose result a plain SQL engine can state too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.identity import edge_id, metadata_id, node_id
from weft.functions.text import iso_utc
from weft.operators.edges import FILE, sequence_edges
from weft.operators.sequence import BLOCK_ROWS, PARTITION_ROWS
from weft.schemas import EDGES_TOPIC, ERRORS_TOPIC, METADATA, METADATA_TOPIC, NODES_TOPIC
from weft.sources.eventlog import event_json


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of text in a partition of :func:`dealt`. The rows made of a text are some twenty to fifty times as large, and a task sorts them.
PARTITION_BYTES = 1 << 19


def dealt(files: DataFrame, text: str, by_range: bool = False) -> DataFrame:
    """Deal out files before rows are made of them, so that each text is moved once and none of its rows.

    The number of partitions follows the size of the texts. Rows made of them still lie together by
    (repo_name, file_path); ``by_range`` puts the files in order.
    """
    size = files.agg(F.sum(F.octet_length(text))).first()[0] or 0
    partitions = max(files.sparkSession.sparkContext.defaultParallelism, size // PARTITION_BYTES + 1)
    return files.repartitionByRange(partitions, *FILE) if by_range else files.repartition(partitions, *FILE)


def token_nodes(spark: SparkSession, sf_dir: str, by_range: bool = False) -> DataFrame:
    """A node table out of ``documents``: a module per text, its lines, their tokens (T1).

    Rows are :func:`dealt` out by file.
    """
    files = table(spark, sf_dir, "documents").select(
        F.col("source").alias("repo_name"), F.concat(F.lit("doc/"), F.col("doc_id")).alias("file_path"), "text"
    )
    # A null in front of the lines stands for the module, so that one generator gives all rows of a text.
    lines = F.concat(F.array(F.lit(None).cast("string")), F.coalesce(F.split("text", "\n"), F.array().cast("array<string>")))
    texts = dealt(files, "text", by_range).select(*FILE, F.sha2("text", 256).alias("file_hash"), lines.alias("lines"))
    keep = ("repo_name", "file_path", "file_hash")
    lines = texts.select(*keep, F.posexplode("lines").alias("lineno", "line"))
    # One generator per line: the line itself (position -1) and its non-empty tokens.
    parts = F.concat(F.array(F.col("line")), F.coalesce(F.split("line", " "), F.array().cast("array<string>")))
    exploded = lines.select(*keep, "lineno", F.posexplode(parts).alias("slot", "tok"))
    module, token = F.col("lineno") == 0, F.col("slot") > 0
    at = F.col("slot") - 1
    line_path = F.concat(F.lit("module.body["), F.col("lineno"), F.lit("]"))
    kind = (
        F.when(module, "Module")
        .when(~token, "Expr")
        .when(F.col("tok").endswith("."), "Call")
        .when((at == 0) & F.col("tok").rlike("^[A-Z]"), "FunctionDef")
        .when(F.col("tok").rlike("^[A-Z]"), "ClassDef")
        .when(F.col("tok").rlike("[0-9]"), "Import")
        .otherwise("Name")
    )
    bare = F.nullif(F.lower(F.regexp_replace("tok", "[.,]+$", "")), F.lit(""))
    rows = exploded.where((~token) | (F.col("tok") != "")).select(
        *keep,
        kind.alias("node_type"),
        F.when(token, bare).alias("name"),
        F.when(token & (kind == "Name"), F.when(F.col("tok").endswith(","), "Store").otherwise("Load"))
        .alias("ctx"),
        F.when(module, "module")
        .when(token, F.concat(line_path, F.lit(".tok["), at, F.lit("]")))
        .otherwise(line_path)
        .alias("structural_path"),
        "lineno",
        F.when(token, at).otherwise(0).alias("col_offset"),
        F.col("lineno").alias("end_lineno"),
        F.when(token, at + F.length("tok")).otherwise(0).alias("end_col_offset"),
    )
    return rows.withColumn("node_id", node_id())


# The node table of token_nodes in SQL; queries put it into their WITH list.
TOKEN_NODES_SQL = """
texts AS (
  SELECT source AS repo_name, 'doc/' || doc_id AS file_path, sha256(text) AS file_hash,
         string_split(text, chr(10)) AS lines
  FROM documents),
lines AS (
  SELECT repo_name, file_path, file_hash, unnest(lines) AS line,
         unnest(range(1, len(lines) + 1))::INT AS lineno
  FROM texts),
toks AS (
  SELECT repo_name, file_path, file_hash, lineno, unnest(string_split(line, ' ')) AS tok,
         unnest(range(0, len(string_split(line, ' '))))::INT AS slot
  FROM lines),
raw_nodes AS (
  SELECT repo_name, file_path, file_hash,
         CASE WHEN tok LIKE '%.' THEN 'Call'
              WHEN slot = 0 AND regexp_matches(tok, '^[A-Z]') THEN 'FunctionDef'
              WHEN regexp_matches(tok, '^[A-Z]') THEN 'ClassDef'
              WHEN regexp_matches(tok, '[0-9]') THEN 'Import'
              ELSE 'Name' END AS node_type,
         nullif(lower(regexp_replace(tok, '[.,]+$', '')), '') AS name,
         tok,
         'module.body[' || lineno || '].tok[' || slot || ']' AS structural_path,
         lineno, slot AS col_offset, lineno AS end_lineno,
         (slot + length(tok))::INT AS end_col_offset
  FROM toks WHERE tok <> ''
  UNION ALL
  SELECT repo_name, file_path, file_hash, 'Expr', NULL, NULL, 'module.body[' || lineno || ']',
         lineno, 0, lineno, 0
  FROM lines
  UNION ALL
  SELECT repo_name, file_path, file_hash, 'Module', NULL, NULL, 'module', 0, 0, 0, 0 FROM texts),
nodes AS MATERIALIZED (
  SELECT repo_name, file_path, file_hash, node_type, name,
         CASE WHEN node_type = 'Name' THEN CASE WHEN tok LIKE '%,' THEN 'Store' ELSE 'Load' END END
           AS ctx,
         structural_path, lineno, col_offset, end_lineno, end_col_offset,
         sha256('{"col_offset":' || col_offset || ',"end_col_offset":' || end_col_offset
           || ',"end_lineno":' || end_lineno || ',"file_path":' || to_json(file_path)
           || ',"lineno":' || lineno || ',"name":' || to_json(coalesce(name, ''))
           || ',"node_type":"' || node_type || '","repo_name":' || to_json(repo_name)
           || ',"structural_path":"' || structural_path || '"}') AS node_id
  FROM raw_nodes)
"""


def metadata_log(events: DataFrame) -> DataFrame:
    """A Kafka-shaped metadata topic out of ``events`` rows, batch or stream (T2).

    Purchases and signups are complete, views lack the id (older producers), clicks lack the
    repository and errors carry broken JSON. Users are files, so keys repeat all the time.
    """
    kind = F.col("event_type")
    complete = events.select(
        "*",
        F.lit("1.0").alias("schema_version"),
        iso_utc(F.col("ts")).alias("event_time"),
        F.when(kind != "click", "users").alias("repo_name"),
        F.concat(F.lit("u/"), F.col("user_id")).alias("file_path"),
        F.sha2("props", 256).alias("file_hash"),
        F.floor("value").cast("int").alias("line_count"),
        *[F.lit(0).alias(c) for c in ("function_count", "class_count", "import_count")],
        F.col("event_id").cast("int").alias("node_count"),
        F.length("props").alias("edge_count"),
        F.lit("parsed").alias("status"),
    ).withColumn("metadata_id", F.when(kind != "view", F.sha2(F.concat(F.lit("users\x1f"), "file_path"), 256)))
    value = F.when(kind == "error", F.lit('{"schema_version":"1.0","repo')).otherwise(
        event_json(*METADATA.fieldNames())
    )
    return complete.select(
        F.coalesce("metadata_id", "file_path").cast("binary").alias("key"),
        value.cast("binary").alias("value"),
        F.lit(METADATA_TOPIC).alias("topic"),
        F.pmod("user_id", F.lit(3)).cast("int").alias("partition"),
        F.col("event_id").alias("offset"),
        F.col("ts").cast("timestamp").alias("timestamp"),
    )


# What metadata_log holds, in SQL: every record with its offset and its kind.
METADATA_LOG_SQL = """
records AS (
  SELECT event_id, event_type, user_id % 3 AS part, '1.0' AS schema_version,
         CASE WHEN date_part('microsecond', ts) % 1000000 = 0
              THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ')
              ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') END AS event_time,
         CASE WHEN event_type <> 'click' THEN 'users' END AS repo_name,
         'u/' || user_id AS file_path,
         CASE WHEN event_type <> 'view' THEN sha256('users' || chr(31) || 'u/' || user_id) END
           AS metadata_id,
         sha256(props) AS file_hash, floor(value)::INT AS line_count, 0 AS function_count,
         0 AS class_count, 0 AS import_count, event_id::INT AS node_count,
         length(props)::INT AS edge_count, 'parsed' AS status
  FROM events),
usable AS (
  SELECT * REPLACE (coalesce(metadata_id, sha256(repo_name || chr(31) || file_path)) AS metadata_id)
  FROM records WHERE event_type NOT IN ('click', 'error')),
documents_now AS (
  SELECT * FROM usable QUALIFY row_number() OVER (PARTITION BY metadata_id ORDER BY event_id DESC) = 1)
"""


def topic_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of all four kinds in one table with a ``topic`` column (T2)."""
    kind = F.col("event_type")

    def only(when: str, value: Column) -> Column:
        return F.when(F.expr(when), value)

    rows = table(spark, sf_dir, "events").select(
        F.when(kind == "view", NODES_TOPIC)
        .when(kind == "click", EDGES_TOPIC)
        .when(kind == "error", ERRORS_TOPIC)
        .otherwise(METADATA_TOPIC)
        .alias("topic"),
        F.pmod("user_id", F.lit(3)).cast("int").alias("partition"),
        F.col("event_id").alias("offset"),
        F.lit("1.0").alias("schema_version"),
        iso_utc(F.col("ts")).alias("event_time"),
        F.lit("users").alias("repo_name"),
        F.concat(F.lit("u/"), F.col("user_id")).alias("file_path"),
        only("event_type = 'view'", F.sha2(F.concat(F.lit("n"), "event_id"), 256)).alias("node_id"),
        only("event_type = 'view'", F.lit("View")).alias("node_type"),
        only("event_type = 'click'", F.sha2(F.concat(F.lit("e"), "event_id"), 256)).alias("edge_id"),
        only("event_type = 'click'", F.lit("CALL")).alias("edge_type"),
        only("event_type IN ('signup', 'purchase')", metadata_id(F.lit("users"), F.concat(F.lit("u/"), "user_id"))).alias("metadata_id"),
        only("event_type = 'error'", F.lit("ValueError")).alias("error_type"),
        only("event_type = 'error'", F.col("props")).alias("error_message"),
        only("event_type = 'error'", F.lit("failed"))
        .when(kind == "signup", F.lit("parsed"))
        .alias("status"),
    )
    return rows


TOPIC_EVENTS_SQL = """
topic_events AS (
  SELECT CASE event_type WHEN 'view' THEN 'cpg.nodes.v1' WHEN 'click' THEN 'cpg.edges.v1'
              WHEN 'error' THEN 'cpg.errors.v1' ELSE 'cpg.metadata.v1' END AS topic,
         (user_id % 3)::INT AS part, event_id, '1.0' AS schema_version,
         CASE WHEN date_part('microsecond', ts) % 1000000 = 0
              THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ')
              ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') END AS event_time,
         'users' AS repo_name, 'u/' || user_id AS file_path, event_type, props,
         CASE event_type WHEN 'view' THEN sha256('n' || event_id)
              WHEN 'click' THEN sha256('e' || event_id) WHEN 'error' THEN 'ValueError'
              ELSE sha256('users' || chr(31) || 'u/' || user_id) END AS identity,
         CASE event_type WHEN 'view' THEN 'View' WHEN 'click' THEN 'CALL' WHEN 'error' THEN 'failed'
              WHEN 'signup' THEN 'parsed' END AS kind,
         CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'parsed' END AS status
  FROM events)
"""


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs as absolute paths below the root ``/pages`` (T3)."""
    path = F.concat(F.lit("/pages/"), F.regexp_replace("url", "^https?://", ""))
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path"))


PAGE_PATHS_SQL = """
paths AS (
  SELECT page_id, '/pages/' || regexp_replace(url, '^https?://', '') AS path FROM pages)
"""


def document_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repository paths out of documents: the language names a folder, the source a file (T3)."""
    folders = {"en": "tests", "fr": "latest_release", "de": "docs"}
    folder = F.create_map(*[F.lit(x) for kv in folders.items() for x in kv])[F.col("lang")]
    name = (
        F.when(F.col("source") == "src1", "setup.py")
        .when(F.col("source") == "src2", F.concat(F.lit("test_"), "doc_id", F.lit(".py")))
        .when(F.col("source") == "src3", "contest.py")
        .otherwise(F.concat("doc_id", F.lit(".py")))
    )
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("repo_name"),
        F.concat(F.lit("pkg/"), F.coalesce(folder, F.lit("src")), F.lit("/"), name).alias("file_path"),
        "doc_id",
    )


DOCUMENT_PATHS_SQL = """
doc_paths AS (
  SELECT source AS repo_name, doc_id, 'pkg/'
         || CASE lang WHEN 'en' THEN 'tests' WHEN 'fr' THEN 'latest_release' WHEN 'de' THEN 'docs'
                 ELSE 'src' END || '/'
         || CASE source WHEN 'src1' THEN 'setup.py' WHEN 'src2' THEN 'test_' || doc_id || '.py'
                 WHEN 'src3' THEN 'contest.py' ELSE doc_id || '.py' END AS file_path,
         lang, source
  FROM documents)
"""


def order_graph(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame | bool]:
    """A graph of orders per customer, and a replay of some customers (T4).

    A customer is a file, an order a node, consecutive orders of a customer an edge. The replay
    covers the customers of one market segment and no longer has their finished orders. ``dealt`` tells that the rows
    of a file lie together in all tables, which they do unless a file is too large for one task.
    """
    file = F.concat(F.lit("cust/"), F.col("o_custkey"))
    orders = table(spark, sf_dir, "orders").select(file.alias("file_path"), "o_orderkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    scope = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(
        F.lit("orders").alias("repo_name"), F.concat(F.lit("cust/"), F.col("c_custkey")).alias("file_path")
    )
    partitions = max(spark.sparkContext.defaultParallelism, orders.count() // PARTITION_ROWS + 1)
    # Files are dealt out before ids and hashes are made: those are most of a row.
    by_file = orders.repartition(partitions, "file_path")
    ids = by_file.groupBy("file_path", "o_orderkey").agg(F.count("*").alias("rows"))
    files = ids.groupBy("file_path").agg(F.sum("rows").alias("rows"), F.max("rows").alias("of_one_id"))
    largest, of_one_id = files.agg(F.max("rows"), F.max("of_one_id")).first()
    is_dealt = (largest or 0) <= BLOCK_ROWS
    if is_dealt:
        orders, scope = by_file, scope.repartition(partitions, "file_path")
    replayed = orders.join(scope.select("file_path"), "file_path", "left_semi")

    def nodes(rows: DataFrame, version: str) -> DataFrame:
        return rows.select(
            F.sha2(F.col("o_orderkey").cast("string"), 256).alias("id"),
            F.lit("orders").alias("repo_name"),
            "file_path",
            F.sha2(F.concat("file_path", F.lit(version)), 256).alias("file_hash"),
            F.col("o_orderpriority").alias("type"),
            F.col("o_orderdate").alias("day"),
        )

    def edges(rows: DataFrame) -> DataFrame:
        # The hash depends on the file, so it comes along as a part of the scope.
        linked = sequence_edges(rows, scope=(*FILE, "file_hash"), order=("day", "id"), id_col="id", dealt=is_dealt)
        linked = linked.where("file_path IS NOT NULL AND source_id IS NOT NULL")
        if (of_one_id or 0) > 1:
            # An edge counts once for every row of its source.
            again = rows.groupBy(*FILE, F.col("id").alias("source_id")).agg(F.count("*").cast("int").alias("_rows"))
            linked = linked.join(again, [*FILE, "source_id"]).withColumn("_row", F.explode(F.array_repeat(F.lit(0), F.col("_rows"))))
        return linked.select(
            edge_id().alias("id"),
            "source_id",
            "target_id",
            F.col("edge_type").alias("type"),
            "repo_name",
            "file_path",
            "file_hash",
        )

    old, new = nodes(orders, "v1"), nodes(replayed.where("o_orderstatus <> 'F'"), "v2")
    return {
        "nodes": old.drop("day"),
        "edges": edges(old),
        "new_nodes": new.drop("day"),
        "new_edges": edges(new),
        "scope": scope,
        "dealt": is_dealt,
    }


ORDER_GRAPH_SQL = """
old_rows AS (
  SELECT sha256(o_orderkey::VARCHAR) AS id, 'orders' AS repo_name,
         'cust/' || o_custkey AS file_path, sha256('cust/' || o_custkey || 'v1') AS file_hash,
         o_orderpriority AS type, o_orderdate AS day, o_custkey, o_orderstatus
  FROM orders),
scope AS (
  SELECT c_custkey, 'orders' AS repo_name, 'cust/' || c_custkey AS file_path
  FROM customer WHERE c_mktsegment = 'BUILDING'),
new_rows AS (
  SELECT * REPLACE (sha256(file_path || 'v2') AS file_hash) FROM old_rows
  WHERE o_orderstatus <> 'F' AND o_custkey IN (SELECT c_custkey FROM scope)),
old_nodes AS (SELECT id, repo_name, file_path, file_hash, type FROM old_rows),
new_nodes AS (SELECT id, repo_name, file_path, file_hash, type FROM new_rows),
old_links AS (
  SELECT *, lead(id) OVER (PARTITION BY file_path ORDER BY day, id) AS target_id FROM old_rows),
new_links AS (
  SELECT *, lead(id) OVER (PARTITION BY file_path ORDER BY day, id) AS target_id FROM new_rows),
old_edges AS (
  SELECT sha256(concat_ws(chr(31), repo_name, file_path, 'CFG', id, target_id)) AS id,
         id AS source_id, target_id, 'CFG' AS type, repo_name, file_path, file_hash
  FROM old_links WHERE target_id IS NOT NULL),
new_edges AS (
  SELECT sha256(concat_ws(chr(31), repo_name, file_path, 'CFG', id, target_id)) AS id,
         id AS source_id, target_id, 'CFG' AS type, repo_name, file_path, file_hash
  FROM new_links WHERE target_id IS NOT NULL),
gone AS (SELECT id FROM old_nodes WHERE file_path IN (SELECT file_path FROM scope)),
kept_nodes AS (SELECT * FROM old_nodes WHERE id NOT IN (SELECT id FROM gone)),
kept_edges AS (
  SELECT * FROM old_edges WHERE source_id NOT IN (SELECT id FROM gone)
    AND target_id NOT IN (SELECT id FROM gone)),
merged_nodes AS (
  SELECT * FROM old_nodes WHERE id NOT IN (SELECT id FROM new_nodes)
  UNION ALL SELECT * FROM new_nodes),
merged_edges AS (
  SELECT * FROM old_edges WHERE id NOT IN (SELECT id FROM new_edges)
  UNION ALL SELECT * FROM new_edges),
replaced_nodes AS (SELECT * FROM kept_nodes UNION ALL SELECT * FROM new_nodes),
replaced_edges AS (SELECT * FROM kept_edges UNION ALL SELECT * FROM new_edges)
"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as ordered records (T5); long conversations are cut every 1024 turns."""
    return table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("conv/"), F.col("conv_id")).alias("file_path"),
        F.lit("chat").alias("repo_name"),
        F.col("turn"),
        F.col("role"),
        F.concat_ws("/", F.col("conv_id"), F.col("turn")).alias("id"),
    )


TURNS_SQL = """
turns AS (
  SELECT 'conv/' || conv_id AS file_path, 'chat' AS repo_name, turn, role,
         conv_id || '/' || turn AS id
  FROM conversations)
"""


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run logs out of documents: one log per source, a coloured line per document (T6)."""
    esc = F.lit("\x1b[32m")
    message = (
        F.when(
            F.col("lang") == "en",
            F.format_string(
                "Parsed   doc/%d.py: nodes=%d edges=%d  metadata=1", "doc_id", "n_chars", F.col("n_chars") * 2
            ),
        )
        .when(F.col("lang") == "fr", F.format_string("Duplicate node IDs: %d", "n_chars"))
        .when(F.col("lang") == "de", F.format_string("size_%d = a=%d", F.col("doc_id") % 10, "n_chars"))
        .otherwise(F.format_string("Failed to parse doc/%d.py", "doc_id"))
    )
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("log"),
        F.col("doc_id").alias("line_no"),
        F.concat(esc, message, F.lit("\x1b[0m")).alias("line"),
    )


LOG_LINES_SQL = """
raw_log AS (
  SELECT source AS log, doc_id AS line_no, lang, n_chars, doc_id,
         chr(27) || '[32m' || CASE lang
           WHEN 'en' THEN 'Parsed   doc/' || doc_id || '.py: nodes=' || n_chars || ' edges='
                          || n_chars * 2 || '  metadata=1'
           WHEN 'fr' THEN 'Duplicate node IDs: ' || n_chars
           WHEN 'de' THEN 'size_' || doc_id % 10 || ' = a=' || n_chars
           ELSE 'Failed to parse doc/' || doc_id || '.py' END || chr(27) || '[0m' AS line
  FROM documents)
"""


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Python sources out of documents: every line of text becomes one statement (T7).

    Words become identifiers. A line of text with ``%%%`` becomes a syntax error.
    """
    files = table(spark, sf_dir, "documents").select(
        F.col("source").alias("repo_name"), F.concat(F.lit("doc/"), F.col("doc_id"), F.lit(".py")).alias("file_path"), "text"
    )
    texts = dealt(files, "text")

    def statement(line: Column) -> Column:
        words = F.filter(F.split(line, " "), lambda w: w != "")
        first, last = (
            F.concat(F.lit("v"), F.regexp_replace(F.get(words, at), "[^A-Za-z0-9]", ""))
            for at in (F.lit(0), F.size(words) - 1)
        )
        return (
            F.when(F.contains(line, F.lit("%%%")), "v v")
            .when(F.size(words) == 0, "pass")
            .when(line.endswith("."), F.concat(last, F.lit("("), first, F.lit(")")))
            .when(line.rlike("^[A-Z]"), F.concat(F.lit("def "), last, F.lit("("), first, F.lit("): pass")))
            .otherwise(F.concat(first, F.lit(" = "), last))
        )

    source = F.concat(F.array_join(F.transform(F.split("text", "\n"), statement), "\n"), F.lit("\n"))
    return texts.select(*FILE, F.encode(source, "UTF-8").alias("content"))


# The sources of code_files and their node rows, in SQL.
CODE_NODES_SQL = """
code_texts AS (
  SELECT source AS repo_name, 'doc/' || doc_id || '.py' AS file_path, doc_id,
         string_split(text, chr(10)) AS lines, contains(text, '%%%') AS broken
  FROM documents),
code_lines AS (
  SELECT repo_name, file_path, broken, doc_id, unnest(lines) AS line,
         unnest(range(1, len(lines) + 1))::INT AS l
  FROM code_texts),
code_words AS (
  SELECT *, list_filter(string_split(line, ' '), lambda w : w <> '') AS words FROM code_lines),
statements AS MATERIALIZED (
  SELECT repo_name, file_path, broken, doc_id, l,
         'v' || regexp_replace(words[1], '[^A-Za-z0-9]', '', 'g') AS a,
         'v' || regexp_replace(words[-1], '[^A-Za-z0-9]', '', 'g') AS b,
         CASE WHEN contains(line, '%%%') THEN 'bad' WHEN len(words) = 0 THEN 'pass'
              WHEN line LIKE '%.' THEN 'call' WHEN regexp_matches(line, '^[A-Z]') THEN 'def'
              ELSE 'assign' END AS form
  FROM code_words),
code_sources AS MATERIALIZED (
  SELECT repo_name, file_path, broken, count(*)::INT AS line_count,
         min(CASE WHEN form = 'bad' THEN l END) AS bad_line,
         sha256(string_agg(CASE form WHEN 'bad' THEN 'v v' WHEN 'pass' THEN 'pass'
           WHEN 'call' THEN b || '(' || a || ')' WHEN 'def' THEN 'def ' || b || '(' || a || '): pass'
           ELSE a || ' = ' || b END || chr(10), '' ORDER BY l)) AS file_hash
  FROM statements GROUP BY ALL),
shapes AS MATERIALIZED (
  SELECT *, 'module.body[' || (l - 1) || ']' AS p, length(a)::INT AS na, length(b)::INT AS nb
  FROM statements WHERE NOT broken),
code_raw AS (
  SELECT repo_name, file_path, 'Module' AS node_type, NULL AS name, NULL AS ctx,
         'module' AS structural_path, NULL AS parent, 0 AS lineno, 0 AS col_offset, 0 AS end_lineno,
         0 AS end_col_offset FROM code_sources WHERE NOT broken
  UNION ALL SELECT repo_name, file_path, 'Pass', NULL, NULL, p, 'module', l, 0, l, 4
    FROM shapes WHERE form = 'pass'
  UNION ALL SELECT repo_name, file_path, 'Expr', NULL, NULL, p, 'module', l, 0, l, na + nb + 2
    FROM shapes WHERE form = 'call'
  UNION ALL SELECT repo_name, file_path, 'Call', b, NULL, p || '.value', p, l, 0, l, na + nb + 2
    FROM shapes WHERE form = 'call'
  UNION ALL SELECT repo_name, file_path, 'Name', b, 'Load', p || '.value.func', p || '.value',
    l, 0, l, nb FROM shapes WHERE form = 'call'
  UNION ALL SELECT repo_name, file_path, 'Load', NULL, NULL, p || '.value.func.ctx',
    p || '.value.func', 0, 0, 0, 0 FROM shapes WHERE form = 'call'
  UNION ALL SELECT repo_name, file_path, 'Name', a, 'Load', p || '.value.args[0]', p || '.value',
    l, nb + 1, l, nb + 1 + na FROM shapes WHERE form = 'call'
  UNION ALL SELECT repo_name, file_path, 'Load', NULL, NULL, p || '.value.args[0].ctx',
    p || '.value.args[0]', 0, 0, 0, 0 FROM shapes WHERE form = 'call'
  UNION ALL SELECT repo_name, file_path, 'FunctionDef', b, NULL, p, 'module', l, 0, l, na + nb + 12
    FROM shapes WHERE form = 'def'
  UNION ALL SELECT repo_name, file_path, 'arguments', NULL, NULL, p || '.args', p, 0, 0, 0, 0
    FROM shapes WHERE form = 'def'
  UNION ALL SELECT repo_name, file_path, 'arg', a, NULL, p || '.args.args[0]', p || '.args',
    l, nb + 5, l, nb + 5 + na FROM shapes WHERE form = 'def'
  UNION ALL SELECT repo_name, file_path, 'Pass', NULL, NULL, p || '.body[0]', p,
    l, na + nb + 8, l, na + nb + 12 FROM shapes WHERE form = 'def'
  UNION ALL SELECT repo_name, file_path, 'Assign', NULL, NULL, p, 'module', l, 0, l, na + nb + 3
    FROM shapes WHERE form = 'assign'
  UNION ALL SELECT repo_name, file_path, 'Name', a, 'Store', p || '.targets[0]', p, l, 0, l, na
    FROM shapes WHERE form = 'assign'
  UNION ALL SELECT repo_name, file_path, 'Store', NULL, NULL, p || '.targets[0].ctx',
    p || '.targets[0]', 0, 0, 0, 0 FROM shapes WHERE form = 'assign'
  UNION ALL SELECT repo_name, file_path, 'Name', b, 'Load', p || '.value', p,
    l, na + 3, l, na + nb + 3 FROM shapes WHERE form = 'assign'
  UNION ALL SELECT repo_name, file_path, 'Load', NULL, NULL, p || '.value.ctx', p || '.value',
    0, 0, 0, 0 FROM shapes WHERE form = 'assign'),
code_nodes AS MATERIALIZED (
  SELECT r.*, s.file_hash,
         sha256('{"col_offset":' || col_offset || ',"end_col_offset":' || end_col_offset
           || ',"end_lineno":' || end_lineno || ',"file_path":"' || r.file_path || '","lineno":'
           || lineno || ',"name":"' || coalesce(name, '') || '","node_type":"' || node_type
           || '","repo_name":"' || r.repo_name || '","structural_path":"' || structural_path
           || '"}') AS node_id
  FROM code_raw r JOIN code_sources s ON r.repo_name = s.repo_name AND r.file_path = s.file_path)
"""
