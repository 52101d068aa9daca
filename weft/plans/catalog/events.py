"""Projections, predicates and scalar functions over paths and event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions import identity as I
from weft.functions import text as X
from weft.operators import contract as C
from weft.operators import rollup as R
from weft.operators.merge import latest_per_key
from weft.plans import reports as V
from weft.plans.adapters import (
    DOCUMENT_PATHS_SQL,
    METADATA_LOG_SQL,
    PAGE_PATHS_SQL,
    TOPIC_EVENTS_SQL,
    document_paths,
    metadata_log,
    page_paths,
    table,
    topic_events,
)
from weft.plans.catalog import query
from weft.schemas import CONTRACTS, EDGES_TOPIC, ERRORS_TOPIC, METADATA, METADATA_TOPIC, NODES_TOPIC
from weft.sources.eventlog import event_json, route, sample_events, to_records
from weft.sources.files import manifest
from weft.jobs.stream_jobs import LOG_ORDER, metadata_events

_LOG = f"WITH {METADATA_LOG_SQL}"
_FIELDS = ", ".join(METADATA.fieldNames())
_EXCLUDED = """
  len(list_filter(string_split(file_path, '/')[1:-2], lambda d :
        d IN ('tests', 'test', 'test_utils', 'examples', 'docs', '__pycache__', '.venv'))) > 0
  OR string_split(file_path, '/')[-1] = 'setup.py'
  OR (starts_with(string_split(file_path, '/')[-1], 'test_') AND file_path LIKE '%.py')"""


def _log(spark, sf_dir):
    return metadata_log(table(spark, sf_dir, "events"))


def _documents_now(spark, sf_dir):
    """Metadata documents after all events: the latest per id."""
    return latest_per_key(metadata_events(_log(spark, sf_dir)), ["metadata_id"], LOG_ORDER)


@query(
    "src2_manifest",
    f"""WITH {DOCUMENT_PATHS_SQL}
    SELECT repo_name AS repo_path, count(*) OVER (PARTITION BY repo_name) AS total_files,
           file_path AS file FROM doc_paths WHERE NOT ({_EXCLUDED})""",
)
def src2(spark, sf_dir):
    paths = document_paths(spark, sf_dir)
    return manifest(paths.where(~X.is_excluded_path(F.col("file_path"))), F.col("repo_name"))


@query("prj1_path_exclusion", f"WITH {DOCUMENT_PATHS_SQL} SELECT doc_id, file_path, {_EXCLUDED} AS excluded FROM doc_paths")
def prj1(spark, sf_dir):
    excluded = X.is_excluded_path(F.col("file_path")).alias("excluded")
    return document_paths(spark, sf_dir).select("doc_id", "file_path", excluded)


@query("prj1_own_rules", f"WITH {PAGE_PATHS_SQL} SELECT page_id FROM paths WHERE NOT list_contains(string_split(path, '/')[1:-2], 'fr')")
def prj1_rules(spark, sf_dir):
    """Exclusion rules are parameters: pages outside any ``fr`` folder."""
    pages = page_paths(spark, sf_dir)
    return pages.where(~X.is_excluded_path(F.col("path"), ["fr"], [])).select("page_id")


@query("prj3_relative_path", f"WITH {PAGE_PATHS_SQL} SELECT page_id, path[8:] AS relative FROM paths")
def prj3(spark, sf_dir):
    return page_paths(spark, sf_dir).select("page_id", X.relative_path(F.col("path"), "/pages").alias("relative"))


@query(
    "prj4_display_path",
    f"""WITH {PAGE_PATHS_SQL}, given AS (
      SELECT page_id, CASE WHEN starts_with(path, '/pages/m.') THEN path[7:] ELSE path END AS path FROM paths)
    SELECT page_id, CASE WHEN starts_with(path, '/pages/') THEN path[8:] ELSE path END AS shown FROM given""",
)
def prj4(spark, sf_dir):
    """Mobile hosts lie outside of the root and keep their path."""
    path = F.when(F.startswith("path", F.lit("/pages/m.")), F.substr("path", F.lit(7))).otherwise(F.col("path"))
    return page_paths(spark, sf_dir).select("page_id", X.display_path(path, "/pages").alias("shown"))


@query(
    "prj5_typed_events",
    f"""{_LOG} SELECT event_id AS "offset", part::INT AS partition,
    {", ".join(f"CASE WHEN event_type <> 'error' THEN {c}::VARCHAR END AS {c}" for c in METADATA.fieldNames())}
    FROM records""",
)
def prj5(spark, sf_dir):
    """As text, since all fields of broken records are null."""
    typed = C.decode(_log(spark, sf_dir), METADATA, LOG_ORDER)
    return typed.select(*LOG_ORDER, *[F.col(c).cast("string").alias(c) for c in METADATA.fieldNames()])


@query("prj6_required_key", f'{_LOG} SELECT event_id AS "offset" FROM usable')
def prj6(spark, sf_dir):
    return C.with_required_key(C.decode(_log(spark, sf_dir), METADATA, LOG_ORDER)).select("offset")


@query("prj7_backfilled_ids", f'{_LOG} SELECT event_id AS "offset", metadata_id FROM usable')
def prj7(spark, sf_dir):
    return metadata_events(_log(spark, sf_dir)).select("offset", "metadata_id")


@query(
    "prj11_contract_validation",
    f"""{_LOG} SELECT event_id AS "offset", CASE event_type WHEN 'error' THEN 'malformed json'
      WHEN 'click' THEN 'missing repo_name' WHEN 'view' THEN 'missing metadata_id' END AS reject_reason
    FROM records""",
)
def prj11(spark, sf_dir):
    return C.validate(_log(spark, sf_dir), METADATA_TOPIC).select("offset", "reject_reason")


@query("prj12_valid_events", f'{_LOG} SELECT event_id AS "offset", {_FIELDS} FROM records WHERE event_type IN (\'signup\', \'purchase\')')
def prj12(spark, sf_dir):
    valid, _ = C.split_valid(C.validate(_log(spark, sf_dir), METADATA_TOPIC))
    return valid.select("offset", *METADATA.fieldNames())


@query(
    "snk7_rejected_records",
    f"""{_LOG} SELECT CASE event_type WHEN 'error' THEN 'malformed json'
      WHEN 'click' THEN 'missing repo_name' ELSE 'missing metadata_id' END AS reject_reason,
      count(*) AS records FROM records WHERE event_type IN ('error', 'click', 'view') GROUP BY 1""",
)
def snk7(spark, sf_dir):
    _, rejected = C.split_valid(C.validate(_log(spark, sf_dir), METADATA_TOPIC))
    return rejected.groupBy("reject_reason").agg(F.count("*").alias("records"))


@query("wn4_latest_per_key", f"{_LOG} SELECT {_FIELDS} FROM documents_now")
def wn4(spark, sf_dir):
    return _documents_now(spark, sf_dir).select(*METADATA.fieldNames())


@query("prj13_metadata_lookup", f"{_LOG} SELECT {_FIELDS} FROM documents_now WHERE repo_name = 'users' AND file_path = 'u/7'")
def prj13(spark, sf_dir):
    return C.find_metadata(_documents_now(spark, sf_dir), "users", "u/7").select(*METADATA.fieldNames())


@query("prj14_display_fields", f"{_LOG} SELECT metadata_id, file_path, file_hash, event_time, node_count, edge_count FROM documents_now")
def prj14(spark, sf_dir):
    return C.display(_documents_now(spark, sf_dir))


@query(
    "prj14_focus_fields",
    f"{_LOG} SELECT {', '.join(C.FOCUS_FIELDS)} FROM documents_now",
)
def prj14_focus(spark, sf_dir):
    return C.display(_documents_now(spark, sf_dir), C.FOCUS_FIELDS)


@query(
    "prj15_defaults",
    f"""WITH {TOPIC_EVENTS_SQL} SELECT event_id AS "offset", coalesce(kind, '') AS name,
    coalesce(status, 'parsed') AS status FROM topic_events""",
)
def prj15(spark, sf_dir):
    rows = topic_events(spark, sf_dir).withColumn("name", C.name_of("node_type", "edge_type", "status"))
    return C.with_default_status(rows, METADATA_TOPIC).select("offset", "name", "status")


@query(
    "prj16_event_summary",
    f"""WITH {TOPIC_EVENTS_SQL} SELECT topic, schema_version, repo_name, file_path, identity,
    kind AS event_type, coalesce(status, 'ok') AS status FROM topic_events""",
)
def prj16(spark, sf_dir):
    return C.summarize_events(topic_events(spark, sf_dir))


@query(
    "fn1_text_hash",
    "SELECT doc_id, sha256(text) AS text_hash FROM documents",
)
def fn1(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", I.sha256_text(F.col("text")).alias("text_hash"))


@query(
    "fn2_canonical_hash",
    """SELECT page_id, sha256('{"html":' || to_json(html) || ',"page_id":' || page_id || ',"url":'
      || to_json(url) || '}') AS stable_hash FROM pages""",
)
def fn2(spark, sf_dir):
    """Whole pages as values: quotes, line breaks and non-ASCII text in canonical JSON."""
    digest = I.stable_hash({"page_id": F.col("page_id")}, {"url": F.col("url"), "html": F.col("html")})
    return table(spark, sf_dir, "pages").select("page_id", digest.alias("stable_hash"))


@query(
    "fn5_edge_identity",
    "SELECT l_orderkey, l_linenumber, sha256(concat_ws(chr(31), 'o' || l_orderkey, 'p' || l_partkey, l_returnflag, 's' || l_suppkey, 'l' || l_linenumber)) AS edge_id FROM lineitem",
)
def fn5(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.concat(F.lit("o"), "l_orderkey").alias("repo_name"),
        F.concat(F.lit("p"), "l_partkey").alias("file_path"),
        F.col("l_returnflag").alias("edge_type"),
        F.concat(F.lit("s"), "l_suppkey").alias("source_id"),
        F.concat(F.lit("l"), "l_linenumber").alias("target_id"),
    )
    return rows.select("l_orderkey", "l_linenumber", I.edge_id().alias("edge_id"))


@query(
    "fn6_metadata_identity",
    "SELECT doc_id, sha256(source || chr(31) || 'doc/' || doc_id) AS metadata_id, source || ':doc/' || doc_id AS file_key FROM documents",
)
def fn6(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("source").alias("repo_name"), F.concat(F.lit("doc/"), "doc_id").alias("file_path")
    )
    return rows.select("doc_id", I.metadata_id().alias("metadata_id"), I.file_key().alias("file_key"))


@query("fn8_event_time", f"{_LOG} SELECT event_id, event_time FROM records")
def fn8(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", X.iso_utc(F.col("ts")).alias("event_time"))


@query(
    "fn9_event_json",
    """SELECT event_id, '{"event_id":' || event_id || ',"kind":'
      || CASE WHEN event_type = 'view' THEN 'null' ELSE to_json(event_type)::VARCHAR END
      || ',"props":' || to_json(props) || '}' AS json FROM events""",
)
def fn9(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn(
        "kind", F.when(F.col("event_type") != "view", F.col("event_type"))
    )
    return rows.select("event_id", event_json("event_id", "kind", "props").alias("json"))


@query(
    "fn10_path_segments",
    f"""WITH {PAGE_PATHS_SQL} SELECT page_id, regexp_replace(path, '\\.[^.]*$', '') AS parent,
    string_split(path, '.')[-1] AS last FROM paths""",
)
def fn10(spark, sf_dir):
    path = F.col("path")
    return page_paths(spark, sf_dir).select(
        "page_id", X.parent_path(path).alias("parent"), X.last_segment(path).alias("last")
    )


@query("fn16_signed_delta", "SELECT doc_id, printf('%+d', n_chars - 1000) AS delta FROM documents")
def fn16(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.signed(F.col("n_chars") - 1000).alias("delta"))


@query(
    "fn17_key_value_split",
    """SELECT event_id, event_type AS key, props || '|' || user_id AS value, false AS is_json FROM events
    WHERE event_type <> 'view'
    UNION ALL SELECT event_id, event_type, props, true FROM events WHERE event_type = 'view'""",
)
def fn17(spark, sf_dir):
    """Only the first separator splits; the JSON behind it stays as it is."""
    tail = F.when(F.col("event_type") != "view", F.concat(F.lit("|"), F.col("user_id"))).otherwise("")
    lines = table(spark, sf_dir, "events").select(
        "event_id", F.concat("event_type", F.lit("|"), "props", tail).alias("line")
    )
    key, value = X.split_key_value(F.col("line"))
    rows = lines.select("event_id", key.alias("key"), value.alias("value"))
    return rows.withColumn("is_json", X.is_json(F.col("value")))


@query(
    "src7_event_samples",
    """SELECT 't' || user_id AS topic, event_type <> 'click' AS exists, event_type = 'error' AS parse_error,
    CASE WHEN event_type NOT IN ('click', 'error') THEN 'u' || user_id END AS repo_name,
    CASE WHEN event_type NOT IN ('click', 'error') THEN event_type END AS status FROM events""",
)
def src7(spark, sf_dir):
    """Sample lines with a key, without one, broken, and missing."""
    kind = F.col("event_type")
    value = F.format_string('{"repo_name":"u%d","status":"%s"}', "user_id", "event_type")
    line = (
        F.when(kind == "view", value)
        .when(kind == "error", F.concat(F.lit("k\t{"), "props"))
        .when(kind != "click", F.concat(F.lit("k\t"), value))
    )
    topic = F.concat(F.lit("t"), "user_id")
    samples = sample_events(table(spark, sf_dir, "events").select(topic.alias("topic"), line.alias("line")))
    return samples.select("topic", "exists", "parse_error", "repo_name", "status")


@query(
    "snk1_keyed_records",
    f"""{_LOG} SELECT 'cpg.metadata.v1' AS topic, metadata_id AS key,
    '{{"schema_version":"1.0","event_time":"' || event_time || '","repo_name":"users","file_path":"'
      || file_path || '","metadata_id":"' || metadata_id || '","file_hash":"' || file_hash
      || '","line_count":' || line_count || ',"function_count":0,"class_count":0,"import_count":0'
      || ',"node_count":' || node_count || ',"edge_count":' || edge_count || ',"status":"parsed"}}'
      AS value FROM usable""",
)
def snk1(spark, sf_dir):
    return to_records(metadata_events(_log(spark, sf_dir)), METADATA_TOPIC)


@query(
    "snk2_topic_routing",
    f"""WITH {TOPIC_EVENTS_SQL} SELECT topic, event_time,
      CASE WHEN topic = 'cpg.errors.v1' THEN repo_name || ':' || file_path ELSE identity END AS key,
      repo_name, file_path, status
    FROM topic_events""",
)
def snk2(spark, sf_dir):
    """Events of all kinds as records, each behind the key of its topic; shown with fields of their JSON."""
    rows = topic_events(spark, sf_dir)
    kinds = {"nodes": NODES_TOPIC, "edges": EDGES_TOPIC, "metadata": METADATA_TOPIC, "errors": ERRORS_TOPIC}

    def of(topic: str) -> DataFrame:
        missing = [f for f in CONTRACTS[topic].fields if f.name not in rows.columns]
        return rows.where(F.col("topic") == topic).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in missing])

    records = route(**{kind: of(topic) for kind, topic in kinds.items()})
    fields = ("event_time", "repo_name", "file_path", "status")
    return records.select("topic", "key", *[F.get_json_object("value", f"$.{f}").alias(f) for f in fields])


@query(
    "sl5_first_per_topic",
    f"""WITH {TOPIC_EVENTS_SQL} SELECT topic, identity AS key, event_time AS value FROM topic_events
    QUALIFY row_number() OVER (PARTITION BY topic ORDER BY part, event_id) = 1""",
)
def sl5(spark, sf_dir):
    log = topic_events(spark, sf_dir).select(
        "topic",
        "partition",
        "offset",
        F.coalesce("node_id", "edge_id", "metadata_id", "error_type").alias("key"),
        F.col("event_time").alias("value"),
    )
    return R.first_per_topic(log)


@query(
    "ag10_parse_report",
    f"""WITH {TOPIC_EVENTS_SQL} SELECT repo_name, file_path,
      count(*) FILTER (topic = 'cpg.nodes.v1') AS nodes, count(*) FILTER (topic = 'cpg.edges.v1') AS edges,
      count(*) FILTER (topic = 'cpg.metadata.v1') AS metadata FROM topic_events GROUP BY 1, 2""",
)
def ag10(spark, sf_dir):
    return R.parse_report(topic_events(spark, sf_dir))


@query(
    "ag6_duplicate_documents",
    f"""{_LOG}, listed AS (
      SELECT metadata_id, count(*) AS count FROM usable GROUP BY 1 HAVING count(*) > 1
      ORDER BY metadata_id LIMIT 10)
    SELECT DISTINCT u.metadata_id, count, file_path FROM usable u JOIN listed l
      ON u.metadata_id = l.metadata_id""",
)
def ag6(spark, sf_dir):
    """The raw event stream as if it were the store: every user repeats."""
    return R.duplicate_documents(metadata_events(_log(spark, sf_dir)))


@query(
    "ag7_duplicate_files",
    f"{_LOG} SELECT repo_name, file_path, count(*) AS count FROM usable GROUP BY 1, 2 HAVING count(*) > 1",
)
def ag7(spark, sf_dir):
    return R.duplicate_groups(metadata_events(_log(spark, sf_dir)), ["repo_name", "file_path"])


@query("ag8_document_count", f"{_LOG} SELECT count(*) AS documents FROM documents_now")
def ag8(spark, sf_dir):
    return _documents_now(spark, sf_dir).agg(F.count("*").alias("documents"))


@query(
    "sl3_recent_documents",
    f"{_LOG} SELECT repo_name, file_path, event_time FROM documents_now ORDER BY event_time::TIMESTAMPTZ DESC, repo_name, file_path LIMIT 10",
)
def sl3(spark, sf_dir):
    return R.recent_documents(_documents_now(spark, sf_dir))


_HEALTH = """SELECT *, duplicate_metadata_ids = 0 AND duplicate_files = 0 AS passed FROM (
  SELECT (SELECT count(*) FROM {0}) AS documents,
    (SELECT count(*) FROM (SELECT metadata_id FROM {0} GROUP BY 1 HAVING count(*) > 1))
      AS duplicate_metadata_ids,
    (SELECT count(*) FROM (SELECT repo_name, file_path FROM {0} GROUP BY 1, 2 HAVING count(*) > 1))
      AS duplicate_files)"""


@query("vr3_metadata_health", f"{_LOG} {_HEALTH.format('documents_now')}")
def vr3(spark, sf_dir):
    return V.metadata_health(_documents_now(spark, sf_dir))


@query("vr3_metadata_faults", f"{_LOG} {_HEALTH.format('usable')}")
def vr3_faults(spark, sf_dir):
    """The verdict on a store that kept every event."""
    return V.metadata_health(metadata_events(_log(spark, sf_dir)))


@query(
    "vr4_metadata_statistics",
    f"""{_LOG}, health AS ({_HEALTH.format('documents_now')})
    SELECT 'documents' AS item, documents::VARCHAR AS value FROM health
    UNION ALL SELECT 'duplicate_metadata_ids', duplicate_metadata_ids::VARCHAR FROM health
    UNION ALL SELECT 'duplicate_files', duplicate_files::VARCHAR FROM health
    UNION ALL SELECT 'file ' || repo_name || ':' || file_path, event_time FROM (
      SELECT * FROM documents_now ORDER BY event_time::TIMESTAMPTZ DESC, repo_name, file_path LIMIT 10)""",
)
def vr4(spark, sf_dir):
    return V.metadata_statistics(_documents_now(spark, sf_dir))


@query(
    "snk8_evidence_lines",
    f"""{_LOG}, health AS ({_HEALTH.format('documents_now')})
    SELECT 0 AS position, 'documents=' || documents AS line FROM health
    UNION ALL SELECT 1, 'duplicate_metadata_ids=' || duplicate_metadata_ids FROM health
    UNION ALL SELECT 2, 'duplicate_files=' || duplicate_files FROM health
    UNION ALL SELECT 3, 'passed=' || passed FROM health""",
)
def snk8(spark, sf_dir):
    return V.evidence_lines(V.metadata_health(_documents_now(spark, sf_dir)))
