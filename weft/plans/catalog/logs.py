"""Log and evidence analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions.text import is_excluded_path
from weft.plans import log_analytics as L
from weft.plans.adapters import DOCUMENT_PATHS_SQL, LOG_LINES_SQL, document_paths, log_lines, table
from weft.plans.catalog import query
from weft.sources.files import manifest
from weft.sources.runlog import clean_line

_WITH = f"""WITH {LOG_LINES_SQL},
clean AS (
  SELECT log, line_no, lang, n_chars, doc_id, regexp_replace(regexp_replace(line,
    chr(27) || '\\[[0-9;]*m', '', 'g'), '\\s+', ' ', 'g') AS line FROM raw_log)"""


def _lines(spark, sf_dir):
    return log_lines(spark, sf_dir).withColumn("line", clean_line(F.col("line")))


@query("src8_run_log", f"{_WITH} SELECT log, line_no, line FROM clean")
def src8(spark, sf_dir):
    return _lines(spark, sf_dir)


@query(
    "la1_parsed_rows",
    f"""{_WITH} SELECT log, regexp_extract(line, 'Parsed (.+?): nodes', 1) AS file_path,
    n_chars::INT AS nodes, (n_chars * 2)::INT AS edges, 1 AS metadata FROM clean WHERE lang = 'en'""",
)
def la1(spark, sf_dir):
    return L.parsed_rows(_lines(spark, sf_dir))


_PATTERNS = {
    "duplicate_node_ids": r"Duplicate node IDs:\s*(\d+)",
    "last_nodes": r"nodes=(\d+)",
    "last_size": r"size_\d+\s*=\s*a=(\d+)",
    "never": r"Totals:\s*(\d+)",
}


@query(
    "la2_last_integers",
    f"""{_WITH} SELECT log,
    (arg_max(n_chars, line_no) FILTER (lang = 'fr'))::VARCHAR AS duplicate_node_ids,
    (arg_max(n_chars, line_no) FILTER (lang = 'en'))::VARCHAR AS last_nodes,
    (arg_max(n_chars, line_no) FILTER (lang = 'de'))::VARCHAR AS last_size, NULL::VARCHAR AS never
    FROM clean GROUP BY 1""",
)
def la2(spark, sf_dir):
    found = L.last_ints(_lines(spark, sf_dir), _PATTERNS)
    return found.select("log", *[F.col(c).cast("string").alias(c) for c in _PATTERNS])


@query(
    "la3_key_values",
    f"""{_WITH}, pairs AS (
      SELECT log, line_no, trim(split_part(line, '=', 1)) AS key,
             trim(substr(line, instr(line, '=') + 1)) AS value FROM clean WHERE contains(line, '='))
    SELECT log, key, arg_max(value, line_no) AS value FROM pairs GROUP BY 1, 2""",
)
def la3(spark, sf_dir):
    return L.key_values(_lines(spark, sf_dir))


@query(
    "la4_presence_flags",
    f"""{_WITH} SELECT log, bool_or(contains(line, 'Failed')) AS has_failure,
    bool_or(contains(line, 'nodes=1') OR contains(line, 'nodes=2')) AS has_small,
    bool_or(contains(line, 'doc/77.py')) AS has_77 FROM clean GROUP BY 1""",
)
def la4(spark, sf_dir):
    needles = {"has_failure": "Failed", "has_small": ("nodes=1", "nodes=2"), "has_77": "doc/77.py"}
    return L.presence_flags(_lines(spark, sf_dir), needles)


@query(
    "la5_discovery_summary",
    f"""WITH {DOCUMENT_PATHS_SQL} SELECT repo_name AS repo_path, count(*) AS total_files,
    least(10, count(*)) AS sample_count_displayed FROM doc_paths
    WHERE lang NOT IN ('en', 'de') AND source NOT IN ('src1', 'src2') GROUP BY 1""",
)
def la5(spark, sf_dir):
    paths = document_paths(spark, sf_dir)
    kept = paths.where(~is_excluded_path(F.col("file_path")))
    return L.discovery_summary(manifest(kept, F.col("repo_name")))


@query(
    "la6_assessment",
    f"""{_WITH} SELECT total_ok, failures_seen, sizes_found, never_found,
      total_ok AND failures_seen AND sizes_found AND never_found AS all_passed FROM (
      SELECT count(*) > 100 AS total_ok, bool_or(contains(line, 'Failed')) AS failures_seen,
        count(*) FILTER (lang = 'de') > 0 AS sizes_found, false AS never_found FROM clean)""",
)
def la6(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    facts = lines.agg(
        F.count("*").alias("total"),
        F.bool_or(F.contains("line", F.lit("Failed"))).alias("failed"),
        F.count_if(F.contains("line", F.lit("size_"))).alias("sizes"),
        F.max(F.when(F.contains("line", F.lit("Totals:")), F.col("line_no"))).alias("never"),
    )
    checks = {
        "total_ok": F.col("total") > 100,
        "failures_seen": F.col("failed"),
        "sizes_found": F.col("sizes") > 0,
        "never_found": F.col("never") > 0,
    }
    return L.assessment(facts, checks)


@query(
    "la8_index_definitions",
    """SELECT p_name || p_partkey AS log, false AS parse_error, p_brand || '_1' AS name,
      '{"' || p_brand || '":1}' AS key, false AS unique FROM part WHERE p_size >= 10
    UNION ALL SELECT p_name || p_partkey, false, 'p_' || p_size, '{"size":-1,"type":1}', true FROM part
      WHERE p_size >= 10
    UNION ALL SELECT p_name || p_partkey, true, NULL, NULL, false FROM part WHERE p_size < 10""",
)
def la8(spark, sf_dir):
    """Index dumps out of parts; those of small parts are broken."""
    text = F.format_string(
        '[{"v":2,"key":{"%s":1},"name":"%s_1"},{"v":2,"key":{"size":-1,"type":1},"name":"p_%d","unique":true}]',
        "p_brand",
        "p_brand",
        "p_size",
    )
    dumps = table(spark, sf_dir, "part").select(
        F.concat("p_name", "p_partkey").alias("log"),
        F.when(F.col("p_size") < 10, "not json").otherwise(text).alias("text"),
    )
    return L.index_rows(dumps)
