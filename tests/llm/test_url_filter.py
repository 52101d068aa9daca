from __future__ import annotations

import re

from weft.llm import url_filter
from weft.llm.catalog import QUERIES, URL_RULES

SMALL = "/root/testdata/sf0.001"


def parts(url: str | None) -> tuple[str, str]:
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule(host: str, path: str) -> tuple | None:
    fits = [r for r in URL_RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    return max(fits, key=lambda r: len(r[1] + r[2]), default=None)


def compare(rows, urls):
    assert len(rows) == len(urls)
    for row in rows:
        host, path = parts(urls[row.page_id])
        found = rule(host, path)
        assert (row.host, row.path) == (host, path), urls[row.page_id]
        assert row["rule"] == (found and found[1] + found[2])
        assert row.verdict == found[0] if found else row.verdict == ("block" if row.p_block >= 0.5 else "allow")


def test_whole_table_and_learned_verdicts(spark):
    urls = {r.page_id: r.url for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    rows = QUERIES["op5_url_filter"](spark, "/root/testdata/sf0.01").collect()
    compare(rows, urls)
    by_rule = [(r.verdict == "block") == (r.p_block >= 0.5) for r in rows if r["rule"]]
    assert sum(by_rule) >= 0.95 * len(by_rule)
    compare(QUERIES["op5_url_filter"](spark, SMALL).collect(), {r.page_id: r.url for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()})


def test_edge_rows(spark):
    urls = [
        None, "", "no scheme", "http://", "https://ORG/x?y", "https://É.ORG/", "https://xorg/", "http://a.example.org/en/12#z", "http://example.org/en/2",
        "http://example.org?/es/", "http://x.com/de/1", "http://x.com/fr", "http://x.com/fr/", "a://b://c/d", "http://x.com:80/de/", "http://u@x.com/de/" + "y" * 50_000,
        "http://example.org/es/", "http://example.org/es/",
    ]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, features string")
    compare(url_filter.judge(pages, URL_RULES).collect(), dict(enumerate(urls)))
    assert url_filter.judge(pages.limit(0), URL_RULES).count() == 0
    none = url_filter.judge(pages, []).collect()
    assert {r.verdict for r in none} == {"allow"} and {r["rule"] for r in none} == {None}
