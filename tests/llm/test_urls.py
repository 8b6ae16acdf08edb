"""URL rules against a plain loop."""

import re

import pytest

from terralake.llm.urls import blocked_bloom, judge_urls, might_be_listed

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es", "block"), ("", "", "block"), (None, "/", "block")]
URLS = [
    "http://example.com/en/1", "HTTP://WWW.Example.COM/en/x?q=1", "https://a.b.net/essay#x", "https://net/es", "http://net", "xnet://y/es", "ftp://com",
    "no scheme", "", None, "://example.com/en/", "http://notexample.com/en/a", "http://example.com:80/en/", "http://u@example.com/en/?//x", "a://b://example.com/en/",
    "http://example.com/en", "http://.com/", "http://example.com./en/x", "http://exämple.com/en/", "http://x.net/es\n/y", "http://example.com/en/1",
]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def verdict(url, rules, default="allow"):
    host, path = split(url)
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if h is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, default))
    return host, path, best[2], best[3]


@pytest.mark.parametrize("blocks", [1, 1 << 10])
def test_against_loop(spark, blocks):
    rules = RULES[:4]
    pages = spark.createDataFrame([(i, u, "v") for i, u in enumerate(URLS)], "page_id long, url string, verdict string")
    listed = spark.createDataFrame(RULES[:4] + RULES[5:], "host string, path string, verdict string")
    rows = judge_urls(pages, listed, blocks=blocks).collect()
    assert sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in rows) == [
        (i, *verdict(u, rules)) for i, u in enumerate(URLS)
    ]


def test_bloom_has_no_false_negatives_and_few_false_positives(spark):
    listed = spark.range(3000).selectExpr("concat('u', id) AS url")
    bloom = blocked_bloom(listed, blocks=1 << 9)
    assert bloom.count() <= 1 << 9
    assert might_be_listed(listed, bloom, blocks=1 << 9).count() == 3000
    others = spark.range(20000).selectExpr("concat('v', id) AS url")
    assert might_be_listed(others, bloom, blocks=1 << 9).count() < 400


def test_empty_tables(spark):
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    assert judge_urls(pages, rules, default="block").collect()[0]["verdict"] == "block"
    listed = spark.createDataFrame(RULES[:2], "host string, path string, verdict string")
    assert judge_urls(pages.limit(0), listed).collect() == []


def test_columns_with_inner_names(spark):
    listed = spark.createDataFrame(RULES[:2], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.com/x", 7, 8, 9)], "page_id long, url string, _fit int, _FIT_ int, _key int")
    r = judge_urls(pages, listed).collect()[0]
    assert (r["page_id"], r["_fit"], r["_key"]) == (1, 7, 9) and r["verdict"] in ("allow", "block")
