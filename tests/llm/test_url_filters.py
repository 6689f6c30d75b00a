import random
import re

import pytest
from pyspark.sql import functions as F

from kinweave.llm import common, url_filters
from kinweave.llm.url_filters import RULE_SCHEMA, filter_urls

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("a.example.com", None, "block"), ("A.Example.COM", "", "allow"), (None, "/", "block"), ("x.org", "/12", "block"), ("x.org", "/123", "allow"), ("zz", "nopath", "block")]


def brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    m = re.match(r"([^/?#]*)([^?#]*)", rest, re.S)
    host, path = re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]
    fits = []
    for h, p, v in RULES:
        if h is None:
            continue
        h, p = h.lower(), p or ""
        if (host == h or host.endswith("." + h)) and path.startswith(p) and rest:
            fits.append((len(h + p), len(h), v, h + p))
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


@pytest.mark.parametrize("limit", [20_000, 0])
def test_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(url_filters, "BROADCAST_RULES", limit)
    rng = random.Random(5)
    hosts = ["net", "example.net", "a.b.EXAMPLE.net", "example.com", "a.example.com", "q.a.example.com", "x.org", "y.x.org", "notexample.com", "", "org.", "ex..net", "zz"]
    paths = ["", "/", "/en/1", "/EN/1", "/de/x", "/fr/", "/12", "/123", "/1234?q#f", "?x=/en/", "#/en/", "/en", "/" + "p" * 500]
    urls = [f"{rng.choice(['http', 'HTTPS', ''])}://{h}{p}" for h in hosts for p in paths] + [None, "", "no scheme", "a://b://net/", "http://"]
    urls += ["http://hot.net/"] * 100
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, Rule string")
    got = filter_urls(pages, spark.createDataFrame(RULES, RULE_SCHEMA)).collect()
    assert len(got) == len(urls)
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute(r["url"]), r


@pytest.mark.parametrize("url", ["http://hot.net/", "http://hot.zz/", None])
def test_hot_urls_are_dealt(spark, monkeypatch, url):
    """A URL of a third of all rows, whether a rule fits it or not."""
    monkeypatch.setattr(common, "HOT_LEAST", 20)
    pages = spark.createDataFrame([(i, url if i % 3 else f"http://{i}.example.com/de/") for i in range(300)], "page_id long, url string")
    judged = filter_urls(pages, spark.createDataFrame(RULES, RULE_SCHEMA))
    got = judged.collect()
    assert sorted(r["page_id"] for r in got) == list(range(300))
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute(r["url"]), r
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        parts = filter_urls(pages, spark.createDataFrame(RULES, RULE_SCHEMA)).where(pages["url"].eqNullSafe(url)).select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert parts > 1


def test_no_rules_and_no_pages(spark):
    none = spark.createDataFrame([], RULE_SCHEMA)
    pages = spark.createDataFrame([(1, "http://a.net/x")], "page_id long, url string")
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in filter_urls(pages, none, default="block").collect()] == [("a.net", "/x", None, "block")]
    assert filter_urls(pages.limit(0), spark.createDataFrame(RULES, RULE_SCHEMA)).collect() == []
