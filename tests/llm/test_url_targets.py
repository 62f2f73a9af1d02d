"""Relative link targets, against the standard library's resolution."""

from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from recallspark.llm import url_filter

TARGETS = ["page2.html", "./p", "../x", "../../../x", "a/../b/./c", "..", ".", "a/", "?id=1", "/y/../z?q=../k", "//other.org/k", "http://third.org/a", "d.html?next=http://q.org/../z"]


def test_targets_resolve(spark):
    urls = ["http://h.org/a/b/page.html", "https://h.org/a/b/?q=/x/y", "http://h.org/top"]
    rows = spark.createDataFrame([(u, t) for u in urls for t in TARGETS], "url string, target string")
    got = {(r["url"], r["target"]): r["to"] for r in rows.withColumn("to", url_filter.resolved(F.col("url"), F.col("target"))).collect()}
    assert got == {(u, t): urljoin(u, t) for u in urls for t in TARGETS}
    bare = spark.createDataFrame([("http://h.org", "x"), ("h.org", "x"), ("http://h.org/a", "mailto:a@b.c")], "url string, target string")
    assert {r[0] for r in bare.select(url_filter.resolved(F.col("url"), F.col("target"))).collect()} == {"http://h.org/x", None}


@pytest.mark.parametrize("target", ["bad.html", "../d/bad.html", "../../../s/d/bad.html"])
def test_block_reaches_relative_alias(spark, target):
    pages = spark.createDataFrame([(1, "http://h.org/s/d/page", f'<link rel="canonical" href="{target}">'), (2, "http://h.org/s/d/bad.html", "")], "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, [url_filter.Rule("block", "h.org/s/d/bad")]).collect()}
    assert got == {1: "block", 2: "block"}
