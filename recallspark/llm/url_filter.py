"""URL filters with redirect equivalence, in DataFrame operations only.

Rules name a host and a path prefix. Redirects, canonical links and refresh tags say that two urls are one resource; their connected
components carry a block to aliases that no rule names. An explicit allow comes first: it wins for the url it fits, and for the
aliases of its component that have no rule of their own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """text: host and path prefix, as `example.org/es/`."""

    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise("")


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def key_of(url: Column) -> Column:
    """The resource: the url without scheme and fragment; null where there is no host."""
    found = F.concat(host_of(url), F.regexp_extract(_rest(url), r"^[^/?#]*([^#]*)", 1))
    return F.when(host_of(url) != "", found)


def fitting(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits the host or a parent domain and starts the path, else null. Rules are few and part of the plan."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.verdict == "allow")):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def _plain_path(path: Column) -> Column:
    """A path that starts with /, without its . and .. segments."""
    parts = F.split(path, "/", -1)
    last = F.element_at(parts, -1)
    step = lambda kept, x: F.when(x == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).when(x == ".", kept).otherwise(F.concat(kept, F.array(x)))
    kept = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.array().cast("array<string>"), step)
    return F.concat(F.lit("/"), F.array_join(F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/"))


def resolved(url: Column, target: Column) -> Column:
    """The target of a link on the page of url; null where it has a scheme without ://, as mailto:, or is relative to a url without host."""
    root = F.concat(F.regexp_extract(url, r"(?s)^(.*?)://", 1), F.lit("://"), F.regexp_extract(_rest(url), r"^[^/?#]*", 0))
    path = F.regexp_extract(target, r"(?s)^[^?#]*", 0)
    tail = F.substr(target, F.length(path) + F.lit(1))
    folder = F.concat(F.lit("/"), F.regexp_extract(path_of(url), r"(?s)^/(.*/)", 1))
    found = F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target).when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
    found = found.when(target.startswith("//"), F.concat(F.regexp_extract(url, r"(?s)^(.*?)://", 1), F.lit(":"), target)).when(host_of(url) == "", None)
    found = found.when(target.startswith("#"), F.concat(F.regexp_extract(url, r"(?s)^[^#]*", 0), target)).when(target.startswith("?"), F.concat(root, path_of(url), target))
    return found.when(target.startswith("/"), F.concat(root, _plain_path(path), tail)).otherwise(F.concat(root, _plain_path(F.concat(folder, path)), tail))


def links(pages: DataFrame) -> DataFrame:
    """pages (url, html) -> (url, target) of canonical links and refresh tags; relative targets are resolved against the page's url."""
    html = F.translate(F.col("html"), UPPER, LOWER)
    some = pages.where("url IS NOT NULL AND html IS NOT NULL").where(html.contains("canonical") | html.contains("http-equiv"))
    tag = F.col("tag")
    tags = some.select("url", F.explode(F.regexp_extract_all("html", F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))).alias("tag"))
    tags = cut(tags.where(tag.rlike(r"(?i)\b(canonical|http-equiv)\b")))
    canonical = F.when(tag.rlike(r"""(?is)^<link\b.*\brel\s*=\s*["']?[^"'>]*\bcanonical\b"""), F.regexp_extract(tag, r"""(?is)\bhref\s*=\s*["']?([^"'\s>]*)""", 1))
    refresh = F.when(tag.rlike(r"""(?is)^<meta\b.*\bhttp-equiv\s*=\s*["']?refresh\b"""), F.regexp_extract(tag, r"""(?is)\burl\s*=\s*["']?([^"'\s>]*)""", 1))
    found = tags.select("url", F.trim(F.coalesce(canonical, refresh)).alias("target")).where("target <> ''")
    return cut(found.select("url", resolved(F.col("url"), F.col("target")).alias("target")).where(F.col("target").contains("://")))


def judge(pages: DataFrame, rules: list[Rule], redirects: DataFrame | None = None) -> DataFrame:
    """pages (page_id, url, html) -> page_id, host, path, rule, verdict, component for every row.

    verdict is the fitting rule's; without one, allow if a url of its component is explicitly allowed, else block if one is
    explicitly blocked, else allow. redirects (url, target) add edges to those in the html. component is null for urls without edges.
    Null urls and urls without :// have empty host and path, no rule and no edges. Repeated rows get the same verdict each.
    """
    edges = links(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.where("url IS NOT NULL AND target IS NOT NULL").select("url", "target"))
    edges = edges.select(key_of(F.col("url")).alias("x"), key_of(F.col("target")).alias("y"), "url", "target").where("x IS NOT NULL AND y IS NOT NULL AND x <> y")
    edges = cut(edges.select(F.xxhash64("x").alias("u"), F.xxhash64("y").alias("v"), "x", "y", "url", "target").distinct())
    groups = cut(components(edges.select("u", "v")))
    ends = edges.select(F.col("u").alias("node"), "url").unionByName(edges.select(F.col("v").alias("node"), F.col("target").alias("url")))
    ruled = ends.select("node", fitting(host_of(F.col("url")), path_of(F.col("url")), rules)["verdict"].alias("own")).where("own IS NOT NULL").distinct()
    carried = ruled.join(groups, "node").groupBy("component").agg(F.min("own").alias("carried"))  # allow is before block
    # A url belongs to a component by its whole key, not by the hash alone.
    keys = edges.select(F.col("u").alias("node"), F.col("x").alias("key")).unionByName(edges.select(F.col("v").alias("node"), F.col("y").alias("key"))).distinct()
    known = groups.join(carried, "component", "left").join(keys, "node").select("key", "component", "carried")
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), key_of(F.col("url")).alias("own_key"))
    rows = rows.withColumn("own", fitting(F.col("host"), F.col("path"), rules))
    out = rows.join(known, F.col("own_key") == F.col("key"), "left")
    return out.select("page_id", "host", "path", F.col("own.rule").alias("rule"), F.coalesce("own.verdict", "carried", F.lit("allow")).alias("verdict"), "component")
