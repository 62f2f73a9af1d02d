"""Cases that every operator takes: extra columns of any name, repeated rows, null ids and very long texts."""

import random

import pytest
from pyspark.sql import functions as F

from recallspark.llm import decontamination, exact_dedup, language_id, lm_scoring, mixing, near_dedup, pii, queries, substring_dedup, url_filter, warc

from .test_operators import docs, text

NAMES = ["body", "row", "n", "a", "b", "c", "w", "size", "score", "lang_pred", "owner", "digest", "length", "spans", "key", "node", "u", "v", "component", "learned", "h", "k", "rank", "cell", "payload", "host", "path", "rule", "verdict", "item_id", "target", "taken"]


def operators(spark):
    bench = spark.createDataFrame([(0, text(random.Random(9), 30, 9000))], "item_id long, text string")
    return {
        "pii": lambda d: pii.digest(pii.scan(d)), "leaks": lambda d: decontamination.leaks(d, bench), "lm": lm_scoring.score, "language": language_id.identify,
        "mix": mixing.mix, "mix_by_size": lambda d: mixing.mix(d, mixing.by_size), "near": near_dedup.near_groups, "exact": exact_dedup.owners, "substring": lambda d: substring_dedup.repeats(d, 8, 4),
    }


@pytest.mark.parametrize("name", ["pii", "leaks", "lm", "language", "mix", "mix_by_size", "near", "exact", "substring"])
def test_extra_columns_change_nothing_and_rows_repeat(spark, name):
    rng = random.Random(4)
    one = text(rng, 60, 50)
    rows = [(i, text(rng, 40, 50)) for i in range(12)] + [(3, one), (3, one), (None, one), (None, one), (20, None), (20, None), (21, ""), (22, text(random.Random(9), 30, 9000)), (23, (one + " ") * 400 + "jane [at] example [dot] org")]
    plain = docs(spark, rows)
    more = plain
    for k, c in enumerate(NAMES):
        more = more.withColumn(c, F.lit(k))
    f = operators(spark)[name]
    a, b = f(plain), f(more)
    assert a.columns == b.columns
    got = sorted(map(str, a.collect()))
    assert got == sorted(map(str, b.collect()))
    if name != "leaks":
        assert len(got) == len(rows) and sum("doc_id=None" in x for x in got) == 2
        assert len({x for x in got if "doc_id=3," in x}) <= 2  # equal rows have equal results
    else:
        assert len(got) == 1


@pytest.mark.parametrize("f", [warc.round_trip, lambda p: url_filter.judge(p, queries.RULES)], ids=["warc", "url"])
def test_extra_columns_of_pages(spark, f):
    rows = [(i, f"http://a{i % 3}.example.org/es/{i}", "<p>" + "x" * (40 * (i % 4))) for i in range(12)] + [(5, "http://a.org", "y" * 200), (5, "http://a.org", "y" * 200), (30, None, None)]
    plain = spark.createDataFrame(rows, "page_id long, url string, html string")
    more = plain
    for k, c in enumerate(NAMES):
        more = more.withColumn(c, F.lit(k))
    got = sorted(map(str, f(plain).collect()))
    assert got == sorted(map(str, f(more).collect())) and len(got) == len(rows)


def test_url_query_carries_verdicts_over_links(spark, tmp_path):
    """The query's method on pages that hold links, against union-find over the same links."""
    rng = random.Random(17)
    n = 60
    hosts = ["x.com", "y.net", "blocked.com", "fine.org", "example.org"]
    paths = ["/de/", "/fr/", "/es/", "/en/1", "/en/7", "/"]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(paths)}{i}" for i in range(n)]
    links = [(i, rng.randrange(n)) if rng.random() < 0.5 else (i, None) for i in range(n)]
    html = [None if t is None else f'<link rel="canonical" href="{urls[t]}">' for _, t in links]
    spark.createDataFrame([(i, urls[i], html[i]) for i in range(n)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    top = list(range(n))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, t in links:
        if t is not None:
            top[root(i)] = root(t)

    def rule(url):
        host, _, path = url[7:].partition("/")
        fit = [r for r in queries.RULES if (host == r.host or host.endswith("." + r.host)) and ("/" + path).startswith(r.path)]
        return max(fit, key=lambda r: len(r.text)) if fit else None

    linked = {x for i, t in links if t is not None and t != i for x in (i, t)}
    want = {}
    for i in range(n):
        r = rule(urls[i])
        group = [rule(urls[j]) for j in range(n) if j in linked and root(j) == root(i)] if i in linked else []
        carried = {x.verdict for x in group if x}
        want[i] = (r.verdict if r else "allow" if "allow" in carried or not carried else "block", i in linked)
    got = queries.op1_url_filter(spark, str(tmp_path)).collect()
    assert {x["page_id"]: (x["verdict"], x["component"] is not None) for x in got} == want
    assert any(v == "block" and rule(urls[i]) is None for i, (v, _) in want.items())
    groups = {}
    for x in got:
        if x["component"] is not None:
            groups.setdefault(x["component"], set()).add(root(x["page_id"]))
    assert all(len(s) == 1 for s in groups.values()) and len(groups) == len({root(i) for i in linked})


def test_decontamination_query_equals_brute_force(spark, tmp_path):
    """Every document of the query against every item, all shifts, by the rule itself."""
    rng = random.Random(31)
    items = [text(rng, n, 40) for n in (3, 8, 9, 12, 15, 19, 20, 26)]
    rows = []
    for i in range(80):
        words = text(rng, rng.randint(0, 60), 40).split()
        if rng.random() < 0.7:
            part = rng.choice(items).split()
            part = part[rng.randrange(max(1, len(part) - 20)) :]
            for _ in range(rng.randrange(5)):
                part[rng.randrange(len(part))] = f"z{rng.randrange(9)}"
            words[rng.randrange(len(words) + 1) : 0] = part
        rows.append((i, " ".join(words)))
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = set()
    for d, t in rows:
        t = t.split()
        for k, item in enumerate(items):
            item = item.split()
            n = min(20, len(item))
            need = n if n < 8 else -(-4 * n // 5)
            for shift in range(-len(item), len(t) + 1):
                equal = [0 <= j + shift < len(t) and t[j + shift] == item[j] for j in range(len(item))]
                inside = [0 <= j + shift < len(t) for j in range(len(item))]
                if any(all(inside[j : j + n]) and sum(equal[j : j + n]) >= need for j in range(len(item) - n + 1)):
                    want.add((d, k))
    got = {(r["doc_id"], r["item_id"]) for r in queries.op4_decontamination(spark, str(tmp_path)).collect()}
    assert got == want and len(want) > 20


def test_mix_ranks_unequal_odds(spark):
    """The larger of two kinds of documents have larger odds, so more of them are taken."""
    rows = [(i, "w " * (100 if i % 2 else 4), "en", "s", 0) for i in range(2000)] + [(5000 + i, "w " * 52, "en", "t", 0) for i in range(2000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    share = {r["big"]: r["x"] for r in mixing.mix(d, mixing.by_size).where("source = 's'").groupBy((F.col("size") > 50).alias("big")).agg(F.avg((F.col("taken") > 0).cast("double")).alias("x")).collect()}
    assert share[True] > share[False] + 0.2
    s = mixing.mix(d, mixing.by_size).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 50 for r in s)


def test_one_trie_a_partition_spills_whole_subtrees(spark):
    """Tries of a few bytes give the same owners; two texts of one length and hash end the job."""
    rng = random.Random(8)
    rows = [(i, text(rng, rng.randint(0, 6), 4)) for i in range(300)]
    key = lambda d: sorted((r["doc_id"], r["owner"], r["n"]) for r in d.collect())
    assert key(exact_dedup.owners(docs(spark, rows), trie_bytes=16)) == key(exact_dedup.owners(docs(spark, rows)))
