"""Texts that are malformed, very long or of one character, through all operators, and labels that are wrong."""

import random

import pytest
from pyspark.sql import functions as F

from recallspark.llm import decontamination, exact_dedup, language_id, lm_scoring, mixing, near_dedup, periodic, pii, queries, substring_dedup, url_filter, warc

BAD = "CAST(X'61FF20C3286A616E65406578616D706C652E6F7267' AS STRING)"


def hostile(spark):
    """Malformed UTF-8 twice, runs of one character, digits, signs and spaces, and some words."""
    some = ["0" * 20000, "1." + "0" * 20000 + "1.2.3", "@" * 20000, "+" * 20000, " " * 20000, "a" * 20000, "a " * 5000, "1 2 " * 3000, "\x00" * 500, "one two three four"]
    good = spark.createDataFrame([(i, t) for i, t in enumerate(some)], "doc_id long, text string")
    bad = spark.sql(f"SELECT 100L AS doc_id, {BAD} AS text UNION ALL SELECT 101L, {BAD}")
    return good.unionByName(bad).select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))


OPERATORS = {
    "pii": lambda d: pii.digest(pii.scan(d)),
    "lm": lm_scoring.score,
    "language": language_id.identify,
    "known": language_id.keep_known,
    "mix": mixing.mix,
    "near": near_dedup.near_groups,
    "exact": exact_dedup.owners,
    "substring": substring_dedup.repeats,
    "runs": periodic.digest,
    "leaks": lambda d: decontamination.leaks(d, d.sparkSession.createDataFrame([(0, "one two three four five six seven eight nine"), (1, "0 0 0 0 0 0 0 0 0 0")], "item_id long, text string")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_hostile_texts(spark, name):
    got = OPERATORS[name](hostile(spark)).collect()
    if name not in ("known", "leaks"):
        assert len(got) == 12


@pytest.mark.parametrize("f", [warc.round_trip, lambda p: url_filter.judge(p, queries.RULES)], ids=["warc", "url"])
def test_malformed_pages(spark, f):
    p = spark.sql(f"SELECT 1L AS page_id, concat('http://a.org/', {BAD}) AS url, concat({BAD}, repeat('x', 200)) AS html UNION ALL SELECT 2L, 'http://b.org/', concat({BAD}, repeat('x', 200))")
    got = f(p).collect()
    assert len(got) == 2 and (f is not warc.round_trip or {r["record_type"] for r in got} == {"response", "revisit"})


def test_ip_parts_of_many_zeros():
    zeros = "0" * 1_000_000
    assert pii.base_spans(f"1.{zeros}1.2.3") == [("ip", 0, 1_000_007)]
    assert pii.base_spans(f"1.{zeros}.2.{zeros}256") == []


def test_spans_of_malformed_text(spark):
    found = pii.scan(spark.sql(f"SELECT 1L AS doc_id, {BAD} AS text")).first()["spans"]
    assert [(s["kind"], s["start"], s["end"]) for s in found if not s["added"]] == [("email", 5, 21)]


def test_wrong_labels_become_the_predicted_ones(spark):
    rng = random.Random(5)
    words = {"en": ["the", "house", "which", "with", "thing", "were"], "de": ["das", "haus", "zwischen", "nicht", "über", "ich"]}
    text = lambda lang, n=80: " ".join(rng.choice(words[lang]) for _ in range(n))
    rows = [(i, text(lang), lang) for i, lang in enumerate(["en", "de"] * 150)]
    rows += [(1000 + i, text("de"), "en") for i in range(5)] + [(2000, "123 456", "en"), (2001, None, "en"), (2002, text("en"), None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang"] for r in language_id.keep_known(d, 0.8).collect()}
    assert {got[1000 + i] for i in range(5)} == {"de"} and got[2002] == "en" and 2000 not in got and 2001 not in got
    assert all(got[i] == lang for i, _, lang in rows[:300])
    none = {r["doc_id"]: r["lang"] for r in language_id.keep_known(d, 1.1).collect()}  # no score is so high
    assert none[1000] == "en" and none[2002] == "en"
