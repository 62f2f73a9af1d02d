"""The pipeline's filters judge each row by itself."""

import random

import corpus_pipeline

from .test_operators import docs, text


def kept(stage, spark, rows, sf_dir=""):
    out = stage(spark, docs(spark, rows), sf_dir)
    assert out.columns == docs(spark, rows).columns
    return sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)


def test_exact_dedup_by_row(spark):
    rows = [(1, "a b"), (1, "a b"), (1, "C"), (2, "A b"), (None, "a b"), (None, "n"), (None, "N"), (0, "c"), (7, None), (8, "")]
    got = kept(corpus_pipeline.exact_deduplicated, spark, rows)
    assert [x for x in got if x[1] not in ("n", "N")] == [(0, "c"), (1, "a b"), (7, None)] and len(got) == 4


def test_near_dedup_by_row(spark):
    base = text(random.Random(1), 100, 9000)
    other = text(random.Random(2), 100, 9000)
    rows = [(5, base + " x"), (5, base + " x"), (5, other), (4, base), (None, base + " y"), (None, other + " z"), (9, other + " q"), (10, ""), (11, "")]
    assert kept(corpus_pipeline.near_deduplicated, spark, rows) == [(10, ""), (11, ""), (4, base), (5, other)]
    nulls = kept(corpus_pipeline.near_deduplicated, spark, [(None, base), (None, base), (None, base + " y")])
    assert len(nulls) == 1


def test_text_filters_by_row(spark, tmp_path):
    item = text(random.Random(3), 30, 9000)
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(1, "clean one"), (1, "x " + item), (None, item), (None, "clean two"), (2, "clean two")]
    got = kept(corpus_pipeline.decontaminated, spark, rows, str(tmp_path))
    assert got == [(1, "clean one"), (2, "clean two"), (None, "clean two")]
    rows = [(i, f"some words {i}") for i in range(40)] + [(3, "123"), (None, None), (None, "77"), (None, "words here")]
    got = kept(corpus_pipeline.identified, spark, rows)
    assert got == sorted(((i, t) for i, t in rows if t and "words" in t), key=str)


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    """Columns named like those that the stages use inside, and a map, come through; only the mix's figures are replaced."""
    from pyspark.sql import functions as F

    item = text(random.Random(3), 30, 9000)
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    extra = ["_key", "_id", "_stays", "_row", "_gone", "_source", "_body", "_lang", "_score", "lang_pred", "key", "id", "stays", "owner", "size", "a.b"]
    rows = [(i, f"some words of text number {i}") for i in range(6)] * 2 + [(9, item), (10, None), (None, "some words of text number 1")]
    d = docs(spark, rows)
    for k, name in enumerate(extra):
        d = d.withColumn(name, F.lit(k))
    d = d.withColumn("m", F.create_map(F.lit("x"), F.lit(1)))
    seen = d
    for name, stage in corpus_pipeline.STAGES[:4]:
        seen = spark.createDataFrame(stage(spark, seen, str(tmp_path)).collect(), d.schema)
        assert seen.columns == d.columns, name
    assert sorted(r["doc_id"] for r in seen.collect()) == list(range(6))
    out = corpus_pipeline.mixed(spark, seen.withColumn("copies", F.lit("x")), str(tmp_path))
    assert set(d.columns) | {"source_size", "target", "copies", "taken"} == set(out.columns) and dict(out.dtypes)["copies"] == "bigint"
    assert all(r["_key"] == 0 and r["a.b"] == len(extra) - 1 and r["m"] == {"x": 1} for r in out.collect())


def test_language_stage_fills_null_languages(spark):
    rows = [(i, t, lang, "s", len(t)) for i, (t, lang) in enumerate([("the cat and the dog are here", "en"), ("der hund und die katze sind hier", "de")] * 30)]
    rows += [(100, "the dog and the cat are there", None, "s", 1), (101, "die katze und der hund sind dort", None, "s", 1), (102, "12 34", None, "s", 1), (103, "the cat", "de", "s", 1)]
    got = {r["doc_id"]: r["lang"] for r in corpus_pipeline.identified(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "").collect()}
    assert {got[100], got[101]} <= {"en", "de"} and got[103] == "de" and 102 not in got and len(got) == 63
