"""Rows that share ids, and texts that repeat themselves."""

import random
import time

import pyarrow as pa
from pyspark.sql import functions as F

from recallspark.llm import decontamination, exact_dedup, mixing, near_dedup
from recallspark.llm.common import NOT_ALNUM, Words, numbered_apart, text_ids

from .test_operators import docs, text


def words(texts):
    return Words(pa.array([t.encode() for t in texts], pa.binary()), separators=NOT_ALNUM)


def test_repeated_texts_match_as_every_shift_does():
    rng = random.Random(3)

    def repeated(most):
        base = [rng.choice("abc") for _ in range(rng.randrange(1, 6))]
        return [base[k % len(base)] if rng.random() > 0.03 else rng.choice("abc") for k in range(rng.randrange(1, most))]

    for _ in range(60):
        items = [(i, " ".join(repeated(45)).encode()) for i in range(4)]
        side, w = decontamination.Side(items), words([" ".join(repeated(200) + repeated(200)) for _ in range(3)])
        want = []
        for d in range(3):
            x = w.hash[w.at[d] : w.at[d + 1]]
            for i in range(4):
                y = side.words[side.at[i] : side.at[i + 1]]
                if found := decontamination.alignment(x, y, range(-len(y), len(x) + 1)):
                    want.append((d, i, *found))
        assert decontamination.matches(side, w) == want


def test_a_million_equal_tokens_take_no_minutes():
    before = time.time()
    assert decontamination.matches(decontamination.Side([(0, b"0 " * 30)]), words(["0 " * 1_000_000])) == [(0, 0, 0, 30, 30)]
    assert time.time() - before < 30


def test_mix_reaches_targets_among_tied_rows(spark):
    """Rows without ids, some with equal texts; a third source has all its rows under one id."""
    rng = random.Random(5)
    rows = [(None, text(rng, rng.randrange(1, 20)), "en", "a", 0) for _ in range(100)] + [(None, "w " * 10, "en", "a", 0)] * 60
    rows += [(i, "x " * 5, "en", "b", 0) for i in range(40)] + [(7, "y " * 4, "en", "c", 0)] * 50
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = mixing.mix(d, mixing.by_size).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.count("*").alias("n")).collect()
    assert {r["source"]: r["n"] for r in out} == {"a": 160, "b": 40, "c": 50}
    assert all(abs(r["taken"] - r["target"]) <= 10 for r in out)


def test_exact_query_keeps_one_rule_for_null_ids(spark, tmp_path):
    from recallspark.llm import queries

    rows = [(5, "x"), (None, "X"), (None, "n"), (3, "x"), (5, "x")]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(((r["doc_id"], r["keep_id"], r["kept"]) for r in queries.op9_exact_dedup(spark, str(tmp_path)).collect()), key=str)
    assert got == [(3, 5, False), (5, 5, True), (5, 5, True), (None, 5, False), (None, None, True)]
    assert sorted((r["doc_id"], r["text"]) for r in exact_dedup.keep_one(docs(spark, rows), "largest").where("doc_id IS NOT NULL").collect()) == [(5, "x"), (5, "x")]


def test_near_copies_under_one_id(spark):
    base, other = text(random.Random(1), 60, 9000), text(random.Random(2), 60, 9000)
    rows = [(1, base), (1, base), (1, other), (None, base + " x"), (2, other + " y")]
    d = docs(spark, rows)
    assert sorted((r["doc_id"], r["text"]) for r in near_dedup.keep_one(d).collect()) == sorted([(1, base), (1, base), (1, other)])


def test_texts_that_share_a_hash_are_told_apart(spark):
    d = spark.createDataFrame([("a", 1, 5, 50), ("a", 1, 5, 50), ("b", 1, 7, 70), ("c", 1, 6, 60), ("d", 2, 5, 80)], "text string, x int, y int, z int")
    got = {(r["text"], r["n"]) for r in numbered_apart(d, "n", F.col("x"), F.col("y"), F.col("z")).collect()}
    assert got == {("a", 1), ("b", 70), ("c", 60), ("d", 2)}
    seen = text_ids(docs(spark, [(1, "a"), (2, "a"), (3, "A"), (4, None), (5, "")]), "n").groupBy("n").count().collect()
    assert sorted(r["count"] for r in seen) == [1, 2, 2]
