"""Exact nearest neighbours against all pairs."""

import numpy as np
import pyarrow as pa
import pytest

from recallspark.operators import neighbours


def brute(v, q, k):
    out = []
    for i, x in q:
        if x is not None:
            near = sorted((float(np.sqrt(((np.array(x) - np.array(y)) ** 2).sum())), j) for j, y in v if y is not None)[:k]
            out += [(i, j, n + 1, round(d, 9)) for n, (d, j) in enumerate(near)]
    return sorted(out)


def rows(spark, v, name):
    return spark.createDataFrame(v, f"{name} long, embedding array<float>")


def found(d):
    return sorted((r["query_id"], r["id"], r["place"], round(r["distance"], 9)) for r in d.collect())


def clustered(n, seed):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(12, 8)) * 10
    return [(i, np.float32(middle[i % 12] + rng.normal(size=8) * 0.3).tolist()) for i in range(n)]


def test_equals_all_pairs_and_prunes(spark):
    v = clustered(900, 1) + [(i, [0.0] * 8) for i in range(900, 1200)] + [(1200, None)]  # a quarter of the rows are copies of one vector
    q = clustered(40, 2) + [(40, [0.0] * 8), (41, None), (42, [100.0] * 8)]
    parts = neighbours.knn_parts(rows(spark, v, "id"), rows(spark, q, "query_id"), 7, 24)
    assert found(parts["best"]) == brute(v, q, 7)
    assert parts["compared"].count() < 0.25 * len(v) * len(q)


def test_few_vectors_and_none(spark):
    v, q = clustered(5, 3), clustered(3, 4)
    assert found(neighbours.knn_batch(rows(spark, v, "id"), rows(spark, q, "query_id"), 9)) == brute(v, q, 9)
    for none in ([], [(1, None)]):
        assert neighbours.knn_batch(rows(spark, none, "id"), rows(spark, q, "query_id"), 2).count() == 0
        assert neighbours.knn_batch(rows(spark, v, "id"), rows(spark, none, "query_id"), 2).count() == 0


def test_large_cells_are_split(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "ROWS", 16)
    v, q = clustered(300, 5), clustered(20, 6)
    assert found(neighbours.knn_batch(rows(spark, v, "id"), rows(spark, q, "query_id"), 4, 3)) == brute(v, q, 4)


def test_lengths_must_agree(spark):
    with pytest.raises(Exception):
        neighbours.knn_batch(rows(spark, [(1, [0.0, 1.0]), (2, [0.0])], "id"), rows(spark, [(1, [0.0, 1.0])], "query_id"), 1).collect()


def test_copies_are_not_compared_pair_by_pair(spark):
    """Before, each query of a group of copies gave a row for each copy."""
    v = [(i, [0.5] * 8) for i in range(600)] + [(i, [0.1 * (i % 7)] * 8) for i in range(600, 640)]
    parts = neighbours.knn_parts(rows(spark, v, "id"), rows(spark, v, "query_id"), 3, 8)
    assert parts["compared"].count() <= 3 * 8 * len(v)
    assert found(parts["best"]) == brute(v, v, 3)


def test_blocks_are_compared_in_single_precision(spark):
    """Products of doubles, and a search for the k-th distance in each row, took most of a block's time."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 16))
    batch = pa.RecordBatch.from_arrays([pa.array([list(range(300))]), pa.array([[10.0] * 300]), pa.array([x.tobytes()], pa.binary()), pa.array([list(range(300))]), pa.array([x.tobytes()], pa.binary())], names=["asked", "reach", "q", "ids", "v"])
    assert {near.dtype for *_, near, _ in neighbours._blocks([batch])} == {np.dtype(np.float32)}
    (a, b), exact = (np.concatenate([r.column(c).to_numpy() for r in neighbours._within(3)([batch])]) for c in (0, 1)), brute(list(enumerate(x)), list(enumerate(x)), 3)
    assert list(zip(a, b)) == [(q, i) for q, i, *_ in sorted(exact, key=lambda r: (r[0], r[2]))]


def test_far_from_the_origin_single_precision_is_left(spark):
    """Vectors whose distances are less than what single precision adds to their squares."""
    rng = np.random.default_rng(9)
    v = [(i, (1e4 + rng.normal(size=6)).tolist()) for i in range(300)]
    kind = "long, embedding array<double>"
    best = neighbours.knn_batch(spark.createDataFrame(v, f"id {kind}"), spark.createDataFrame(v[:50], f"query_id {kind}"), 3, 8)
    assert found(best) == brute(v, v[:50], 3)
