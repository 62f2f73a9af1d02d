"""Exact nearest neighbours of many vectors at once, by pivots and the triangle inequality.

A vector belongs to the cell of its nearest pivot, at some radius. A first look at a query's nearest cells gives a distance within which it has k
neighbours; then only cells that come so near are met. Queries and vectors meet in blocks, whose distances are products of matrices; those that
may count are then taken exactly. What is left out can't be among the k, so the result is that of all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed

#: Pivots, which are vectors of the table: their distances to all vectors are taken, and each has a row of statistics on the driver.
PIVOTS = 64
#: Vectors of a cell that are joined as one group of rows; larger cells are split.
ROWS = 4096
#: What rounding may add to a distance.
SLACK = 1e-9
#: What a rounding of single precision adds, relatively.
SINGLE = 2.0**-23
#: Vectors within a query's reach, as a multiple of k, from which on a block's k-th distance is looked for.
MANY = 4


def _distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((x - one) ** 2).sum(1)) for one in p], axis=1)


def chosen(vectors: DataFrame, pivots: int = PIVOTS) -> np.ndarray:
    """Pivots: the vectors of the smallest hashes of their ids, without repeats."""
    rows = vectors.where("embedding IS NOT NULL").orderBy(F.xxhash64("id"), "id").limit(pivots).select(F.col("embedding").cast("array<double>")).collect()
    return np.unique(np.array([r[0] for r in rows], float), axis=0) if rows else np.zeros((0, 0))


def cells(vectors: DataFrame, points: np.ndarray) -> DataFrame:
    """vectors (id, embedding) with cell, the number of the nearest pivot, and radius. Null vectors are left out; vectors must have the pivots' length."""

    @F.pandas_udf("cell int, radius double")
    def nearest(x: pd.Series) -> pd.DataFrame:
        d = _distances(np.stack(x.to_list()), points)
        return pd.DataFrame({"cell": d.argmin(1).astype(np.int32), "radius": d.min(1)})

    v = vectors.where("embedding IS NOT NULL").select("id", F.col("embedding").cast("array<double>").alias("embedding"))
    return v.withColumn("at", nearest("embedding")).select("id", "embedding", "at.cell", "at.radius")


def _blocks(batches: Iterator[pa.RecordBatch]):
    """Pairs of blocks -> query ids, vectors and reaches, ids and vectors, approximate squares of all distances, and what these may be off by."""

    for batch in batches:
        for i in range(batch.num_rows):
            asked, reach, ids = (batch.column(c).slice(i, 1).flatten() for c in ("asked", "reach", "ids"))
            x, y = (np.frombuffer(batch.column(c)[i].as_buffer()).reshape(n, -1) for c, n in (("q", len(asked)), ("v", len(ids))))
            xx, yy = (x * x).sum(1), (y * y).sum(1)
            reach = reach.to_numpy(zero_copy_only=False)
            single = SINGLE * (xx + yy.max()) * (x.shape[1] + 8)
            # Single precision tells most vectors apart where what it is off by is little beside the reach.
            fits = max(xx.max(), yy.max()) < 1e30 and np.mean(single <= 0.01 * reach**2) > 0.9
            kind, off = (np.float32, single) if fits else (float, 1e-12 * (xx + yy.max()) * x.shape[1])
            # The product of rows (-2x, x.x, 1) and (y, 1, y.y) is the square of the distance.
            left = np.column_stack([-2 * x, xx, np.ones(len(x))]).astype(kind)
            right = np.column_stack([y, np.ones(len(y)), yy]).astype(kind).T
            for at in range(0, len(x), 256):
                s = slice(at, at + 256)
                yield asked.slice(at, 256), x[s], reach[s], ids, y, left[s] @ right, off[s]


def _packed(vectors: pa.ChunkedArray) -> pa.Array:
    """Vectors of a block as one value, which goes from process to process without a look at its numbers."""
    return pa.array([pa.concat_arrays(vectors.chunks).flatten().to_numpy(zero_copy_only=False).tobytes()], pa.binary())


def _listed(x: pa.ChunkedArray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.concat_arrays(x.chunks))


def _held(rows: pa.Table) -> pa.Table:
    """A block of vectors, in order of id."""
    t = rows.sort_by("id")
    return pa.table({"cell": t["cell"].slice(0, 1), "ids": _listed(t["id"]), "v": _packed(t["embedding"])})


def _asked(rows: pa.Table) -> pa.Table:
    """A block of queries, and the cells that any of them meets."""
    cells = np.unique(pa.concat_arrays(rows["cells"].chunks).flatten().to_numpy(zero_copy_only=False))
    return pa.table({"asked": _listed(rows["query_id"]), "reach": _listed(rows["reach"]), "q": _packed(rows["q"]), "cells": pa.ListArray.from_arrays(pa.array([0, len(cells)], pa.int32()), pa.array(cells, pa.int32()))})


def _nearest(k: int):
    """Upper bounds of the k smallest distances of each query in a block."""

    def work(batches):
        for names, _, _, _, y, near, off in _blocks(batches):
            m = min(k, len(y))
            least = np.partition(near, m - 1, axis=1)[:, :m]
            d = np.sqrt(np.maximum(least + off[:, None], 0))
            yield pa.RecordBatch.from_arrays([names.take(pa.array(np.repeat(np.arange(len(d)), m))), pa.array(d.ravel())], names=["query_id", "distance"])

    return work


def _within(k: int):
    """The k nearest vectors of each query in a block, by distance and id, of those within its reach."""

    def work(batches):
        for names, x, reach, ids, y, near, off in _blocks(batches):
            most = reach * (1 + SLACK) + SLACK
            limit = most**2 + off
            top = np.nextafter(limit.astype(near.dtype), np.inf, dtype=near.dtype)
            a, b = np.divmod(np.flatnonzero(near <= top[:, None]), len(y))
            if len(y) > k and len(a) > MANY * k * len(x):  # many vectors may be as near as the k-th one; only equals of it are looked at
                limit = np.minimum(limit, np.partition(near, k - 1, axis=1)[:, k - 1] + 2 * off)
                a, b = np.nonzero(near <= limit[:, None])
            total = np.zeros(len(a))
            for j in range(x.shape[1]):  # in order, as a sum over the elements is
                total += (x[a, j] - y[b, j]) ** 2
            d = np.sqrt(total)
            a, b, d = (z[d <= most[a]] for z in (a, b, d))
            order = np.lexsort((b, d, a))
            a, b, d = a[order], b[order], d[order]
            place = np.arange(len(a)) - np.searchsorted(a, a)
            a, b, d = a[place < k], b[place < k], d[place < k]
            yield pa.RecordBatch.from_arrays([names.take(pa.array(a)), ids.take(pa.array(b)), pa.array(d)], names=["query_id", "id", "distance"])

    return work


def knn_batch(vectors: DataFrame, queries: DataFrame, k: int, pivots: int = PIVOTS) -> DataFrame:
    """vectors (id, embedding), queries (query_id, embedding) -> query_id, id, distance, place: the k nearest vectors to each query by L2 distance, then by id.

    Exact. Null vectors are no one's neighbours, and queries without a vector have none; with fewer than k vectors all are given. Vectors of different lengths end the job.
    """
    return knn_parts(vectors, queries, k, pivots)["best"]


def knn_parts(vectors: DataFrame, queries: DataFrame, k: int, pivots: int = PIVOTS) -> dict[str, DataFrame]:
    """best, as knn_batch returns it, and compared (query_id, id, distance): the pairs whose distance was taken after the first look."""
    points = chosen(vectors, pivots)
    if not len(points):
        none = queries.select("query_id", F.lit(None).cast(vectors.schema["id"].dataType).alias("id"), F.lit(0.0).alias("distance")).limit(0)
        return {"best": none.withColumn("place", F.lit(0)), "compared": none}
    placed = checkpointed(cells(vectors, points))
    stats = {r["cell"]: r for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("radius").alias("low"), F.max("radius").alias("high")).collect()}  # a row a pivot
    own = np.array(sorted(stats))
    n, low, high = (np.array([stats[c][f] for c in own], float) for f in ("n", "low", "high"))
    apart = _distances(points[own], points[own])

    @F.pandas_udf("reach double, home int, cells array<int>")
    def plan(x: pd.Series) -> pd.DataFrame:
        """Within reach are k vectors; cells: the nearest ones, which hold k."""
        d = _distances(np.stack(x.to_list()), points[own])
        reach, out = [], []
        for row in d:
            far = np.argsort(row + high, kind="stable")
            enough = np.searchsorted(np.cumsum(n[far]), k)
            reach.append(float((row + high)[far[enough]]) if enough < len(own) else float("inf"))
            near = np.argsort(row, kind="stable")
            out.append(own[near[: np.searchsorted(np.cumsum(n[near]), k) + 1]].tolist())
        return pd.DataFrame({"reach": reach, "home": own[d.argmin(1)].astype(np.int32), "cells": out})

    @F.pandas_udf("array<int>")
    def within(x: pd.Series, reach: pd.Series) -> pd.Series:
        """Cells that can hold a vector within reach."""
        d = _distances(np.stack(x.to_list()), points[own])
        out = []
        for row, most in zip(d, reach * (1 + SLACK) + SLACK, strict=True):
            home = int(row.argmin())
            beyond = np.divide(row**2 - row[home] ** 2, 2 * apart[home], out=np.zeros(len(own)), where=apart[home] > 0)
            out.append(own[np.maximum.reduce([row - high, low - row, beyond]) <= most].tolist())
        return pd.Series(out)

    def split(cell: str, key: str, sizes: dict[int, int]) -> Column:
        parts = F.create_map(*(x for c, m in sizes.items() for x in (F.lit(int(c)), F.lit(int(-(-m // ROWS))))))
        return F.pmod(F.xxhash64(key), parts[F.col(cell)].cast("long")).cast("int")

    # Blocks of up to about ROWS vectors, in order of id, are rows, dealt so that a task holds a few.
    kind = vectors.schema["id"].dataType.simpleString()
    held = placed.withColumn("part", split("cell", "id", {c: r["n"] for c, r in stats.items()})).groupBy("cell", "part").applyInArrow(_held, f"cell int, ids array<{kind}>, v binary")
    held = checkpointed(held.repartition(max(1, -(-int(n.sum()) // (4 * ROWS)))))
    asked = queries.where("embedding IS NOT NULL").select("query_id", F.col("embedding").cast("array<double>").alias("q"))
    asked = checkpointed(asked.withColumn("plan", plan("q")).select("query_id", "q", "plan.reach", "plan.home", "plan.cells"))
    homes = {r["home"]: r["n"] for r in asked.groupBy("home").agg(F.count("*").alias("n")).collect()}  # a row a pivot
    spread = max(2 * asked.sparkSession.sparkContext.defaultParallelism, -(-sum(homes.values()) // (4 * ROWS)))
    named = queries.schema["query_id"].dataType.simpleString()

    def met(q: DataFrame, work, out: str) -> DataFrame:
        """Blocks of queries (query_id, q, reach, home, cells) with all blocks of vectors of their cells, without a copy of either for each pair on disk."""
        if not homes:
            return q.sparkSession.createDataFrame([], out)
        blocks = q.withColumn("part", split("home", "query_id", homes)).groupBy("home", "part").applyInArrow(_asked, f"asked array<{named}>, reach array<double>, q binary, cells array<int>")
        blocks = checkpointed(blocks.repartition(spread))
        return blocks.crossJoin(held).where(F.array_contains("cells", F.col("cell"))).select("asked", "reach", "q", "ids", "v").mapInArrow(work, out)

    looked = met(asked, _nearest(k), f"query_id {named}, distance double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance"))
    # query_id may be repeated with other vectors; the farther reach is then right for all.
    reached = looked.withColumn("place", place).where(F.col("place") == k).select("query_id", F.col("distance").alias("kth"))
    narrow = asked.join(reached, "query_id", "left").withColumn("reach", F.least("reach", F.coalesce("kth", F.lit(float("inf")))))
    pairs = met(narrow.withColumn("cells", within("q", "reach")), _within(k), f"query_id {named}, id {kind}, distance double")

    def best(pairs: DataFrame) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
        return pairs.withColumn("place", place).where(F.col("place") <= k)

    return {"best": best(pairs), "compared": pairs}
