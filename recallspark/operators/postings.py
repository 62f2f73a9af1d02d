"""An inverted index of three-character pieces with their places, which answers full-text searches without reading contents.

Rows are (bucket, gram, id, project, size, at): the places of a piece in a chunk's lower-cased content. A keyword occurs where its pieces stand at
places in step, so occurrences, and with them BM25, come from the rows of its pieces alone. A task gives runs of rows in order of bucket and gram, each of many
chunks, which are stored as they come: rows take several times the bytes of their texts, so they are not dealt anew. A search reads the pages of its buckets. A row of bucket -1, which is of no chunk, has the number of chunks as gram and the sum of their sizes as size.

An index may be several segments, each the postings of the chunks that a change brought, without those of chunks that a later change took away. The
rows of bucket -1 then count what each change brought less what it took away.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "bucket int, gram long, id long, project string, size long, at array<int>"
BUCKETS = 256
#: Places of a run, which a task holds in memory (but for one longer chunk).
PLACES = 1 << 21


def code(gram: str) -> int:
    """Three characters as one number, 21 bits each."""
    a, b, c = map(ord, gram)
    return a << 42 | b << 21 | c


def bucket(gram: int) -> int:
    return (gram * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 56


def build(chunks: DataFrame, lost: DataFrame | None = None) -> DataFrame:
    """chunks (id, project, content) -> SCHEMA. Contents of under three characters, and null ones, count as chunks and have no pieces.

    lost (id, content): chunks that are gone, which the segment's counts are less by.
    """

    def run(ids: list[int], projects: list[str | None], grams: list[np.ndarray]) -> pa.RecordBatch:
        sizes = np.array([len(g) for g in grams])
        gram = np.concatenate(grams)
        chunk = np.repeat(np.arange(len(ids)), sizes)
        at = (np.arange(len(gram)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
        own = (gram.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(56)).astype(np.int32)
        order = np.lexsort((np.repeat(np.array(ids), sizes), gram, own))  # stable, so places stay in order
        gram, chunk = gram[order], chunk[order]
        first = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (chunk[1:] != chunk[:-1])]))
        who = chunk[first]
        places = pa.ListArray.from_arrays(pa.array(np.append(first, len(gram)).astype(np.int32)), pa.array(at[order]))
        return pa.RecordBatch.from_arrays([pa.array(own[order][first]), pa.array(gram[first]), pa.array(np.array(ids)[who]), pa.array(projects, pa.string()).take(pa.array(who)), pa.array(sizes[who]), places], names=["bucket", "gram", "id", "project", "size", "at"])

    def work(batches):
        held, n = [], 0
        for batch in batches:
            for id_, project, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
                if len(points) < 3:
                    continue
                if n and n + len(points) > PLACES:
                    yield run(*zip(*held, strict=True))
                    held, n = [], 0
                held.append((id_, project, points[:-2] << 42 | points[1:-1] << 21 | points[2:]))
                n += len(points)
        if held:
            yield run(*zip(*held, strict=True))

    plain = F.lower(F.coalesce("content", F.lit("")))
    text = chunks.select(F.col("id").cast("long").alias("id"), F.col("project").cast("string").alias("project"), plain.alias("text"))
    sizes = lambda d, sign: d.select(F.lit(sign).cast("long").alias("gram"), (sign * F.greatest(F.length(plain) - 2, F.lit(0))).cast("long").alias("size"))
    counts = sizes(chunks, 1) if lost is None else sizes(chunks, 1).unionByName(sizes(lost, -1))
    return text.mapInArrow(work, SCHEMA).unionByName(_counted(counts))


def _counted(counts: DataFrame) -> DataFrame:
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return counts.agg(total("gram"), total("size")).select(F.lit(-1).alias("bucket"), "gram", F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("project"), "size", F.array().cast("array<int>").alias("at"))


def combined(rows: DataFrame) -> DataFrame:
    """Rows of several segments as one segment, in runs again: their counts become one row."""
    return rows.where("bucket >= 0").sortWithinPartitions("bucket", "gram", "id").unionByName(_counted(rows.where("bucket = -1")))


def occurrences(index: DataFrame, words: list[tuple[str, bool]]) -> DataFrame:
    """words (text, only at the start) -> no, id, project, size, f: how often each word is in each chunk that has it, overlaps too."""
    spark = index.sparkSession
    rows = []
    for no, (word, _) in enumerate(words):
        low = word.lower()
        offsets = sorted({*range(0, len(low) - 2, 3), len(low) - 3})
        rows += [(no, code(low[i : i + 3]), i, len(offsets)) for i in offsets]
    wanted = spark.createDataFrame(rows, "no int, gram long, offset int, parts int")
    grams = sorted({r[1] for r in rows})
    near = index.where(F.col("bucket").isin(sorted({bucket(g) for g in grams})) & F.col("gram").isin(grams))
    each = near.join(F.broadcast(wanted), "gram").select("no", "parts", "id", "project", "size", F.transform("at", lambda p: p - F.col("offset")).alias("at"))
    met = each.groupBy("no", "parts", "id", "project", "size").agg(F.collect_list("at").alias("all")).where(F.size("all") == F.col("parts"))
    at = F.aggregate(F.slice("all", 2, 1 << 20), F.element_at("all", 1), lambda s, x: F.array_intersect(s, x))
    starts = [no for no, (_, initial) in enumerate(words) if initial]
    found = met.withColumn("at", at)
    f = F.when(F.col("no").isin(starts), F.array_contains("at", 0).cast("int")).otherwise(F.size("at")) if starts else F.size("at")
    return found.select("no", "id", "project", "size", f.cast("double").alias("f")).where("f > 0")


def totals(index: DataFrame) -> tuple[int, float]:
    """Chunks, and the mean size."""
    r = index.where("bucket = -1").agg(F.sum("gram").alias("n"), F.sum("size").alias("size")).first()
    return (r["n"], r["size"] / r["n"]) if r["n"] else (0, 0.0)
