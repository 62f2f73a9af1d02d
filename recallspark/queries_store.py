"""Queries of the store's layers, the index's segments, the line source and the resumed log, on the driver's tables, with DuckDB SQL.

A log is written in pieces. The store reads the first, and then what the log has grown by; its tables and its index must be as if all had been there at first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import search
from .plans.engine import MemoryEngine
from .queries import C, OTHER, PROJECT, TERM, _bm25, chunks, query, table
from .session import scratch
from .sources import lines, logs


def records(c: DataFrame) -> DataFrame:
    """Chunks as lines of version 1 records, whose ids are the documents'."""
    return logs.chunk_records(c.withColumn("external_id", F.col("id").cast("string")).withColumn("role", F.lit("human")).withColumn("token_count", F.lit(1))).select("value")


def _pieces(spark: SparkSession, d: str) -> list[DataFrame]:
    """Documents as chunks, a piece a language; the last takes what is left."""
    c = chunks(spark, d).withColumn("lang", F.element_at(F.split("session", "/"), -1))
    names = [r[0] for r in c.select("lang").distinct().orderBy("lang").limit(4).collect()]
    first = names[:-1]
    return [c.where(F.col("lang") == x).drop("lang") for x in first] + [c.where(~F.coalesce(F.col("lang").isin(first), F.lit(False))).drop("lang")]


def _grown(spark: SparkSession, d: str, index: bool = True) -> MemoryEngine:
    """A store that was rebuilt from the first piece and indexed, and refreshed after each other piece."""
    where = scratch(spark, "log")
    e = MemoryEngine(spark, scratch(spark, "store"))
    for i, piece in enumerate(_pieces(spark, d)):
        records(piece).write.mode("append").option("compression", "gzip").text(where)
        if i:
            e.refresh(where)
        else:
            e.rebuild(where)
            if index:
                e.index()
    return e


def _ranks(e: MemoryEngine, term: str) -> DataFrame:
    """Ranks of all hits of a keyword from the index alone, by the documents' ids."""
    hits = search.bm25(e.chunks(), [term], k=None, index=e.table("postings"))
    return hits.join(e.chunks().select("id", "external_id"), "id").select(F.col("external_id").cast("long").alias("id"), F.round("rank", 6).alias("rank"))


@query(f"SELECT id, round(rank, 6) AS rank FROM {_bm25(TERM)}")
def index_after_refresh(spark, d):
    """The index of a store that grew by three commits, as a fresh index would rank."""
    return _ranks(_grown(spark, d), TERM)


_EDITED = C.replace("text AS content", "CASE WHEN source = 'src1' THEN text || ' amentia and ment' ELSE text END AS content")


@query(f"SELECT id, round(rank, 6) AS rank FROM {_bm25(OTHER).replace(C, _EDITED)}")
def index_after_edit(spark, d):
    """Records of one project come again with longer texts."""
    e, where = MemoryEngine(spark, scratch(spark, "store")), scratch(spark, "log")
    c = chunks(spark, d)
    records(c).write.option("compression", "gzip").text(where)
    e.rebuild(where)
    e.index()
    records(c.where(F.col("project") == PROJECT).withColumn("content", F.concat("content", F.lit(" amentia and ment")))).write.mode("append").option("compression", "gzip").text(where)
    e.refresh(where)
    return _ranks(e, OTHER)


@query(f"SELECT id, round(rank, 6) AS rank FROM {_bm25(TERM).replace(C, C[:-1] + f' WHERE source IS DISTINCT FROM {PROJECT!r})')}")
def index_after_delete(spark, d):
    """All chunks of one project are deleted."""
    e, where = MemoryEngine(spark, scratch(spark, "store")), scratch(spark, "log")
    records(chunks(spark, d)).write.option("compression", "gzip").text(where)
    e.rebuild(where)
    e.index()
    e.delete(F.col("project") == PROJECT)
    return _ranks(e, TERM)


@query(f"SELECT id, session, row_number() OVER (PARTITION BY session ORDER BY chunk_index) - 1 AS chunk_index, md5(content) AS hash FROM {C}")
def merged_layers(spark, d):
    """Chunks of a store that grew by commits, after its layers were merged."""
    e = _grown(spark, d, False)
    if "chunks" not in e.compact(whole=True) or len(e.snapshots.current()[1]["chunks"]) != 1:
        raise ValueError("the layers were not merged")
    return e.chunks().select(F.col("external_id").cast("long").alias("id"), "session", "chunk_index", F.md5(F.col("content").cast("binary")).alias("hash"))


@query(f"SELECT session, count(*) AS chunk_count, min(created_at) AS started_at FROM {C} GROUP BY session")
def sessions_of_layers(spark, d):
    """Sessions of a store that grew by commits; they are read from four layers."""
    e = _grown(spark, d, False)
    if len(e.snapshots.current()[1]["sessions"]) < 2:
        raise ValueError("the sessions are in one layer")
    return e.table("sessions").select("session", "chunk_count", F.col("started_at").cast("timestamp_ntz").alias("started_at"))


# --- the line source

_LINE = "(doc_id || ' ' || repeat('é', (doc_id % 7)::INT) || md5(coalesce(text, '')))"


def _one_file(spark: SparkSession, rows: DataFrame, *order: str) -> tuple[str, int]:
    """The column value as one file in order, and a number of bytes that cuts it into ten ranges."""
    where = scratch(spark, "one")
    rows.coalesce(1).sortWithinPartitions(*order).select("value").write.text(where)
    size = rows.agg(F.sum(F.octet_length("value") + 1)).first()[0]
    return where, -(-size // 10)


def _ranged(found: DataFrame) -> DataFrame:
    if found.rdd.getNumPartitions() < 8:
        raise ValueError("the file is read by fewer than eight tasks")
    return found


@query(f"SELECT doc_id AS id, row_number() OVER (ORDER BY doc_id) - 1 AS line_no, coalesce(sum(strlen({_LINE}) + 1) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place FROM documents")
def split_lines(spark, d):
    """Numbers and byte offsets of the lines of one file that ten tasks read."""
    x = table(spark, d, "documents").select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(" "), F.repeat(F.lit("é"), (F.col("doc_id") % 7).cast("int")), F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("value"))
    where, split = _one_file(spark, x, "doc_id")
    _ranged(lines.scan(spark, where, split))
    return lines.read_lines(spark, where, split, numbers=True).select(F.split_part("line", F.lit(" "), F.lit(1)).cast("long").alias("id"), "line_no", F.col("offset").alias("place"))


@query(f"SELECT id, session, project, created_at, md5(content) AS hash FROM {C}")
def split_records(spark, d):
    """Version 1 records of one file that ten tasks read."""
    c = chunks(spark, d)
    where, split = _one_file(spark, records(c), "value")
    found = logs.chunks_of(_ranged(lines.read_lines(spark, where, split)))
    return found.select(F.col("external_id").cast("long").alias("id"), "session", "project", F.col("created_at").cast("timestamp_ntz").alias("created_at"), F.md5(F.col("content").cast("binary")).alias("hash"))


@query("SELECT conv_id, turn, md5(coalesce(text, '')) AS hash FROM conversations")
def followed_lines(spark, d):
    """A file that grows four times, followed by a stream, which reads each line once."""
    where, out = scratch(spark, "grows"), scratch(spark, "followed")
    m = table(spark, d, "conversations").select("conv_id", "turn", F.concat_ws(" ", "conv_id", "turn", F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("value"))
    for part in m.randomSplit([1.0] * 4, 7):
        part.select("value").write.mode("append").text(where)
        q = lines.follow(spark, where, 1 << 16).select("line").writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(once=True).start()
        q.awaitTermination()
    cut = F.split("line", " ")
    return spark.read.schema("line string").parquet(f"{out}/rows").select(cut[0].cast("long").alias("conv_id"), cut[1].cast("long").alias("turn"), cut[2].alias("hash"))
