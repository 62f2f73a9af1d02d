"""Import from another memory store: sessions, observations and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import estimate_tokens, file_list, observation_text, summary_text


def import_foreign(sessions: DataFrame, observations: DataFrame, summaries: DataFrame, existing: DataFrame, project: str | None = None) -> tuple[DataFrame, DataFrame]:
    """-> chunks and sessions to add. A session needs a memory id, must not be in existing (session), and needs an observation or summary. Observations are numbered from 0, summaries from 10000."""
    s = sessions if project is None else sessions.where(F.col("project") == project)
    s = s.where("memory_session_id <> ''").select(F.col("memory_session_id").alias("session"), F.concat(F.lit("claude-mem:"), F.col("project")).alias("project"), "user_prompt", "started_at", "completed_at").join(existing.select("session"), "session", "left_anti")
    number = F.row_number().over(Window.partitionBy("memory_session_id").orderBy("id")) - 1
    paths = lambda a, b: F.array_distinct(F.concat(file_list(F.col(a)), file_list(F.col(b))))
    o = observations.select(F.col("memory_session_id").alias("session"), number.cast("long").alias("chunk_index"), observation_text(F.col("type"), F.col("title"), F.col("narrative"), F.col("facts")).alias("content"), paths("files_read", "files_modified").alias("file_paths"), "created_at")
    m = summaries.select(F.col("memory_session_id").alias("session"), (number + 10000).cast("long").alias("chunk_index"), summary_text(**{k: F.col(k) for k in ("request", "investigated", "learned", "completed", "next_steps")}).alias("content"), paths("files_read", "files_edited").alias("file_paths"), "created_at")
    chunks = o.unionByName(m).join(s.select("session", "project"), "session").withColumn("role", F.lit("assistant")).withColumn("token_count", estimate_tokens(F.col("content")))
    counts = chunks.groupBy("session").agg(F.count("*").alias("chunk_count"))
    return chunks, s.join(counts, "session").select("session", "project", F.col("started_at"), F.col("completed_at").alias("ended_at"), "chunk_count", F.substring("user_prompt", 1, 200).alias("first_message"))
