"""Messages to turns, turns to chunks, chunks to sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import estimate_tokens, metadata, role, split_text, turn_text


def turns(messages: DataFrame) -> DataFrame:
    """messages (session, line, role, text) -> session, turn_no, line, human, assistant.

    A user message begins a turn; the assistant's texts up to the next are joined by newlines. Assistant text before the first user message is a turn with
    empty human. Other roles are left out. A session is one window partition: it is one conversation's messages.
    """
    order = Window.partitionBy("session").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    d = messages.where(F.col("role").isin("user", "assistant")).withColumn("turn_no", F.sum((F.col("role") == "user").cast("long")).over(order))
    said = F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", F.struct("line", F.coalesce("text", F.lit("")).alias("text")))))
    return d.groupBy("session", "turn_no").agg(F.min("line").alias("line"), F.coalesce(F.max(F.when(F.col("role") == "user", F.col("text"))), F.lit("")).alias("human"), F.array_join(F.transform(said, lambda x: x["text"]), "\n").alias("assistant"))


def build_chunks(messages: DataFrame, most: int = 512) -> DataFrame:
    """messages -> session, chunk_index (from 0 in a session), turn_no, part_index, content, role, token_count, metadata."""
    t = turns(messages).withColumn("text", turn_text(F.col("human"), F.col("assistant"))).where("text <> ''")
    parts = t.select("session", "turn_no", F.posexplode(split_text(F.col("text"), most)).alias("part_index", "content"))
    index = F.row_number().over(Window.partitionBy("session").orderBy("turn_no", "part_index")) - 1
    return parts.select("session", index.cast("long").alias("chunk_index"), "turn_no", "part_index", "content", role(F.col("content")).alias("role"), estimate_tokens(F.col("content")).alias("token_count"), metadata(F.col("content")).alias("metadata"))


def last_turn(messages: DataFrame) -> DataFrame:
    """session, line and prompt of the last user message, and the assistant's text after it."""
    last = messages.where("role = 'user'").groupBy("session").agg(F.max("line").alias("at"), F.max_by("text", "line").alias("prompt"))
    after = messages.where("role = 'assistant'").join(last.select("session", "at"), "session").where("line > at")
    text = after.groupBy("session").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("answer"))
    return last.join(text, "session", "left").select("session", "at", "prompt", F.coalesce("answer", F.lit("")).alias("answer"))


def session_summary(chunks: DataFrame) -> DataFrame:
    """From chunks (session, project, chunk_index, content, created_at): project, times, count, first and last text cut to 200 characters."""
    return chunks.groupBy("session").agg(
        F.max("project").alias("project"), F.min("created_at").alias("started_at"), F.max("created_at").alias("ended_at"), F.count("*").alias("chunk_count"),
        F.substring(F.min_by("content", "chunk_index"), 1, 200).alias("first_message"), F.substring(F.max_by("content", "chunk_index"), 1, 200).alias("last_message"))


def transcript_summary(messages: DataFrame) -> DataFrame:
    """First and last user text, and the number of messages of a session."""
    user = F.col("role") == "user"
    by = lambda f: f(F.when(user, F.col("text")), F.when(user, F.col("line")))
    return messages.groupBy("session").agg(F.substring(by(F.min_by), 1, 200).alias("first_message"), F.substring(by(F.max_by), 1, 200).alias("last_message"), F.count("*").alias("messages"))


def reindex(chunks: DataFrame) -> DataFrame:
    """chunk_index from 0 in each session: chunks without turn_key by their index, then the others by source_order, turn_key, part_index."""
    w = Window.partitionBy("session").orderBy(F.col("turn_key").isNotNull(), F.when(F.col("turn_key").isNull(), F.col("chunk_index")), "source_order", "turn_key", "part_index", "id")
    return chunks.withColumn("chunk_index", (F.row_number().over(w) - 1).cast("long"))


def index_state(chunks: DataFrame, sessions: DataFrame) -> DataFrame:
    """For each of sessions (session): the largest index, -1 without chunks, and the count."""
    own = chunks.groupBy("session").agg(F.max("chunk_index").alias("m"), F.count("*").alias("n"))
    return sessions.join(own, "session", "left").select("session", F.coalesce("m", F.lit(-1)).cast("long").alias("max_index"), F.coalesce("n", F.lit(0)).alias("chunks"))


def next_sequences(committed: DataFrame, arriving: DataFrame) -> DataFrame:
    """arriving (session, key) with sequence numbers after the largest committed one of the session."""
    top = committed.groupBy("session").agg(F.max("sequence").alias("m"))
    n = F.row_number().over(Window.partitionBy("session").orderBy("key"))
    return arriving.join(top, "session", "left").withColumn("sequence", F.coalesce("m", F.lit(0)) + n).drop("m")
