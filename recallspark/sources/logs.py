"""The canonical log: chunk records (version 1) and transaction frames (version 2), read and written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import hex_to_vec
from ..operators import log
from ..schema import FRAME, METADATA, V1_CHUNK, V2
from .lines import parsed, read_lines, scan


def read_chunks(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Version 1 records as chunks; malformed lines and records without their fields are skipped. Null or damaged metadata is empty."""
    return chunks_of(read_lines(spark, path))


def chunks_of(lines: DataFrame) -> DataFrame:
    """The same from lines (file, line_no, offset, line)."""
    d = parsed(lines.select(*[c for c in ("file", "line_no", "offset", "line") if c in lines.columns]), V1_CHUNK).where("problem IS NULL AND v = 1 AND id IS NOT NULL AND sessionId IS NOT NULL AND content IS NOT NULL AND role IN ('human', 'assistant', 'mixed') AND chunkIndex IS NOT NULL AND createdAt IS NOT NULL")
    none = F.from_json(F.lit('{"filePaths":[],"toolNames":[],"errorMessages":[]}'), METADATA)
    vector = F.when(F.col("embedding").rlike("^([0-9a-fA-F]{8})+$"), hex_to_vec("embedding"))
    return d.select("file", "line_no", F.col("id").alias("external_id"), F.col("sessionId").alias("session"), F.col("projectPath").alias("project"), F.col("chunkIndex").alias("chunk_index"), "content", "role", F.coalesce(F.from_json("metadata", METADATA), none).alias("metadata"), F.col("tokenCount").alias("token_count"), F.to_timestamp("createdAt").alias("created_at"), vector.alias("embedding"), F.col("embeddingModel").alias("embedding_model"))


def read_frames(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    return log.frames(frame_lines(spark, path))


def frame_lines(spark: SparkSession, path: str | list[str], since: dict[str, int] | None = None, split: int | None = None) -> DataFrame:
    """Lines with what frames are told by, and their problems; since: from where each file is read."""
    found = scan(spark, path, split, since).where(F.trim("line") != "")
    return parsed(found.select("file", "split", F.col("offset").alias("line_no"), "offset", "ended", "line"), FRAME)


def payloads(frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turn checkpoints and resets of committed frames."""
    p = frames.select("file", "tx_id", F.explode("payloads").alias("line")).withColumn("r", F.from_json("line", V2))
    turns = p.where("r.type = 'turn_checkpoint'").select("file", "tx_id", F.col("r.sessionId").alias("session"), F.col("r.turnKey").alias("turn_key"), F.col("r.runtime").alias("runtime"), F.col("r.sourceOrder").alias("source_order"), F.col("r.historyEpoch").alias("history_epoch"), F.col("r.revision").alias("revision"), F.col("r.contentHash").alias("content_hash"), F.col("r.completedAt").alias("completed_at"), F.col("r.projectPath").alias("project"), F.col("r.observedThrough").alias("observed_through"), F.col("r.parts").alias("parts"), F.col("r.executions").alias("executions"))
    resets = p.where("r.type = 'session_reset'").select(F.col("r.sessionId").alias("session"), F.col("r.historyEpoch").alias("history_epoch"))
    return turns, resets


def parts(turns: DataFrame) -> DataFrame:
    """Chunks of turn checkpoints."""
    d = turns.select("session", "project", "turn_key", "source_order", "history_epoch", "revision", "content_hash", "observed_through", F.to_timestamp("completed_at").alias("created_at"), F.explode("parts").alias("p"))
    return d.select("revision", "content_hash", "history_epoch", "observed_through", F.col("p.externalId").alias("external_id"), "session", "project", "turn_key", "source_order", F.col("p.partIndex").alias("part_index"), F.col("p.content").alias("content"), F.col("p.role").alias("role"), F.col("p.metadata").alias("metadata"), F.col("p.tokenCount").alias("token_count"), "created_at")


def observations(turns: DataFrame) -> DataFrame:
    d = turns.select("runtime", "session", "project", "turn_key", "source_order", "history_epoch", "revision", "completed_at", F.explode("executions").alias("e"))
    return d.select("runtime", "session", "project", "turn_key", "source_order", "history_epoch", "revision", "completed_at", F.col("e.executionIndex").alias("execution_index"), F.col("e.toolName").alias("tool_name"), F.col("e.command").alias("command"), F.col("e.status").alias("status"), F.col("e.exitCode").alias("exit_code"), F.col("e.outputExcerpt").alias("output_excerpt"))


def chunk_records(chunks: DataFrame) -> DataFrame:
    """value and year_month of version 1 records, in UTC months; chunks without external_id get one from session and index."""
    key = F.coalesce("external_id", F.sha2(F.concat_ws("\0", "session", F.col("chunk_index").cast("string")), 256))
    meta = F.to_json("metadata") if "metadata" in chunks.columns else F.lit(None).cast("string")
    made = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    record = F.struct(F.lit(1).alias("v"), F.lit("chunk").alias("type"), key.alias("id"), F.col("session").alias("sessionId"), F.col("project").alias("projectPath"), F.col("chunk_index").alias("chunkIndex"), "content", "role", meta.alias("metadata"), F.col("token_count").alias("tokenCount"), made.alias("createdAt"))
    return chunks.select(F.to_json(record).alias("value"), F.date_format("created_at", "yyyy-MM").alias("year_month"))


def append_chunks(chunks: DataFrame, path: str, host: str = "local") -> None:
    """Version 1 records to files by month and by the host that writes them."""
    chunk_records(chunks).withColumn("host", F.lit(host)).write.mode("append").partitionBy("year_month", "host").text(path)
