"""Results as text and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def entry(content: Column, session: Column, created_at: Column, score: Column, project: Column | None = None, local: Column | None = None, most: int = 360) -> Column:
    """[date session s=score] and the content, cut after `most` characters; from=name for another project."""
    tag = F.lit("") if project is None or local is None else F.when(~local & (project != ""), F.concat(F.lit(" from="), F.substring_index(project, "/", -1))).otherwise("")
    body = F.when(F.length(content) > most, F.concat(F.substring(content, 1, most), F.lit("..."))).otherwise(content)
    return F.concat(F.lit("["), F.date_format(created_at, "yyyy-MM-dd"), F.lit(" "), F.substring(session, 1, 6), F.coalesce(tag, F.lit("")), F.lit(" s="), F.format_string("%.2f", score), F.lit("]\n"), body)


def format_results(df: DataFrame, limit: int = 10) -> DataFrame:
    """One row, text: the best entries under [Mem], none if there are none."""
    has = "is_local" in df.columns
    e = entry(F.col("content"), F.col("session"), F.col("created_at"), F.col("score"), F.col("project") if has else None, F.col("is_local") if has else None)
    top = df.orderBy(F.desc("score"), "id").limit(limit).select(F.struct((-F.col("score")).alias("s"), "id", e.alias("e")).alias("x"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["e"]), "\n---\n")
    return top.agg(F.when(F.count("*") > 0, F.concat(F.lit("[Mem]\n"), text, F.lit("\n"))).otherwise("").alias("text"))


def hook_output(text: Column, event: str) -> Column:
    return F.to_json(F.struct(F.struct(F.lit(event).alias("hookEventName"), text.alias("additionalContext")).alias("hookSpecificOutput")))


def _ends(chunks: DataFrame) -> DataFrame:
    """chunks with whether each is the first and the last of its session. No session is brought together: only its first and last index are."""
    ends = chunks.groupBy("session").agg(F.min("chunk_index").alias("_low"), F.max("chunk_index").alias("_high"))
    return chunks.join(ends, "session").withColumn("_first", F.col("chunk_index") == F.col("_low")).withColumn("_last", F.col("chunk_index") == F.col("_high"))


def export_json(chunks: DataFrame) -> DataFrame:
    """session, chunk_index, line: the lines of a session, in order of chunk_index, are one JSON array of its chunks. Times are ISO texts."""
    made = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("created_at") if dict(chunks.dtypes)["created_at"].startswith("timestamp") else F.col("created_at")
    line = F.concat(F.when(F.col("_first"), "[").otherwise(","), F.to_json(F.struct("chunk_index", "role", "content", made)), F.when(F.col("_last"), "]").otherwise(""))
    return _ends(chunks).select("session", "chunk_index", line.alias("line"))


def export_markdown(chunks: DataFrame) -> DataFrame:
    """session, chunk_index, line: the lines of a session, in order of chunk_index and joined by newlines, are one document."""
    head = F.when(F.col("_first"), F.concat(F.lit("# "), F.col("session").cast("string"), F.lit("\n\n"))).otherwise("")
    return _ends(chunks).select("session", "chunk_index", F.concat(head, F.lit("### "), F.col("role"), F.lit("\n\n"), F.coalesce("content", F.lit("")), F.lit("\n")).alias("line"))


def write_export(lines: DataFrame, path: str) -> None:
    """Lines as text files, in order of session and chunk, a hot session over several files."""
    lines.repartitionByRange("session", "chunk_index").sortWithinPartitions("session", "chunk_index").select(F.col("line").alias("value")).write.text(path)
