"""Agent transcripts, one JSON-lines file a session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import HEAD_LINES, TAIL_LINES, truncate_output
from ..schema import BLOCK, TRANSCRIPT
from .lines import read_lines


def blocks(content: Column) -> Column:
    """The well-formed text, tool_use and tool_result blocks of a message's content array."""
    found = F.from_json(content, f"array<{BLOCK.simpleString()}>")
    fine = lambda b: ((b["type"] == "text") & b["text"].isNotNull()) | ((b["type"] == "tool_use") & b["id"].isNotNull() & b["name"].isNotNull()) | ((b["type"] == "tool_result") & b["tool_use_id"].isNotNull())
    return F.filter(found, lambda b: F.coalesce(fine(b), F.lit(False)))


def _joined(content: Column) -> Column:
    """Text of a result: a string, or the texts of an array of blocks."""
    texts = F.transform(F.filter(F.from_json(content, "array<struct<type:string,text:string>>"), lambda b: b["type"] == "text"), lambda b: b["text"])
    return F.when(content.rlike(r"^\s*\["), F.array_join(texts, "\n")).otherwise(content)


def read_transcripts(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """-> messages (file, session, line, role, text, timestamp), tool uses and tool results (both with the message they belong to).

    Damaged lines, lines that aren't objects and summaries of compaction are left out. A result belongs to the latest assistant message before it, and
    is dropped if there is none. User text is a string or the text blocks joined by newlines; a message of results alone is no message.
    """
    lines = read_lines(spark, path)
    d = lines.withColumn("r", F.from_json("line", TRANSCRIPT)).where(F.col("r.type").isin("user", "assistant") & ~F.coalesce("r.isCompactSummary", F.lit(False)))
    content = F.col("r.message.content")
    d = d.select("file", F.col("line_no").alias("line"), F.col("r.sessionId").alias("session"), F.col("r.type").alias("role"), F.col("r.timestamp").alias("timestamp"), content.alias("content"), F.col("r.toolUseResult").alias("extra"), F.when(content.rlike(r"^\s*\["), blocks(content)).alias("blocks"))
    text = F.array_join(F.transform(F.filter("blocks", lambda b: b["type"] == "text"), lambda b: b["text"]), "\n")
    d = d.withColumn("text", F.when(F.col("blocks").isNotNull(), text).otherwise(F.coalesce("content", F.lit(""))))
    order = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("owner", F.last(F.when(F.col("role") == "assistant", F.col("line")), ignorenulls=True).over(order))
    messages = d.where((F.col("role") == "assistant") | (F.col("text") != "")).select("file", "session", "line", "role", "text", "timestamp")
    each = d.select("file", "session", "line", "role", "owner", F.posexplode("blocks").alias("block", "b"))
    uses = each.where("role = 'assistant' AND b.type = 'tool_use'").select("file", "session", F.col("line").alias("message"), "block", F.col("b.id").alias("tool_id"), F.col("b.name").alias("tool_name"), F.get_json_object("b.input", "$.command").alias("command"), F.coalesce(F.get_json_object("b.input", "$.command"), F.get_json_object("b.input", "$.content"), F.col("b.input")).alias("input"))
    own = each.where("role = 'user' AND b.type = 'tool_result' AND owner IS NOT NULL").select("file", "session", F.col("owner").alias("message"), "line", "block", F.col("b.tool_use_id").alias("tool_id"), _joined(F.col("b.content")).alias("content"), F.col("b.is_error").alias("is_error"))
    x = F.from_json("extra", BLOCK)
    extra = d.where("extra IS NOT NULL AND owner IS NOT NULL").select("file", "session", F.col("owner").alias("message"), "line", F.lit(-1).alias("block"), x["tool_use_id"].alias("tool_id"), _joined(x["content"]).alias("content"), x["is_error"].alias("is_error")).where("tool_id IS NOT NULL")
    results = own.unionByName(extra).withColumn("place", F.struct("line", "block")).drop("line", "block")
    return messages, uses, results


def with_tools(messages: DataFrame, uses: DataFrame, results: DataFrame, head: int = HEAD_LINES, tail: int = TAIL_LINES) -> DataFrame:
    """messages whose assistant texts are followed by `[Tool: name] input` of each use and then the results, cut."""
    u = uses.groupBy("file", F.col("message").alias("line")).agg(F.array_sort(F.collect_list(F.struct("block", F.concat(F.lit("[Tool: "), F.col("tool_name"), F.lit("] "), F.col("input")).alias("t")))).alias("u"))
    r = results.groupBy("file", F.col("message").alias("line")).agg(F.array_sort(F.collect_list(F.struct("place", truncate_output(F.coalesce("content", F.lit("")), head, tail).alias("t")))).alias("r"))
    t = lambda c: F.transform(c, lambda x: x["t"])
    d = messages.join(u, ["file", "line"], "left").join(r, ["file", "line"], "left")
    return d.withColumn("text", F.when(F.col("role") == "assistant", F.concat_ws("\n", F.when(F.col("text") != "", F.col("text")), t("u"), t("r"))).otherwise(F.col("text"))).drop("u", "r")


def recoverable(spark: SparkSession, path: str, sessions: DataFrame) -> DataFrame:
    """file, session, project of transcripts whose session isn't stored; the session is the file's name, and the folder's name is the project with - for /."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", "true").load(path).select("path")
    found = files.select(F.col("path").alias("file"), F.regexp_extract("path", r"([^/]+)\.jsonl$", 1).alias("session"), F.replace(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1), F.lit("-"), F.lit("/")).alias("project"))
    return found.join(sessions.select("session"), "session", "left_anti")
