"""Payloads of hooks, and wire logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import HOOK, WIRE
from .lines import read_lines


def parse_payloads(raw: DataFrame) -> DataFrame:
    """raw (value) -> the payload's fields; a prompt that is an array becomes its text parts joined by newlines. Values without session_id are left out."""
    d = raw.select(F.from_json("value", HOOK).alias("r")).select("r.*").where("session_id IS NOT NULL")
    texts = F.transform(F.filter(F.from_json("prompt", "array<struct<type:string,text:string>>"), lambda b: b["type"] == "text"), lambda b: b["text"])
    return d.withColumn("prompt", F.when(F.col("prompt").rlike(r"^\s*\["), F.array_join(texts, "\n")).otherwise(F.col("prompt")))


def wire_texts(lines: DataFrame) -> DataFrame:
    """lines (file, line_no, line) -> file and the assistant text after the last step.begin of each wire log."""
    d = lines.withColumn("r", F.from_json("line", WIRE)).where("r.type = 'context.append_loop_event'")
    order = Window.partitionBy("file").orderBy("line_no")
    d = d.withColumn("step", F.sum((F.col("r.event.type") == "step.begin").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    last = Window.partitionBy("file")
    d = d.withColumn("top", F.max("step").over(last)).where("step = top AND r.event.type = 'content.part' AND r.event.part.type = 'text'")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.coalesce("r.event.part.text", "r.event.part.content").alias("t")))), lambda x: x["t"]), "")
    return d.groupBy("file").agg(F.trim(text).alias("text"))


def wire_answers(spark: SparkSession, path: str) -> DataFrame:
    """file, session (the folder above agents/main) and text of the wire logs that path names."""
    return wire_texts(read_lines(spark, path)).withColumn("session", F.regexp_extract("file", r"sessions/[^/]+/([^/]+)/agents/main/wire\.jsonl", 1))


def wire_files(home: str, session: str) -> str:
    """Where the wire logs of a session may be below a home folder, for any work folder."""
    return f"{home.rstrip('/')}/sessions/*/{session}/agents/main/wire.jsonl"
