"""Prompts that wait for their answer, one JSON file each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PENDING = "runtime string, session string, turn_id string, project string, prompt string, model string, pending_key string, turn_sequence int, source_order string, created_at string"
_FIELDS = "version int, runtime string, sessionId string, runtimeTurnId string, projectPath string, prompt string, model string, pendingKey string, turnSequence int, sourceOrder string, createdAt string, cwd string"


def safe_part(c: Column) -> Column:
    """A string as part of a file's name."""
    return F.regexp_replace(c, "[^a-zA-Z0-9_.-]", "_")


def file_name(runtime: Column, session: Column, key: Column) -> Column:
    return F.concat(F.sha2(F.concat_ws("\0", runtime, session, key), 256), F.lit(".json"))


def _files(spark: SparkSession, path: str) -> DataFrame:
    d = spark.read.option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").text(path, wholetext=True)
    return d.select(F.input_file_name().alias("file"), "value").withColumn("name", F.regexp_extract("file", r"([^/]+)$", 1)).where(~F.col("name").startswith("."))


def _legacy(r: Column, order: Column) -> Column:
    """A prompt of the older form, which has no key."""
    key = F.concat_ws("\0", F.lit("kimi"), r["sessionId"], F.lit("legacy"), r["createdAt"], r["prompt"])
    values = {"runtime": F.lit("kimi"), "session": r["sessionId"], "turn_id": F.lit(None), "project": r["cwd"], "prompt": r["prompt"], "model": F.lit(None), "pending_key": key, "turn_sequence": F.lit(0), "source_order": order, "created_at": r["createdAt"]}
    return F.struct(*[values[f.split()[0]].cast(f.split()[1]).alias(f.split()[0]) for f in PENDING.split(", ")])


def read_pending(spark: SparkSession, path: str, runtime: str, session: str | None = None) -> tuple[DataFrame, DataFrame]:
    """-> prompts (PENDING, file) in order of source_order, and bad files (file, reason).

    Files hold version 2 of the form; those of kimi may also hold the older one, ordered by its time in milliseconds. Hidden files are no prompts.
    """
    r = F.col("r")
    d = _files(spark, path).withColumn("valid", F.expr("try_parse_json(value)").isNotNull() & F.trim("value").startswith("{")).withColumn("r", F.when(F.col("valid"), F.from_json("value", _FIELDS)))
    there = lambda *names: F.forall(F.array(*[r[n].cast("string").isNotNull() for n in names]), lambda x: x)
    new = (r["version"] == 2) & there("runtime", "sessionId", "projectPath", "prompt", "pendingKey", "turnSequence", "sourceOrder", "createdAt")
    old = F.lit(runtime == "kimi") & there("sessionId", "cwd", "prompt", "createdAt")
    millis = F.lpad(F.coalesce(F.unix_millis(F.try_to_timestamp(r["createdAt"])), F.lit(0)).cast("string"), 20, "0")
    values = {"runtime": "runtime", "session": "sessionId", "turn_id": "runtimeTurnId", "project": "projectPath", "prompt": "prompt", "model": "model", "pending_key": "pendingKey", "turn_sequence": "turnSequence", "source_order": "sourceOrder", "created_at": "createdAt"}
    whole = F.struct(*[r[v].alias(k) for k, v in values.items()])
    d = d.withColumn("p", F.when(F.coalesce(new, F.lit(False)), whole).when(F.coalesce(old, F.lit(False)), _legacy(r, millis)))
    found = d.where("p IS NOT NULL").select("file", "p.*")
    if session is not None:
        found = found.where(F.col("session") == session)
    bad = d.where("p IS NULL").select("file", F.when(F.col("valid"), "unrecognized pending format").otherwise("malformed JSON").alias("reason"))
    return found.orderBy("source_order", "file"), bad


def read_legacy_pending(spark: SparkSession, path: str, session: str) -> DataFrame:
    """Prompts of the older form (PENDING, file) whose file name begins with the session, in order of created_at; damaged files are left out."""
    r = F.col("r")
    d = _files(spark, path).where(F.col("name").startswith(F.concat(safe_part(F.lit(session)), F.lit("-"))))
    d = d.where(F.expr("try_parse_json(value)").isNotNull()).withColumn("r", F.from_json("value", _FIELDS)).withColumn("p", _legacy(r, F.lit("0" * 20)))
    return d.select("file", "p.*").orderBy("created_at", "file")


def pending_records(prompts: DataFrame) -> DataFrame:
    """prompts (PENDING) -> name and value of their files."""
    names = {"runtime": "runtime", "session": "sessionId", "turn_id": "runtimeTurnId", "project": "projectPath", "prompt": "prompt", "model": "model", "pending_key": "pendingKey", "turn_sequence": "turnSequence", "source_order": "sourceOrder", "created_at": "createdAt"}
    record = F.struct(F.lit(2).alias("version"), *[F.col(k).alias(v) for k, v in names.items()])
    return prompts.select(file_name(F.col("runtime"), F.col("session"), F.col("pending_key")).alias("name"), F.to_json(record).alias("value"))


def pair_answers(prompts: DataFrame, stops: DataFrame) -> DataFrame:
    """prompts (PENDING), stops (runtime, session, turn_id, project, answer, sequence, completed_at, model) -> a candidate turn for each stop that has an answer and a prompt.

    A stop takes the prompt with its turn_id, else its session's last in order of source_order. The turn's identity is the turn_id, or the prompt's key.
    """
    from ..functions.text import turn_key

    p = prompts.select("runtime", "session", "turn_id", "pending_key", F.struct("source_order", "pending_key", "prompt", "project", "model").alias("p"))
    last = p.groupBy("runtime", "session").agg(F.max("p").alias("last"))
    own = p.where("turn_id IS NOT NULL").groupBy("runtime", "session", "turn_id").agg(F.min("p").alias("own"))
    d = stops.where(F.trim("answer") != "").join(own, ["runtime", "session", "turn_id"], "left").join(last, ["runtime", "session"]).withColumn("m", F.coalesce("own", "last"))
    identity = F.coalesce(F.concat(F.lit("turn_id:"), F.col("turn_id")), F.concat(F.lit("pending:"), F.col("m.pending_key")))
    at = F.struct(F.lit("delivery_sequence").alias("kind"), F.lit(None).cast("long").alias("generation"), F.lit(None).cast("long").alias("offset"), F.col("sequence").cast("long").alias("sequence"))
    none = lambda kind: F.array().cast(kind)
    from ..schema import EXECUTION

    return d.select("runtime", "session", F.coalesce(F.col("project"), F.col("m.project")).alias("project"), turn_key(F.col("runtime"), F.col("session"), identity).alias("turn_key"), F.col("m.source_order").alias("source_order"), at.alias("observed_through"), "completed_at", F.col("m.prompt").alias("prompt"), F.trim("answer").alias("assistant"), none("array<string>").alias("tool_results"), none(f"array<{EXECUTION.simpleString()}>").alias("executions"), F.col("m.pending_key").alias("pending_key"), F.coalesce(F.col("model"), F.col("m.model")).alias("model"))
