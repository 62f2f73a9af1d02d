"""Committing turn checkpoints to the log and the tables, and recovering what a crash left half done.

All functions take and return DataFrames, for any number of sessions at once. MemoryEngine puts them in order: receipts of what is prepared, then the
log, then one manifest with all tables and without the receipts. A crash before the log is written leaves receipts that the log lacks, which
are superseded; a crash after it leaves receipts that the log has, whose turns are applied again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import log
from ..schema import BOUNDARY, EXECUTION, METADATA

CANDIDATE = f"runtime string, session string, project string, turn_key string, source_order string, observed_through {BOUNDARY.simpleString()}, completed_at string, prompt string, assistant string, tool_results array<string>, executions array<{EXECUTION.simpleString()}>, pending_key string, model string"
HEADS = f"session string, turn_key string, history_epoch int, revision int, content_hash string, source_order string, observed_through {BOUNDARY.simpleString()}"
EPOCHS = "session string, history_epoch int"
COMMITTED = "tx_id string, digest string"
RECEIPTS = "tx_id string, digest string, session string, history_epoch int, reset boolean, turns array<struct<turnKey:string,revision:int,contentHash:string>>, lines array<string>, pending_keys array<string>"
#: Fixed value: records of a transaction.
MOST_RECORDS = 4096


def parts(runtime: Column, session: Column, key: Column, prompt: Column, assistant: Column, model: Column, most: int = 512) -> Column:
    """The parts of a turn's text, as the log has them."""

    def part(content: Column, i: Column) -> Column:
        m = T.metadata(content)
        extra = {"sourceRuntime": runtime, "model": model}
        meta = F.struct(*[(m[f.name] if f.name in ("filePaths", "toolNames", "errorMessages") else extra.get(f.name, F.lit(None)).cast(f.dataType)).alias(f.name) for f in METADATA.fields])
        return F.struct(i.cast("int").alias("partIndex"), T.part_id(runtime, session, key, i).alias("externalId"), content.alias("content"), T.role(content).alias("role"), meta.alias("metadata"), T.estimate_tokens(content).cast("int").alias("tokenCount"))

    whole = T.turn_text(F.coalesce(prompt, F.lit("")), F.coalesce(assistant, F.lit("")))
    return F.transform(F.filter(T.split_text(whole, most), lambda x: x != ""), part)


def decide(candidates: DataFrame, resets: DataFrame, heads: DataFrame, epochs: DataFrame, most: int = 512) -> DataFrame:
    """candidates (CANDIDATE), resets (session, reason), heads (HEADS), epochs (EPOCHS) -> candidates with history_epoch, parts, content_hash, revision and status.

    A reset starts the session's next epoch, in which no turn has a head. Without a head of its epoch a turn is inserted as revision 1; with one, an equal content hash is
    already_current, an older boundary stale, one of another kind a conflict, and anything else the next revision, in the head's place of the order.
    Of several candidates of a turn the one with the newest boundary counts and the others are stale.
    """
    named = candidates.select("session").unionByName(resets.select("session")).distinct()
    own = named.join(epochs, "session", "left").join(resets.select("session", F.lit(1).alias("again")).distinct(), "session", "left").select("session", (F.coalesce("history_epoch", F.lit(0)) + F.coalesce("again", F.lit(0))).cast("int").alias("history_epoch"))
    at = F.col("observed_through")
    newest = Window.partitionBy("session", "turn_key").orderBy(at["generation"].desc(), at["offset"].desc(), at["sequence"].desc(), "completed_at", "prompt", "assistant")
    d = candidates.withColumn("nth", F.row_number().over(newest)).join(own, "session")
    old = heads.select("session", "turn_key", "history_epoch", F.struct("revision", "content_hash", "source_order", "observed_through").alias("head"))
    d = d.join(old, ["session", "turn_key", "history_epoch"], "left")
    lists = {"tool_results": "array<string>", "executions": f"array<{EXECUTION.simpleString()}>"}
    for name, kind in lists.items():
        d = d.withColumn(name, F.coalesce(name, F.array().cast(kind)))
    d = d.withColumn("source_order", F.coalesce("head.source_order", "source_order")).withColumn("parts", parts(*[F.col(c) for c in ("runtime", "session", "turn_key", "prompt", "assistant", "model")], most))
    text = lambda c: F.coalesce(c, F.lit(""))
    d = d.withColumn("content_hash", T.content_hash(text("runtime"), text("project"), text("prompt"), text("assistant"), F.col("tool_results"), F.col("parts"), F.col("executions")))
    cmp = T.compare_boundary(at, F.col("head.observed_through"))
    status = (
        F.when(F.col("nth") > 1, "stale")
        .when(F.col("head").isNull(), "inserted")
        .when(F.col("head.content_hash") == F.col("content_hash"), "already_current")
        .when(cmp == "older", "stale")
        .when(cmp == "incomparable", "conflict")
        .otherwise("inserted")
    )
    d = d.withColumn("status", status)
    revision = F.when(F.col("status") == "inserted", F.coalesce("head.revision", F.lit(0)) + 1).otherwise(F.col("head.revision"))
    return d.withColumn("revision", revision.cast("int")).drop("nth", "head")


def receipts(decided: DataFrame, resets: DataFrame, created_at: str) -> DataFrame:
    """decided, resets (session, history_epoch, reason) -> RECEIPTS: a transaction for each session with something to write. Larger ones than MOST_RECORDS are an error."""
    won = decided.where("status = 'inserted'")
    each = won.select("session", "history_epoch", T.hash_fields(F.col("turn_key"), F.col("revision"), F.col("content_hash")).alias("h"), F.struct(F.col("turn_key").alias("turnKey"), "revision", F.col("content_hash").alias("contentHash")).alias("t"), "pending_key")
    turns = each.groupBy("session", "history_epoch").agg(F.collect_list("h").alias("hs"), F.array_sort(F.collect_list("t")).alias("turns"), F.array_sort(F.collect_set("pending_key")).alias("pending_keys"))
    tx = turns.join(resets, ["session", "history_epoch"], "full")
    none = lambda name, kind: F.coalesce(name, F.array().cast(kind))
    tx = tx.select("session", "history_epoch", "reason", F.col("reason").isNotNull().alias("reset"), none("turns", "array<struct<turnKey:string,revision:int,contentHash:string>>").alias("turns"), none("pending_keys", "array<string>").alias("pending_keys"), none("hs", "array<string>").alias("hs"))
    tx = tx.withColumn("tx_id", T.transaction_id(F.col("session"), F.col("history_epoch"), F.col("reset"), F.col("hs"))).drop("hs")
    count = F.size("turns") + F.col("reset").cast("int")
    tx = tx.withColumn("tx_id", F.when(count <= MOST_RECORDS, F.col("tx_id")).otherwise(F.raise_error(F.concat(F.lit("too many records in a transaction of session "), F.col("session")))))
    head = [F.lit(2).alias("v")]
    reset = tx.where("reset").select("tx_id", F.struct(F.lit(0).alias("a"), F.lit("").alias("b"), F.lit("").alias("c")).alias("no"), F.to_json(F.struct(*head, F.lit("session_reset").alias("type"), F.col("tx_id").alias("txId"), F.col("session").alias("sessionId"), F.col("history_epoch").alias("historyEpoch"), "reason")).alias("line"))
    names = {"session": "sessionId", "runtime": "runtime", "turn_key": "turnKey", "source_order": "sourceOrder", "observed_through": "observedThrough", "history_epoch": "historyEpoch", "revision": "revision", "content_hash": "contentHash", "completed_at": "completedAt", "project": "projectPath", "parts": "parts", "executions": "executions"}
    record = F.struct(*head, F.lit("turn_checkpoint").alias("type"), F.col("tx_id").alias("txId"), *[F.col(k).alias(v) for k, v in names.items()])
    lines = won.join(tx.select("session", "tx_id"), "session").select("tx_id", F.struct(F.lit(1).alias("a"), F.col("source_order").alias("b"), F.col("turn_key").alias("c")).alias("no"), F.to_json(record).alias("line"))
    frames = log.serialize_frame(reset.unionByName(lines).withColumn("created_at", F.lit(created_at)))
    return tx.join(frames, "tx_id").select("tx_id", "digest", "session", "history_epoch", "reset", "turns", "lines", "pending_keys")


def advance(heads: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """heads (HEADS) and turns of committed transactions -> the heads after them, and errors (session, turn_key, message).

    A higher epoch always advances a head, a lower epoch or revision never does. The same revision must have the same hash, and a higher one no older boundary.
    """
    fresh = log.latest_revisions(turns)
    fresh = fresh.withColumn("_n", F.row_number().over(Window.partitionBy("session", "turn_key").orderBy(F.desc("history_epoch")))).where("_n = 1").drop("_n")
    columns = [c.split()[0] for c in ("session", "turn_key", "history_epoch", "revision", "content_hash", "source_order", "observed_through")]
    d = fresh.select(*columns).join(heads.select("session", "turn_key", F.struct(*columns[2:]).alias("old")), ["session", "turn_key"], "left")
    epoch, old = F.col("history_epoch"), F.col("old")
    same = epoch == old["history_epoch"]
    boundary = T.compare_boundary(F.col("observed_through"), old["observed_through"])
    error = F.when(same & (F.col("revision") == old["revision"]) & (F.col("content_hash") != old["content_hash"]), "a revision has another content").when(same & (F.col("revision") > old["revision"]) & boundary.isin("older", "incomparable"), "the boundary goes backwards")
    moves = old.isNull() | (epoch > old["history_epoch"]) | (same & (F.col("revision") > old["revision"]))
    d = d.withColumn("error", error)
    moved = d.where(moves & F.col("error").isNull()).select(*columns)
    return heads.join(moved, ["session", "turn_key"], "left_anti").unionByName(moved), d.where("error IS NOT NULL").select("session", "turn_key", F.col("error").alias("message"))


def raised_epochs(epochs: DataFrame, resets: DataFrame) -> DataFrame:
    """epochs with those of resets (session, history_epoch) where they are higher."""
    return epochs.unionByName(resets.select("session", "history_epoch")).groupBy("session").agg(F.max("history_epoch").alias("history_epoch"))


def judged(found: DataFrame, committed: DataFrame, heads: DataFrame, epochs: DataFrame) -> DataFrame:
    """receipts (RECEIPTS) that a crash left -> tx_id, result (finalized or superseded), reason.

    A session's newer epoch supersedes a receipt; else one that the log has, with the same digest, is finalized; any other is superseded, because heads cover all of its
    turns or because the source has to be read again. The log having it with another digest is an error.
    """
    d = found.join(epochs.withColumnRenamed("history_epoch", "now"), "session", "left").join(committed.withColumnRenamed("digest", "said"), "tx_id", "left")
    each = found.select("tx_id", "session", "history_epoch", F.explode("turns").alias("t")).withColumn("turn_key", F.col("t.turnKey"))
    head = heads.select("session", "turn_key", F.struct("history_epoch", "revision", "content_hash").alias("h"))
    h = F.col("h")
    covers = (h["history_epoch"] > F.col("history_epoch")) | ((h["history_epoch"] == F.col("history_epoch")) & ((h["revision"] > F.col("t.revision")) | ((h["revision"] == F.col("t.revision")) & (h["content_hash"] == F.col("t.contentHash")))))
    covered = each.join(head, ["session", "turn_key"], "left").groupBy("tx_id").agg(F.every(F.coalesce(covers, F.lit(False))).alias("covered"))
    d = d.join(covered, "tx_id", "left")
    newer, there = F.coalesce(F.col("now") > F.col("history_epoch"), F.lit(False)), F.col("said").isNotNull()
    other = F.raise_error(F.concat(F.lit("a committed transaction has another digest: "), F.col("tx_id"))).cast("string")
    reason = F.when(newer, "newer session epoch covers receipt").when(there & (F.col("said") != F.col("digest")), other).when(there, "the log has it").when(F.coalesce("covered", F.lit(False)), "canonical head covers turns").otherwise("uncommitted receipt requires source replay")
    return d.select("tx_id", F.when(~newer & there, "finalized").otherwise("superseded").alias("result"), reason.alias("reason"))
