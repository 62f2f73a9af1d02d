"""The append-only log: frames, their validation, and folding revisions to current state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import payload_digest
from . import whole_frames

# Workers need not find this package.
cloudpickle.register_pickle_by_value(whole_frames)


def frames(lines: DataFrame, cut: Callable[[DataFrame], DataFrame] = lambda d: d) -> tuple[DataFrame, DataFrame]:
    """lines (file, line_no, offset, line, v, type, txId, recordCount, payloadDigest, createdAt, problem) -> committed frames and diagnostics.

    Frames: file, tx_id, created_at, begin_offset, digest, payloads. Diagnostics: file, offset, tx_id, digest, message: damaged lines, frames abandoned by a
    new begin, commits without begin, invalid frames, frames without end. Begins are counted by the lines' ranges (split, if there is one) and added up
    over a file's ranges, so that a file of any size is many tasks. Frames that a task reads whole are put together there; only the lines of others are shuffled.
    cut may store the frames, which both results are made from.
    """
    if "split" not in lines.columns:
        lines = lines.withColumn("split", F.lit(0))
    bad = lines.where("problem IS NOT NULL").select("file", "offset", F.lit(None).cast("string").alias("tx_id"), F.lit(None).cast("string").alias("digest"), F.col("problem").alias("message"))
    v2 = lines.where("problem IS NULL AND v = 2")
    begin, commit = F.col("type") == "tx_begin", F.col("type") == "tx_commit"
    begins = v2.groupBy("file", "split").agg(F.count_if(begin).alias("n"))
    mark = F.when(begin, 1).when(commit, 2).when(F.col("type").isNotNull(), 0)
    marked = v2.select("file", *[F.col(c).cast("long").alias(c) for c in ("split", "line_no", "offset")], F.octet_length("line").alias("size"), mark.alias("mark"), F.when(mark == 0, F.col("line")).alias("line"), "txId", "recordCount", "payloadDigest", "createdAt")
    marked = marked.mapInArrow(whole_frames.gather, whole_frames.SCHEMA)
    whole = marked.where("frame IS NOT NULL").select("file", F.lit(None).cast("long").alias("frame"), F.col("txId").alias("tx_id"), F.col("createdAt").alias("created_at"), F.col("offset").alias("begin_offset"), "frame.commit_tx", "frame.record_count", "frame.said", F.lit(1).cast("long").alias("ends"), "frame.payloads", "frame.same")
    # Of the others, and of the begins and commits of whole frames, which others are told by: a frame number begins at each begin; whatever stands after a commit of the same number is outside of frames.
    begin, commit = F.col("mark") == 1, F.col("mark") == 2
    own = F.sum(begin.cast("int")).over(Window.partitionBy("file", "split").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
    d = marked.select("file", "split", "line_no", "offset", "mark", "line", "closed", *[F.when(~F.col("closed"), F.col(c)).alias(c) for c in ("txId", "recordCount", "payloadDigest", "createdAt")])
    d = d.withColumn("own", own).join(begins.select("file", "split", before.alias("before")), ["file", "split"]).withColumn("frame", F.col("before") + F.col("own"))
    d = d.withColumn("commits", F.coalesce(F.sum(commit.cast("int")).over(Window.partitionBy("file", "frame").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    orphan = d.where(commit & ((F.col("frame") == 0) | (F.col("commits") > 0))).select("file", "offset", F.col("txId").alias("tx_id"), F.lit(None).cast("string").alias("digest"), F.lit("orphan tx_commit without tx_begin").alias("message"))
    last = begins.groupBy("file").agg(F.sum("n").alias("last_frame"))
    pick = lambda c, when: F.max(F.when(when, F.col(c)))
    body = F.transform(F.array_sort(F.collect_list(F.when(~begin & ~commit, F.struct("line_no", "line", "txId")))), lambda x: x)
    g = d.where("frame > 0 AND commits = 0 AND NOT closed").groupBy("file", "frame").agg(
        pick("txId", begin).alias("tx_id"), pick("createdAt", begin).alias("created_at"), pick("offset", begin).alias("begin_offset"),
        pick("txId", commit).alias("commit_tx"), pick("recordCount", commit).alias("record_count"), pick("payloadDigest", commit).alias("said"), F.count_if(commit).alias("ends"), body.alias("body"))
    same = F.forall("body", lambda x: F.coalesce(x["txId"] == F.col("tx_id"), F.lit(False)))
    g = g.withColumn("payloads", F.transform("body", lambda x: x["line"])).withColumn("same", same).drop("body")
    g = whole.unionByName(g).withColumn("digest", payload_digest(F.col("payloads")))
    valid = (F.col("ends") == 1) & (F.col("tx_id") == F.col("commit_tx")) & (F.col("record_count") == F.size("payloads")) & (F.col("said") == F.col("digest")) & F.col("created_at").isNotNull() & F.col("same")
    g = cut(g.withColumn("valid", F.coalesce(valid, F.lit(False))))
    message = F.when(F.col("ends") > 0, "invalid transaction frame").when(F.col("frame") < F.col("last_frame"), "abandoned frame: new tx_begin before commit").otherwise("incomplete transaction at EOF")
    broken = g.where("NOT valid").join(last, "file").select("file", F.col("begin_offset").alias("offset"), "tx_id", F.when(message.startswith("abandoned"), F.col("digest")).alias("digest"), message.alias("message"))
    return g.where("valid").select("file", "tx_id", "created_at", "begin_offset", "digest", "payloads"), bad.unionByName(orphan).unionByName(broken)


#: Fixed value: bytes of a record in a transaction.
MOST_BYTES = 4 * 1024 * 1024


def serialize_frame(payloads: DataFrame) -> DataFrame:
    """payloads (tx_id, created_at, no, line) -> tx_id, lines (begin, payloads in order of no, commit with count and digest), digest. A payload over MOST_BYTES is an error."""
    fits = F.octet_length("line") <= MOST_BYTES
    line = F.when(fits, F.col("line")).otherwise(F.raise_error(F.concat(F.lit("a record is too long in transaction "), F.col("tx_id"))).cast("string"))
    g = payloads.groupBy("tx_id", "created_at").agg(F.transform(F.array_sort(F.collect_list(F.struct("no", line.alias("line")))), lambda x: x["line"]).alias("body"))
    head = lambda kind: [F.lit(2).alias("v"), F.lit(kind).alias("type"), F.col("tx_id").alias("txId")]
    g = g.withColumn("digest", payload_digest(F.col("body")))
    begin = F.to_json(F.struct(*head("tx_begin"), F.col("created_at").alias("createdAt")))
    end = F.to_json(F.struct(*head("tx_commit"), F.size("body").alias("recordCount"), F.col("digest").alias("payloadDigest"), F.col("created_at").alias("createdAt")))
    return g.select("tx_id", F.concat(F.array(begin), F.col("body"), F.array(end)).alias("lines"), "digest")


def one_payload_each(committed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Committed frames, each transaction once, by its first digest; and the errors of those with the same id and another digest."""
    order = Window.partitionBy("tx_id").orderBy("file", "begin_offset")
    d = committed.withColumn("first_digest", F.first("digest").over(order)).withColumn("n", F.row_number().over(order))
    errors = d.where("digest <> first_digest").select("file", "tx_id", "digest", F.lit("duplicate transaction ID has a different payload digest").alias("message"))
    return d.where("n = 1").drop("first_digest", "n"), errors


def cursors(lines: DataFrame, committed: DataFrame, problems: DataFrame) -> DataFrame:
    """lines (file, offset, ended, line), and frames() of them -> file, offset: where reading each file goes on when it has grown.

    That is after the last line; but where the file ends in a frame without commit at that frame, and where its last line has no newline at that line, or at the file's last
    frame, if that comes before. What is read twice is the same and changes nothing.
    """
    last = lines.groupBy("file").agg(F.max(F.col("offset") + F.octet_length("line") + F.col("ended").cast("int")).alias("end"), F.min(F.when(~F.col("ended"), F.col("offset"))).alias("open"))
    unfinished = problems.where("message = 'incomplete transaction at EOF'").groupBy("file").agg(F.min("offset").alias("begun"))
    done = committed.groupBy("file").agg(F.max("begin_offset").alias("frame"))
    d = last.join(unfinished, "file", "left").join(done, "file", "left")
    return d.select("file", F.least("end", "open", "begun", F.when(F.col("open").isNotNull(), F.col("frame"))).alias("offset"))


def latest_revisions(turns: DataFrame) -> DataFrame:
    """turns (session, turn_key, history_epoch, revision, content_hash, ...) -> for each turn and epoch the highest revision, the first hash of it."""
    best = F.row_number().over(Window.partitionBy("session", "turn_key", "history_epoch").orderBy(F.desc("revision"), "content_hash"))
    return turns.withColumn("_n", best).where("_n = 1").drop("_n")


def revision_conflicts(turns: DataFrame) -> DataFrame:
    """Revisions of a turn with more than one content hash."""
    return turns.groupBy("session", "turn_key", "history_epoch", "revision").agg(F.count_distinct("content_hash").alias("hashes")).where("hashes > 1")


def fold(turns: DataFrame, resets: DataFrame, legacy: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """turns, resets (session, history_epoch), legacy (session, ...) -> current turns, legacy rows of sessions without reset, conflicts that matter.

    A session with a reset keeps the turns of its highest reset epoch; without one, the highest epoch of each turn counts.
    """
    top = resets.groupBy("session").agg(F.max("history_epoch").alias("top"))
    own = turns.join(top, "session", "left").where("top IS NULL OR history_epoch = top").drop("top")
    # The first of a turn is its highest revision in its highest epoch, so that turns are put in order once.
    best = F.row_number().over(Window.partitionBy("session", "turn_key").orderBy(F.desc("history_epoch"), F.desc("revision"), "content_hash"))
    now = own.withColumn("_n", best).where("_n = 1").drop("_n")
    conflicts = revision_conflicts(turns).join(top, "session", "left").where("top IS NULL OR history_epoch = top").drop("top")
    return now, legacy.join(top.select("session"), "session", "left_anti"), conflicts


#: Fixed value: bytes at the end of a file that a tail reads.
TAIL_BYTES = 1024 * 1024


def tail(lines: DataFrame, n: int = 100) -> DataFrame:
    """The last n lines of each file; of lines with their text, only those that lie wholly in the last TAIL_BYTES."""
    w = Window.partitionBy("file").orderBy(F.desc("line_no"))
    d = lines.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n)
    if "line" in lines.columns:
        d = d.withColumn("_bytes", F.sum(F.octet_length("line") + 1).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("_bytes") <= TAIL_BYTES).drop("_bytes")
    return d.drop("_n")


def self_heal(records: DataFrame, chunks: DataFrame, n: int = 100) -> DataFrame:
    """Of the last n records of the newest file, those that chunks (external_id) lacks."""
    newest = records.agg(F.max("file").alias("file"))
    return tail(records.join(F.broadcast(newest), "file"), n).join(chunks.select("external_id"), "external_id", "left_anti")


def latest_by_id(records: DataFrame, cut: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Each external id once, its last record in order of file and line. With cut, which stores the places of the others, records are not put in order whole."""
    w = Window.partitionBy("external_id").orderBy(F.desc("file"), F.desc("line_no"))
    if cut is None:
        return records.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    older = cut(records.select("external_id", "file", "line_no").withColumn("_n", F.row_number().over(w)).where("_n > 1").select("file", "line_no"))
    return records.join(older, ["file", "line_no"], "left_anti")


def insert_count(legacy: DataFrame, turns: DataFrame) -> DataFrame:
    """One row, chunks: the chunks that a rebuild stores, legacy ones and the parts of turns."""
    return legacy.select(F.lit(1).alias("n")).unionByName(turns.select(F.size("parts").alias("n"))).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"))
