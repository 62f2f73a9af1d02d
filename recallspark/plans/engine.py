"""MemoryEngine: the store's commands over tables in a folder. Tables are layers of immutable folders, and a command's changes to all of them appear at once.

A command that changes some sessions reads and writes these: their rows become a layer on top of each table, and the full-text index gets a segment
with the postings of the chunks that are new, and the ids of those that are gone.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.errors import PythonException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..operators import duplicates, embedding, executions, formatting, log, postings, search, sessions, store
from ..schema import BOUNDARY
from ..session import Kept, checkpointed
from ..sources import foreign, lines, logs, pending, transcripts
from . import checkpoints
from .snapshots import Conflict, Snapshots

CHUNKS = f"id long, external_id string, session string, project string, chunk_index long, content string, role string, metadata struct<filePaths:array<string>,toolNames:array<string>,errorMessages:array<string>>, token_count long, created_at timestamp, turn_key string, source_order string, part_index long, revision int, content_hash string, history_epoch int, observed_through {BOUNDARY.simpleString()}"
SESSIONS = "session string, project string, started_at timestamp, ended_at timestamp, chunk_count long, first_message string, last_message string"
OBSERVATIONS = "runtime string, session string, project string, turn_key string, source_order string, history_epoch int, revision int, completed_at string, execution_index int, tool_name string, command string, status string, exit_code int, output_excerpt string"
RESOLUTIONS = "runtime string, project string, session string, command string, failure_count long, first_failure_turn string, last_failure_turn string, failure_excerpt string, success_turn string, success_index int, success_excerpt string, verified_at string"
VECTORS = "id long, embedding array<float>"
MAINTENANCE = "action string, chunks_deleted long, bytes_freed long, executed_at timestamp"
CURSORS = "runtime string, session string, cursor string"
#: How far each log file is in the tables.
LOG_STATE = "file string, offset long"
TABLES = {"chunks": CHUNKS, "sessions": SESSIONS, "observations": OBSERVATIONS, "resolutions": RESOLUTIONS, "vectors": VECTORS, "maintenance_log": MAINTENANCE, "heads": checkpoints.HEADS, "epochs": checkpoints.EPOCHS, "committed": checkpoints.COMMITTED, "receipts": checkpoints.RECEIPTS, "pending": pending.PENDING, "cursors": CURSORS, "postings": postings.SCHEMA, "log_state": LOG_STATE}
#: Tables that a rebuild makes from the log.
DERIVED = ("chunks", "sessions", "observations", "resolutions", "vectors", "postings")
#: What rows are replaced by: a commit writes rows of some keys, and readers forget the older ones of these.
KEYS = {"chunks": ("session",), "sessions": ("session",), "observations": ("session",), "resolutions": ("session",), "heads": ("session",), "epochs": ("session",), "vectors": ("id",), "postings": ("id",), "committed": ("tx_id",), "receipts": ("tx_id",), "pending": ("runtime", "session", "pending_key"), "cursors": ("runtime", "session"), "log_state": ("file",)}
PARTED = ("chunks", "observations", "heads")
LAYOUT = {"chunks": ("project", "created_at")}


def names(schema: str) -> list[str]:
    return [f.split()[0] for f in _top_level(schema)]


def _top_level(schema: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(schema + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            out.append(schema[start:i].strip())
            start = i + 1
    return out


class MemoryEngine:
    def __init__(self, spark: SparkSession, path: str, config: Config | None = None):
        self.spark, self.path, self.config = spark, path.rstrip("/"), config or Config()
        self.snapshots = Snapshots(spark, self.path, KEYS, PARTED, LAYOUT)

    # --- tables

    def table(self, name: str, keys: DataFrame | None = None) -> DataFrame:
        """The table's rows; with keys, those of these keys (sessions, for most tables)."""
        return self.snapshots.read(name, TABLES[name], keys)

    def chunks(self) -> DataFrame:
        return self.table("chunks")

    def _fitted(self, name: str, rows: DataFrame) -> DataFrame:
        have = set(rows.columns)
        kinds = [f.split(None, 1) for f in _top_level(TABLES[name])]
        return rows.select(*[(F.col(c) if c in have else F.lit(None)).cast(kind).alias(c) for c, kind in kinds])

    def _commit(self, base: int, **tables: DataFrame | None) -> None:
        """Tables that are written whole."""
        self.snapshots.commit(base, **{k: None if v is None else self._fitted(k, v) for k, v in tables.items()})

    def _change(self, base: int, touched: DataFrame | None, **changes: tuple[DataFrame | None, DataFrame | None]) -> None:
        """For each table, new rows and the keys whose older rows don't count any more. Other writers may come between if they touch other sessions."""
        self.snapshots.commit(base, touched, {k: (None if rows is None else self._fitted(k, rows), gone) for k, (rows, gone) in changes.items()})
        self.compact()

    def compact(self, least: int | None = None, whole: bool = False) -> list[str]:
        """Merges layers of like size, if there are many, or with `whole` all layers of each table; -> the tables. If another writer comes first, nothing happens."""
        more = {} if least is None else {"least": least}
        try:
            return self.snapshots.compact(TABLES, {"postings": postings.combined}, whole=whole, **more)
        except Conflict:
            return []

    def _indexed(self) -> bool:
        return "postings" in self.snapshots.current()[1]

    def save(self, chunks: DataFrame, base: int | None = None, **others: DataFrame | None) -> None:
        """All chunks anew, and the sessions that follow from them. Vectors of chunks that are gone go too, and if there is an index it is made anew."""
        base = self.snapshots.current()[0] if base is None else base
        kept = Kept(self.spark)
        try:
            self._save(base, kept(self._fitted("chunks", chunks)), others)
        finally:
            kept.clear()

    def _save(self, base: int, chunks: DataFrame, others: dict[str, DataFrame | None]) -> None:
        vectors = others.pop("vectors", None)
        vectors = self.table("vectors") if vectors is None else vectors
        tables = {"chunks": chunks, "sessions": sessions.session_summary(chunks), "vectors": vectors.join(chunks.select("id"), "id", "left_semi"), "postings": postings.build(chunks) if self._indexed() else None} | others
        self._commit(base, **tables)

    def _replace(self, base: int, touched: DataFrame, mine: DataFrame, vectors: DataFrame | None = None, **more: tuple[DataFrame | None, DataFrame | None]) -> None:
        """The sessions touched (session) have the chunks `mine` from now on; sessions, vectors (with new ones) and index follow, and more tables change with them."""
        kept = Kept(self.spark)
        try:
            self._replaced(base, kept, checkpointed(touched.select("session").distinct()), kept(self._fitted("chunks", mine)), vectors, more)
        finally:
            kept.clear()

    def _replaced(self, base: int, kept: Kept, touched: DataFrame, mine: DataFrame, vectors: DataFrame | None, more: dict[str, tuple[DataFrame | None, DataFrame | None]]) -> None:
        have = self.snapshots.current()[1]
        changes = {"chunks": (mine, touched), "sessions": (sessions.session_summary(mine), touched)}
        if "vectors" in have or "postings" in have or vectors is not None:
            had = self.table("chunks", touched)
            if "vectors" in have or vectors is not None:
                lost = had.select("id").join(mine, "id", "left_anti")
                changes["vectors"] = (vectors, lost if vectors is None else lost.unionByName(vectors.select("id")))
            if "postings" in have:
                # Texts are told apart by their hashes, so that what meets is small; only those that change go on.
                thin = lambda d: d.select("id", "project", F.sha2("content", 256).alias("hash"))
                a, b = kept(thin(had)), kept(thin(mine))
                differ = lambda a, b: kept(a.alias("a").join(b.alias("b"), (F.col("a.id") == F.col("b.id")) & F.col("a.project").eqNullSafe(F.col("b.project")) & F.col("a.hash").eqNullSafe(F.col("b.hash")), "left_anti").select("id"))
                lost = kept(had.join(differ(a, b), "id", "left_semi").select("id", "project", "content"))
                changes["postings"] = (postings.build(mine.join(differ(b, a), "id", "left_semi"), lost), lost)
        self._change(base, touched, **(changes | more))

    def _add(self, base: int, new: DataFrame) -> None:
        """Chunks (as _numbered makes them) to sessions that may have others. Two chunks of one id are an error."""
        new = checkpointed(new)
        touched = checkpointed(new.select("session").distinct())
        mine = self._distinct(checkpointed(self.table("chunks", touched).unionByName(new)))
        clash = self.chunks().select("id", "session").join(touched, "session", "left_anti").join(new.select("id"), "id", "left_semi").limit(1).collect()
        if clash:
            raise ValueError(f"several chunks have the id {clash[0]['id']}")
        self._replace(base, touched, mine)

    def _drop(self, base: int, lost: DataFrame, orphans_too: bool = False) -> None:
        """Chunks lost (id, session) go, and with orphans_too observations and resolutions of sessions that then have none."""
        lost = checkpointed(lost.select("id", "session"))
        touched = checkpointed(lost.select("session").distinct())
        mine = self.table("chunks", touched).join(lost.select("id"), "id", "left_anti")
        gone = touched.join(mine, "session", "left_anti")
        self._replace(base, touched, mine, **({"observations": (None, gone), "resolutions": (None, gone)} if orphans_too else {}))

    def _numbered(self, new: DataFrame) -> DataFrame:
        """The columns of chunks for new rows; ids are hashes of session and external_id or index, so that no counter is shared. Two chunks of one id are an error."""
        have = set(new.columns)
        column = lambda c: F.col(c).cast("string") if c in have else F.lit(None).cast("string")
        key = F.coalesce(column("external_id"), F.concat_ws("\0", "session", column("chunk_index")))
        out = new.withColumn("id", F.xxhash64("session", key).bitwiseAND(F.lit((1 << 63) - 1)))
        if "metadata" in have:
            # The metadata of a log record has more fields than a chunk's.
            out = out.withColumn("metadata", F.struct(*[F.coalesce(F.col(f"metadata.{k}"), F.array().cast("array<string>")).alias(k) for k in ("filePaths", "toolNames", "errorMessages")]))
        return self._fitted("chunks", out)

    def _distinct(self, chunks: DataFrame) -> DataFrame:
        again = chunks.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").limit(5).collect()
        if again:
            raise ValueError(f"several chunks have the id {again[0]['id']}")
        return chunks

    # --- import and rebuild

    def import_transcripts(self, path: str, project: str) -> DataFrame:
        """Transcripts to chunks; sessions in the input replace their older chunks."""
        m, u, r = transcripts.read_transcripts(self.spark, path)
        found = transcripts.with_tools(m, u, r, self.config.chunking.head_lines, self.config.chunking.tail_lines)
        when = found.groupBy("session").agg(F.to_timestamp(F.min("timestamp")).alias("created_at"))
        new = sessions.build_chunks(found, self.config.chunking.max_tokens).join(when, "session").withColumn("project", F.lit(project))
        base, incoming = self.snapshots.current()[0], checkpointed(self._numbered(new))
        self._replace(base, incoming, self._distinct(incoming))
        return new

    def _read(self, where: str | list[str], kept: Kept, since: dict[str, int] | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """-> lines, committed frames (each transaction once), how far each file is read, and errors (message); all of them are read from what is kept."""
        seen = kept(logs.frame_lines(self.spark, where, since))
        frames, problems = log.frames(seen, kept)
        committed, doubles = log.one_payload_each(frames)
        left = problems.where("message <> 'incomplete transaction at EOF' AND message <> 'unknown record version/type'").join(committed.select("tx_id", "digest"), ["tx_id", "digest"], "left_anti")
        return seen, committed, log.cursors(seen, committed, problems), left.select("message").unionByName(doubles.select("message"))

    def _folded(self, path: str, kept: Kept, from_month: str | None = None):
        """-> current turns, legacy chunks, resets, committed transactions, how far files are read. Errors that matter raise. Turns and chunks are in what is kept."""
        where: str | list[str] = path
        if from_month is not None:
            where = [r["path"] for r in lines.list_files(self.spark, path, from_month).select("path").collect()]
        if not where:
            raise FileNotFoundError(f"no log file below {path} has {from_month}")
        read, parsed = Kept(self.spark), Kept(self.spark)
        try:
            seen, committed, ends, errors = self._read(where, read)
            turns, resets = logs.payloads(committed)
            turns, resets = parsed(turns.drop("file", "tx_id")), checkpointed(resets)
            now, old, conflicts = log.fold(turns, resets, log.latest_by_id(logs.chunks_of(seen.where("v = 1")), read))
            if bad := errors.unionByName(conflicts.select(F.lit("").alias("message"))).count():
                raise ValueError(f"the log has {bad} errors")
            old, committed, ends = kept(old.drop("file", "line_no")), kept(committed.select("tx_id", "digest")), checkpointed(ends)
            read.clear()
            return kept(now), old, resets, committed, ends
        finally:
            read.clear()
            parsed.clear()

    def refresh(self, path: str) -> dict:
        """What the log's files have grown by since they were last read, to the tables: as a rebuild would have it. -> new transactions, records and bytes.

        Each file is read from where it was left: after its last line, or at a transaction that had no end yet. Files that are gone or shorter are an error.
        """
        base = self.snapshots.current()[0]
        since = {r["file"]: r["offset"] for r in self.table("log_state").collect()}  # a row a file
        kept = Kept(self.spark)
        try:
            return self._refreshed(base, kept, *self._read(path, kept, since))
        finally:
            kept.clear()

    def _refreshed(self, base: int, kept: Kept, seen: DataFrame, found: DataFrame, ends: DataFrame, errors: DataFrame) -> dict:
        if bad := errors.count():
            raise ValueError(f"the log has {bad} errors")
        known = self.table("committed").select("tx_id", F.col("digest").alias("said"))
        found = kept(found.join(known, "tx_id", "left"))
        if found.where("said <> digest").limit(1).count():
            raise ValueError("a committed transaction has another digest")
        new = found.where("said IS NULL").drop("said")
        turns, resets = logs.payloads(new)
        own = self.table("epochs").where("history_epoch > 0")
        resets = checkpointed(resets.groupBy("session").agg(F.max("history_epoch").alias("history_epoch")).join(own.withColumnRenamed("history_epoch", "own"), "session", "left").where("own IS NULL OR history_epoch > own").drop("own"))
        top = own.unionByName(resets).groupBy("session").agg(F.max("history_epoch").alias("top"))
        turns = checkpointed(turns.join(top, "session", "left").where("top IS NULL OR history_epoch = top").drop("top"))
        legacy = kept(log.latest_by_id(logs.chunks_of(seen.where("v = 1")), kept))
        ends = checkpointed(ends)
        self._apply(base, turns, resets, new.select("tx_id", "digest"), legacy=legacy, by_revision=True, log_state=(ends, ends))
        size = seen.agg(F.coalesce(F.sum(F.octet_length("line") + F.col("ended").cast("int")), F.lit(0))).first()[0]
        return {"transactions": new.count(), "records": legacy.count(), "bytes": size}

    def rebuild(self, path: str, dry_run: bool = False, from_month: str | None = None) -> DataFrame:
        """The log folded to all tables: chunks, sessions, observations, resolutions, vectors, and heads, epochs and transactions for later checkpoints.

        Returns the chunks that would be or were stored. With a month only files whose name has it are read, which needs dry_run.
        """
        if from_month is not None and not dry_run:
            raise ValueError("from_month needs dry_run")
        base = self.snapshots.current()[0]
        kept = Kept(self.spark)
        now, old, resets, committed, ends = self._folded(path, kept, from_month)
        new = self._numbered(logs.parts(now)).unionByName(self._numbered(old))
        new = sessions.reindex(self._distinct(new))
        if dry_run:
            return new
        try:
            seen = logs.observations(now)
            vectors = old.where("embedding IS NOT NULL").select("external_id", "embedding").join(new.select("id", "external_id"), "external_id").select("id", "embedding")
            epochs = checkpoints.raised_epochs(self.spark.createDataFrame([], checkpoints.EPOCHS), resets)
            receipts = self.table("receipts").join(committed.select("tx_id"), "tx_id", "left_anti")
            self.save(new, base, vectors=vectors, observations=seen, resolutions=executions.resolutions(seen), heads=now.select(*names(checkpoints.HEADS)), epochs=epochs, committed=committed, receipts=receipts, log_state=ends)
        finally:
            kept.clear()
        return self.chunks()

    def truncate(self) -> None:
        """Empties the derived tables; what is needed for checkpoints, and the maintenance log, stay."""
        self._commit(self.snapshots.current()[0], **dict.fromkeys(DERIVED))

    # --- checkpoints

    def commit(self, candidates: DataFrame, path: str, as_of: datetime, resets: DataFrame | None = None, cursors: DataFrame | None = None) -> DataFrame:
        """Turn candidates (checkpoints.CANDIDATE) to the log below path and to the tables; -> session, turn_key, revision, status of each.

        resets (session, reason) start a new epoch: the session's other chunks and observations go. What an earlier commit left half done is
        recovered first. Pending prompts of a session, and its cursor (runtime, session, cursor), are settled if none of its candidates is stale or in conflict.
        """
        if self.table("receipts").limit(1).count():
            self.recover_prepared(path)
        base = self.snapshots.current()[0]
        resets = self.spark.createDataFrame([], "session string, reason string") if resets is None else resets
        decided = checkpointed(checkpoints.decide(candidates, resets, self.table("heads"), self.table("epochs"), self.config.chunking.max_tokens))
        raised = resets.join(self.table("epochs"), "session", "left").select("session", (F.coalesce("history_epoch", F.lit(0)) + 1).cast("int").alias("history_epoch"), "reason")
        found = checkpointed(checkpoints.receipts(decided, raised, as_of.isoformat(timespec="milliseconds") + "Z"))
        self._prepare(base, found)
        self._append(found, path, as_of)
        turns = decided.where("status = 'inserted'")
        fine = decided.groupBy("session").agg(F.every(F.col("status").isin("inserted", "already_current")).alias("fine")).where("fine").select("session")
        settled = decided.join(fine, "session", "left_semi").select("runtime", "session", "pending_key")
        changes = {}
        if "pending" in self.snapshots.current()[1]:
            changes["pending"] = (None, settled)
        if cursors is not None:
            own = cursors.join(fine, "session", "left_semi").select(*names(CURSORS))
            changes["cursors"] = (own, own)
        self._apply(base, turns, raised, found.select("tx_id", "digest"), found, **changes)
        return decided.select("session", "turn_key", "revision", "status")

    def _prepare(self, base: int, found: DataFrame) -> None:
        """Receipts are stored before anything is written to the log."""
        self._change(base, None, receipts=(found, None))

    def _append(self, found: DataFrame, path: str, as_of: datetime) -> None:
        """Frames of transactions that were not committed yet, each as one piece of a file of the month. An id that was committed with another digest is an error."""
        new = found.join(self.table("committed").withColumnRenamed("digest", "said"), "tx_id", "left")
        if new.where("said <> digest").limit(1).count():
            raise ValueError("a committed transaction has another digest")
        new.where("said IS NULL").select(F.array_join("lines", "\n").alias("value"), F.lit(as_of.strftime("%Y-%m")).alias("year_month")).write.mode("append").partitionBy("year_month").text(path)

    def _apply(self, base: int, turns: DataFrame, resets: DataFrame, committed: DataFrame, receipts: DataFrame | None = None, legacy: DataFrame | None = None, by_revision: bool = False, **others: tuple[DataFrame | None, DataFrame | None]) -> None:
        """Committed turns and resets to the tables of their sessions, in one commit that settles the receipts (tx_id).

        legacy: version 1 records, which replace those of their ids. by_revision: a turn's highest epoch and revision count, as a rebuild has it, whatever its boundary.
        """
        again = checkpointed(resets.select("session").distinct())
        touched = turns.select("session").unionByName(again)
        if legacy is not None:
            # A session that was ever reset has no version 1 records.
            epochs = self.table("epochs").where("history_epoch > 0").select("session").unionByName(again)
            records = legacy.join(epochs, "session", "left_anti")
            legacy = self._numbered(records)
            touched = touched.unionByName(legacy.select("session"))
            vectors = records.where("embedding IS NOT NULL").select("external_id", "embedding").join(legacy.select("id", "external_id"), "external_id").select("id", "embedding")
        touched = checkpointed(touched.distinct())
        before = store.baseline(self.table("heads", touched), again)
        heads, errors = checkpoints.advance(before, turns)
        if bad := errors.limit(1).collect():
            raise ValueError(f"turn {bad[0]['turn_key']}: {bad[0]['message']}")
        chunks, seen = self.table("chunks", touched), self.table("observations", touched)
        stored = store.turn_state(chunks.where("turn_key IS NOT NULL").join(again, "session", "left_anti"), "observed_through")
        if by_revision:
            place = ["session", "turn_key", "history_epoch", "revision", "content_hash"]
            moved = heads.select(*place).join(before.select(*place), place, "left_anti")
            won = checkpointed(log.latest_revisions(turns).join(moved, place, "left_semi"))
        else:
            won = checkpointed(store.checkpoint_decision(turns, stored).where("status = 'inserted'").drop("status"))
        kept = store.baseline(chunks, again).join(won.select("session", "turn_key"), ["session", "turn_key"], "left_anti")
        new = self._numbered(logs.parts(won))
        if legacy is not None:
            kept = kept.join(legacy.select("external_id"), "external_id", "left_anti")
            new = new.unionByName(legacy)
        mine = self._distinct(sessions.reindex(kept.unionByName(new)))
        seen = checkpointed(executions.replace_turn(store.baseline(seen, again), logs.observations(won), won))
        changes = {
            "observations": (seen, touched),
            "resolutions": (executions.resolutions(seen), touched),
            "heads": (heads, touched),
            "epochs": (checkpoints.raised_epochs(self.table("epochs", again), resets), again),
            "committed": (committed.dropDuplicates(["tx_id"]).join(self.table("committed").select("tx_id"), "tx_id", "left_anti"), None),
        }
        if receipts is not None:
            changes["receipts"] = (None, receipts)
        self._replace(base, touched, mine, None if legacy is None else vectors, **(changes | others))

    def recover_prepared(self, path: str) -> DataFrame:
        """Receipts that a crash left -> tx_id, result, reason; transactions that the log has are applied to the tables, and all receipts are settled."""
        base = self.snapshots.current()[0]
        found = self.table("receipts")
        frames = self.spark.createDataFrame([], "file string, tx_id string, created_at string, begin_offset long, digest string, payloads array<string>")
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            frames = log.one_payload_each(logs.read_frames(self.spark, path)[0])[0]
        mine = checkpointed(frames.join(found.select("tx_id").distinct(), "tx_id", "left_semi"))
        judged = checkpointed(checkpoints.judged(found, mine.select("tx_id", "digest"), self.table("heads"), self.table("epochs")))
        good = mine.join(judged.where("result = 'finalized'").select("tx_id"), "tx_id", "left_semi")
        turns, resets = logs.payloads(good)
        keys = found.join(good.select("tx_id"), "tx_id", "left_semi").select("session", F.explode("pending_keys").alias("pending_key"))
        self._apply(base, turns, resets, good.select("tx_id", "digest"), found, pending=(None, self.table("pending").join(keys, ["session", "pending_key"], "left_semi")))
        return judged

    def capture_prompts(self, prompts: DataFrame) -> None:
        """Pending prompts (pending.PENDING) to the store; a key that is there already is replaced."""
        key = ["runtime", "session", "pending_key"]
        new = prompts.dropDuplicates(key)
        self._change(self.snapshots.current()[0], None, pending=(new, new))

    def save_answers(self, stops: DataFrame, path: str, as_of: datetime) -> DataFrame:
        """Answers (as pending.pair_answers takes them) paired with the pending prompts and committed."""
        return self.commit(pending.pair_answers(self.table("pending"), stops), path, as_of)

    def stream_checkpoints(self, stream: DataFrame, path: str, as_of: Callable[[], datetime]):
        """A writer that commits each micro-batch of candidates; a batch that is run again changes nothing, as its turns are current by then."""
        return stream.writeStream.foreachBatch(lambda batch, _: self.commit(batch, path, as_of()) and None)

    # --- search

    def search(self, query: str, as_of: datetime, project: str | None = None, limit: int = 50) -> DataFrame:
        return search.rank(self._candidates(query, project, limit), as_of, self.config.search.half_life_days, query).orderBy(F.desc("score"), "id")

    def index(self) -> None:
        """Stores the postings of all chunks, which later searches read instead of all contents, and which later changes of chunks add to."""
        self._commit(self.snapshots.current()[0], postings=postings.build(self.chunks()))

    def _candidates(self, query: str, project: str | None, limit: int, query_vector: list[float] | None = None) -> DataFrame:
        c = self.chunks()
        index = self.table("postings") if self._indexed() else None
        hits = search.search_fts(c, query, project, limit, all_projects=self.config.search.project_scope != True, index=index)  # noqa: E712
        if query_vector is not None:
            scoped = self.config.search.project_scope == True and project is not None  # noqa: E712
            mine = c.where(F.col("project") == project) if scoped else c
            near = search.knn(self.table("vectors").join(mine.select("id"), "id", "left_semi"), query_vector, limit)
            pos = F.row_number().over(search.Window.orderBy("distance", "id"))
            hits = search.rrf(hits, near.withColumn("pos", pos))
        return c.join(F.broadcast(hits.select("id", "rank")), "id")  # limit rows at most, or twice

    def query_vector(self, prompt: str, model: Callable[[Column], Column]) -> list[float] | None:
        """The prompt's vector by a pandas UDF of text, if hybrid search is set and there are vectors; None if the model fails, as full text alone then has to do."""
        if not self.config.search.hybrid or "vectors" not in self.snapshots.current()[1]:
            return None
        made = self.spark.createDataFrame([(prompt,)], "text string").select(model(embedding.query_input(F.col("text"))).alias("v"))
        vector = made.select(embedding.unit(F.col("v")).alias("v"))
        try:
            return vector.first()["v"]
        except PythonException:
            return None

    def recall(self, prompt: str, as_of: datetime, project: str | None = None, query_vector: list[float] | None = None, model: Callable[[Column], Column] | None = None) -> DataFrame:
        """The best chunks for a prompt as one text. With a model and hybrid search, the nearest vectors are fused with the full-text hits."""
        s = self.config.search
        if query_vector is None and model is not None:
            query_vector = self.query_vector(prompt, model)
        tiered = s.project_scope == "tiered"
        cands = checkpointed(self._candidates(prompt, project, s.default_limit * (3 if tiered else 1), query_vector))
        best = search.cascade(cands, as_of, s.default_limit, s.half_life_days, prompt, project, s.cross_project_penalty if tiered else None, s.min_score, tiered)
        return formatting.format_results(best, s.default_limit)

    def inject(self, project: str, n: int = 3) -> DataFrame:
        return formatting.format_results(search.recent(self.chunks(), project, n).withColumn("is_local", F.lit(True)), n)

    def resolutions(self, query: str | None = None, project: str | None = None, limit: int = 50) -> DataFrame:
        return executions.search_resolutions(self.table("resolutions"), query or "", project, limit)

    # --- maintenance

    def merge(self, threshold: float = 0.6, dry_run: bool = False) -> DataFrame:
        base, chunks = self.snapshots.current()[0], self.chunks()
        kept, marked = duplicates.merge(chunks, threshold)
        marked = checkpointed(marked)
        if not dry_run:
            self._drop(base, chunks.select("id", "session").join(kept.select("id"), "id", "left_anti"))
        return marked

    def prune(self, as_of: datetime, days: float) -> None:
        base, old = self.snapshots.current()[0], store.older_than(F.col("created_at"), as_of - timedelta(days=days))
        self._drop(base, self.chunks().where(old))

    def maintain(self, as_of: datetime) -> dict:
        """If it is switched on and due: age, then size, then sessions without chunks, then old snapshots, and a line in the maintenance log.

        -> skipped, reason, and how many chunks, observations, orphaned sessions and bytes of content went.
        """
        m = self.config.maintenance
        if not m.enabled:
            return {"skipped": True, "reason": "disabled"}
        if not store.maintenance_due(self.table("maintenance_log"), as_of, m.interval_hours):
            return {"skipped": True, "reason": "interval"}
        base = self.snapshots.current()[0]
        chunks, seen, named = self.chunks(), self.table("observations"), self.table("sessions")
        before, before_seen = store.measure(chunks, "content"), store.measure(seen, "output_excerpt")
        left, left_seen = chunks, seen
        if m.retention_days is not None:
            cutoff = as_of - timedelta(days=m.retention_days)
            left, left_seen = store.retain(left, cutoff), store.retain(left_seen, cutoff, "completed_at")
        if m.max_bytes is not None:
            left, left_seen, _ = store.evict_to_size(left, left_seen, m.max_bytes)
        left = checkpointed(left)
        live, left_seen = store.drop_orphans(named, left, left_seen)
        left_seen = checkpointed(left_seen)
        after, after_seen = store.measure(left, "content"), store.measure(left_seen, "output_excerpt")
        orphans = named.count() - live.count()
        freed = before[1] + before_seen[1] - after[1] - after_seen[1]
        entry = self.spark.createDataFrame([("auto", before[0] - after[0], freed, as_of)], MAINTENANCE)
        # Sessions that lost chunks or observations are written anew, others stay as they are.
        lost = checkpointed(chunks.select("session", "id").join(left.select("id"), "id", "left_anti").select("session").unionByName(store.orphan_sessions(named, left).select("session")).distinct())
        rest = seen.groupBy("session").agg(F.count("*").alias("n")).join(left_seen.groupBy("session").agg(F.count("*").alias("m")), "session", "left").where("m IS NULL OR m < n").select("session")
        less = checkpointed(lost.unionByName(rest).distinct())
        kept_seen = left_seen.join(less, "session", "left_semi")
        self._replace(base, less, left.join(less, "session", "left_semi"), observations=(kept_seen, less), resolutions=(executions.resolutions(kept_seen), less), maintenance_log=(entry, None))
        self.snapshots.vacuum()
        return {"skipped": False, "reason": None, "chunks_deleted": before[0] - after[0], "observations_deleted": before_seen[0] - after_seen[0], "orphaned_sessions_deleted": orphans, "bytes_freed": freed}

    def edit(self, id_: int, content: str) -> None:
        base = self.snapshots.current()[0]
        touched = checkpointed(store.by_key(self.chunks(), "id", id_).select("session"))
        self._replace(base, touched, store.edit(self.table("chunks", touched), id_, content))

    def delete(self, where: Column) -> None:
        """Chunks go; observations and resolutions of sessions that then have no chunk go too."""
        self._drop(self.snapshots.current()[0], self.chunks().where(where), orphans_too=True)

    # --- reports and exchange

    def sessions(self, project: str | None = None) -> DataFrame:
        return store.list_sessions(self.table("sessions"), project)

    def stats(self, project: str | None = None) -> DataFrame:
        return store.overview(self.chunks(), self.table("sessions"), self.table("observations"), self.table("resolutions"), project).withColumn("bytes", F.lit(self.snapshots.size()))

    def export(self, markdown: bool = False) -> DataFrame:
        return formatting.export_markdown(self.chunks()) if markdown else formatting.export_json(self.chunks())

    def migrate(self, path: str, host: str = "local") -> None:
        logs.append_chunks(self.chunks(), path, host)

    def recover(self, path: str) -> DataFrame:
        return transcripts.recoverable(self.spark, path, self.chunks().select("session").distinct())

    def self_heal(self, path: str, n: int = 100) -> DataFrame:
        base = self.snapshots.current()[0]
        lost = checkpointed(log.self_heal(logs.read_chunks(self.spark, path), self.chunks(), n))
        self._add(base, self._numbered(lost))
        return lost

    def import_foreign(self, s: DataFrame, o: DataFrame, m: DataFrame, project: str | None = None, dry_run: bool = False) -> DataFrame:
        base = self.snapshots.current()[0]
        new, added = foreign.import_foreign(s, o, m, self.chunks().select("session").distinct(), project)
        added = checkpointed(added)
        if not dry_run:
            self._add(base, self._numbered(new))
        return added

    def backfill(self, model: Callable[[Column], Column], dry_run: bool = False) -> dict:
        """Vectors for chunks that lack them, by a pandas UDF of text; dry_run only counts. -> total, processed, skipped."""
        c, have = self.chunks(), self.table("vectors")
        total = embedding.backlog(c, have).count()
        if dry_run or not total:
            return {"total": total, "processed": 0, "skipped": total}
        base = self.snapshots.current()[0]
        new = checkpointed(embedding.backfill(c, have, model))
        self._change(base, None, vectors=(new, new))
        return {"total": total, "processed": total, "skipped": 0}

    def add_vectors(self, rows: DataFrame) -> None:
        """Vectors (id, embedding) of chunks, in place of older ones."""
        base, new = self.snapshots.current()[0], checkpointed(rows.join(self.chunks().select("id"), "id", "left_semi"))
        self._change(base, None, vectors=(new, new))

