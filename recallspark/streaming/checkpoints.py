"""Turn checkpoints as a stream: stateful processors with values, maps and timers, and an idempotent append to the log."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: State stores that keep maps and timers.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Groups that keys are dealt to by hash. The state of a group's keys is one value, which is read and written once a micro-batch that has rows of it.
SHARDS = 256


class _InOrder(StatefulProcessor):
    """Takes the rows of a key within a micro-batch in order; step(key, row) -> rows. State is read and written a key of a map at a time."""

    order: tuple[str, ...] = ()
    columns: tuple[str, ...] = ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def begin(self) -> None:
        pass

    def end(self) -> None:
        pass

    def step(self, key: tuple, r: object) -> list[tuple]:
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows)).sort_values(list(self.order), kind="stable")
        self.begin()
        out = [x for r in batch.itertuples(index=False) for x in self.step(key, r)]
        self.end()
        if out:
            yield pd.DataFrame(out, columns=list(self.columns))

    def close(self) -> None:
        pass


def _stateful(stream: DataFrame, key: list[str], processor: _InOrder, out: str, mode: str = "none") -> DataFrame:
    """The processor over a stream. The session's state stores become RocksDB, which maps and timers need."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    processor.columns = tuple(f.strip().split()[0] for f in out.split(","))
    return stream.groupBy(*key).transformWithStateInPandas(processor, out, "append", mode)


class _InShards(_InOrder):
    """Takes the rows of all keys of a shard in order; turn(row) -> the output's row. self.now has the state of each key: state by call for each of many small keys would cost more than the rows do."""

    def init(self, handle):
        self.held = handle.getValueState("held", "json string")

    def begin(self):
        self.now = {tuple(k): v for k, v in json.loads(self.held.get()[0])} if self.held.exists() else {}

    def end(self):
        self.held.update((json.dumps(list(self.now.items())),))

    def turn(self, r: object) -> tuple:
        raise NotImplementedError

    def step(self, key, r):
        return [self.turn(r)]


def _in_shards(stream: DataFrame, key: list[str], processor: _InShards, out: str) -> DataFrame:
    shard = F.pmod(F.xxhash64(*key), F.lit(SHARDS)).cast("int")
    return _stateful(stream.withColumn("shard", shard), ["shard"], processor, out)


class _Decide(_InShards):
    order = ("history_epoch", "generation", "offset", "revision")

    def turn(self, r):
        key, new = (r.session, r.turn_key), _head(r)
        status = status_of(new, self.now.get(key))
        if status == "inserted":
            self.now[key] = new
        return (*key, new[0], new[1], new[2], status)


def decide(stream: DataFrame) -> DataFrame:
    """stream (session, turn_key, history_epoch, revision, content_hash, generation, offset) -> each row with status inserted, already_current, stale or conflict.

    State holds the head of each turn. Within a micro-batch rows of a turn are taken in order of epoch, generation, offset and revision.
    """
    return _in_shards(stream, ["session", "turn_key"], _Decide(), "session string, turn_key string, history_epoch int, revision int, content_hash string, status string")


def _head(r: object) -> tuple:
    return int(r.history_epoch), int(r.revision), r.content_hash, int(r.generation), int(r.offset)


def status_of(new: tuple, head: tuple | None) -> str:
    head = None if head is None else tuple(head)
    if head is None:
        return "inserted"
    if new[0] < head[0] or new[3:] < head[3:] or new[1] < head[1]:
        return "stale"
    if new[1] > head[1]:
        return "inserted"
    return "already_current" if new[2] == head[2] else "conflict"


def commit_batch(spark: SparkSession, log_path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: appends a batch of (tx_id, no, digest, line) once, no being the line's place in its transaction.

    Each batch has a folder of lines and one of ids, which a second run of the batch replaces. Transactions of other batches are left out, seen from their ids alone; an id with
    another digest, in the batch or before it, is an error.
    """
    ids_path = f"{log_path.rstrip('/')}-ids"

    def commit(batch: DataFrame, batch_id: int) -> None:
        own = batch.dropDuplicates(["tx_id", "no", "digest"])
        jvm = spark._jvm.org.apache.hadoop.fs.Path(ids_path)
        if jvm.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm):
            have = spark.read.parquet(ids_path).where(F.col("batch") != batch_id).select("tx_id", F.col("digest").alias("old"))
            own = own.join(have, "tx_id", "left")
        else:
            own = own.withColumn("old", F.lit(None).cast("string"))
        bad = own.groupBy("tx_id").agg(F.count_distinct("digest").alias("digests"), F.count_if(F.col("old") != F.col("digest")).alias("others")).where("digests > 1 OR others > 0")
        if bad.limit(1).count():
            raise ValueError(f"batch {batch_id}: a transaction id has two digests")
        new = own.where("old IS NULL").drop("old")
        new.write.mode("overwrite").parquet(f"{log_path.rstrip('/')}/batch={batch_id}")
        new.select("tx_id", "digest").distinct().write.mode("overwrite").parquet(f"{ids_path}/batch={batch_id}")

    return commit


class _Numbers(_InOrder):
    order = ("pending_key",)

    def init(self, handle):
        self.known, self.last = handle.getMapState("known", "pending_key string", "n long"), handle.getValueState("last", "n long")

    def step(self, key, r):
        own = (r.pending_key,)
        if self.known.containsKey(own):
            return [(*key, r.pending_key, self.known.getValue(own)[0])]
        n = 1 + (self.last.get()[0] if self.last.exists() else 0)
        self.known.updateValue(own, (n,))
        self.last.update((n,))
        return [(*key, r.pending_key, n)]


def sequences(stream: DataFrame) -> DataFrame:
    """stream (runtime, session, pending_key) -> each row with its sequence in the session from 1 on; a key that comes again keeps its number. State is a map from keys to numbers."""
    return _stateful(stream, ["runtime", "session"], _Numbers(), "runtime string, session string, pending_key string, sequence long")


class _Deliveries(_InOrder):
    order = ("event",)

    def init(self, handle):
        self.last = handle.getValueState("last", "n long")

    def step(self, key, r):
        n = 1 + (self.last.get()[0] if self.last.exists() else 0)
        self.last.update((n,))
        return [(*key, r.event, n)]


def delivery_sequences(stream: DataFrame) -> DataFrame:
    """stream (runtime, session, event) -> each row with the next number of the session, also where an event comes again."""
    return _stateful(stream, ["runtime", "session"], _Deliveries(), "runtime string, session string, event string, sequence long")


class _Resets(_InShards):
    """The state of a session is its epoch, and the heads of its turns."""

    order = ("history_epoch", "kind", "generation", "offset", "revision")

    def begin(self):
        super().begin()
        self.now = {k: (epoch, dict(heads)) for k, (epoch, heads) in self.now.items()}

    def end(self):
        self.now = {k: (epoch, list(heads.items())) for k, (epoch, heads) in self.now.items()}
        super().end()

    def turn(self, r):
        own = int(r.history_epoch)
        epoch, heads = self.now.get((r.session,), (0, {}))
        row = lambda status: (r.session, r.kind, r.turn_key, own, status)
        if r.kind == "reset":
            if own <= epoch:
                return row("stale")
            self.now[(r.session,)] = (own, {})
            return row("reset")
        if own < epoch:
            return row("stale")
        new = _head(r)
        status = status_of(new, heads.get(r.turn_key))
        if status == "inserted":
            heads[r.turn_key] = new
            self.now[(r.session,)] = (epoch, heads)
        return row(status)


def decide_with_resets(stream: DataFrame) -> DataFrame:
    """stream (session, kind, turn_key, history_epoch, revision, content_hash, generation, offset), kind being turn or reset -> each row with its status.

    A reset to a higher epoch forgets the session's heads, and rows of lower epochs are stale from then on; its status is reset, or stale for a lower epoch.
    """
    # A reset needs no place; a null would make numbers of 64 bits floats.
    placed = stream.withColumns({c: F.when(F.col("kind") == "reset", F.coalesce(c, F.lit(0).cast(stream.schema[c].dataType))).otherwise(F.col(c)) for c in ("generation", "offset", "revision")})
    return _in_shards(placed, ["session"], _Resets(), "session string, kind string, turn_key string, history_epoch int, status string")


class _Failures(_InOrder):
    order = ("history_epoch", "source_order", "execution_index")

    def init(self, handle):
        self.held = handle.getValueState("failures", "n long, first string, last string, excerpt string")

    def step(self, key, r):
        n, first, last, excerpt = self.held.get() if self.held.exists() else (0, "", "", "")
        if r.status == "failed":
            self.held.update((n + 1, first if n else r.turn_key, r.turn_key, r.output_excerpt))
        elif r.status == "succeeded" and n:
            self.held.clear()
            return [(*key, n, first, last, excerpt, r.turn_key)]
        return []


def resolutions(stream: DataFrame) -> DataFrame:
    """stream of observations (runtime, project, session, command, history_epoch, source_order, execution_index, turn_key, status, output_excerpt) -> a row for each success that ends failures of its command.

    State holds the pending failures of a command: their number, the first and last turn, and the last output; a success removes it.
    """
    out = "runtime string, project string, session string, command string, failure_count long, first_failure_turn string, last_failure_turn string, failure_excerpt string, success_turn string"
    return _stateful(stream, ["runtime", "project", "session", "command"], _Failures(), out)


class _Pairs(_InOrder):
    order = ("at",)
    wait = 0  # milliseconds that a prompt waits; 0: for ever

    def init(self, handle):
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "pending_key string", "source_order string, turn_id string, text string, until long")

    def begin(self):
        """The session's waiting prompts, read once a micro-batch; end() writes what has changed."""
        self.now = {k[0]: tuple(v) for k, v in self.waiting.iterator()}
        self.before = dict(self.now)

    def end(self):
        for k in self.before.keys() - self.now.keys():
            self.waiting.removeKey((k,))
        for k, v in self.now.items():
            if self.before.get(k) != v:
                self.waiting.updateValue((k,), v)

    def step(self, key, r):
        if r.kind == "prompt":
            until = int(r.ts.value // 1_000_000) + self.wait if self.wait else 0
            if until:
                self.handle.registerTimer(until)
            self.now[r.pending_key] = (r.source_order, r.turn_id, r.text, until)
            return []
        answer = (r.text or "").strip()
        own = [k for k, v in self.now.items() if r.turn_id and v[1] == r.turn_id] or sorted(self.now, key=lambda k: (self.now[k][0], k))[-1:]
        if not answer or not own:
            return [(*key, r.turn_id, "deferred", None, None, answer or None)]
        own = min(own, key=lambda k: (self.now[k][0], k))
        prompt = self.now.pop(own)
        return [(*key, r.turn_id, "ready", own, prompt[2], answer)]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        self.begin()
        at = expiredTimerInfo.getExpiryTimeInMs()
        late = sorted(k for k, v in self.now.items() if v[3] and v[3] <= at)
        out = [(*key, self.now[k][1], "expired", k, self.now[k][2], None) for k in late]
        for k in late:
            del self.now[k]
        self.end()
        if out:
            yield pd.DataFrame(out, columns=list(self.columns))


def pair_answers(stream: DataFrame, wait: str | None = None, late: str = "1 minute") -> DataFrame:
    """stream (runtime, session, at, kind, turn_id, pending_key, source_order, text), kind being prompt or stop -> a row for each stop: ready with its prompt, or deferred.

    A stop takes the waiting prompt with its turn_id, else the last one in order of source_order, which then waits no more. A stop without text or prompt is deferred.
    A prompt whose pending_key is waiting replaces it. wait (an interval): the stream also has ts, a prompt that waited so long by the watermark, which is `late` behind, is
    given up with a row `expired`, and rows that come after the watermark count for nothing. Without it prompts wait for ever.
    """
    out = "runtime string, session string, turn_id string, status string, pending_key string, prompt string, answer string"
    if wait is None:
        return _stateful(stream, ["runtime", "session"], _Pairs(), out)
    timed = _Pairs()
    timed.wait = int(pd.Timedelta(wait).total_seconds() * 1000)
    return _stateful(stream.withWatermark("ts", late), ["runtime", "session"], timed, out, "eventTime")


def sessions_of(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Event-time sessions of a stream (user_id, ts): start, end and count, once the watermark has passed them."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("events")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")
