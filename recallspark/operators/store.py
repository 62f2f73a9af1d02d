"""The store as immutable tables: reads, statistics, and mutations that return a new snapshot."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed


def by_key(df: DataFrame, column: str, value: object) -> DataFrame:
    return df.where(F.col(column) == F.lit(value))


def list_sessions(sessions: DataFrame, project: str | None = None, limit: int | None = None) -> DataFrame:
    d = sessions if project is None else sessions.where(F.col("project") == project)
    d = d.orderBy(F.col("ended_at").desc_nulls_last(), "session")
    return d if limit is None else d.limit(limit)


def stats(chunks: DataFrame, project: str | None = None) -> DataFrame:
    """Counts of chunks, sessions and projects in one pass; with a project, also its own."""
    mine = F.lit(True) if project is None else F.col("project") == project
    return chunks.agg(F.count("*").alias("chunks"), F.count_distinct("session").alias("sessions"), F.count_distinct("project").alias("projects"), F.count_if(mine).alias("own_chunks"), F.sum(F.length("content")).alias("characters"), F.min("created_at").alias("oldest"), F.max("created_at").alias("newest"))


def missing(wanted: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Rows of wanted whose key is not present: chunks without vectors, external ids to insert, transcripts to recover."""
    return wanted.join(present.select(key).distinct(), key, "left_anti")


def edit(chunks: DataFrame, id_: int, content: str) -> DataFrame:
    return chunks.withColumn("content", F.when(F.col("id") == id_, F.lit(content)).otherwise(F.col("content")))


def replace_sessions(chunks: DataFrame, incoming: DataFrame) -> DataFrame:
    """incoming's sessions lose their chunks and get incoming's."""
    return chunks.join(incoming.select("session").distinct(), "session", "left_anti").unionByName(incoming)


def upsert(table: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    return table.join(incoming.select(*key).distinct(), key, "left_anti").unionByName(incoming)


def append_new(table: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """table with those rows of incoming whose key it doesn't hold yet, one for each key."""
    return table.unionByName(incoming.dropDuplicates(key).join(table.select(*key), key, "left_anti"))


def delete_sessions(table: DataFrame, gone: DataFrame) -> DataFrame:
    return table.join(gone.select("session"), "session", "left_anti")


def orphan_sessions(sessions: DataFrame, chunks: DataFrame) -> DataFrame:
    return sessions.join(chunks.select("session").distinct(), "session", "left_anti")


def older_than(created_at: Column, cutoff: datetime, as_strings: bool = False) -> Column:
    """Instants are compared; as_strings compares texts, where a space sorts before T."""
    return created_at.cast("string") < F.lit(cutoff.isoformat(sep=" ")) if as_strings else created_at.cast("timestamp") < F.lit(cutoff).cast("timestamp")


def retain(rows: DataFrame, cutoff: datetime, made: str = "created_at") -> DataFrame:
    """Rows that are not older than the cutoff; those without a time stay."""
    return rows.where(~F.coalesce(older_than(F.col(made), cutoff), F.lit(False)))


def drop_orphans(sessions: DataFrame, chunks: DataFrame, observations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """sessions that have chunks, and observations without those of sessions that are stored and have none."""
    gone = orphan_sessions(sessions, chunks).select("session")
    return delete_sessions(sessions, gone), delete_sessions(observations, gone)


def baseline(rows: DataFrame, sessions: DataFrame) -> DataFrame:
    """rows without those of sessions, which start anew."""
    return rows.join(sessions.select("session"), "session", "left_anti")


def replace_baseline(chunks: DataFrame, observations: DataFrame, sessions: DataFrame, parts: DataFrame, seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """chunks and observations where all rows of sessions are replaced by parts and seen."""
    return baseline(chunks, sessions).unionByName(parts.join(sessions.select("session"), "session", "left_semi")), baseline(observations, sessions).unionByName(seen.join(sessions.select("session"), "session", "left_semi"))


def measure(rows: DataFrame, content: str) -> tuple[int, int]:
    """Rows, and bytes of the column."""
    r = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(content)), F.lit(0))).first()
    return r[0], r[1]


def overview(chunks: DataFrame, sessions: DataFrame, observations: DataFrame, resolutions: DataFrame, project: str | None = None) -> DataFrame:
    """One row: stats of the chunks, stored sessions, observations with and without a known status, and resolutions. Each table gives one row to the join."""
    known = F.col("status") != "unknown"
    seen = observations.agg(F.count_if(known).alias("explicit_observations"), F.count_if(~known).alias("unknown_observations"))
    found = resolutions.agg(F.count("*").alias("resolutions"))
    return stats(chunks, project).crossJoin(sessions.agg(F.count("*").alias("stored_sessions"))).crossJoin(seen).crossJoin(found)


def _aged(rows: DataFrame, n: int, made: str = "created_at", key: tuple[str, ...] = ("id",)) -> tuple[DataFrame, DataFrame]:
    """The n oldest rows, and the rest; nulls are oldest, and the key orders equal times. Rows are counted by day, and only the day where the n-th falls is put in order row by row."""
    day = F.substring(made, 1, 10) if dict(rows.dtypes)[made] == "string" else F.to_date(made).cast("string")
    d = rows.withColumn("_day", F.coalesce(day, F.lit("")))
    days = d.groupBy("_day").agg(F.count("*").alias("_count"))
    before = F.sum("_count").over(Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1))  # a row a day
    d = d.join(days.withColumn("_before", F.coalesce(before, F.lit(0))), "_day")
    start, end = F.col("_before"), F.col("_before") + F.col("_count")
    edge = d.where((start < n) & (end > n)).withColumn("_rank", F.row_number().over(Window.partitionBy("_day").orderBy(made, *key)))
    both = lambda whole, part: whole.select(*rows.columns).unionByName(part.select(*rows.columns))
    return both(d.where(end <= n), edge.where(start + F.col("_rank") <= n)), both(d.where(start >= n), edge.where(start + F.col("_rank") > n))


def oldest(chunks: DataFrame, n: int) -> DataFrame:
    return _aged(chunks, n)[0]


def evict_oldest(chunks: DataFrame, n: int) -> DataFrame:
    return _aged(chunks, n)[1]


#: What tells an observation from all others.
OBSERVATION = ("runtime", "session", "turn_key", "execution_index")


def evict_to_size(chunks: DataFrame, observations: DataFrame, most_bytes: int, rounds: int = 10) -> tuple[DataFrame, DataFrame, int]:
    """While both hold more than most_bytes, at most `rounds` times, the oldest tenth (rounded up) of the larger table goes, of chunks if they are as large.

    Rounds go over keys, times and sizes alone; only counts and sizes come to the driver.
    """
    key = ("id",) if "id" in observations.columns else OBSERVATION
    thin = lambda d, content, *columns: checkpointed(d.select(*columns, F.octet_length(content).alias("bytes")))
    total = lambda d: tuple(d.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first())
    c, o = thin(chunks, "content", "id", "created_at"), thin(observations, "output_excerpt", *key, "completed_at")
    (n, a), (m, b), done = total(c), total(o), 0
    while done < rounds and a + b > most_bytes and n + m > 0:
        if n >= m:
            c = checkpointed(_aged(c, -(-n // 10))[1])
            n, a = total(c)
        else:
            o = checkpointed(_aged(o, -(-m // 10), "completed_at", key)[1])
            m, b = total(o)
        done += 1
    if not done:
        return chunks, observations, 0
    return chunks.join(c.select("id"), "id", "left_semi"), observations.join(o.select(*key), list(key), "left_semi"), done


def fitting(chunks: DataFrame, most_bytes: int, days: str = "created_at") -> DataFrame:
    """The newest chunks that fit into most_bytes, in one pass: sizes are summed by day first, and only the day where the limit falls is put in order row by row."""
    size = F.octet_length("content").cast("long")
    d = chunks.withColumn("_day", F.to_date(days)).withColumn("_size", size)
    by_day = d.groupBy("_day").agg(F.sum("_size").alias("_sum"))
    running = by_day.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.orderBy(F.desc("_day")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    near = d.join(running.where(F.col("_before") < most_bytes), "_day")
    whole = near.where(F.col("_before") + F.col("_sum") <= most_bytes)
    edge = near.where(F.col("_before") + F.col("_sum") > most_bytes)
    kept = edge.withColumn("_through", F.col("_before") + F.sum("_size").over(Window.partitionBy("_day").orderBy(F.desc(days), F.desc("id")))).where(F.col("_through") <= most_bytes)
    cols = chunks.columns
    return whole.select(*cols).unionByName(kept.select(*cols))


def checkpoint_decision(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """incoming and stored (session, turn_key, history_epoch, revision, content_hash, observed_through) -> incoming with status inserted, already_current, stale or conflict."""
    from ..functions.text import compare_boundary

    s = stored.select("session", "turn_key", F.struct("history_epoch", "revision", "content_hash", "observed_through").alias("old"))
    d = incoming.join(s, ["session", "turn_key"], "left")
    old, cmp = F.col("old"), compare_boundary(F.col("observed_through"), F.col("old.observed_through"))
    status = (
        F.when(old.isNull(), "inserted")
        .when(old["history_epoch"] > F.col("history_epoch"), "stale")
        .when(cmp == "older", "stale")
        .when(cmp == "incomparable", "conflict")
        .when(F.col("revision") < old["revision"], "stale")
        .when(F.col("revision") > old["revision"], "inserted")
        .when(F.col("content_hash") == old["content_hash"], "already_current")
        .otherwise("conflict")
    )
    return d.withColumn("status", status).drop("old")


def apply_checkpoints(parts: DataFrame, incoming_parts: DataFrame, decided: DataFrame) -> DataFrame:
    """Stored parts with those of the turns that were decided as inserted replaced by the incoming ones."""
    turn = ["session", "turn_key"]
    won = decided.where("status = 'inserted'").select(*turn)
    return parts.join(won, turn, "left_anti").unionByName(incoming_parts.join(won, turn, "left_semi"))


def turn_state(turns: DataFrame, *more: str) -> DataFrame:
    """One row a turn: its highest epoch and revision, and more columns of that row."""
    return turns.groupBy("session", "turn_key").agg(F.max_by(F.struct("history_epoch", "revision", "content_hash", *more), F.struct("history_epoch", "revision")).alias("x")).select("session", "turn_key", "x.*")


def maintenance_due(log: DataFrame, as_of: datetime, interval_hours: float) -> bool:
    last = log.agg(F.max("executed_at")).first()[0]
    return last is None or (as_of - last).total_seconds() >= interval_hours * 3600
