import json
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from recallspark import cli
from recallspark.config import Config, merged
from recallspark.operators import log
from recallspark.plans import checkpoints as plans
from recallspark.plans.engine import MemoryEngine
from recallspark.plans.snapshots import Conflict, Snapshots
from recallspark.sources import logs, pending
from recallspark.streaming import checkpoints
from tests.test_operators import frame, turn

NOW = datetime(2026, 3, 1)


def test_commands(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    v1 = [json.dumps({"v": 1, "type": "chunk", "id": f"x{i}", "sessionId": f"s{i % 3}", "projectPath": "/p/one", "chunkIndex": i, "content": f"the parser failed with error {i}" if i % 2 else f"all about gardens {i}", "role": "human", "metadata": None, "tokenCount": 5, "createdAt": f"2026-01-{i + 1:02d}T00:00:00Z"}) for i in range(20)]
    (log / "2026-01.jsonl").write_text("\n".join([*v1, *frame("a", [turn("a", "k1")])]) + "\n")
    e = MemoryEngine(spark, str(tmp_path / "store"))
    assert e.rebuild(str(log), dry_run=True).count() == 21 and e.chunks().count() == 0
    e.rebuild(str(log))
    assert e.chunks().count() == 21 and e.stats().first()["sessions"] == 4
    assert e.search("parser error", NOW).first()["content"].startswith("the parser")
    assert e.recall("parser error", NOW, "/p/one").first()["text"].startswith("[Mem]\n[2026-01-")
    assert e.inject("/p/one", 2).first()["text"].count("s=") == 2
    assert e.sessions().count() == 4 and e.export().select("session").distinct().count() == 4
    e.prune(NOW, 50)
    assert e.chunks().count() < 21
    lost = e.self_heal(str(log), 100).count()
    assert lost > 0 and e.chunks().where("external_id LIKE 'x%'").count() == 20
    first = e.chunks().first()["id"]
    e.edit(first, "edited")
    assert e.chunks().where(F.col("content") == "edited").count() == 1
    e.delete(F.col("session") == "s0")
    assert e.chunks().where("session = 's0'").count() == 0
    e.migrate(str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == e.chunks().count()
    e.truncate()
    assert e.chunks().count() == e.sessions().count() == 0
    with pytest.raises(ValueError):
        e.rebuild(str(log), from_month="2026-01")
    assert e.rebuild(str(log), dry_run=True, from_month="2026-01").count() == 21
    with pytest.raises(FileNotFoundError):
        e.rebuild(str(log), dry_run=True, from_month="2027-01")


def test_damaged_log_stops_a_rebuild(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text("\n".join(frame("a", [turn("a", "k")], digest="x")) + "\n")
    with pytest.raises(ValueError):
        MemoryEngine(spark, str(tmp_path / "store")).rebuild(str(tmp_path / "l.jsonl"))


def test_stream_decides_as_the_rules_say(spark, tmp_path):
    kind = "session string, turn_key string, history_epoch int, revision int, content_hash string, generation long, offset long"
    rows = [("s", "k", 0, 0, "a", 0, 1), ("s", "k", 0, 0, "a", 0, 1), ("s", "k", 0, 0, "b", 0, 1), ("s", "k", 0, 1, "b", 0, 2), ("s", "k", 0, 0, "a", 0, 1), ("t", "k", 0, 0, "a", 0, 1)]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], kind).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = checkpoints.decide(stream).writeStream.format("memory").queryName("decided").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(r["status"] for r in spark.table("decided").collect())
    head, want = {}, []
    for s, k, e, v, h, g, o in rows:
        new = (e, v, h, g, o)
        status = checkpoints.status_of(new, head.get((s, k)))
        want.append(status)
        if status == "inserted":
            head[s, k] = new
    assert got == sorted(want) == sorted(["inserted", "already_current", "conflict", "inserted", "stale", "inserted"])


def test_append_is_idempotent(spark, tmp_path):
    commit = checkpoints.commit_batch(spark, str(tmp_path / "log"))
    batch = lambda *rows: spark.createDataFrame(pd.DataFrame(rows, columns=["tx_id", "no", "digest", "line"]))
    commit(batch(("a", 0, "1", "x"), ("a", 0, "1", "x"), ("a", 1, "1", "x2")), 0)
    commit(batch(("a", 0, "1", "x"), ("b", 0, "2", "y")), 1)
    commit(batch(("a", 0, "1", "x"), ("b", 0, "2", "y")), 1)  # the batch is run again
    assert sorted((r["tx_id"], r["no"]) for r in spark.read.parquet(str(tmp_path / "log")).collect()) == [("a", 0), ("a", 1), ("b", 0)]
    for wrong in (batch(("a", 0, "9", "z")), batch(("c", 0, "1", "z"), ("c", 1, "2", "z"))):
        with pytest.raises(ValueError):
            commit(wrong, 2)


def test_snapshots_appear_at_once(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path / "store"))
    rows = lambda *x: spark.createDataFrame([(i,) for i in x], "i long")
    read = lambda name: sorted(r["i"] for r in s.read(name, "i long").collect())
    assert s.current() == (0, {}) and read("a") == []
    assert s.commit(0, a=rows(1), b=rows(2)) == 1
    assert s.commit(1, a=rows(3)) == 2 and (read("a"), read("b")) == ([3], [2])
    with pytest.raises(Conflict):  # a writer that began with manifest 1
        s.commit(1, a=rows(4))
    assert (read("a"), read("b")) == ([3], [2])
    s.write("a", rows(9))  # a crash before the manifest
    assert read("a") == [3]
    s.commit(2, b=None)
    assert read("b") == [] and s.size() > 0
    assert s.vacuum(1) == 4 and (read("a"), read("b")) == ([3], [])
    for f in (tmp_path / "store").glob("manifest-*"):
        f.unlink()
    with pytest.raises(ValueError):
        s.current()


def candidates(spark, *rows):
    """(session, turn_key, offset, prompt, assistant), with executions for prompts that are statuses."""
    made = []
    for session, key, offset, prompt, assistant in rows:
        run = [(0, "sh", "make", prompt, None, "out")] if prompt in ("failed", "succeeded") else []
        made.append(("claude", session, "/p", key, f"{offset:020d}", ("source_offset", 0, offset, None), "2026-01-01T00:00:00Z", prompt, assistant, [], run, f"k-{key}", None))
    return spark.createDataFrame(made, plans.CANDIDATE)


def statuses(df):
    return {r["turn_key"]: (r["status"], r["revision"]) for r in df.collect()}


def test_checkpoints_are_committed_once(spark, tmp_path):
    e, path = MemoryEngine(spark, str(tmp_path / "store")), str(tmp_path / "log")
    first = candidates(spark, ("s", "a", 1, "failed", "x"), ("s", "b", 2, "succeeded", "y"), ("t", "a", 1, "hello", "z"))
    assert set(statuses(e.commit(first, path, NOW)).values()) == {("inserted", 1)}
    assert set(statuses(e.commit(first, path, NOW)).values()) == {("already_current", 1)}
    assert (e.chunks().count(), e.sessions().count(), e.table("observations").count()) == (3, 2, 2)
    assert [r["success_turn"] for r in e.resolutions().collect()] == ["b"]
    again = candidates(spark, ("s", "a", 0, "failed", "old"), ("s", "b", 3, "succeeded", "newer"))
    assert statuses(e.commit(again, path, NOW)) == {"a": ("stale", 1), "b": ("inserted", 2)}
    other = again.where("turn_key = 'a'").withColumn("observed_through", F.struct(F.lit("delivery_sequence").alias("kind"), F.lit(None).cast("long").alias("generation"), F.lit(None).cast("long").alias("offset"), F.lit(9).cast("long").alias("sequence")))
    assert statuses(e.commit(other, path, NOW)) == {"a": ("conflict", 1)}
    twice = candidates(spark, ("t", "a", 5, "hello", "p"), ("t", "a", 6, "hello", "q"))
    assert sorted(r["status"] for r in e.commit(twice, path, NOW).collect()) == ["inserted", "stale"]
    assert {r["content"].split("\n")[-1] for r in e.chunks().collect()} == {"x", "newer", "q"}
    # The log alone gives the same tables.
    f = MemoryEngine(spark, str(tmp_path / "again"))
    f.rebuild(path)
    for name in ("chunks", "sessions", "observations", "resolutions", "heads", "epochs", "committed"):
        columns = [c for c in e.table(name).columns if c != "id"]
        assert sorted(map(str, e.table(name).select(*columns).collect())) == sorted(map(str, f.table(name).select(*columns).collect())), name
    assert f.commit(twice.where("assistant = 'q'"), path, NOW).first()["status"] == "already_current"


def test_reset_replaces_a_session(spark, tmp_path):
    e, path = MemoryEngine(spark, str(tmp_path / "store")), str(tmp_path / "log")
    e.commit(candidates(spark, ("s", "a", 1, "failed", "x"), ("s", "b", 2, "hello", "y"), ("t", "a", 1, "hello", "z")), path, NOW)
    reset = spark.createDataFrame([("s", "legacy_mismatch")], "session string, reason string")
    got = statuses(e.commit(candidates(spark, ("s", "b", 0, "hello", "baseline")), path, NOW, reset))
    assert got == {"b": ("inserted", 1)}  # in its epoch the turn has no head, whatever its boundary
    assert sorted((r["session"], r["turn_key"], r["history_epoch"]) for r in e.chunks().collect()) == [("s", "b", 1), ("t", "a", 0)]
    assert e.table("observations").count() == 0 and {r["session"]: r["history_epoch"] for r in e.table("epochs").collect()} == {"s": 1}
    f = MemoryEngine(spark, str(tmp_path / "again"))
    f.rebuild(path)
    assert sorted((r["session"], r["turn_key"]) for r in f.chunks().collect()) == [("s", "b"), ("t", "a")]


@pytest.mark.parametrize("crash", ["before the log", "after the log"])
def test_recovery_after_a_crash(spark, tmp_path, monkeypatch, crash):
    e, path = MemoryEngine(spark, str(tmp_path / "store")), str(tmp_path / "log")
    e.capture_prompts(spark.createDataFrame([("claude", "s", None, "/p", "hello", None, "k-a", 1, "0", "t"), ("claude", "s", None, "/p", "later", None, "k-b", 2, "1", "t")], "runtime string, session string, turn_id string, project string, prompt string, model string, pending_key string, turn_sequence int, source_order string, created_at string"))
    new = candidates(spark, ("s", "a", 1, "hello", "x"))

    def fail(*_args, **_more):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(MemoryEngine, "_append" if crash.startswith("before") else "_apply", fail)
        with pytest.raises(RuntimeError):
            e.commit(new, path, NOW)
    assert e.chunks().count() == 0 and e.table("receipts").count() == 1 and e.table("pending").count() == 2
    got = [(r["result"], r["reason"]) for r in e.recover_prepared(path).collect()]
    assert e.table("receipts").count() == 0
    if crash.startswith("before"):
        assert got == [("superseded", "uncommitted receipt requires source replay")] and e.chunks().count() == 0
        assert statuses(e.commit(new, path, NOW)) == {"a": ("inserted", 1)}
    else:
        assert got == [("finalized", "the log has it")]
        assert statuses(e.commit(new, path, NOW)) == {"a": ("already_current", 1)}
    assert e.chunks().count() == 1 and [r["pending_key"] for r in e.table("pending").collect()] == ["k-b"]
    frames = logs.read_frames(spark, path)[0]
    assert frames.count() == 1


def test_receipts_are_judged(spark):
    at = ("source_offset", 0, 1, None)
    r = lambda tx, session, epoch, turns: (tx, "d", session, epoch, False, turns, [], [])
    found = spark.createDataFrame([r("new", "s", 0, [("a", 1, "h")]), r("there", "t", 0, [("a", 1, "h")]), r("covered", "t", 0, [("a", 1, "h"), ("b", 1, "x")]), r("part", "t", 0, [("a", 1, "h"), ("c", 1, "x")])], plans.RECEIPTS)
    heads = spark.createDataFrame([("t", "a", 0, 2, "z", "0", at), ("t", "b", 0, 1, "x", "0", at), ("t", "c", 0, 1, "other", "0", at)], plans.HEADS)
    got = {x["tx_id"]: x["reason"] for x in plans.judged(found, spark.createDataFrame([("there", "d")], plans.COMMITTED), heads, spark.createDataFrame([("s", 1)], plans.EPOCHS)).collect()}
    assert got == {"new": "newer session epoch covers receipt", "there": "the log has it", "covered": "canonical head covers turns", "part": "uncommitted receipt requires source replay"}
    with pytest.raises(Exception, match="another digest"):
        plans.judged(found, spark.createDataFrame([("there", "other")], plans.COMMITTED), heads, spark.createDataFrame([], plans.EPOCHS)).collect()


def test_heads_do_not_go_backwards(spark):
    h = lambda *rows: spark.createDataFrame([(s, k, e, r, c, "0", ("source_offset", 0, o, None)) for s, k, e, r, c, o in rows], plans.HEADS)
    heads = h(("s", "a", 0, 1, "x", 5), ("s", "b", 0, 2, "x", 5), ("s", "c", 0, 1, "x", 5), ("s", "d", 1, 1, "x", 5), ("s", "e", 0, 1, "x", 5))
    new = h(("s", "a", 0, 2, "y", 6), ("s", "b", 0, 1, "y", 9), ("s", "c", 0, 1, "y", 5), ("s", "d", 0, 9, "y", 9), ("s", "e", 0, 2, "y", 4), ("s", "f", 0, 1, "y", 1))
    after, errors = plans.advance(heads, new)
    assert {r["turn_key"]: (r["history_epoch"], r["revision"]) for r in after.collect()} == {"a": (0, 2), "b": (0, 2), "c": (0, 1), "d": (1, 1), "e": (0, 1), "f": (0, 1)}
    assert {r["turn_key"]: r["message"] for r in errors.collect()} == {"c": "a revision has another content", "e": "the boundary goes backwards"}


def test_limits_of_a_transaction(spark, monkeypatch):
    long = spark.createDataFrame([("t", "c", 0, "x" * 100)], "tx_id string, created_at string, no int, line string")
    monkeypatch.setattr(log, "MOST_BYTES", 99)
    with pytest.raises(Exception, match="too long"):
        log.serialize_frame(long).collect()


def test_maintenance(spark, tmp_path):
    m = {"maintenance": {"retention_days": 30.0, "max_bytes": 10_000, "interval_hours": 24.0}}
    e = MemoryEngine(spark, str(tmp_path / "store"), merged(Config(), m))
    old = [("s", f"o{i}", i, "failed", "x") for i in range(3)]
    e.commit(candidates(spark, *old, ("t", "a", 1, "succeeded", "y" * 30_000)), str(tmp_path / "log"), NOW)
    fresh = e.chunks().where("session = 't'").withColumn("created_at", F.lit(NOW).cast("timestamp")).withColumn("session", F.lit("u")).withColumn("id", F.col("id") + 1).withColumn("content", F.lit("new"))
    e.save(e.chunks().unionByName(fresh))
    got = e.maintain(NOW)
    assert (got["skipped"], got["chunks_deleted"], got["observations_deleted"], got["orphaned_sessions_deleted"]) == (False, 5, 4, 2)
    assert [r["session"] for r in e.sessions().collect()] == ["u"] and e.resolutions().count() == 0
    assert e.maintain(NOW + timedelta(hours=1)) == {"skipped": True, "reason": "interval"}
    assert not e.maintain(NOW + timedelta(hours=25))["skipped"] and e.table("maintenance_log").count() == 2
    assert MemoryEngine(spark, e.path, merged(Config(), {"maintenance": {"enabled": False}})).maintain(NOW)["reason"] == "disabled"


def test_vectors_and_index(spark, tmp_path):
    @F.pandas_udf("array<double>")
    def model(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [3.0, 4.0] if t.startswith("検索文書: ") else [0.0, 0.0])

    e = MemoryEngine(spark, str(tmp_path / "store"))
    e.commit(candidates(spark, ("s", "a", 1, "the parser fails", "x"), ("t", "b", 2, "about gardens", "y")), str(tmp_path / "log"), NOW)
    assert e.backfill(model, dry_run=True) == {"total": 2, "processed": 0, "skipped": 2}
    assert e.backfill(model)["processed"] == 2 and e.backfill(model)["total"] == 0
    assert [[round(x, 6) for x in r["embedding"]] for r in e.table("vectors").collect()] == [[0.6, 0.8]] * 2
    plain = [(r["session"], round(r["score"], 6)) for r in e.search("parser", NOW).collect()]
    e.index()
    assert "postings" in e.snapshots.current()[1]
    assert [(r["session"], round(r["score"], 6)) for r in e.search("parser", NOW).collect()] == plain and [s for s, _ in plain] == ["s"]
    assert e.recall("parser", NOW, "/p", query_vector=[0.6, 0.8]).first()["text"].count("s=") == 2
    one = e.chunks().first()["id"]
    e.add_vectors(spark.createDataFrame([(one, [1.0, 0.0]), (-5, [1.0, 0.0])], "id long, embedding array<double>"))
    assert {r["id"]: r["embedding"] for r in e.table("vectors").collect()}[one] == [1.0, 0.0] and e.table("vectors").count() == 2
    e.delete(F.col("session") == "s")
    assert e.table("vectors").count() == 1 and "postings" in e.snapshots.current()[1] and e.search("parser", NOW).count() == 0
    stats = e.stats().first()
    assert (stats["chunks"], stats["stored_sessions"], stats["resolutions"]) == (1, 1, 0) and stats["bytes"] > 0


def test_hybrid_recall_and_refresh_by_the_command_line(spark, tmp_path, monkeypatch):
    @F.pandas_udf("array<double>")
    def model(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [0.0, 2.0] if "garden" in t or t == "検索クエリ: parser" else [2.0, 0.0])

    @F.pandas_udf("array<double>")
    def broken(texts: pd.Series) -> pd.Series:
        raise ValueError("no model")

    log = tmp_path / "2026-01.jsonl"
    line = lambda i, text: json.dumps({"v": 1, "type": "chunk", "id": f"x{i}", "sessionId": f"s{i}", "projectPath": "/p", "chunkIndex": 0, "content": text, "role": "human", "tokenCount": 1, "createdAt": "2026-01-05T00:00:00.000Z"}) + "\n"
    log.write_text(line(1, "the parser fails"))
    monkeypatch.setenv(cli.LOG_VARIABLE, str(log))
    settings = tmp_path / "settings.json"
    settings.write_text(json.dumps({"search": {"hybrid": True}}))
    call = lambda *args, m=model: cli.run(spark, ["--store", str(tmp_path / "store"), "--config", str(settings), "--as-of", "2026-01-06", *args], m)
    assert json.loads(call("refresh")[0])["records"] == 1
    log.write_text(log.read_text() + line(2, "about gardens"))
    assert json.loads(call("refresh")[0])["records"] == 1
    call("embed")
    assert call("recall", "parser", "--project", "/p")[0].count("s=") == 2  # the garden by its vector
    assert call("recall", "parser", "--project", "/p", m=broken)[0].count("s=") == 1  # full text alone
    assert "chunks" in call("compact") and json.loads(call("stats")[0])["chunks"] == 2


def test_pending_prompts(spark, tmp_path):
    p = {"version": 2, "runtime": "codex", "sessionId": "s", "projectPath": "/p", "prompt": "q", "pendingKey": "k", "turnSequence": 2, "sourceOrder": "2", "createdAt": "t"}
    files = {"a.json": p, "b.json": p | {"sourceOrder": "1", "runtimeTurnId": "t1"}, "c.json": p | {"sessionId": "u"}, "d.json": {"version": 1}, "e.json": "not json", ".hidden.json": p, "f.txt": p}
    for name, value in files.items():
        (tmp_path / name).write_text(value if isinstance(value, str) else json.dumps(value))
    found, bad = pending.read_pending(spark, str(tmp_path), "codex", "s")
    assert [(r["source_order"], r["turn_id"]) for r in found.collect()] == [("1", "t1"), ("2", None)]
    assert sorted((r["file"][-6:], r["reason"]) for r in bad.collect()) == [("d.json", "unrecognized pending format"), ("e.json", "malformed JSON")]
    old = tmp_path / "old"
    old.mkdir()
    legacy = {"sessionId": "s:1", "cwd": "/p", "prompt": "x", "createdAt": "2026-01-02T00:00:00Z"}
    (old / "s_1-b.json").write_text(json.dumps(legacy))
    (old / "s_1-a.json").write_text(json.dumps(legacy | {"createdAt": "2026-01-03T00:00:00Z", "prompt": "y"}))
    (old / "other-a.json").write_text(json.dumps(legacy))
    (old / "s_1-c.json").write_text("{")
    assert [r["prompt"] for r in pending.read_legacy_pending(spark, str(old), "s:1").collect()] == ["x", "y"]
    assert [r["source_order"] for r in pending.read_pending(spark, str(old), "kimi", "s:1")[0].collect()] == ["00000001767312000000"] * 2 + ["00000001767398400000"]


def test_answers_are_paired_and_saved(spark, tmp_path):
    e = MemoryEngine(spark, str(tmp_path / "store"))
    prompts = [("codex", "s", "t1", "/p", "first", None, "k1", 1, "1", "t"), ("codex", "s", None, "/p", "second", "m", "k2", 2, "2", "t")]
    e.capture_prompts(spark.createDataFrame(prompts, pending.PENDING))
    stops = "runtime string, session string, turn_id string, project string, answer string, sequence long, completed_at string, model string"
    made = spark.createDataFrame([("codex", "s", "t1", None, " one ", 1, "2026-01-01T00:00:00Z", None), ("codex", "none", None, None, "x", 1, "t", None), ("codex", "s", "t9", None, " ", 2, "t", None)], stops)
    assert [r["status"] for r in e.save_answers(made, str(tmp_path / "log"), NOW).collect()] == ["inserted"]
    assert [r["content"] for r in e.chunks().collect()] == ["[User]\nfirst\n\n[Assistant]\none"]
    assert [r["pending_key"] for r in e.table("pending").collect()] == ["k2"]


def test_stream_of_resets_numbers_and_pairs(spark, tmp_path):
    def run(rows, kind, make, name):
        for i, r in enumerate(rows):
            spark.createDataFrame([r], kind).coalesce(1).write.parquet(str(tmp_path / name / f"{i:03d}"))
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / name))
        make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True).start().awaitTermination(120)
        return spark.table(name).collect()

    kind = "session string, kind string, turn_key string, history_epoch int, revision int, content_hash string, generation long, offset long"
    rows = [("s", "turn", "a", 0, 1, "x", 0, 1), ("s", "reset", "", 1, 0, "", 0, 0), ("s", "turn", "a", 0, 2, "y", 0, 2), ("s", "turn", "a", 1, 1, "z", 0, 0), ("s", "turn", "a", 1, 1, "z", 0, 0), ("s", "reset", "", 1, 0, "", 0, 0)]
    got = sorted((r["kind"], r["history_epoch"], r["status"]) for r in run(rows, kind, checkpoints.decide_with_resets, "resets"))
    assert got == sorted([("turn", 0, "inserted"), ("reset", 1, "reset"), ("turn", 0, "stale"), ("turn", 1, "inserted"), ("turn", 1, "already_current"), ("reset", 1, "stale")])
    got = sorted((r["event"], r["sequence"]) for r in run([("r", "s", "a"), ("r", "s", "b"), ("r", "s", "a")], "runtime string, session string, event string", checkpoints.delivery_sequences, "numbers"))
    assert sorted(n for _, n in got) == [1, 2, 3] and [e for e, _ in got] == ["a", "a", "b"]
    kind = "runtime string, session string, at long, kind string, turn_id string, pending_key string, source_order string, text string"
    rows = [("r", "s", 1, "stop", None, None, None, "early"), ("r", "s", 2, "prompt", "t1", "k1", "1", "p1"), ("r", "s", 3, "prompt", None, "k2", "2", "p2"), ("r", "s", 4, "stop", "t1", None, None, "a1"), ("r", "s", 5, "stop", None, None, None, " "), ("r", "s", 6, "stop", None, None, None, "a2")]
    got = sorted((r["status"], r["pending_key"], r["prompt"], r["answer"]) for r in run(rows, kind, checkpoints.pair_answers, "pairs") if r["status"] == "ready")
    assert got == [("ready", "k1", "p1", "a1"), ("ready", "k2", "p2", "a2")]


def test_prompts_that_wait_too_long_expire(spark, tmp_path):
    """Four micro-batches: a prompt that is answered late, one that is never answered, and one that comes twice."""
    kind = "runtime string, session string, at long, kind string, turn_id string, pending_key string, source_order string, text string, ts timestamp"
    at = lambda minutes: datetime(2026, 1, 1) + timedelta(minutes=minutes)
    batches = [
        [("r", "s", 1, "prompt", "t1", "k1", "1", "first", at(0)), ("r", "s", 2, "prompt", None, "k2", "2", "second", at(1)), ("r", "u", 1, "prompt", None, "k9", "1", "other", at(1))],
        [("r", "s", 3, "stop", "t1", None, None, "answer", at(5)), ("r", "s", 4, "prompt", None, "k2", "2", "second again", at(6))],
        [("r", "u", 2, "stop", None, None, None, "in time", at(9)), ("r", "v", 1, "prompt", None, "k5", "1", "late", at(90))],
        [("r", "s", 5, "stop", None, None, None, "too late", at(91))],
    ]
    found = None
    for rows in batches:
        spark.createDataFrame(rows, kind).write.mode("append").parquet(str(tmp_path / "in"))
        made = checkpoints.pair_answers(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), "30 minutes")
        made.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
        found = spark.read.schema(made.schema).parquet(str(tmp_path / "out"))
    got = sorted((r["session"], r["status"], r["pending_key"], r["prompt"], r["answer"]) for r in found.collect())
    assert got == [("s", "deferred", None, None, "too late"), ("s", "expired", "k2", "second again", None), ("s", "ready", "k1", "first", "answer"), ("u", "ready", "k9", "other", "in time")]


def test_command_line(spark, tmp_path):
    (tmp_path / "2026-01.jsonl").write_text("\n".join(json.dumps({"v": 1, "type": "chunk", "id": f"x{i}", "sessionId": "s", "projectPath": "/p", "chunkIndex": i, "content": f"the parser failed {i}", "role": "human", "tokenCount": 5, "createdAt": "2026-01-05T00:00:00Z"}) for i in range(3)) + "\n")
    call = lambda *args: cli.run(spark, ["--store", str(tmp_path / "store"), "--as-of", "2026-03-01", *args])
    assert call("rebuild", str(tmp_path / "2026-01.jsonl"), "--dry-run") == ["3"] == call("rebuild", str(tmp_path / "2026-01.jsonl"))
    assert call("recall", "parser failed", "--project", "/p")[0].startswith("[Mem]") and len(call("search", "parser")) >= 1
    stats = json.loads(call("stats")[0])
    assert stats["chunks"] == 3 and stats["size"].endswith("B") and json.loads(call("list")[0])["session"] == "s"
    chunk = json.loads(call("search", "parser")[0])["id"]
    assert call("edit", str(chunk), "--content", "edited") == []
    whole = json.loads("".join(call("export")))
    assert sorted(x["content"] for x in whole)[0] == "edited" and [x["chunk_index"] for x in whole] == [0, 1, 2]
    assert call("export", "--markdown")[0].startswith("# s\n\n### human")
    assert json.loads(call("inject", "--project", "/p", "--hook")[0])["hookSpecificOutput"]["hookEventName"] == "SessionStart"
    assert json.loads(call("embed", "--dry-run")[0])["total"] == 3 and json.loads(call("merge", "--dry-run")[0])["removed"] >= 0
    assert call("index") == call("delete", "--chunk", str(chunk)) == []
    assert json.loads(call("stats")[0])["chunks"] == 2 and call("prune", "--older-than", "30d") == [] and json.loads(call("stats")[0])["chunks"] == 0
    assert json.loads(call("maintain")[0])["skipped"] is False
    with pytest.raises(SystemExit):
        call("delete")
