"""Layers, index segments, concurrent writers, byte ranges and the resumed log, each against the same state made from nothing."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from recallspark.operators import postings
from recallspark.plans.engine import MemoryEngine
from recallspark.plans.snapshots import PARTS, Conflict, Snapshots, part
from recallspark.sources import line_source, lines

from .test_engine import NOW, candidates


def rows(df, *columns):
    return sorted(map(repr, map(tuple, (df.select(*columns) if columns else df).collect())))


def index_is_fresh(e):
    fresh = postings.build(e.chunks())
    same = ("bucket", "gram", "id", "project", "size", "at")
    plain = lambda d: rows(d.where("bucket >= 0").withColumn("at", F.array_sort("at")), *same)
    assert plain(e.table("postings")) == plain(fresh)
    assert postings.totals(e.table("postings")) == postings.totals(fresh)


def test_layers_replace_keys_and_are_merged(spark, tmp_path):
    """Random commits to a table with and without parts, against a dictionary."""
    rng = random.Random(3)
    s = Snapshots(spark, str(tmp_path / "store"), {"a": ("k",), "b": ("k",)}, ("a",))
    want, kind = {}, "k string, v long"
    for i in range(6):
        keys = rng.sample("pqrstuv", 2)
        new = {k: [rng.randrange(99) for _ in range(rng.randrange(3))] for k in keys}
        want |= new
        put = spark.createDataFrame([(k, v) for k, vs in new.items() for v in vs], kind)
        gone = spark.createDataFrame([(k,) for k in keys], "k string")
        s.commit(s.current()[0], None, {"a": (put, gone), "b": (put, gone)})
        if i == 3:
            assert s.compact({"a": kind, "b": kind}, least=3) == ["a", "b"] and len(s.current()[1]["a"]) == 1
    flat = sorted((k, v) for k, vs in want.items() for v in vs)
    for name in "ab":
        assert sorted(map(tuple, s.read(name, kind).collect())) == flat
        some = spark.createDataFrame([("p",), ("q",)], "k string")
        assert sorted(map(tuple, s.read(name, kind, some).collect())) == [x for x in flat if x[0] in "pq"]
    s.compact({"a": kind, "b": kind}, least=2)
    assert sorted(map(tuple, s.read("a", kind).collect())) == flat and s.vacuum(1) > 0
    assert sorted(map(tuple, s.read("b", kind).collect())) == flat


def test_a_commit_writes_the_parts_that_it_touches(spark, tmp_path):
    e, where = MemoryEngine(spark, str(tmp_path / "store")), str(tmp_path / "log")
    e.commit(candidates(spark, *[(f"s{i}", "a", i, f"prompt {i}", "x") for i in range(40)]), where, NOW)
    e.index()
    before = e.snapshots.current()[1]
    first = before["chunks"][-1]
    assert len(first["parts"]) > 10
    e.commit(candidates(spark, ("s7", "b", 99, "the parser", "y")), where, NOW)
    after = e.snapshots.current()[1]
    own = spark.createDataFrame([("s7",)], "session string").select(part("session")).first()[0]
    for name in ("chunks", "observations", "heads"):
        assert after[name][: len(before[name])] == before[name] and after[name][-1]["parts"] in ([own], [])
    assert after["chunks"][-1]["parts"] == [own] and 0 <= own < PARTS
    assert e.table("chunks", spark.createDataFrame([("s7",)], "session string")).count() == 2 and e.chunks().count() == 41
    index_is_fresh(e)
    assert [r["session"] for r in e.search("parser", NOW).collect()] == ["s7"]
    id_ = e.chunks().where("session = 's3'").first()["id"]
    e.edit(id_, "a parser as well")
    index_is_fresh(e)
    assert sorted(r["session"] for r in e.search("parser", NOW).collect()) == ["s3", "s7"]
    e.delete(F.col("session").isin("s7", "s9"))
    index_is_fresh(e)
    assert [r["session"] for r in e.search("parser", NOW).collect()] == ["s3"] and e.chunks().count() == 38
    assert e.sessions().count() == 38
    e.compact(2)
    index_is_fresh(e)
    assert len(e.snapshots.current()[1]["postings"]) == 1 and e.chunks().count() == 38


def test_writers_of_other_sessions_both_succeed(spark, tmp_path):
    path = str(tmp_path / "store")
    e = MemoryEngine(spark, path)
    e.commit(candidates(spark, *[(f"s{i}", "a", i, f"prompt {i}", "x") for i in range(4)]), str(tmp_path / "log"), NOW)
    e.index()
    chunks, one = e.chunks(), lambda s: spark.createDataFrame([(s,)], "session string")
    edited = lambda s, text: e.table("chunks", one(s)).withColumn("content", F.lit(text))
    base = e.snapshots.current()[0]
    a, b, c = edited("s0", "first"), edited("s1", "second"), edited("s0", "third")
    MemoryEngine(spark, path)._replace(base, one("s0"), a)
    MemoryEngine(spark, path)._replace(base, one("s1"), b)  # began with the same state, and touches another session
    with pytest.raises(Conflict):
        MemoryEngine(spark, path)._replace(base, one("s0"), c)
    got = {r["session"]: r["content"] for r in e.chunks().collect()}
    assert (got["s0"], got["s1"]) == ("first", "second") and e.chunks().count() == chunks.count() == 4
    index_is_fresh(e)
    with pytest.raises(Conflict):  # a table that is written whole
        e.snapshots.commit(base, maintenance_log=spark.createDataFrame([], "action string"))


# --- lines


def test_ranges_have_each_line_once(tmp_path, monkeypatch):
    rng = random.Random(1)
    want = {}
    os.makedirs(tmp_path / "in" / "sub")
    for f in ("a.txt", "sub/b.txt", "c.txt", "empty.txt"):
        some = [] if f == "empty.txt" else [b"x" * rng.choice([0, 1, 5, 40, 300]) + bytes([rng.choice(b"abc\xc3\xa9\r")]) if rng.random() < 0.8 else b"" for _ in range(80)]
        data = b"\n".join(some) + (b"" if f in ("c.txt", "empty.txt") else b"\n")
        (tmp_path / "in" / f).write_bytes(data)
        at = 0
        for x in data.split(b"\n"):
            if at < len(data):
                want[f, at] = (x.decode("utf-8", "replace"), at + len(x) < len(data))
            at += len(x) + 1
    (tmp_path / "in" / "_SUCCESS").write_text("no data\n")
    root = f"file://{tmp_path}/in"
    for split in (1, 7, 64, 1 << 20):
        for block in (1, 3, 50, 1 << 20):
            monkeypatch.setattr(line_source, "BLOCK", block)
            parts = line_source.ranges(line_source.listed([root]), {}, split)
            got = [((r["file"][len(root) + 1 :], r["offset"]), (r["line"], r["ended"])) for p in parts for b in line_source.read_range(p) for r in b.to_pylist()]
            assert len(got) == len(dict(got)) and dict(got) == want, (split, block)


def test_line_numbers_of_ranges(spark, tmp_path):
    text = "".join(f"line {i}\n\n" for i in range(500)) + "end"
    (tmp_path / "x.txt").write_text(text)
    found = lines.read_lines(spark, str(tmp_path / "x.txt"), 100, numbers=True)
    assert sorted((r["line_no"], r["line"]) for r in found.collect()) == [*((2 * i, f"line {i}") for i in range(500)), (1000, "end")]
    assert lines.scan(spark, str(tmp_path), 100).rdd.getNumPartitions() > 40
    with pytest.raises(FileNotFoundError):
        lines.scan(spark, str(tmp_path / "no-*.txt"))


# --- the resumed log


def frame(tx, *payloads, end=True):
    import hashlib

    body = [json.dumps({"v": 2, "txId": tx} | p, separators=(",", ":")) for p in payloads]
    digest = hashlib.sha256("".join(x + "\n" for x in body).encode()).hexdigest()
    last = [json.dumps({"v": 2, "type": "tx_commit", "txId": tx, "recordCount": len(body), "payloadDigest": digest, "createdAt": "t"})]
    return [json.dumps({"v": 2, "type": "tx_begin", "txId": tx, "createdAt": "t"}), *body, *(last if end else [])]


def turn(session, key, epoch, revision, content, status="failed"):
    part = {"partIndex": 0, "externalId": f"{session}-{key}", "content": content, "role": "human", "metadata": {"filePaths": [], "toolNames": [], "errorMessages": []}, "tokenCount": 1}
    run = {"executionIndex": 0, "toolName": "sh", "command": "make", "status": status, "outputExcerpt": "o"}
    return {"type": "turn_checkpoint", "sessionId": session, "runtime": "claude", "turnKey": key, "sourceOrder": key, "historyEpoch": epoch, "revision": revision, "contentHash": content, "completedAt": "2026-01-01T00:00:00Z", "projectPath": "/p", "observedThrough": {"kind": "source_offset", "generation": epoch, "offset": revision}, "parts": [part], "executions": [run]}


def reset(session, epoch):
    return {"type": "session_reset", "sessionId": session, "historyEpoch": epoch, "reason": "r"}


def record(id_, session, content, vector=None):
    return json.dumps({"v": 1, "type": "chunk", "id": id_, "sessionId": session, "projectPath": "/p", "chunkIndex": 0, "content": content, "role": "human", "tokenCount": 1, "createdAt": "2026-01-05T00:00:00.000Z"} | ({"embedding": vector} if vector else {}))


TABLES = {"chunks": ("external_id", "session", "chunk_index", "content", "turn_key", "revision", "history_epoch"), "sessions": (), "observations": (), "resolutions": (), "heads": (), "epochs": (), "committed": (), "vectors": ()}


def test_refresh_equals_a_rebuild_and_reads_what_is_new(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    file, other = log / "2026-01.jsonl", log / "2026-02.jsonl"
    e = MemoryEngine(spark, str(tmp_path / "store"))
    first = [record("l1", "old", "a parser"), record("l2", "both", "legacy"), *frame("t1", turn("s", "a", 0, 1, "one")), *frame("t2", turn("u", "x", 0, 1, "x"), turn("both", "k", 0, 1, "k"))]
    file.write_text("\n".join(first) + "\n")
    e.rebuild(str(log))
    e.index()
    steps = [
        # A new revision, a new turn that succeeds, a record with a vector, and the start of a frame that has no end yet.
        ([*frame("t3", turn("s", "a", 0, 2, "two")), *frame("t4", turn("s", "b", 0, 1, "b", "succeeded")), record("l3", "old", "new", "0000803f00000040"), *frame("t5", turn("u", "y", 0, 1, "y"), end=False)], True),
        # The frame's end; a reset with a turn of the new epoch; an older revision, which changes nothing.
        (frame("t5", turn("u", "y", 0, 1, "y"))[-1:] + frame("t6", reset("both", 1), turn("both", "k", 1, 1, "again")) + frame("t7", turn("s", "a", 0, 1, "one")), True),
        # A turn and a record of a session that was reset count for nothing; the last line has no newline.
        ([*frame("t8", turn("both", "z", 0, 9, "late")), record("l4", "both", "late"), record("l1", "old", "a parser edited")], False),
        # The newline, and the same transaction once more.
        (["", *frame("t4", turn("s", "b", 0, 1, "b", "succeeded")), *frame("t9", turn("s", "c", 0, 1, "c"))], True),
    ]
    for i, (some, closed) in enumerate(steps):
        size = file.stat().st_size
        with file.open("a") as f:
            f.write("\n".join(some) + ("\n" if closed else ""))
        if i == 1:
            other.write_text("\n".join(frame("o1", turn("v", "a", 0, 1, "parser too"))) + "\n")
        at = {r["file"]: r["offset"] for r in e.table("log_state").collect()}
        assert at[f"file://{file}"] <= size and (i in (1, 3) or at[f"file://{file}"] == size)
        got = e.refresh(str(log))
        assert got["bytes"] == sum(f.stat().st_size - at.get(f"file://{f}", 0) for f in (file, other) if f.exists())
        fresh = MemoryEngine(spark, str(tmp_path / f"fresh{i}"))
        fresh.rebuild(str(log))
        for name, columns in TABLES.items():
            assert rows(e.table(name), *columns) == rows(fresh.table(name), *columns), (i, name)
        index_is_fresh(e)
    assert e.refresh(str(log)) == {"transactions": 0, "records": 0, "bytes": 0}
    file.write_text("")
    with pytest.raises(Exception, match="was read up to"):
        e.refresh(str(log))


def test_refresh_refuses_a_transaction_with_another_digest(spark, tmp_path):
    file = tmp_path / "2026-01.jsonl"
    file.write_text("\n".join(frame("t1", turn("s", "a", 0, 1, "one"))) + "\n")
    e = MemoryEngine(spark, str(tmp_path / "store"))
    e.rebuild(str(file))
    with file.open("a") as f:
        f.write("\n".join(frame("t1", turn("s", "a", 0, 2, "two"))) + "\n")
    with pytest.raises(ValueError, match="another digest"):
        e.refresh(str(file))
