"""Frames of a log are put together in the tasks that read them, and come out as they would line by line."""

import hashlib
import json
import random

import pyarrow as pa
from pyspark.sql import functions as F

from recallspark.operators import log, whole_frames
from recallspark.sources import logs


def line(kind, tx, **more):
    return json.dumps({"v": 2, "type": kind, "txId": tx, **more}, ensure_ascii=False)


def made(rng, i):
    """Lines of one frame or of what is left of one."""
    tx = f"t{i}"
    body = [line("turn_checkpoint", tx, turnKey=f"{i} {k} é", contentHash="x" * rng.randrange(40)) for k in range(rng.randrange(5))]
    digest = hashlib.sha256(("\n".join(body) + "\n").encode()).hexdigest()
    begin, end = line("tx_begin", tx, createdAt="t"), line("tx_commit", tx, recordCount=len(body), payloadDigest=digest, createdAt="t")
    kind = rng.randrange(10)
    if kind == 0:
        return [begin, *body]
    if kind == 1:
        return [*body, end]
    if kind == 2:
        return [begin, *body, line("tx_commit", tx, recordCount=len(body), payloadDigest="no")]
    if kind == 3:
        return [begin, *body[:1], "", "broken", *body[1:], end]
    if kind == 4:
        return [begin, *body, end, end, *body]
    if kind == 5:
        return [begin, *body, line("turn_checkpoint", "other"), end]
    return [begin, *body, end]


def read(lines):
    """The same rules, line by line."""
    frames, problems, now = [], [], None
    for text in [x for x in lines if x.strip()]:
        try:
            r = json.loads(text)
        except ValueError:
            problems.append((None, "invalid JSON"))
            continue
        if r["type"] == "tx_begin":
            if now and not now["done"]:
                problems.append((now["tx"], "abandoned frame: new tx_begin before commit"))
            now = {"tx": r["txId"], "body": [], "same": True, "done": False}
        elif r["type"] == "tx_commit":
            if not now or now["done"]:
                problems.append((r["txId"], "orphan tx_commit without tx_begin"))
                continue
            now["done"] = True
            digest = hashlib.sha256(("\n".join(now["body"]) + "\n").encode()).hexdigest()
            if r["txId"] == now["tx"] and now["same"] and r["recordCount"] == len(now["body"]) and r["payloadDigest"] == digest:
                frames.append((now["tx"], digest, tuple(now["body"])))
            else:
                problems.append((now["tx"], "invalid transaction frame"))
        elif now and not now["done"]:
            now["body"].append(text)
            now["same"] &= r["txId"] == now["tx"]
    if now and not now["done"]:
        problems.append((now["tx"], "incomplete transaction at EOF"))
    return sorted(frames), sorted(problems, key=str)


def result(found):
    frames, problems = found
    return sorted((r["tx_id"], r["digest"], tuple(r["payloads"])) for r in frames.collect()), sorted(((r["tx_id"], r["message"]) for r in problems.collect()), key=str)


def test_frames_are_the_same_however_their_lines_are_dealt(spark, tmp_path):
    rng = random.Random(7)
    lines = [x for i in range(150) for x in made(rng, i)] + [line("tx_begin", "end", createdAt="t")]
    (tmp_path / "a.jsonl").write_text("\n".join(lines) + "\n")
    want = read(lines)
    assert len(want[0]) > 60 and len({m for _, m in want[1]}) == 5
    path = str(tmp_path)
    assert result(logs.read_frames(spark, path)) == want
    assert result(log.frames(logs.frame_lines(spark, path, split=700))) == want
    assert result(log.frames(logs.frame_lines(spark, path).repartition(3, "offset"))) == want
    assert result(log.frames(logs.frame_lines(spark, path).orderBy(F.desc("offset")))) == want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        assert result(logs.read_frames(spark, path)) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_frame_larger_than_what_a_task_holds_goes_by_the_shuffle(monkeypatch):
    monkeypatch.setattr(whole_frames, "HELD_BYTES", 2000)
    texts = ["begin", *["p" * 300] * 12, "commit", "begin", "p", "commit"]
    marks = [1, *[0] * 12, 2, 1, 0, 2]
    offsets = [sum(len(x) + 1 for x in texts[:i]) for i in range(len(texts))]
    n = len(texts)
    all_ = pa.RecordBatch.from_pydict({"file": ["f"] * n, "split": [0] * n, "line_no": offsets, "offset": offsets, "size": [len(x) for x in texts], "mark": pa.array(marks, pa.int32()), "line": texts, "txId": ["t"] * n, "recordCount": pa.array([1] * n, pa.int32()), "payloadDigest": ["d"] * n, "createdAt": ["c"] * n})
    out = pa.Table.from_batches(list(whole_frames.gather(iter([all_.slice(i, 1) for i in range(n)]))))
    assert out["line_no"].to_pylist() == [x for x, m in zip(offsets, [*[1] * 14, 1, 0, 1]) if m]
    assert out["closed"].to_pylist() == [False] * 14 + [True, True]
    assert [x and x["payloads"] for x in out["frame"].to_pylist()] == [None] * 14 + [["p"], None]


def test_payloads_of_whole_frames_are_not_shuffled(spark, tmp_path):
    """Each payload line went through two shuffles and their sorts."""
    body = lambda i: [line("turn_checkpoint", f"t{i}", turnKey=hashlib.sha512(f"{i} {k}".encode()).hexdigest() * 4) for k in range(20)]
    frames = [[line("tx_begin", f"t{i}", createdAt="t"), *(b := body(i)), line("tx_commit", f"t{i}", recordCount=20, payloadDigest=hashlib.sha256(("\n".join(b) + "\n").encode()).hexdigest())] for i in range(100)]
    (tmp_path / "a.jsonl").write_text("\n".join(x for f in frames for x in f) + "\n")
    found = logs.read_frames(spark, str(tmp_path))[0].select("tx_id", F.size("payloads").alias("n"))
    rows = found.collect()
    assert len(rows) == 100 and {r["n"] for r in rows} == {20}
    text = found._jdf.queryExecution().executedPlan()
    assert written(text) < sum(len(x) for f in frames for x in f) / 10


def written(plan):
    """Bytes that the exchanges of a finished plan have written."""
    todo, n = [plan], 0
    while todo:
        p = todo.pop()
        name = p.nodeName()
        if "Exchange" in name and p.metrics().contains("shuffleBytesWritten"):
            n += p.metrics().apply("shuffleBytesWritten").value()
        if name == "AdaptiveSparkPlan":
            todo.append(p.executedPlan())
        elif "QueryStage" in name:
            todo.append(p.plan())
        children = p.children()
        todo += [children.apply(i) for i in range(children.size())]
    return n
