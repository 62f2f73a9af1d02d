"""What commands and queries leave on disk, or read from it compressed."""

import gzip
import hashlib
import pathlib

from recallspark.plans.engine import MemoryEngine
from recallspark.session import shared_dir
from recallspark.sources import line_source, lines, logs
from recallspark.queries_store import records


def stored(spark):
    where = shared_dir(spark).removeprefix("file:")
    return sum(p.stat().st_size for p in pathlib.Path(where).rglob("*") if p.is_file())


def noise(i, n):
    return "".join(hashlib.sha512(f"{i} {k}".encode()).hexdigest() for k in range(n))


def made(spark, n, size):
    rows = [(i, noise(i, size), "p", f"s{i % 3}", i, "2026-01-01 00:00:00") for i in range(n)]
    return spark.createDataFrame(rows, "id long, content string, project string, session string, chunk_index long, created_at string").withColumn("created_at", lines.F.to_timestamp("created_at"))


def test_compressed_logs_are_read_and_followed_by_offset(spark, tmp_path):
    """A compressed file's bytes were taken as text."""
    plain, packed = tmp_path / "plain", tmp_path / "packed"
    text = b"".join(f"{i} é {noise(i, 1)}\n".encode() for i in range(300)) + b"open"
    for at, name, data in ((plain, "a", text), (packed, "a.gz", gzip.compress(text[:5000]) + gzip.compress(text[5000:]))):
        at.mkdir()
        (at / name).write_bytes(data)
    found = lambda at, **more: sorted((r["offset"], r["line"], r["ended"]) for r in lines.scan(spark, str(at), **more).collect())
    assert found(packed) == found(plain) and len(found(packed)) == 301
    place = found(plain)[150][0]
    assert found(packed, since={f"file://{packed}/a.gz": place}) == found(plain, since={f"file://{plain}/a": place})
    assert line_source._last_newline(f"file://{packed}/a.gz", 1) == len(text) - 4


def test_a_rebuild_leaves_no_copies_of_the_log(spark, tmp_path):
    """Lines, frames, turns and chunks were checkpoints, each as large as the log, that stayed."""
    c = made(spark, 60, 400)
    records(c).write.option("compression", "gzip").text(f"{tmp_path}/log")
    e = MemoryEngine(spark, str(tmp_path / "store"))
    before = stored(spark)
    back = e.rebuild(f"{tmp_path}/log")
    assert {(r["external_id"], r["content"]) for r in back.collect()} == {(str(i), noise(i, 400)) for i in range(60)}
    assert stored(spark) - before < 60 * 400 * 128 / 4
    records(c.where("id < 2").withColumn("content", lines.F.lit("new"))).write.mode("append").option("compression", "gzip").text(f"{tmp_path}/log")
    assert e.refresh(f"{tmp_path}/log")["records"] == 2 and e.chunks().where("content = 'new'").count() == 2


def test_the_last_of_repeated_records_stays(spark, tmp_path):
    for name, part in (("a", made(spark, 6, 1)), ("b", made(spark, 3, 2))):
        records(part.coalesce(1)).write.text(f"{tmp_path}/log/{name}")
    found = logs.read_chunks(spark, f"{tmp_path}/log")
    from recallspark.operators import log

    out = log.latest_by_id(found, lambda d: d.localCheckpoint())
    assert sorted((r["external_id"], len(r["content"])) for r in out.collect()) == [(str(i), 256 if i < 3 else 128) for i in range(6)]


def test_postings_are_stored_as_they_come(spark, monkeypatch):
    """Rows of a chunk came one chunk after another, and were all dealt anew and put in order on disk."""
    from recallspark.operators import postings

    monkeypatch.setattr(postings, "PLACES", 1 << 12)
    rows = postings.build(made(spark, 60, 4).coalesce(1)).where("bucket >= 0")
    assert "hashpartitioning" not in rows._jdf.queryExecution().executedPlan().toString()
    keys = [(r["bucket"], r["gram"], r["id"]) for r in rows.collect()]
    runs = 1 + sum(b < a for a, b in zip(keys, keys[1:]))
    assert 7 <= runs <= 9 and len(set(keys)) == len(keys)


def test_changes_of_an_indexed_store_leave_no_copies_of_its_texts(spark, tmp_path):
    """Chunks of the sessions that change, and those that are gone, stayed as checkpoints of their texts."""
    c = made(spark, 60, 400)
    records(c).write.text(f"{tmp_path}/log")
    e = MemoryEngine(spark, str(tmp_path / "store"))
    e.rebuild(f"{tmp_path}/log")
    e.index()
    before = stored(spark)
    records(c.where("id % 2 = 0").withColumn("content", lines.F.concat("content", lines.F.lit(" and more")))).write.mode("append").text(f"{tmp_path}/log")
    e.refresh(f"{tmp_path}/log")
    e.delete(lines.F.col("session") == "s1")
    assert stored(spark) - before < 60 * 400 * 128 / 4
    from recallspark.operators import postings, search

    assert e.chunks().count() == 40 and postings.totals(e.table("postings"))[0] == 40
    assert search.bm25(e.chunks(), ["and more"], k=None, index=e.table("postings")).count() == e.chunks().where("content LIKE '%and more'").count() == 20


def test_blocks_meet_without_copies_of_their_texts(spark, monkeypatch):
    """Each text went through the shuffle once for each pair of blocks that its block is in."""
    from recallspark.operators import duplicates

    monkeypatch.setattr(duplicates, "ELEMENTS", 2048)
    texts = [noise(i // 2, 1 + i % 5 // 4) + f" {i}" for i in range(120)]
    grams = [{t[k : k + 3] for k in range(len(t) - 2)} for t in texts]
    want = {(a, b) for a in range(120) for b in range(a + 1, 120) if len(grams[a] & grams[b]) >= 0.6 * len(grams[a] | grams[b])}
    pairs = duplicates.similar_pairs(spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "id long, session string, content string"))
    assert {(r["a"], r["b"]) for r in pairs.collect()} == want and len(want) > 30
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "array_contains" in plan and "FlatMapGroups" not in plan


def test_only_texts_with_a_vector_are_shuffled_to_it(spark):
    """All texts went through the shuffle, and were put in order, where the vectors are no broadcast."""
    from recallspark import queries_io
    from tests.test_frames import written

    c = spark.createDataFrame([(i if i else None, noise(i, 20)) for i in range(1000)], "id long, content string").localCheckpoint()
    v = spark.createDataFrame([(i, [float(i)]) for i in range(5, 1200, 10)], "id long, v array<float>").localCheckpoint()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = queries_io.with_vectors(c, v)
        rows = found.collect()
        assert sorted((r["id"] or 0, r["content"], r["v"]) for r in rows) == [(i, noise(i, 20), [float(i)] if i % 10 == 5 else None) for i in range(1000)]
        assert written(found._jdf.queryExecution().executedPlan()) < 1000 * 20 * 128 / 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
