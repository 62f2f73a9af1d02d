"""Queries on tables whose parts are of unlike or large sizes."""

import hashlib
import pathlib
import random
import time

import pandas as pd
import pyarrow as pa

from recallspark import queries_store
from recallspark.operators import duplicates
from recallspark.session import shared_dir
from recallspark.streaming import checkpoints


def documents(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_layers_of_unlike_sizes_are_merged(spark, tmp_path):
    """The second piece is many times as large as the later ones, which are then of other size classes."""
    noise = lambda i: "".join(hashlib.sha512(f"{i} {k}".encode()).hexdigest() for k in range(20))
    langs = ["de"] * 3 + ["en"] * 300 + ["es"] * 3 + ["fr"] * 3
    d = documents(spark, tmp_path, [(i, noise(i) if lang == "en" else f"text {i}", "s", lang) for i, lang in enumerate(langs)])
    found = queries_store.merged_layers(spark, d).collect()
    assert sorted(r["id"] for r in found) == list(range(len(langs)))
    assert all(r["hash"] == hashlib.md5((noise(r["id"]) if langs[r["id"]] == "en" else f"text {r['id']}").encode()).hexdigest() for r in found)


def test_decisions_of_many_turns_take_few_groups(spark, tmp_path, monkeypatch):
    """Turns share groups: a group a turn took a second for each few hundred of them. Keys that share one keep their own heads over two micro-batches."""
    made = []
    plain = checkpoints._stateful
    monkeypatch.setattr(checkpoints, "_stateful", lambda stream, key, *more: made.append(stream.select(*key)) or plain(stream, key, *more))
    monkeypatch.setattr(checkpoints, "SHARDS", 2)
    kind = "session string, turn_key string, history_epoch int, revision int, content_hash string, generation long, offset long"
    one = [(f"s{i}", t, 0, 1, f"{i}", 0, 1 << 60) for i in range(20) for t in ("a", None)]
    two = [(f"s{i}", t, 0, i % 3, f"{i}", 0, (1 << 60) + 1) for i in range(20) for t in ("a", None)]
    for x, part in (("0", one), ("1", two)):
        spark.createDataFrame(part, kind).coalesce(1).write.parquet(f"{tmp_path}/in/{x}")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    found = checkpoints.decide(stream)
    assert made[0].columns == ["shard"]
    found.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    got = sorted((r["session"], r["turn_key"] or "", r["revision"], r["status"]) for r in spark.read.schema(found.schema).parquet(f"{tmp_path}/out").collect())
    later = ("stale", "already_current", "inserted")
    assert got == sorted([(s, t or "", 1, "inserted") for s, t, *_ in one] + [(s, t or "", v, later[v]) for s, t, _, v, *_ in two])


class _Held:
    """A value state in memory."""

    value = None
    calls = 0

    def getValueState(self, *_):  # noqa: N802
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value


def test_resets_of_many_sessions_take_two_state_calls_a_micro_batch():
    held, p = _Held(), checkpoints._Resets()
    p.columns = ("session", "kind", "turn_key", "history_epoch", "status")
    p.init(held)
    names = ["session", "kind", "turn_key", "history_epoch", "revision", "content_hash", "generation", "offset"]
    batch = lambda *rows: sorted(x for d in p.handleInputRows((0,), iter([pd.DataFrame(rows, columns=names)]), None) for x in d.itertuples(index=False, name=None))
    first = [(f"s{i}", "turn", t, 0, 1, "x", 0, 1 << 60) for i in range(50) for t in ("a", "b")]
    assert {x[-1] for x in batch(*first)} == {"inserted"} and held.calls == 1
    got = batch(("s1", "reset", "", 1, 0, "", 0, 0), ("s1", "turn", "a", 1, 1, "y", 0, 2), ("s1", "turn", "b", 0, 2, "y", 0, 1 << 61), ("s2", "turn", "b", 0, 1, "y", 0, 1 << 60), ("s2", "turn", "a", 0, 2, "y", 0, 1 << 61))
    assert got == sorted([("s1", "reset", "", 1, "reset"), ("s1", "turn", "a", 1, "inserted"), ("s1", "turn", "b", 0, "inserted"), ("s2", "turn", "b", 0, "conflict"), ("s2", "turn", "a", 0, "inserted")])
    assert held.calls == 3
    assert [x[-1] for x in batch(("s1", "turn", "a", 1, 1, "y", 0, 2), ("s1", "reset", "", 1, 0, "", 0, 0))] == ["stale", "already_current"]


def test_similar_pairs_store_less_than_the_texts(spark):
    """Sets of trigrams take eight times the bytes of their texts; they were stored twice."""
    where = shared_dir(spark).removeprefix("file:")
    stored = lambda: sum(p.stat().st_size for p in pathlib.Path(where).rglob("*") if p.is_file())
    texts = [" ".join(hashlib.md5(f"{i // 2} {k}".encode()).hexdigest() for k in range(60)) + f" {i}" for i in range(200)]
    before = stored()
    pairs = duplicates.similar_pairs(spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "id long, session string, content string"))
    assert sorted((r["a"], r["b"]) for r in pairs.collect()) == [(i, i + 1) for i in range(0, 200, 2)]
    assert stored() - before < sum(map(len, texts))


def _block(texts):
    t = pa.table({"session": ["s"] * len(texts), "block": [0] * len(texts), "id": list(texts), "text": list(texts.values())})
    return duplicates._packed(t).column(2).combine_chunks()


def _meeting(x, y, *more):
    batch = pa.RecordBatch.from_arrays([pa.array([0]), pa.array([0 if x is y else 1]), _block(x), _block(y)], names=["i", "j", "x", "y"])
    return {(r["a"], r["b"]): r["similarity"] for out in duplicates._met(0.6, *more)([batch]) for r in out.to_pylist()}


def test_blocks_meet_in_less_than_a_pass_over_their_sets_for_each_set():
    """Each set was held against all elements of the other block: 6.0 to 7.4 s of CPU for these blocks, 1.2 s as products of matrices."""
    rng = random.Random(3)
    words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(3, 9))) for _ in range(400)]
    x, y = ({i: " ".join(rng.choice(words) for _ in range(300)) + f" {i}" for i in range(k, k + 1500)} for k in (0, 1500))
    blocks = [pa.array([0]), pa.array([1]), _block(x), _block(y)]
    began = time.process_time()
    found = sum(len(out) for out in duplicates._met(0.6)([pa.RecordBatch.from_arrays(blocks, names=["i", "j", "x", "y"])]))
    took = time.process_time() - began
    assert found > 1000 and took < 3, took


def test_blocks_count_frequent_and_rare_trigrams(monkeypatch):
    rng = random.Random(4)
    texts = {i: " ".join(rng.choice(["the", "tion", "größe", "日本語", "😀😀", hashlib.md5(f"{i // 3}".encode()).hexdigest()[:8]]) for _ in range(rng.randint(2, 20))) for i in range(300)}
    sets = {i: {t[k : k + 3] for k in range(len(t) - 2)} for i, t in texts.items()}
    share = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    x, y = ({i: t for i, t in texts.items() if i % 2 == k} for k in (0, 1))
    across = {(min(a, b), max(a, b)): share(a, b) for a in x for b in y if share(a, b) >= 0.6}
    within = {(a, b): share(a, b) for a in x for b in x if a < b and share(a, b) >= 0.6}
    assert min(len(across), len(within)) > 50
    for rare, held, strip in ((256, 1 << 22, 256), (1, 7, 16), (1 << 30, 500, 1000), (20, 1000, 7)):
        for k, v in (("RARE", rare), ("HELD", held), ("STRIP", strip)):
            monkeypatch.setattr(duplicates, k, v)
        assert _meeting(x, y) == across and _meeting(x, x) == within


def test_similarities_are_rounded_as_the_function_does(spark):
    """Halves at the fifth digit, as 99/160, go up; round() took longer than all else of a pair."""
    n = 160
    texts = {i: "".join(chr(0x4E00 + k) for k in range(i + 2)) for i in range(90, n + 1)}
    found, exact = _meeting(texts, texts, 4), _meeting(texts, texts)
    rows = spark.createDataFrame([(*k, v) for k, v in exact.items()], "a long, b long, v double").selectExpr("a", "b", "round(v, 4) AS v").collect()
    assert found == {(r["a"], r["b"]): r["v"] for r in rows} and exact[99, 160] == 0.61875 and found[99, 160] == 0.6188
