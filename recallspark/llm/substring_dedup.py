"""Substring de-duplication by seed and extend.

Every window of LENGTH words selects one anchor, the smallest hash among its runs of SEED words (winnowing), so equal windows
have equal anchors at equal places. Documents are joined on the anchors that at least two of them hold. An anchor's match is extended both ways
over the whole context of the windows that selected it: where the context also stands in a document with a smaller doc_id, all
those windows are repeats at once. Where the anchor is shared and the context is not, which is at the ends of a repeat, the
match is extended word by word: the windows of one document for each different context are held against each other. Touching
windows merge into maximal repeats.

No pairs of occurrences are made: each step takes the smallest doc_id of equal hashes, which is pre-aggregated by the tasks.
Hashes at a step have 64 bits and count only together with the anchor's, 128 bits in all.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, cut, mix, powers, short_batches, signed, text_bytes, Words

LENGTH, SEED = 50, 25


def anchors(w: Words, length: int, seed: int) -> tuple[np.ndarray, ...]:
    """For each run of windows that select the same anchor: text, first window (a word of the chunk), windows, anchor hash, hash of the context."""
    n = len(w.hash) - length + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    doc = w.doc()
    g, _ = w.grams(seed)
    valid = doc[:n] == doc[length - 1 :]
    near = np.lib.stride_tricks.sliding_window_view(g, length - seed + 1)
    start = np.flatnonzero(valid)
    where = np.empty(len(start), np.int64)
    for i in range(0, len(start), 1 << 16):
        s = start[i : i + (1 << 16)]
        where[i : i + (1 << 16)] = s + near[s].argmin(1)
    if not len(start):
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    new = np.ones(len(start), bool)
    new[1:] = (where[1:] != where[:-1]) | (doc[start[1:]] != doc[start[:-1]])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(start)))
    i0, p = start[first], where[first]
    up, down = powers(0xC2B2AE3D27D4EB4F, len(w.hash))
    total = np.zeros(len(w.hash) + 1, np.uint64)
    np.cumsum(w.hash * up[: len(w.hash)], out=total[1:])
    context = mix((total[i0 + count + length - 1] - total[i0]) * down[i0] + (count * 64 + (p - i0)).astype(np.uint64))
    return doc[i0], i0, count, g[p], context


def _covered(n: int, ranges: list[tuple[int, int]]) -> np.ndarray:
    step = np.zeros(n + 1, np.int32)
    for a, b in ranges:
        step[min(a, n)] += 1
        step[min(b, n)] -= 1
    return np.cumsum(step[:n]) > 0


def _finish(body: bytes, ranges: list[tuple[int, int]]) -> tuple[int, int, str, list[dict]]:
    words = body.split()
    gone = _covered(len(words), ranges)
    kept = b" ".join(words[i] for i in np.flatnonzero(~gone)) if ranges else b" ".join(words)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    return len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), [{"first": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]


_CODEC = "zstd"


def _packed(body: bytes) -> bytes:
    """The text compressed, after its size in eight bytes."""
    return len(body).to_bytes(8, "little") + pa.compress(body, codec=_CODEC, asbytes=True)


def _unpacked(packed: bytes) -> bytes:
    return pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), codec=_CODEC, asbytes=True)


_RANGES = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
_OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string, repeats array<struct<first:long,end:long>>"


def repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_words, n_removed, kept_sha256, repeats (maximal removed ranges of words), a row for every row.

    Words are cut at white space and otherwise unchanged; null text has none. Each word goes that is in a window of `length` words
    whose sequence also starts in a document with a smaller doc_id, judged on the input. Rows with null doc_id lose nothing and cost others nothing;
    of rows with the same doc_id none is before the other.
    """
    rows = short_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("body")).withColumn("row", F.xxhash64("body"))

    def find(batches):
        for batch in batches:
            for i, j in chunks(batch.column(2)):
                w = Words(batch.column(2).slice(i, j - i), fold=False)
                d, i0, n, a, c = anchors(w, length, seed)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).take(pa.array(d)), batch.column(1).slice(i, j - i).take(pa.array(d)), pa.array((i0 - w.at[d]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(signed(a)), pa.array(signed(c))], names=["doc_id", "row", "i", "n", "a", "c"])

    seen = rows.where("doc_id IS NOT NULL").select("doc_id", "row", "body").mapInArrow(find, "doc_id long, row long, i int, n int, a long, c long")
    # Read from the shared folder, so that its side of the join is dealt anew and the partition of a hot anchor can be split.
    shared = cut(seen.groupBy("a").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("low < high").select("a", (F.col("c0") != F.col("c1")).alias("several")))
    # Joined, a table of the occurrences of shared anchors only.
    met = cut(seen.join(shared, "a"))
    least = cut(met.groupBy("a", "c").agg(F.min("doc_id").alias("low")))
    # An occurrence is a repeat as a whole, or stands first with its context and may still be one in part.
    marks = met.join(least, ["a", "c"]).where("low < doc_id OR several").select("doc_id", "row", F.struct("i", "n", "a", (F.col("low") < F.col("doc_id")).alias("whole")).alias("mark"))
    marks = marks.groupBy("doc_id", "row").agg(F.collect_set("mark").alias("marks"))

    def pack(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([_packed(x) for x in batch.column(2).to_pylist()], pa.binary())], names=["doc_id", "row", "packed"])

    def settle(batches):
        for batch in batches:
            out = []
            for doc_id, row, packed, marks in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                ranges = [(m["i"], m["i"] + m["n"] - 1 + length) for m in marks or () if m["whole"]]
                if marks and len(ranges) < len(marks):
                    part = [m for m in marks if not m["whole"]]
                    out.append((doc_id, row, None, None, None, [{"first": a, "end": b} for a, b in ranges], packed, [m["i"] for m in part], [m["n"] for m in part], [m["a"] for m in part]))
                else:
                    out.append((doc_id, row, *_finish(_unpacked(packed), ranges), None, None, None, None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), _RANGES, pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64())), strict=True)], names=["doc_id", "row", "n_words", "n_removed", "kept_sha256", "repeats", "packed", "i", "n", "a"])

    kind = "doc_id long, row long, n_words long, n_removed long, kept_sha256 string, repeats array<struct<first:long,end:long>>, packed binary, i array<int>, n array<int>, a array<long>"
    packed = rows.select("doc_id", "row", "body").mapInArrow(pack, "doc_id long, row long, packed binary")
    settled = cut(packed.join(marks, ["doc_id", "row"], "left").select("doc_id", "row", "packed", "marks").mapInArrow(settle, kind))
    open_rows = settled.where("packed IS NOT NULL")

    def extend(batches):
        for batch in batches:
            for doc_id, row, packed, i, n, a in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                g, _ = Words(pa.array([_unpacked(packed)], pa.binary()), fold=False).grams(length)
                i, n = np.array(i), np.array(n)
                at = np.repeat(i, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                yield pa.RecordBatch.from_arrays([pa.array([doc_id] * len(at), pa.int64()), pa.array([row] * len(at), pa.int64()), pa.array(at.astype(np.int32)), pa.array(np.repeat(np.array(a, np.int64), n)), pa.array(signed(g[at]))], names=["doc_id", "row", "i", "a", "w"])

    windows = open_rows.select("doc_id", "row", "packed", "i", "n", "a").mapInArrow(extend, "doc_id long, row long, i int, a long, w long")
    first = cut(windows.groupBy("a", "w").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("a", "w", "low"))
    more = windows.join(first, ["a", "w"]).where("low < doc_id").groupBy("doc_id", "row").agg(F.collect_set("i").alias("windows"))

    def close(batches):
        for batch in batches:
            out = []
            for doc_id, packed, ranges, windows in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                out.append((doc_id, *_finish(_unpacked(packed), [(r["first"], r["end"]) for r in ranges] + [(i, i + length) for i in windows or ()])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), _RANGES), strict=True)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "repeats"])

    closed = open_rows.join(more, ["doc_id", "row"], "left").select("doc_id", "packed", "repeats", "windows").mapInArrow(close, _OUT)
    return settled.where("packed IS NULL").select("doc_id", "n_words", "n_removed", "kept_sha256", "repeats").unionByName(closed)
