"""MinHash near-de-duplication with min-max hashing.

Each random permutation of a document's shingles gives two signature values, its minimum and its maximum;
both agree for two sets with probability their Jaccard similarity, so half as many hash evaluations fill a
signature, and the estimate's variance is lower. BANDS bands of ROWS values each find candidates: at
similarity 0.8 a pair is missed with probability (1 - 0.8**4)**20 = 3e-5, at 0.85 with 4e-7.

Documents with equal sets are one class. Then two waves confirm links on full sets:

1. in each bucket every class is held against the bucket's smallest one, as sorted streams;
2. in buckets where more than one component is left, blocks of the classes outside its main component meet all blocks of the bucket, classes of
   different components are compared in memory, and only edges that join two components come out.

So no pairs of a group are emitted, no bucket is capped, and no task holds more than two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, cut, mix, short_batches, signed, text_bytes, text_ids, unused, Words
from .components import components

BANDS, ROWS = 20, 4
#: Classes of a bucket that are compared in one task with as many others.
BLOCK = 256
#: Members of a bucket that meet its head in one stream.
STREAM = 64


def shingle_sets(texts: pa.Array, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For ranges of texts: hashes of the distinct shingles, sorted within each text, and where each text's begin.

    Fewer than k words are one shingle; no words, none.
    """
    for i, j in chunks(texts):
        w = Words(texts.slice(i, j - i))
        n = np.diff(w.at)
        hashes, inside = w.grams(k)
        doc = w.doc()[: len(hashes)][inside]
        hashes = hashes[inside]
        few = np.flatnonzero((n > 0) & (n < k))
        if len(few):
            own = np.array([_whole(w.hash[w.at[x] : w.at[x + 1]]) for x in few], np.uint64)
            doc, hashes = np.concatenate([doc, few]), np.concatenate([hashes, own])
        order = np.lexsort((hashes, doc))
        doc, hashes = doc[order], hashes[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
        doc, hashes = doc[new], hashes[new]
        yield hashes, np.searchsorted(doc, np.arange(j - i + 1))


def _whole(words: np.ndarray) -> int:
    x = np.uint64(len(words))
    for h in words:
        x = mix(np.array([x ^ h], np.uint64))[0]
    return x


def signatures(hashes: np.ndarray, at: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Band hashes (documents with shingles, bands): min-max signature values hashed by band."""
    full = np.flatnonzero(np.diff(at))
    begin = at[full]
    out = np.zeros((len(full), bands), np.uint64)
    if not len(full):
        return out
    seeds = mix(np.arange(1, bands * rows + 1, dtype=np.uint64))
    shift = np.uint64(16)
    k = 0
    for band in range(bands):
        x = np.full(len(full), mix(np.array([band + 1], np.uint64))[0])
        for _ in range(rows // 2):
            v = (hashes ^ seeds[2 * k]) * (seeds[2 * k + 1] | np.uint64(1))
            x = mix(x ^ (np.minimum.reduceat(v, begin) >> shift))
            x = mix(x ^ (np.maximum.reduceat(v, begin) >> shift) + np.uint64(1))
            k += 1
        out[:, band] = x
    return out


_SIGNED = "doc_id long, n long, a long, b long, bands array<long>"


def _signed(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n (shingles), a and b (hash of the set), bands (null without shingles)."""

    def work(batches):
        for batch in batches:
            texts, done = batch.column(1), 0
            for hashes, at in shingle_sets(texts, k):
                n = np.diff(at)
                full = np.flatnonzero(n)
                a, b = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
                if len(full):
                    a[full] = np.add.reduceat(mix(hashes), at[full])
                    b[full] = np.bitwise_xor.reduceat(mix(hashes + np.uint64(1)), at[full])
                sig = signed(signatures(hashes, at, bands, rows).reshape(-1))
                ends = np.concatenate([[0], np.cumsum((n > 0) * bands)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(sig))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(n)), pa.array(n.astype(np.int64)), pa.array(signed(a)), pa.array(signed(b)), lists], names=["doc_id", "n", "a", "b", "bands"])
                done += len(n)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("body")).mapInArrow(work, _SIGNED)


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """rep, s: the set as bytes of sorted 64-bit hashes."""

    def work(batches):
        for batch in batches:
            done = 0
            for hashes, at in shingle_sets(batch.column(1), k):
                n = len(at) - 1
                body = pa.py_buffer(np.ascontiguousarray(hashes))
                sets = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((at * 8).astype(np.int32)), body])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, n), sets], names=["rep", "s"])
                done += n

    return docs.mapInArrow(work, "rep long, s binary")


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    common = int((large[at] == small).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def _against_heads(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs (head, rep, members of the bucket) -> links (u, v) whose sets are alike. A head meets its members in a stream, split by salt where they are many."""
    salt = F.pmod(F.xxhash64("rep"), F.ceil(F.col("members") / STREAM))
    pairs = pairs.withColumn("salt", salt)
    heads = pairs.select("head", "salt").distinct().join(sets.withColumnRenamed("rep", "head"), "head").select("head", "salt", F.lit(0).alias("turn"), F.col("head").alias("rep"), "s")
    rest = pairs.join(sets, "rep").select("head", "salt", F.lit(1).alias("turn"), "rep", "s")

    def work(batches):
        now, head = None, None
        for batch in batches:
            u, v = [], []
            for h, salt, turn, rep, s in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                s = np.frombuffer(s, np.uint64)
                if turn == 0:
                    now, head = (h, salt), s
                elif now == (h, salt) and _alike(head, s, percent):
                    u.append(h)
                    v.append(rep)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return heads.unionByName(rest).repartition("head", "salt").sortWithinPartitions("head", "salt", "turn").mapInArrow(work, "u long, v long")


def _within(rows: DataFrame, percent: int) -> DataFrame:
    """rows (band, i, j, mine, rep, component, s) -> links (u, v) that join components, within groups of band, i, j."""

    def work(t: pa.Table) -> pa.Table:
        part, rep, comp = (t.column(c).to_numpy() for c in ("mine", "rep", "component"))
        sets = [np.frombuffer(x, np.uint64) for x in t.column("s").to_pylist()]
        n = len(rep)
        size = np.array([len(x) for x in sets])
        two = t.column("i")[0].as_py() != t.column("j")[0].as_py()
        names, own = np.unique(comp, return_inverse=True)
        root = np.arange(len(names))

        def top(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        u, v = [], []
        if len(names) > 1:
            ids, flat = np.unique(np.concatenate(sets), return_inverse=True)
            begin = np.concatenate([[0], np.cumsum(size)])
            marked = np.zeros(len(ids), np.int32)
            count = np.bincount(own)
            large = int(count.argmax())
            running = np.zeros(len(flat) + 1, np.int64)
            # All rows but those of the largest component meet every row, so each pair of components is met.
            for x in np.flatnonzero(own != large):
                marked[flat[begin[x] : begin[x + 1]]] = 1
                np.cumsum(marked[flat], out=running[1:])
                marked[flat[begin[x] : begin[x + 1]]] = 0
                common = running[begin[1:]] - running[begin[:-1]]
                hit = (own != own[x]) & (100 * common >= percent * (size + size[x] - common))
                if two:
                    hit &= part != part[x]
                for y in np.flatnonzero(hit):
                    a, b = top(own[x]), top(own[y])
                    if a != b:
                        root[b] = a
                        u.append(rep[x])
                        v.append(rep[y])
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return rows.groupBy("band", "i", "j").applyInArrow(work, "u long, v long")


def near_groups(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, component_id for every row.

    Words are cut at white space and A-Z lower-cased; a set holds the distinct shingles of k words. Two documents are linked at
    100 * |intersection| >= percent * |union|; component_id is the smallest doc_id reachable over links. Documents without words are
    linked with nothing; rows with null doc_id keep component_id null and link nothing.
    """
    sig = cut(_signed(short_batches(docs), k, bands, rows))
    found = sig.where("n > 0 AND doc_id IS NOT NULL")
    classes = cut(found.groupBy("a", "b").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands")))
    at = classes.select("rep", "n", F.explode("bands").alias("band"))
    heads = at.groupBy("band").agg(F.min("rep").alias("head"), F.count("*").alias("members")).where("members > 1")
    met = cut(at.join(heads, "band").select("band", "rep", "head", "members"))
    wanted = met.select("rep").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), text_bytes().alias("body"))
    sets = cut(_sets(texts.join(wanted, "rep", "left_semi"), k))
    pairs = met.where("rep <> head").groupBy("head", "rep").agg(F.max("members").alias("members"))
    links = cut(_against_heads(pairs, sets, percent))
    groups = cut(components(links))
    known = met.join(groups, F.col("rep") == F.col("node"), "left").select("band", "rep", "members", F.coalesce("component", "rep").alias("component"))
    # In a bucket with several components, the members of its main one need not meet each other, so their blocks meet only those of the rest.
    sizes = known.groupBy("band", "component").agg(F.count("*").alias("c"))
    mixed = sizes.groupBy("band").agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.max("c").alias("most"), F.sum("c").alias("all"), F.count("*").alias("several")).where("several > 1")
    blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    left = known.join(mixed, "band").withColumn("loose", F.col("component") != F.col("main")).withColumn("lb", blocks(F.col("all") - F.col("most"))).withColumn("mb", blocks(F.col("most")))
    place = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    left = left.withColumn("mine", F.when(F.col("loose"), place(F.col("lb"))).otherwise(F.col("lb") + place(F.col("mb"))))
    left = left.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("loose"), F.col("lb") + F.col("mb")).otherwise(F.col("lb")) - 1)))
    left = left.select("band", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "rep", "component")
    more = cut(_within(left.join(sets, "rep").select("band", "i", "j", "mine", "rep", "component", "s"), percent))
    final = components(links.unionByName(more))
    named = classes.select("a", "b", "rep").join(final, F.col("rep") == F.col("node"), "left").select("a", "b", F.coalesce("component", "rep").alias("component_id"))
    out = sig.select("doc_id", "n", "a", "b").join(named, ["a", "b"], "left")
    alone = (F.col("n") == 0) | F.col("doc_id").isNull()
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without the rows whose own text is linked to that of a smaller doc_id; five words a shingle. All columns stay.

    Texts are linked, whatever ids their rows have; rows without doc_id come after all others. Repeated rows of one doc_id and text all stay.
    """
    (text,) = unused(docs, "_key")
    docs = text_ids(docs, text)
    found = near_groups(docs.select(F.col(text).alias("doc_id"), "text")).where("n_shingles > 0").select(F.col("doc_id").alias("key"), "component_id").distinct()
    rows = docs.select(F.col(text).alias("key"), "doc_id").join(found, "key").select("component_id", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key").alias("me"))
    best = rows.groupBy("component_id").agg(F.min("me").alias("best"))
    same, id_ = unused(docs, "_same", "_id")
    gone = cut(rows.join(best, "component_id").where("me <> best").select(F.col("me.key").alias(same), F.col("me.doc_id").alias(id_)).distinct())
    return docs.join(gone, (F.col(text) == F.col(same)) & F.col("doc_id").eqNullSafe(F.col(id_)), "left_anti").drop(text)
