"""Scores of a language model: context-tree weighting over bytes, with a word unigram model as base.

A byte is eight binary decisions, each at a node of the byte's code tree. For each node, the contexts of 0 to DEPTH bytes
before form a tree; at every depth the Krichevsky-Trofimov estimate of that context is weighted against the mixture of the
contexts one byte longer. Weights come from the training counts of (DEPTH + 1)-grams of bytes.

Spark counts the grams of all documents, with how often training text has them. The trees below a context of ROOT bytes are
independent of each other, so grams are grouped by it, and a task mixes the depths from DEPTH to ROOT. A first sweep sums what the
trees say for each node of the contexts of two bytes, a table of at most 256 * 256 * 255 rows (UTF-8 text has some hundred thousand), which
the driver mixes with depths 1 and 0; with it, a second sweep gives every gram the log-probability of its last byte.
A document's score is the sum over its grams. The HOT grams with the largest counts, a bounded table, are broadcast; the others, any number, are
joined by shuffle to the rare grams of each document, and so are words for the base. All tables but the broadcast ones grow with the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, cut, mix_int, short_batches, signed, text_bytes, Words

DEPTH = 5
#: Bytes of the context that grams are grouped by. It has at most 256**(DEPTH - ROOT + 1) different grams.
ROOT = 3
ROOTS = (1 << 8 * ROOT) - 1
#: Words and grams whose counts are broadcast, at most so many of each.
HOT = 1 << 20
#: Different words or grams that a task holds before their counts leave it.
HELD = 1 << 20
#: Grams whose trees a task mixes at once, if they have more than one context of ROOT bytes; each takes some 160 bytes of memory.
BLOCK = 1 << 17
#: Hash that stands for the end of a text.
END = np.uint64(0xE0D5C3A1977B5F2D)
WORDS, GRAMS = 0, 1


def learned() -> Column:
    """The documents to learn from: crc32 of the doc_id as text is not 1 modulo 5."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 != 1


def _lower(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def grams(data: np.ndarray, offsets: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """byte + 256 * byte before + 65536 * byte before that and so on, for each byte of the texts; before a text there are zeros."""
    out = data.astype(np.int64)
    begin = offsets[:-1][np.diff(offsets) > 0]
    for j in range(1, depth + 1):
        before = np.zeros(len(data), np.int64)
        before[j:] = data[:-j]
        for t in range(j):
            # In a shorter text, this is a byte of the next one that has fewer than j before it too.
            at = begin + t
            before[at[at < len(data)]] = 0
        out |= before << (8 * j)
    return out


# --- counting


def _summed(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    keys, n, m = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(n[order], at) if len(at) else n, np.add.reduceat(m[order], at) if len(at) else m


def _counted(rows: DataFrame, depth: int) -> DataFrame:
    """rows (body, learned) -> kind, key, n (in text to learn from), m (in all): words to learn from with one END a text, and the grams of all texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {WORDS: [], GRAMS: []}

        def leave(kind: int) -> pa.RecordBatch:
            keys, n, m = _summed(held[kind])
            held[kind] = []
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys), pa.array(n), pa.array(m)], names=["kind", "key", "n", "m"])

        def add(kind: int, keys: np.ndarray, n: np.ndarray, own: bool) -> bool:
            held[kind].append((keys, n if own else np.zeros_like(n), n))
            if sum(len(x[0]) for x in held[kind]) > HELD:
                held[kind] = [_summed(held[kind])]
            return len(held[kind]) == 1 and len(held[kind][0][0]) > HELD // 2

        for batch in batches:
            for own in (True, False):
                texts = batch.column(0).filter(pc.equal(batch.column(1), own))
                for i, j in chunks(texts):
                    w = Words(texts.slice(i, j - i))
                    if add(GRAMS, *np.unique(grams(_lower(w.data), w.offsets, depth), return_counts=True), own):
                        yield leave(GRAMS)
                    if own:
                        keys, n = np.unique(signed(w.hash), return_counts=True)
                        if add(WORDS, np.append(keys, signed(np.array([END]))), np.append(n, j - i), True):
                            yield leave(WORDS)
        for kind in (WORDS, GRAMS):
            if held[kind]:
                yield leave(kind)

    return cut(rows.mapInArrow(work, "kind int, key long, n long, m long").groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("m").alias("m")))


# --- the tree


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """By the recurrence up to x + 8 and then Stirling's series."""
    y = x + 8
    product = np.ones_like(x)
    for i in range(8):
        product = product * (x + i)
    z = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y - np.log(product)


def _kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov block probability."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - 2 * math.lgamma(0.5) - _log_gamma(zeros + ones + 1.0)


def _share(kt: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Weight of a context's own estimate against the mixture of longer ones."""
    return 0.5 * (1 + np.tanh(0.5 * np.clip(kt - below, -700, 700)))


def _half(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.logaddexp(x, y) - math.log(2)


class Level:
    """The nodes of one level of the code tree in all contexts of ROOT to depth bytes: what goes up from depth ROOT, and the estimates."""

    def __init__(self, k: int, rows: dict, counts: dict, up: dict, depth: int):
        self.k, self.depth, self.p, self.w, self.parent = k, depth, {}, {}, {}
        weighted = above = None
        for d in range(depth, ROOT - 1, -1):
            prefix = rows[d] >> (8 - k)
            at = np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1]]))
            own = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(prefix))))
            total = np.add.reduceat(counts[d], at)
            ones = np.add.reduceat(counts[d] * (rows[d] >> (7 - k) & 1), at)
            kt = _kt(total - ones, ones)
            if d == depth:
                self.of, weighted = own, kt
            else:
                self.parent[d] = own[up[d][above]]
                below = np.bincount(self.parent[d], weighted, len(at))
                self.w[d], weighted = _share(kt, below), _half(kt, below)
            self.p[d] = (ones + 0.5) / (total + 1)
            above = at
        root = rows[ROOT][above]
        #: The node with its last two bytes of context, as in Top.
        self.place = (root >> 8 & 0xFFFF) << 8 | 1 << k | (root & 255) >> (8 - k)
        self.zeros, self.ones, self.weighted = total - ones, ones, weighted

    def one(self, top: Top) -> np.ndarray:
        """Probability of a 1 at each node of the deepest contexts."""
        q, at = self.p[self.depth], np.arange(len(self.p[self.depth]))
        for d in range(self.depth - 1, ROOT - 1, -1):
            at = self.parent[d][at]
            q = self.w[d][at] * self.p[d][at] + (1 - self.w[d][at]) * q
        own, rest = top.at(self.place)
        return own[at] + rest[at] * q


def levels(keys: np.ndarray, n: np.ndarray, depth: int) -> Iterator[Level]:
    """The eight levels of whole trees below contexts of ROOT bytes; keys: different grams, sorted; n: their counts."""
    rows, counts, up = {depth: keys}, {depth: n.astype(np.float64)}, {}
    for d in range(depth - 1, ROOT - 1, -1):
        rows[d], up[d] = np.unique(rows[d + 1] & ((1 << 8 * (d + 1)) - 1), return_inverse=True)
        counts[d] = np.bincount(up[d], counts[d + 1])
    for k in range(8):
        yield Level(k, rows, counts, up, depth)


class Top:
    """Depths 0 to 2 mixed: at a node of a two-byte context, P(1) = own + rest * mixture from depth 3 on."""

    def __init__(self, place: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray):
        """place: 256 * context + node, each once; below: summed log-probabilities of the mixtures from depth 3 on."""
        order = np.argsort(place)
        self.place, z2, o2, below = (x[order] for x in (place, zeros, ones, below))
        at = (self.place >> 8 & 255, self.place & 255)
        kt2, p2 = _kt(z2, o2), (o2 + 0.5) / (z2 + o2 + 1)
        z1, o1, below1 = (np.zeros((256, 256)) for _ in range(3))
        for into, x in ((z1, z2), (o1, o2), (below1, _half(kt2, below))):
            np.add.at(into, at, x)
        kt1, p1 = _kt(z1, o1), (o1 + 0.5) / (z1 + o1 + 1)
        z0, o0, below0 = z1.sum(0), o1.sum(0), _half(kt1, below1).sum(0)
        w0, w1, w2 = _share(_kt(z0, o0), below0), _share(kt1, below1), _share(kt2, below)
        own, rest = w0 * (o0 + 0.5) / (z0 + o0 + 1) + (1 - w0) * w1 * p1, (1 - w0) * (1 - w1)
        self.own, self.rest = own[at] + rest[at] * w2 * p2, rest[at] * (1 - w2)

    def at(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = np.searchsorted(self.place, place)
        return self.own[found], self.rest[found]


def gram_scores(keys: np.ndarray, n: np.ndarray, depth: int, top: Top) -> np.ndarray:
    """log10 P(byte | bytes before) of each gram."""
    out = np.zeros(len(keys))
    for level in levels(keys, n, depth):
        one = level.one(top)[level.of]
        out += np.log10(np.where(keys >> (7 - level.k) & 1, one, 1 - one))
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Keys (sorted), n and m of whole trees below contexts of ROOT bytes, from rows in order of those contexts."""
    held, size = [], 0
    for b in batches:
        held.append(tuple(b.column(c).to_numpy() for c in ("key", "n", "m")))
        size += b.num_rows
        if size < BLOCK:
            continue
        keys, n, m = (np.concatenate(x) for x in zip(*held, strict=True))
        context = keys >> 8 & ROOTS
        done = int(np.searchsorted(context, context[-1]))
        if done:
            order = np.argsort(keys[:done])
            yield keys[:done][order], n[:done][order], m[:done][order]
        held, size = [(keys[done:], n[done:], m[done:])], len(keys) - done
        if not done:
            held, size = [(keys, n, m)], 0  # One context is larger than a block: wait for as much again.
    if held:
        keys, n, m = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(keys)
        if len(keys):
            yield keys[order], n[order], m[order]


def _tree(grams_: DataFrame, depth: int) -> DataFrame:
    """grams_ (key, n, m) -> key, m, value: log10 P(byte | bytes before) of each."""
    context = F.shiftright("key", 8).bitwiseAND(ROOTS)
    grouped = cut(grams_.select("key", "n", "m", context.alias("context")).repartition("context").sortWithinPartitions("context").drop("context"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, n, _ in _blocks(batches):
            for level in levels(keys, n, depth):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (level.place, level.zeros, level.ones, level.weighted)], names=["place", "zeros", "ones", "weighted"])

    found = grouped.mapInArrow(sums, "place long, zeros double, ones double, weighted double").groupBy("place").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "weighted"))).toArrow()
    top = grams_.sparkSession.sparkContext.broadcast(Top(*(found.column(c).to_numpy() for c in ("place", "zeros", "ones", "weighted"))))

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, n, m in _blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(m), pa.array(gram_scores(keys, n, depth, top.value))], names=["key", "m", "value"])

    return cut(grouped.mapInArrow(values, "key long, m long, value double"))


# --- scoring


class Hot:
    """key -> value by a table of slots; a slot leads to the most frequent of its keys, the others are searched for."""

    def __init__(self, keys: np.ndarray, m: np.ndarray, value: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.value = keys[order], value[order]
        self.shift = np.uint64(63 - max(8, len(keys).bit_length()))
        self.slot = np.zeros(1 << (64 - int(self.shift)), np.int32)
        rising = np.argsort(m[order], kind="stable")
        self.slot[self._at(self.keys[rising])] = rising

    def _at(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(mix_int(1) | 1)) >> self.shift

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, 0 for unknown keys, and whether they are known."""
        if not len(self.keys):
            return np.zeros(len(keys)), np.zeros(len(keys), bool)
        at = self.slot[self._at(keys)]
        known = self.keys[at] == keys
        miss = np.flatnonzero(~known)
        if len(miss):
            other = np.minimum(np.searchsorted(self.keys, keys[miss]), len(self.keys) - 1)
            at[miss], known[miss] = other, self.keys[other] == keys[miss]
        return np.where(known, self.value[at], 0.0), known


def _hot(found: DataFrame, most: int) -> tuple[Hot, int]:
    """found (key, m, value): the rows with the largest m, at most so many, and the least m that they all have; rows of equal m stay together."""
    by = found.groupBy("m").agg(F.count("*").alias("w"))
    least = 0
    if found.count() > most:
        # The largest counts belong to few rows each; a few thousand rows settle where the bound is met.
        got, least = 0, 1 << 62
        for r in by.orderBy(F.desc("m")).limit(most).toLocalIterator():
            if got + r["w"] > most:
                break
            got, least = got + r["w"], r["m"]
    t = found.where(F.col("m") >= least).select("key", "m", "value").toArrow()
    return Hot(*(t.column(c).to_numpy() for c in ("key", "m", "value"))), least


def _lists(keys: np.ndarray, doc: np.ndarray, n: int) -> pa.ListArray:
    """The keys of each of n texts; doc is in order."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)), pa.array(keys))


def score(docs: DataFrame, learn: Column | None = None, hot: int = HOT, depth: int = DEPTH) -> DataFrame:
    """docs (doc_id, text) -> doc_id, learned, n_bytes, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte, a row for every row.

    Learns from rows where learn holds (learned() by default). Text is lower-cased in A-Z; null is empty: one token, the end, and score 0. With nothing
    to learn from, N and V are 0 and every byte has probability 1/256. depth is 3 at least.
    """
    chosen = learned() if learn is None else F.coalesce(learn, F.lit(False))
    rows = short_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("body"), chosen.alias("learned"))
    counts = _counted(rows.select("body", "learned"), depth)
    gain = F.log10(F.col("n") + 0.5) - F.lit(math.log10(0.5))
    words = counts.where(F.col("kind") == WORDS).select("key", "m", "n", gain.alias("value"))
    trees = _tree(counts.where(F.col("kind") == GRAMS), depth)
    tokens, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    (hot_words, least_word), (hot_grams, least_gram) = _hot(words, hot), _hot(trees, hot)
    model = docs.sparkSession.sparkContext.broadcast((hot_words, hot_grams, tokens, distinct))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_words, hot_grams, tokens, distinct = model.value
        unseen, scale = math.log10(0.5), math.log10(tokens + 0.5 * (distinct + 1))
        for batch in batches:
            for i, j in chunks(batch.column(1)):
                w = Words(batch.column(1).slice(i, j - i))
                count = np.diff(w.at) + 1
                doc, h = np.concatenate([w.doc(), np.arange(j - i)]), signed(np.concatenate([w.hash, np.full(j - i, END)]))
                value, known = hot_words.get(h)
                base = np.bincount(doc, value, j - i) + count * (unseen - scale)
                seen = np.bincount(doc, known, j - i).astype(np.int64)
                rare = np.flatnonzero(~known)
                rare = rare[np.argsort(doc[rare], kind="stable")]
                words_left = _lists(h[rare], doc[rare], j - i)
                g = grams(_lower(w.data), w.offsets, depth)
                size = np.diff(w.offsets)
                doc = np.repeat(np.arange(j - i), size)
                value, known = hot_grams.get(g)
                rare = np.flatnonzero(~known)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(size), pa.array(count.astype(np.int64)), pa.array(seen), pa.array(base), pa.array(np.bincount(doc, value, j - i)), words_left, _lists(g[rare], doc[rare], j - i)], names=["doc_id", "learned", "n_bytes", "n_tokens", "n_known", "base_score", "score", "words_left", "grams_left"])

    scored = rows.mapInArrow(work, "doc_id long, learned boolean, n_bytes long, n_tokens long, n_known long, base_score double, score double, words_left array<long>, grams_left array<long>")
    scored = cut(scored.withColumn("row", F.monotonically_increasing_id()))
    left = lambda kind, c: scored.select("row", F.lit(kind).alias("kind"), F.explode(c).alias("key"))
    rest = lambda kind, found, least: found.where(F.col("m") < least).select(F.lit(kind).alias("kind"), "key", "value")
    each = left(WORDS, "words_left").unionByName(left(GRAMS, "grams_left"))
    cold = rest(WORDS, words, least_word).unionByName(rest(GRAMS, trees, least_gram))
    of = lambda kind: F.when(F.col("kind") == kind, F.col("value"))
    more = each.join(cold, ["kind", "key"]).groupBy("row").agg(F.count(of(WORDS)).alias("more"), F.sum(of(WORDS)).alias("gain"), F.sum(of(GRAMS)).alias("rest"))
    out = scored.drop("words_left", "grams_left").join(more, "row", "left")
    out = out.withColumn("score", F.col("score") + F.coalesce("rest", F.lit(0.0)))
    return out.select("doc_id", "learned", "n_bytes", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), (F.col("base_score") + F.coalesce("gain", F.lit(0.0))).alias("base_score"), "score", F.when(F.col("n_bytes") > 0, -F.col("score") * math.log2(10) / F.col("n_bytes")).alias("bits_per_byte"))
