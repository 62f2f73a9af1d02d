"""Benchmark decontamination by spaced-seed hashing.

A seed reads the tokens where a fixed mask has a 1 and ignores those between, so that a replaced word there costs nothing. The hashes of all
seeds of the benchmark meet those of the corpus. The masks are lossless: however the tokens that the rule allows to differ lie in a
stretch, one of the masks fits somewhere among the others, so every stretch that the rule accepts has a hit. Around a hit, document and
item are laid side by side and compared token by token.

A benchmark of up to SLICE_BYTES of text is broadcast and joined in memory, in one pass over the documents. A larger one is joined by a shuffle on
the hashes of both sides: the documents are read once for their seeds, of which a bitmap of fixed size turns away most that no
item has, and once more where they have hits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NOT_ALNUM, chunks, cut, hinted, mix, short_batches, signed, text_bytes, unused, Words

#: Tokens of an aligned stretch, and the part of them that must be equal. Shorter items are one stretch.
STRETCH, EQUAL = 20, 0.8
#: Items with fewer tokens are found only whole.
LEAST = 8
#: Fixed masks for stretches of 15 to 20 tokens, of which 3 or 4 may differ, and for those of 8 to 14, of which 1 or 2 may.
LONG_FROM = 15
LONG = ("1111-111", "11-1---1-111", "111-11---11", "11--1-1--1-11", "1-1---11-111", "11--11-11--1")
SHORT = ("1111-11", "11--1111", "11-11--11", "1111-1-1", "1-1-1111")
#: Bytes of benchmark text that are broadcast.
SLICE_BYTES = 8 << 20
#: Bits of the map that turns away seeds of the documents where the benchmark is larger; it is broadcast, 32 MB.
MAP_BITS = 1 << 28
#: Distances at which a text may repeat itself for long without more work than one repeat is.
PERIODS = (1, 2, 3, 4)
#: Hits that are laid side by side at once.
HITS = 1 << 14

_ODD = mix(np.arange(1, 32, dtype=np.uint64)) | np.uint64(1)


def needed(n: int) -> int:
    """Tokens of a stretch of n that must be equal."""
    return n if n < LEAST else int(np.ceil(EQUAL * n - 1e-9))


def masks_of(n: int) -> tuple[str, ...]:
    """The masks for items of n tokens: all tokens where all must be equal."""
    return () if n < 1 else ("1" * n,) if n < LEAST else SHORT if n < LONG_FROM else LONG


#: All masks, for looking up by number; no number is used for two.
MASKS = (*(m for n in range(1, LEAST) for m in masks_of(n)), *SHORT, *LONG)


def seeds(w: Words, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens that the mask reads from each place on, and whether it lies in one text there."""
    n = max(0, len(w.hash) - len(mask) + 1)
    total = np.full(n, MASKS.index(mask) + 1, np.uint64)
    for k, i in enumerate(i for i, c in enumerate(mask) if c == "1"):
        total += w.hash[i : i + n] * _ODD[k]
    doc = w.doc()
    return mix(total), doc[:n] == doc[len(mask) - 1 : len(mask) - 1 + n]


def settled(w: Words, reach: int) -> np.ndarray:
    """By token: whether the `reach` tokens before it and from it on all repeat those some places earlier, in one text, at one of the distances PERIODS.

    With an item of at most `reach` tokens, whatever alignment such a token is in, the one shifted back by that distance has the same equal tokens and comes earlier.
    So it is never the best, and its hits need not be looked at.
    """
    n, doc = len(w.hash), w.doc()
    out = np.zeros(n, bool)
    for q in PERIODS:
        if n >= 2 * reach + q:
            total = np.zeros(n + 1, np.int64)
            total[q + 1 :] = np.cumsum((w.hash[q:] == w.hash[:-q]) & (doc[q:] == doc[:-q]))
            out[reach : n - reach + 1] |= (total[2 * reach :] - total[: n + 1 - 2 * reach] == 2 * reach)[: n - reach]
    return out


class Side:
    """The benchmark's side of the join in memory: sorted seeds with positions, and a bitmap that turns most others away."""

    def __init__(self, items: list[tuple[int, bytes]]):
        w = Words(pa.array([t for _, t in items], pa.binary()), separators=NOT_ALNUM)
        self.ids = np.array([i for i, _ in items], np.int64)
        self.words, self.at, self.doc = w.hash, w.at, w.doc()
        length = np.diff(w.at)
        self.reach = max(STRETCH, int(length.max(initial=0)))
        size = np.minimum(length, STRETCH)
        self.need = np.array([needed(n) for n in range(STRETCH + 1)])[size]
        # By mask: sorted hashes, positions, bitmap and its mask.
        self.seeds: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray, np.uint64]] = {}
        for mask in sorted({m for n in set(size.tolist()) for m in masks_of(n)}, key=MASKS.index):
            own = np.array([mask in masks_of(n) for n in range(STRETCH + 1)])[size]
            h, inside = seeds(w, mask)
            p = np.flatnonzero(inside & own[self.doc[: len(h)]])
            h = h[p]
            order = np.argsort(h, kind="stable")
            n = 1 << max(16, int(len(h)).bit_length() + 5)
            bits = np.zeros(n, bool)
            bits[h & np.uint64(n - 1)] = True
            self.seeds[mask] = h[order], p[order], bits, np.uint64(n - 1)


def _stretches(equal: np.ndarray, least: int) -> tuple[int, int, int] | None:
    """First and last token of the union of stretches of `least` tokens with enough equal ones, and how many are equal there."""
    need = needed(least)
    total = np.concatenate([[0], np.cumsum(equal)])
    good = np.flatnonzero(total[least:] - total[:-least] >= need)
    if not len(good):
        return None
    first, last = int(good[0]), int(good[-1]) + least
    return first, last, int(total[last] - total[first])


Found = tuple[int, int, int]


def alignment(text: np.ndarray, item: np.ndarray, diagonals: Iterable[int]) -> Found | None:
    """(first token, end token, equal tokens) of the best match of an item in a text at some shifts; of equally good ones the first."""
    best = None
    n = min(STRETCH, len(item))
    for shift in diagonals:
        first, last = max(0, shift), min(len(text), len(item) + shift)
        if last - first < n:
            continue
        found = _stretches(text[first:last] == item[first - shift : last - shift], n)
        if found:
            new = (first + found[0], first + found[1], found[2])
            if best is None or (-new[2], new) < (-best[2], best):
                best = new
    return best


def _near(side: Side, w: Words, docs: np.ndarray, at: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
    """Whether enough tokens are equal in some STRETCH places around hits of k tokens, within both texts: true for all that an accepted stretch holds."""
    o = np.arange(k - STRETCH, STRETCH)
    d, item = docs[at], side.doc[q]
    x, y = at[:, None] + o, q[:, None] + o
    inside = (x >= w.at[d][:, None]) & (x < w.at[d + 1][:, None]) & (y >= side.at[item][:, None]) & (y < side.at[item + 1][:, None])
    equal = inside & (w.hash[np.clip(x, 0, len(w.hash) - 1)] == side.words[np.clip(y, 0, len(side.words) - 1)])
    total = np.zeros((len(at), len(o) + 1), np.int16)
    np.cumsum(equal, axis=1, out=total[:, 1:])
    return (total[:, STRETCH:] - total[:, :-STRETCH]).max(1) >= side.need[item]


def matches(side: Side, w: Words) -> list[tuple[int, int, int, int, int]]:
    """(text, item's row, first token, end token, equal tokens) of each text's best match with each item."""
    met: dict[tuple[int, int], set[int]] = {}
    docs, over = w.doc(), settled(w, side.reach)
    for mask, (hashes, places, bits, low_bits) in side.seeds.items():
        h, inside = seeds(w, mask)
        p = np.flatnonzero(inside & ~over[: len(h)] & bits[h & low_bits])
        low, high = np.searchsorted(hashes, h[p], "left"), np.searchsorted(hashes, h[p], "right")
        ends = np.cumsum(high - low)
        for start in range(0, int(ends[-1]) if len(ends) else 0, HITS):
            hit = np.arange(start, min(start + HITS, int(ends[-1])))
            row = np.searchsorted(ends, hit, "right")
            at, q = p[row], places[high[row] - ends[row] + hit]
            near = _near(side, w, docs, at, q, len(mask))
            at, q = at[near], q[near]
            shift = (at - w.at[docs[at]]) - (q - side.at[side.doc[q]])
            for d, item, s in np.unique(np.stack([docs[at], side.doc[q], shift]), axis=1).T.tolist():
                met.setdefault((d, item), set()).add(s)
    out = []
    for (d, item), shifts in sorted(met.items()):
        found = alignment(w.hash[w.at[d] : w.at[d + 1]], side.words[side.at[item] : side.at[item + 1]], sorted(shifts))
        if found:
            out.append((d, item, *found))
    return out


_OUT = "doc_id long, item_id long, first_token long, end_token long, equal_tokens long"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=["doc_id", "item_id", "first_token", "end_token", "equal_tokens"])


def _in_memory(rows: DataFrame, own: list[tuple[int, bytes]]) -> DataFrame:
    side = rows.sparkSession.sparkContext.broadcast(Side(own))

    def work(batches):
        s = side.value
        for batch in batches:
            for i, j in chunks(batch.column(1)):
                found = matches(s, Words(batch.column(1).slice(i, j - i), separators=NOT_ALNUM))
                ids = batch.column(0).slice(i, j - i).to_pylist()
                if found:
                    yield _batch([(ids[d], int(s.ids[item]), a, b, n) for d, item, a, b, n in found])

    return rows.mapInArrow(work, _OUT)


_PAGE = 1 << 16


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """MAP_BITS bits, packed, with those of the hashes (h long) set. Each task sends its own map's pages that aren't empty; pages are joined before the driver gets them."""

    def local(batches):
        bits = np.zeros(MAP_BITS, bool)
        for batch in batches:
            bits[batch.column(0).to_numpy().view(np.uint64) & np.uint64(MAP_BITS - 1)] = True
        pages = bits.reshape(-1, _PAGE)
        for i in np.flatnonzero(pages.any(1)):
            yield pa.RecordBatch.from_arrays([pa.array([int(i)], pa.int32()), pa.array([np.packbits(pages[i]).tobytes()], pa.binary())], names=["page", "bits"])

    def union(t: pa.Table) -> pa.Table:
        whole = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in t.column("bits").to_pylist()])
        return pa.table({"page": t.column("page").slice(0, 1), "bits": pa.array([whole.tobytes()], pa.binary())})

    kind = "page int, bits binary"
    out = np.zeros((MAP_BITS // _PAGE, _PAGE // 8), np.uint8)
    for r in hashes.mapInArrow(local, kind).groupBy("page").applyInArrow(union, kind).toLocalIterator():
        out[r["page"]] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out.reshape(-1)


def _seeded(rows: DataFrame, whole_items: bool, bitmap=None, reach: int = 0) -> DataFrame:
    """rows (id, row, body) -> id, row, at, h: the seeds of items by the masks of their length, or of documents by all masks, where the bitmap has them and items of up to `reach` tokens need them."""

    def work(batches) -> Iterator[pa.RecordBatch]:
        have = None if bitmap is None else bitmap.value
        for batch in batches:
            for i, j in chunks(batch.column(2)):
                w = Words(batch.column(2).slice(i, j - i), separators=NOT_ALNUM)
                ids, keys, docs, length = batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), w.doc(), np.minimum(np.diff(w.at), STRETCH)
                over = settled(w, reach) if reach else np.zeros(len(w.hash), bool)
                for mask in MASKS:
                    h, inside = seeds(w, mask)
                    inside = inside & ~over[: len(h)]
                    if whole_items:
                        inside = inside & np.array([mask in masks_of(n) for n in range(STRETCH + 1)])[length][docs[: len(h)]]
                    if have is not None:
                        bit = h & np.uint64(MAP_BITS - 1)
                        inside = inside & (have[bit >> np.uint64(3)] >> (7 - (bit & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
                    p = np.flatnonzero(inside)
                    d = pa.array(docs[p])
                    yield pa.RecordBatch.from_arrays([ids.take(d), keys.take(d), pa.array((p - w.at[docs[p]]).astype(np.int32)), pa.array(signed(h[p]))], names=["id", "row", "at", "h"])

    return rows.mapInArrow(work, "id long, row long, at int, h long")


def _by_shuffle(rows: DataFrame, items: DataFrame) -> DataFrame:
    """The same rows as _in_memory for a benchmark of any size."""
    context = rows.sparkSession.sparkContext
    keyed = lambda d, name: d.select(F.col(name).alias("id"), F.xxhash64(F.lit(2), "body").alias("row"), "body")
    bench = keyed(items, "item_id")
    own = cut(_seeded(bench, True))
    documents = keyed(rows, "doc_id")
    longest = bench.agg(F.max(F.octet_length("body"))).first()[0] or 0
    hits = _seeded(documents, False, context.broadcast(_bitmap(own.select("h"))), max(STRETCH, longest // 2 + 1))
    theirs = own.select(F.col("id").alias("item_id"), F.col("row").alias("item"), F.col("at").alias("there"), "h")
    met = hits.join(theirs, "h").groupBy("id", "row", "item_id", "item").agg(F.collect_set(F.col("at") - F.col("there")).alias("shifts"))
    met = cut(met)
    none = lambda kind: F.lit(None).cast(kind)
    pairs = met.join(bench.select(F.col("id").alias("item_id"), F.col("row").alias("item"), "body"), ["item_id", "item"]).select("id", "row", F.lit(1).alias("turn"), "body", "item_id", "shifts")
    held = documents.join(met.select(F.col("id").alias("i2"), F.col("row").alias("r2")).distinct(), F.col("id").eqNullSafe(F.col("i2")) & (F.col("row") == F.col("r2")), "left_semi")
    texts = held.select("id", "row", F.lit(0).alias("turn"), "body", none("long").alias("item_id"), none("array<int>").alias("shifts"))

    def work(batches):
        now, copies, text = None, 0, None
        for batch in batches:
            out = []
            for id_, row, turn, body, item_id, shifts in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                w = Words(pa.array([body], pa.binary()), separators=NOT_ALNUM).hash
                if turn == 0:
                    copies = copies + 1 if now == (id_, row) else 1
                    now, text = (id_, row), w
                elif found := alignment(text, w, sorted(shifts)):
                    out += [(id_, item_id, *found)] * copies
            if out:
                yield _batch(out)

    return texts.unionByName(pairs).repartition("id", "row").sortWithinPartitions("id", "row", "turn").mapInArrow(work, _OUT)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs (doc_id, text), benchmark (item_id, text) -> doc_id, item_id, first_token, end_token, equal_tokens: a row for each document and item that it holds.

    Tokens are runs of letters and digits (bytes from 128 on count as letters), A-Z lower-cased. A document holds an item if STRETCH aligned tokens (the
    whole item, if it has fewer) are equal in EQUAL of their places; items of fewer than LEAST tokens must be found whole. Of several matches the one
    with most equal tokens is given, the first on ties. Null texts, and items without tokens, match nothing. Ids must fit into a long;
    a null doc_id stays null, and repeated rows give repeated results.
    """
    items = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), text_bytes().alias("body")).distinct()
    size = items.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    rows = short_batches(docs).where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("body"))
    if size <= SLICE_BYTES:
        return _in_memory(rows, [(r[0], bytes(r[1])) for r in items.where("item_id IS NOT NULL").collect()])
    return _by_shuffle(rows, items.where("item_id IS NOT NULL"))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that hold a benchmark item, judged by their texts whatever their ids; all columns stay.

    Texts go by a 64-bit hash. Those that are found go through the search again by another hash, so that a clean text stays unless both hashes are those of a text that goes.
    """
    body = F.coalesce(F.col("text"), F.lit(""))
    one, two = F.xxhash64(body), F.xxhash64(F.lit(1), body)
    a, b = unused(docs, "_gone", "_again")
    found = cut(leaks(docs.withColumn("doc_id", one), benchmark).select(F.col("doc_id").alias(a)).distinct())
    suspects = docs.select(one.alias("one"), two.alias("doc_id"), "text").join(hinted(found), F.col("one") == F.col(a), "left_semi").dropDuplicates(["one", "doc_id"])
    suspects = cut(suspects)
    again = leaks(suspects, benchmark).select(F.col("doc_id").alias(b)).distinct()
    gone = cut(suspects.join(again, F.col("doc_id") == F.col(b)).select(F.col("one").alias(a), F.col("doc_id").alias(b)))
    return docs.join(gone, (one == F.col(a)) & (two == F.col(b)), "left_anti")


__all__ = ["MASKS", "Side", "alignment", "keep_clean", "leaks", "masks_of", "matches", "needed", "seeds"]
