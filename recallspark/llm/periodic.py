"""Periodic runs of words by the linear tandem-repeat method of Gusfield and Stoye.

A tandem repeat is a stretch of words that is some sequence twice. Of each kind, the leftmost one crosses a border of two Lempel-Ziv blocks: it would else
have been copied from further left. At each border and for each period, two extensions (Z-functions) give the first of the tandem repeats that cross there one
after the other. Their ends are marked in a suffix tree; from each mark, a walk along suffix links turns the repeat by a word at a time until it fails or meets a
mark, which completes the vocabulary. Then the leaves below each mark of a primitive repeat are where it stands; those of one period that start one after the other are a run.

Only stretches that can hold a run go that way: with runs of MIN_RUN words or more, each of a run's words is in a sequence of GRAM words that
the document repeats. Stretches of a task are put together, with a symbol of its own after each, in strings of about STRING words.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, chunks, short_batches, text_bytes

#: Words of the shortest run that counts.
MIN_RUN = 12
#: A run of 12 words or more with period q is covered by sequences of that many words that stand again q words further on or back.
GRAM = 6
#: Words of the strings that are searched, if no stretch is longer.
STRING = 1 << 16


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in order, by doubling: each round sorts by twice as many symbols. A suffix comes before those that it starts."""
    n = len(s)
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    k = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - k] = rank[k:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        rank[order] = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1])))
        k *= 2
        if k >= n or rank[order[-1]] == n - 1:
            return order


def z_function(s: list[int]) -> list[int]:
    """For each place, how many symbols from there on are those of the start; the length at place 0."""
    n = len(s)
    z = [n] + [0] * (n - 1)
    left = right = 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


class SuffixTree:
    """Suffix tree of a string whose last symbol is unique. Nodes 0 to inner - 1 are inner ones (0: the root), node inner + r is the leaf of rank r."""

    def __init__(self, s: np.ndarray):
        self.s, self.n = array("i", s.astype(np.int32).tobytes()), len(s)
        order = suffix_array(s)
        self.order = order
        sa = self.sa = array("i", order.astype(np.int32).tobytes())
        rank = np.empty(self.n, np.int32)
        rank[order] = np.arange(self.n, dtype=np.int32)
        self._build(sa, array("i", rank.tobytes()))
        self._links()

    def _common(self, sa: array, rank: array) -> array:
        """Symbols that each suffix shares with the one before in order."""
        s, n, k = self.s, self.n, 0
        out = array("i", bytes(4 * n))
        for i in range(n):
            r = rank[i]
            if r:
                j = sa[r - 1]
                while s[i + k] == s[j + k]:  # ends at the unique last symbol
                    k += 1
                out[r] = k
                k -= k > 0
            else:
                k = 0
        return out

    def _build(self, sa: array, rank: array) -> None:
        common, n = self._common(sa, rank), self.n
        depth, low, high, up = array("i", [0]), array("i", [0]), array("i", [n]), array("i", [-1])
        leaf_up = array("i", bytes(4 * n))
        path = [0]
        for r in range(n):
            d = common[r]
            below = -1
            while depth[path[-1]] > d:
                below = path.pop()
                high[below] = r
            if depth[path[-1]] < d:
                # A node above the one that was left, or above the last leaf.
                new = len(depth)
                depth.append(d)
                low.append(low[below] if below >= 0 else r - 1)
                high.append(n)
                up.append(path[-1])
                if below >= 0:
                    up[below] = new
                else:
                    leaf_up[r - 1] = new
                path.append(new)
            elif below >= 0:
                up[below] = path[-1]
            leaf_up[r] = path[-1]
        while len(path) > 1:
            high[path.pop()] = n
        inner = self.inner = len(depth)
        self.depth = array("i", depth)
        self.low, self.high, self.up = array("i", low), array("i", high), array("i", up)
        order = self.order
        self.depth.extend(array("i", (n - order).astype(np.int32).tobytes()))
        self.low.extend(range(n))
        self.high.extend(range(1, n + 1))
        self.up.extend(leaf_up)
        # Children by first symbol, which is the order of their leaves.
        top, first = np.frombuffer(self.up, np.int32), np.frombuffer(self.low, np.int32)
        kids = np.lexsort((first, top))[1:]  # without the root
        count = np.bincount(top[kids], minlength=inner)
        self.at = array("i", np.concatenate(([0], np.cumsum(count))).astype(np.int32).tobytes())
        self.kids = array("i", kids.astype(np.int32).tobytes())
        symbols = np.frombuffer(self.s, np.int32)
        self.symbol = array("i", symbols[order[first[kids]] + np.frombuffer(self.depth, np.int32)[top[kids]]].astype(np.int32).tobytes())
        # The smallest start below each node, from the deepest nodes up.
        least = array("i", np.concatenate((np.full(inner, n), order)).astype(np.int32).tobytes())
        up = self.up
        for v in range(inner, inner + n):
            if least[v] < least[up[v]]:
                least[up[v]] = least[v]
        for v in np.argsort(-np.frombuffer(self.depth, np.int32)[:inner], kind="stable").tolist():
            if v and least[v] < least[up[v]]:
                least[up[v]] = least[v]
        self.least = least

    def child(self, node: int, symbol: int) -> int:
        """The node below by an edge that begins with the symbol, or -1."""
        i = bisect_left(self.symbol, symbol, self.at[node], self.at[node + 1])
        return self.kids[i] if i < self.at[node + 1] and self.symbol[i] == symbol else -1

    def descend(self, node: int, start: int, length: int) -> int:
        """From a node, the first at depth length or more towards s[start : start + length], which occurs: one look an edge."""
        depth, s = self.depth, self.s
        while depth[node] < length:
            node = self.child(node, s[start + depth[node]])
        return node

    def _links(self) -> None:
        """Suffix links of inner nodes, from the root down: each starts at its parent's link, and all looks together are linear in the string."""
        self.link = array("i", bytes(4 * self.inner))
        for v in np.argsort(np.frombuffer(self.depth, np.int32)[: self.inner], kind="stable").tolist()[1:]:
            u, i, d = self.up[v], self.least[v], self.depth[v]
            self.link[v] = self.descend(self.link[u], i + 1, d - 1)


def blocks(tree: SuffixTree) -> Iterator[int]:
    """Starts of the Lempel-Ziv blocks, and the end: each is the longest stretch that began before as well, or one symbol."""
    i, n, up, least, depth, inner = 0, tree.n, tree.up, tree.least, tree.depth, tree.inner
    leaf = array("i", bytes(4 * n))
    for r in range(n):
        leaf[tree.sa[r]] = inner + r
    yield 0
    while i < n:
        v = leaf[i]
        while v > 0 and least[v] == i:
            v = up[v]
        i += max(1, depth[v])
        yield i


def covering(tree: SuffixTree) -> dict[int, list[int]]:
    """Starts of tandem repeats with their periods, such that the leftmost one of each kind is reached from one of them by steps of a word to the right."""
    s, out = tree.s, {}
    starts = list(blocks(tree))
    for a, b, c in zip(starts[:-1], starts[1:], [*starts[2:], starts[-1]], strict=True):
        # The border is b. Its second half holds the border, or ends before it: periods up to both blocks' lengths.
        most = c - a if c > b else 0
        if most:
            ahead = s[b : min(tree.n, b + 2 * most)].tolist()
            behind = s[max(0, b - 2 * most) : b].tolist()[::-1]
            # How far the text from b on equals that from b - k on, and the text before b that before b - k.
            forward = z_function(ahead + [-1] + s[max(0, b - most) : min(tree.n, b + most)].tolist())
            shift, base = len(ahead) + 1, max(0, b - most)
            back = z_function(behind) if behind else []
            for k in range(1, min(most, b) + 1):
                k1, k2 = forward[shift + b - k - base], back[k] if k < len(back) else 0
                if k1 + k2 >= k:
                    j = max(b - k - k2, b - 2 * k + 1)
                    if 0 <= j and j + k <= b - k + k1:
                        out.setdefault(j, []).append(k)
        # The border is a, in the first half; the second half is in the block from a to b.
        if a:
            size = b - a
            ahead = z_function(s[a : min(tree.n, a + 2 * size)].tolist())
            before = s[max(0, a - size) : a].tolist()[::-1]
            joined = z_function(before + [-1] + s[max(0, a - size) : min(tree.n, a + size)].tolist()[::-1])
            top = min(tree.n, a + size)
            for k in range(1, size + 1):
                k1 = ahead[k] if k < len(ahead) else 0
                # The text before a + k, backwards, begins at place top - (a + k).
                k2 = joined[len(before) + 1 + top - a - k]
                if k1 + k2 >= k and k2:
                    j = max(a - k2, a - k)
                    if j < a and j + k <= a + k1:
                        out.setdefault(j, []).append(k)
    return out


def vocabulary(tree: SuffixTree) -> dict[int, dict[int, int]]:
    """All kinds of tandem repeats: for each period the nodes below whose edge they end, with a start of each."""
    n, up, depth, least, link, inner, s = tree.n, tree.up, tree.depth, tree.least, tree.link, tree.inner, tree.s
    found: dict[int, dict[int, int]] = {}
    todo = []
    pairs = covering(tree)
    rank = array("i", bytes(4 * n))
    for r in range(n):
        rank[tree.sa[r]] = r
    for i, periods in pairs.items():
        v = inner + rank[i]
        for k in sorted(set(periods), reverse=True):
            # Further up, another start is the smallest, and has the mark or one that leads to it.
            while least[v] == i and depth[up[v]] >= 2 * k:
                v = up[v]
            if least[v] != i:
                break
            found.setdefault(k, {})[v] = i
            todo.append((v, i, k))
    for v, i, k in todo:
        marks = found[k]
        while True:
            u, size = up[v], 2 * k
            # The repeat without its first word, then with that word at its end.
            w = tree.descend(link[u], i + 1, size - 1)
            if depth[w] == size - 1:
                w = tree.child(w, s[i])
                if w < 0:
                    break
            elif s[least[w] + size - 1] != s[i]:
                break
            v, i = w, least[w]
            if v in marks:
                break
            marks[v] = i
    return found


def runs(s: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a string of numbers: stretches of at least twice their smallest period that no neighbour extends."""
    if len(s) < 2:
        return []
    # Symbols from 1 on; 0 is the unique last one.
    tree = SuffixTree(np.concatenate((np.unique(s, return_inverse=True)[1] + 1, [0])))
    marks, out = vocabulary(tree), []
    for k in sorted(marks):
        kinds = marks.pop(k)
        if not kinds:
            continue
        starts = np.sort(np.concatenate([tree.order[tree.low[v] : tree.high[v]] for v in kinds]))
        cut = np.flatnonzero(np.diff(starts) > 1) + 1
        first, last = starts[np.concatenate(([0], cut))], starts[np.concatenate((cut - 1, [len(starts) - 1]))]
        out += [(a, z - a + 2 * k, k) for a, z in zip(first.tolist(), last.tolist(), strict=True)]
        # Repeats of a multiple of the period within these runs have a root that is itself a repetition.
        longest = int((last - first).max()) + 2 * k
        for m in range(2 * k, longest // 2 + 1, k):
            others = marks.get(m)
            if others:
                nodes, at = np.array(list(others)), np.array(list(others.values()))
                r = np.searchsorted(first, at, "right") - 1
                within = (r >= 0) & (at + 2 * m <= last[r] + 2 * k)
                for v in nodes[within].tolist():
                    del others[v]
    return out


def repeated(words: Words) -> np.ndarray:
    """Whether each word is in a sequence of GRAM words that its text has twice."""
    alive = np.zeros(len(words.hash) + 1, np.int64)
    gram, whole = words.grams(GRAM)
    at = np.flatnonzero(whole)
    if len(at):
        doc = words.doc()[at]
        order = np.lexsort((gram[at], doc))
        g, d = gram[at][order], doc[order]
        same = (g[1:] == g[:-1]) & (d[1:] == d[:-1])
        twice = np.zeros(len(at), bool)
        twice[order[1:]] = same
        twice[order[:-1]] |= same
        np.add.at(alive, at[twice], 1)
        np.add.at(alive, at[twice] + GRAM, -1)
    return np.cumsum(alive)[:-1] > 0


def find(texts: list[list[bytes]], words: Words) -> list[list[tuple[int, int, int]]]:
    """Runs of MIN_RUN words or more of each list of words, by start, then period; words are the same ones, hashed."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    alive = np.concatenate(([False], repeated(words), [False]))
    edge = np.zeros(len(alive) + 1, bool)
    edge[words.at] = True  # a stretch ends with its text
    inside = alive[1:-1]
    first = np.flatnonzero(inside & (~alive[:-2] | edge[: len(inside)]))
    last = np.flatnonzero(inside & (~alive[2:] | edge[1 : len(inside) + 1])) + 1
    wide = last - first >= MIN_RUN
    first, last = first[wide], last[wide]
    doc = words.doc()

    def search(part: list[tuple[int, int]]) -> None:
        ids: dict[bytes, int] = {}
        symbols, places = array("i"), []
        for a, b in part:
            d = int(doc[a])
            at = a - int(words.at[d])
            places.append((len(symbols), d, at))
            symbols.extend([ids.setdefault(w, len(ids)) for w in texts[d][at : at + b - a]])
            symbols.append(-len(places))  # in no other place
        begins = [p[0] for p in places]
        for start, length, period in runs(np.frombuffer(symbols, np.int32)):
            if length >= MIN_RUN:
                begin, d, at = places[bisect_left(begins, start + 1) - 1]
                out[d].append((at + start - begin, length, period))

    part, size = [], 0
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        if part and size + b - a > STRING:
            search(part)
            part, size = [], 0
        part.append((a, b))
        size += b - a
    if part:
        search(part)
    for r in out:
        r.sort(key=lambda x: (x[0], x[2]))
    return out


def planted(n: int, h: int) -> list[int] | None:
    """Places of the words that a document of n words with hash h gets, or None where they stay: from a word on, the first p of them again and again."""
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [*range(a), *(a + i % p for i in range(n - a))]


def detect(docs: DataFrame, plant: bool = False) -> DataFrame:
    """docs (doc_id, text) -> doc_id, runs (array of start, length, period, by start, then period), collapsed (text), for every row.

    Words end at ASCII white space. A run is a stretch of MIN_RUN words or more and of twice its smallest period or more that no neighbouring word extends.
    collapsed has the words, joined by a space, but for those that a run contains after its first period. Words are compared as bytes. Null texts count as empty.
    plant: periodic words are put into a tenth of the documents, by the CRC-32 of doc_id (none where it is null); rows with the same doc_id each have a row.
    """

    def row(found: list[tuple], kept: bytes) -> tuple:
        return [dict(zip(("start", "length", "period"), r, strict=True)) for r in found], kept.decode("utf-8", "replace")

    each = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    return _mapped(docs, plant, row, [("runs", pa.list_(each)), ("collapsed", pa.string())], "runs array<struct<start:long,length:long,period:long>>, collapsed string")


def digest(docs: DataFrame, plant: bool = True) -> DataFrame:
    """The same, as numbers and hashes: n_runs, the longest run (ties: smallest start, then period), runs_sha256, collapsed_sha256."""

    def row(found: list[tuple], kept: bytes) -> tuple:
        text = "".join(f"{a},{n},{q}\n" for a, n, q in found)
        a, n, q = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
        return len(found), a, n, q, 1000 * n // q if found else None, hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()

    names = [*((c, pa.int64()) for c in ("n_runs", "start", "length", "period", "exponent_milli")), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())]
    return _mapped(docs, plant, row, names, "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")


def _mapped(docs: DataFrame, plant: bool, row, fields: list[tuple], kind: str) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), *fields])

    def part(ids: list, bodies: list[bytes]) -> Iterator[tuple]:
        texts = []
        for i, body in zip(ids, bodies, strict=True):
            w = body.split()  # at the same white space as Words
            places = planted(len(w), zlib.crc32(str(i).encode())) if plant and i is not None else None
            texts.append(w if places is None else [w[k] for k in places])
        joined = [b" ".join(w) for w in texts]
        for w, body, found in zip(texts, joined, find(texts, Words(pa.array(joined, pa.large_binary()), fold=False)), strict=True):
            if found:
                gone = np.zeros(len(w) + 1, np.int64)
                for a, n, q in found:
                    gone[a + q] += 1
                    gone[a + n] -= 1
                body = b" ".join([w[k] for k in np.flatnonzero(np.cumsum(gone)[:-1] == 0).tolist()])
            yield row(found, body)

    def run(batches):
        for b in batches:
            for i, j in chunks(b.column(1)):
                ids = b.column(0).slice(i, j - i)
                columns = zip(*part(ids.to_pylist(), b.column(1).slice(i, j - i).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, f.type) for x, f in zip(columns, list(schema)[1:], strict=True))], schema=schema)

    short = short_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("body"))
    return short.mapInArrow(run, f"doc_id long, {kind}")
