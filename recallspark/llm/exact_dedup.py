"""Exact de-duplication by Patricia-trie owners.

Each task first inserts its texts into compressed radix tries of its own, which leaves one row for each
different text of the task (a hot text costs one row a task, not one a copy). Those go to partitions by
length and content hash, sorted, and all of a partition are inserted as full byte strings into one trie, so two
texts are one only if all bytes are; different ones of one length and hash end the job. A terminal node holds the smallest identifier and the count (the
largest one where that row is to stay). A trie over its budget spills its largest subtree: the subtree's
terminals leave as rows. In the first tries they meet the rest of their text in the partition of their key; in the second
they are complete, as keys come in order and a trie spills only between two keys.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short_batches, text_bytes, unused

#: Bytes of text that a trie holds before it spills a subtree.
TRIE_BYTES = 32 << 20


class Node:
    __slots__ = ("kids", "label", "value")

    def __init__(self, label: bytes):
        self.label, self.kids, self.value = label, {}, None


class PatriciaTrie:
    """Byte strings with (owner, count) at terminal nodes. better(a, b) picks the owner of two."""

    def __init__(self, better=min):
        self.root, self.better, self.size = Node(b""), better, 0

    def insert(self, key: bytes, owner, count: int = 1) -> None:
        node, at = self.root, 0
        while at < len(key):
            kid = node.kids.get(key[at])
            if kid is None:
                kid = node.kids[key[at]] = Node(key[at:])
                self.size += len(kid.label)
                node, at = kid, len(key)
                break
            label = kid.label
            if key.startswith(label, at):
                node, at = kid, at + len(label)
                continue
            same = _shared(label, key, at)
            upper = Node(label[:same])
            kid.label = label[same:]
            upper.kids[kid.label[0]] = kid
            node.kids[key[at]] = upper
            node, at = upper, at + same
        if node.value is None:
            node.value = (owner, count)
        else:
            had, n = node.value
            node.value = (owner if had is None else had if owner is None else self.better(had, owner), n + count)

    def items(self, node: Node | None = None, prefix: bytes = b"") -> Iterator[tuple[bytes, object, int]]:
        stack = [(node or self.root, prefix)]
        while stack:
            node, prefix = stack.pop()
            whole = prefix + node.label
            if node.value is not None:
                yield (whole, *node.value)
            stack += [(kid, whole) for kid in node.kids.values()]

    def spill(self) -> list[tuple[bytes, object, int]]:
        """Removes the largest subtree below the root and returns its terminals."""
        sizes = {k: self._weigh(x) for k, x in self.root.kids.items()}
        if not sizes:
            return []
        first = max(sizes, key=sizes.get)
        self.size -= sizes[first]
        return list(self.items(self.root.kids.pop(first)))

    @staticmethod
    def _weigh(node: Node) -> int:
        total, stack = 0, [node]
        while stack:
            x = stack.pop()
            total += len(x.label)
            stack += x.kids.values()
        return total


def _shared(label: bytes, key: bytes, at: int) -> int:
    """Length of the common start of label and key[at:], by halving; the first byte is known to be equal."""
    low, high = 1, min(len(label), len(key) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if label[low:mid] == key[at + low : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


_PART = pa.schema([("length", pa.int64()), ("digest", pa.binary()), ("body", pa.binary()), ("owner", pa.int64()), ("n", pa.int64())])


def _rows(found: Iterable[tuple[bytes, object, int]], with_body: bool = True) -> Iterator[pa.RecordBatch]:
    size, batch = 0, []
    for key, owner, n in found:
        batch.append((len(key), hashlib.sha256(key).digest(), key if with_body else None, owner, n))
        size += len(key)
        if size > 8 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*batch, strict=True), _PART, strict=True)], schema=_PART)
            size, batch = 0, []
    if batch:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*batch, strict=True), _PART, strict=True)], schema=_PART)


def owners(docs: DataFrame, keep: str = "smallest", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """docs (doc_id, text) -> doc_id, length, digest, owner, n for every row.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. owner is the smallest
    (keep="largest": largest) doc_id among equal texts, null ids aside; n counts rows, repeated ones too.
    """
    better = {"smallest": min, "largest": max}[keep]

    def mark(batches):
        for b in batches:
            texts = [x.lower() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array([hashlib.sha256(x).digest() for x in texts], pa.binary())], names=["doc_id", "length", "digest"])

    def first(batches):
        trie = PatriciaTrie(better)
        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                trie.insert(x.lower(), i)
                if trie.size > trie_bytes:
                    yield from _rows(trie.spill())
        yield from _rows(list(trie.items()))

    def second(batches):
        trie, now, text = PatriciaTrie(better), None, None
        for b in batches:
            for length, digest, body, owner, n in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if (length, digest) != now:
                    while trie.size > trie_bytes:
                        yield from _rows(trie.spill(), False)
                    now, text = (length, digest), body
                elif body != text:
                    raise ValueError(f"two texts of {length} bytes have the hash {digest.hex()}")
                trie.insert(body, owner, n)
        yield from _rows(trie.items(), False)

    rows = short_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("body"))
    kind = "length long, digest binary, body binary, owner long, n long"
    parts = rows.mapInArrow(first, kind).repartition("length", "digest").sortWithinPartitions("length", "digest")
    found = parts.mapInArrow(second, kind).select("length", "digest", "owner", "n")
    return rows.mapInArrow(mark, "doc_id long, length long, digest binary").join(found, ["length", "digest"])


def keep_one(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """docs without the rows whose doc_id isn't the owner of their text; all columns stay.

    A row is judged by its own text, also where others have its doc_id. Rows without doc_id stay where no row of their text has one. Repeated rows
    of an owner all stay: they are told apart by nothing (the pipeline's stage keeps one of them).
    """
    text = F.unhex(F.sha2(F.translate(F.coalesce(F.col("text"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").cast("binary"), 256))
    digest, owner = unused(docs, "_digest", "_owner")
    found = owners(docs, keep).where("owner IS NOT NULL").select(F.col("digest").alias(digest), F.col("owner").alias(owner)).distinct()
    return docs.join(found, (text == F.col(digest)) & (F.col("doc_id").isNull() | (F.col("doc_id") != F.col(owner))), "left_anti")
