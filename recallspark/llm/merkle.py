"""Merkle manifest of a dataset by higher-order SQL functions.

Leaves of a source stand in order in arrays of a fixed size (a block is a whole subtree). Within a block every level is collapsed natively by
sequence, transform, slice and aggregate; the block roots are the leaves of the next round, until each source has one root, and the same
goes on over the sources. On the way down each block hands its leaves the path from them to the root. Nothing but a yes or no for each round comes to the driver.

A node is the SHA-256 of the digests (as hex text) of FAN consecutive ones; while a tree has several nodes on a level, all runs of that level
collapse, also a last run of one. A lone leaf is its own root.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, hinted

#: Children of a node, and levels that a block collapses.
FAN, LEVELS = 16, 2
#: Leaves of a block.
BLOCK = FAN**LEVELS
#: Paths that may be broadcast: each has 960 bytes a level, so that these take some 20 MB.
PATHS = 5_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def sha(x: Column) -> Column:
    return F.sha2(x.cast("binary"), 256)


def leaf(fields: list[Column]) -> Column:
    """The digest of a row: `-` for each null, else the UTF-8 byte count, a colon and the value."""
    parts = (F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in (c.cast("string") for c in fields))
    return sha(F.concat(*parts))


def numbered(rows: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """rows with g (the key), pos (place from 0 in the order, nulls first, within the key) and total (rows of the key).

    One sort by ranges; places are those within a task plus the counts of the tasks before, so that no key is one task.
    """
    rows = rows.withColumn("g", key)
    at = F.monotonically_increasing_id()
    # Read back from the shared folder: a task that is run again must not see other ranges.
    rows = cut(rows.repartitionByRange("g", *order).sortWithinPartitions("g", *order).withColumn("at", at)).withColumn("task", F.shiftright("at", 33))
    each = rows.groupBy("g", "task").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    mine = Window.partitionBy("g")  # a row a task
    before = F.sum("n").over(mine.orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    each = cut(each.select(F.col("g").alias("g2"), F.col("task").alias("task2"), (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(mine).alias("total")))
    found = rows.join(hinted(each), F.col("g").eqNullSafe(F.col("g2")) & (F.col("task") == F.col("task2")))
    return found.withColumn("pos", F.col("at") + F.col("shift")).drop("g2", "task2", "task", "at", "shift")


def _levels(total: Column) -> Column:
    """Levels that a block of a tree with so many leaves collapses."""
    out = F.lit(LEVELS)
    for k in reversed(range(LEVELS)):
        out = F.when(total <= FAN**k, k).otherwise(out)
    return out


def _up(nodes: Column) -> Column:
    """The next level: each run of FAN digests becomes its digest."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FAN).cast("int")), lambda i: sha(F.concat_ws("", F.slice(nodes, i * FAN + 1, F.lit(FAN)))))


def _floors(leaves: Column, levels: Column) -> Column:
    """All levels of a block, the leaves first."""
    steps = F.slice(F.array(*(F.lit(k) for k in range(LEVELS))), F.lit(1), levels)
    return F.aggregate(steps, F.array(leaves), lambda acc, _: F.concat(acc, F.array(_up(F.element_at(acc, -1)))))


def _path(floors: Column, j: Column) -> Column:
    """Siblings on the left and on the right of leaf j of a block, for each level that it collapses."""

    def step(row: Column, k: Column) -> Column:
        at = F.floor(j / F.pow(F.lit(FAN), k)).cast("int")
        place = at % FAN
        return F.struct(F.concat_ws("", F.slice(row, at - place + 1, place)).alias("left"), F.concat_ws("", F.slice(row, at + 2, F.lit(FAN - 1) - place)).alias("right"))

    return F.transform(F.slice(floors, F.lit(1), F.size(floors) - 1), step)


_NO_PATH = "CAST(array() AS array<struct<left:string,right:string>>)"


def _blocks(items: DataFrame, payload: list[str]) -> DataFrame:
    """items (g, pos, total, digest, payload) -> g, block, total, items (in order), floors, node (its root)."""
    member = F.struct("pos", "digest", *payload)
    blocks = items.groupBy("g", F.floor(F.col("pos") / BLOCK).alias("block")).agg(F.max("total").alias("total"), F.sort_array(F.collect_list(member)).alias("items"))
    blocks = blocks.withColumn("floors", _floors(F.col("items.digest"), _levels(F.col("total"))))
    return cut(blocks.withColumn("node", F.element_at(F.element_at("floors", -1), 1)))


def climb(items: DataFrame, payload: list[str], over: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """items (g, pos, total, digest, payload) -> g, top, above, block rows: items and floors of each block, the path above it, and what `over` adds.

    over takes (g, top), the root of each tree, and returns it with above (the path on from there) and further columns.
    """
    rounds = [_blocks(items, payload)]
    while rounds[-1].where(F.col("total") > BLOCK).limit(1).count():
        last = rounds[-1]
        rounds.append(_blocks(last.select("g", F.col("block").alias("pos"), F.ceil(F.col("total") / BLOCK).alias("total"), F.col("node").alias("digest")), []))
    tops = rounds[-1].select("g", F.col("node").alias("top"))
    tops = over(tops) if over else tops.withColumn("above", F.expr(_NO_PATH))
    rest = [c for c in tops.columns if c != "g"]
    up = tops.withColumn("block", F.lit(0).cast("long"))
    for k in reversed(range(len(rounds))):
        up = hinted(cut(up), PATHS)
        up = up.withColumnsRenamed({"g": "g2", "block": "block2"})
        now = rounds[k].join(up, F.col("g").eqNullSafe(F.col("g2")) & (F.col("block") == F.col("block2"))).drop("g2", "block2")
        if k:
            each = now.select("g", F.posexplode(F.transform("items", lambda x: x["pos"])).alias("j", "pos"), "floors", *rest)
            up = each.select("g", F.col("pos").alias("block"), *(c for c in rest if c != "above"), F.concat(_path(F.col("floors"), F.col("j")), F.col("above")).alias("above"))
    return now


def fold(node: Column, path: Column) -> Column:
    """The root that a leaf's digest leads to by the siblings on its path."""
    return F.aggregate(path, node, lambda acc, s: sha(F.concat(s["left"], acc, s["right"])))


def proof(path: Column) -> Column:
    """The digest of all siblings from the leaf to the root, left to right."""
    return sha(F.concat_ws("", F.transform(path, lambda s: F.concat(s["left"], s["right"]))))


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """docs (FIELDS) -> doc_id, source, leaf, subroot, root, proof_sha256, folded_root, verified: a row for each row.

    Leaves of a source ascend by doc_id, nulls first; rows with the same doc_id ascend by their digest, and equal rows are leaves of their own. The sources'
    roots ascend by source, null first, and lead to the root. folded_root follows the path from the row's digest, or where tampered is true (null
    is false) from that of the row with A-Z of the text lower-cased. Malformed UTF-8 is hashed by its bytes. An empty table has no rows.
    """
    fields = [F.col(c) for c in FIELDS]
    bad = leaf([*fields[:-1], F.translate(F.col("text"), _UPPER, _LOWER)])
    changed = F.when(tampered, bad) if tampered is not None else F.lit(None).cast("string")
    leaves = cut(docs.select("doc_id", "source", leaf(fields).alias("digest"), changed.alias("changed")))
    items = numbered(leaves, F.col("source"), ["doc_id", "digest"])

    def over(tops: DataFrame) -> DataFrame:
        """Subroots in order of their sources are the leaves of one more tree."""
        many = numbered(tops.select(F.col("g").alias("source"), F.col("top").alias("digest")), F.lit(0), ["source"])
        found = climb(many, ["source"])
        each = found.select("top", "above", "floors", F.posexplode("items").alias("j", "x"))
        return each.select(F.col("x.source").alias("g"), F.col("x.digest").alias("subroot"), F.col("top").alias("root"), F.concat(_path(F.col("floors"), F.col("j")), F.col("above")).alias("above"))

    blocks = climb(items, ["doc_id", "changed"], over)

    def row(x: Column, j: Column) -> Column:
        path = F.concat(_path(F.col("floors"), j), F.col("above"))
        return F.struct(x["doc_id"].alias("doc_id"), x["digest"].alias("leaf"), proof(path).alias("proof_sha256"), fold(F.coalesce(x["changed"], x["digest"]), path).alias("folded_root"))

    found = blocks.select(F.col("g").alias("source"), "subroot", "root", F.inline(F.transform("items", row)))
    return found.select("doc_id", "source", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
