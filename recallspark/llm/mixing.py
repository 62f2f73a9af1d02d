"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

A document wants target / size-of-its-source copies. Whole copies are certain. For the fraction p that is left,
each document gets a uniform number u from its doc_id and ranks by u/(1-u) over o, with
inclusion odds o = weight * p/(1-p): random odds divided by inclusion odds. The lowest ranks are taken, up to
a fixed size in words for each source. That cut is found by two passes of partial sums over 4096 cells of the rank, after
which the ranks in one cell of about a 16-millionth of a source are put in order. Rows that share the rank at the cut, as those of one
doc_id do, are cut in the same way by a random number from their text, and rows of one id and text by one from their place in the input; no task holds a whole source.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, hinted

#: A document is taken as often at most, and a source as its size times this.
MOST = 3
#: Steps of the rank for each pass.
CELLS = 4096


def shares(sizes: DataFrame) -> DataFrame:
    """sizes (source, source_size) one row each -> with weight and target.

    Sources in code-point order, null last, weigh 1, 2, 3, repeating. Targets are in proportion to the weights, sum to all
    sizes, and stop at MOST times a source's size; the excess goes to the others by weight until none is above.
    The table has one row a source, so one task may order it.
    """
    w = Window.orderBy(F.col("source").isNull(), F.col("source"))
    d = sizes.withColumn("weight", ((F.row_number().over(w) - 1) % 3 + 1).cast("double")).withColumn("most", F.lit(float(MOST)) * F.col("source_size"))
    # Sources reach their stop in order of most / weight. With the first k stopped, the rest get (total - their stops) / (weights of the rest) a unit.
    by = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before, everything = by.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    d = d.withColumn("unit", (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    d = d.withColumn("free", F.col("unit") * F.col("weight") <= F.col("most"))
    rank = F.row_number().over(by)
    d = d.withColumn("rank", rank)
    first = F.min(F.when(F.col("free"), F.struct("rank", "unit"))).over(everything)["unit"]
    return d.withColumn("level", first).select("source", "source_size", "weight", F.when(F.col("source_size") == 0, 0.0).otherwise(F.coalesce(F.least("most", F.col("level") * F.col("weight")), F.col("most"))).alias("target"))


def uniform(key: Column) -> Column:
    """A number between 0 and 1 from the key's text, the same in every run."""
    return (F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def by_size(size: Column) -> Column:
    """Inclusion odds in proportion to the square root of the size."""
    return F.sqrt(size)


def _edge(rows: DataFrame, value: str, key: str) -> DataFrame:
    """rows (source, size, budget, value between 0 and 1, key that sorts as value does) -> s2, edge, rest: the key in each source at which its budget ends, and what is left of the budget before it."""
    at = F.least((F.col(value) * float(CELLS * CELLS)).cast("long"), F.lit(CELLS * CELLS - 1))
    same = F.col("source").eqNullSafe(F.col("s2"))
    for step in (F.floor(at / CELLS), at % CELLS):
        rows = rows.withColumn("cell", step)
        found = rows.groupBy("source", "cell").agg(F.sum("size").alias("words"), F.first("budget").alias("whole"))
        through = F.sum("words").over(Window.partitionBy("source").orderBy("cell"))
        ends = found.withColumn("through", through).where("through >= whole").groupBy("source").agg(F.min(F.struct("cell", (F.col("whole") - F.col("through") + F.col("words")).alias("rest"))).alias("x"))
        ends = hinted(cut(ends.select(F.col("source").alias("s2"), F.col("x.cell").alias("end"), F.col("x.rest").alias("rest"))))
        rows = rows.join(ends, same & (F.col("cell") == F.col("end"))).withColumn("budget", F.col("rest")).drop("s2", "cell", "end", "rest")
    found = rows.groupBy("source", key).agg(F.sum("size").alias("words"), F.first("budget").alias("whole"))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = found.withColumn("before", before).where("before < whole").groupBy("source").agg(F.max(F.struct(F.col(key).alias("edge"), (F.col("whole") - F.col("before")).alias("rest"))).alias("x"))
    return cut(found.select(F.col("source").alias("s2"), "x.edge", "x.rest"))


def mix(docs: DataFrame, weight: Callable[[Column], Column] | Column | None = None, digests: bool = False) -> DataFrame:
    """docs (doc_id, text, source) -> doc_id, source, size, source_size, target, copies, taken for every row; with digests, also the MD5 of the text.

    Size is the number of words; null text has none. weight multiplies a document's inclusion odds: a column of docs, or a function of the size (none: all alike).
    Rows with the same doc_id (or none) have the same rank. Where the cut falls among them, they are told apart by their texts, and rows with equal texts too by their
    places in the input, so that which of several equal rows is taken may depend on how the input is split. The words that a
    source takes differ from its target by half a document's size at most.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD.replace("]+", "]++"))), F.lit(0)).cast("long")
    digest = F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), digest.alias("digest"), F.monotonically_increasing_id().alias("row"), *([weight.cast("double").alias("w")] if isinstance(weight, Column) else []))
    own = F.lit(1.0) if weight is None else F.col("w") if isinstance(weight, Column) else weight(F.col("size")).cast("double")
    base = cut(base.withColumn("w", F.greatest(own, F.lit(1e-9))))
    plan = shares(base.groupBy("source").agg(F.sum("size").alias("source_size")))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = plan.withColumn("whole", F.least(F.floor(ratio), F.lit(MOST)).cast("long"))
    plan = cut(plan.withColumn("left", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0))))
    u = uniform(F.col("doc_id"))
    p = F.col("left") / F.col("source_size")
    odds = F.col("w") * p / (F.lit(1.0) - p)
    rank = (u / (F.lit(1.0) - u)) / odds
    same = F.col("source").eqNullSafe(F.col("s2"))
    each = base.join(hinted(plan).withColumnRenamed("source", "s2"), same).drop("s2").withColumn("rank", F.when((F.col("left") > 0) & (F.col("size") > 0), rank))
    # By id, by text and by place: a key that is shared only by rows that are alike in this, and a number between 0 and 1 that grows with it.
    r = F.col("rank")
    places = [("id", F.struct(r.alias("at"), F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("own")), r / (F.lit(1.0) + r))]
    places += [(name, F.struct(uniform(c).alias("at"), F.col(name).alias("own")), uniform(c)) for name, c in (("digest", F.hex("digest")), ("row", F.col("row")))]
    open_rows = each.where("rank IS NOT NULL").withColumn("budget", F.col("left"))
    ends, before, known = plan.select(F.col("source").alias("s3")), F.lit(False), F.lit(True)
    for name, key, value in places:
        rows = open_rows.withColumn("key", key).withColumn("value", value)
        edge = _edge(rows, "value", "key")
        open_rows = cut(rows.join(hinted(edge), same & (F.col("key") == F.col("edge"))).withColumn("budget", F.col("rest")).drop("s2", "edge", "rest", "key", "value"))
        ends = ends.join(edge.select("s2", F.col("edge").alias(f"edge_{name}")), F.col("s3").eqNullSafe(F.col("s2")), "left").drop("s2")
        e = F.col(f"edge_{name}")
        before = before | (known & F.coalesce(key < e, F.lit(name == "id")))
        known = known & F.coalesce(key == e, F.lit(False))
        if open_rows.groupBy("source").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            break
    # A document over the edge is taken if that comes nearer.
    over = open_rows.where(F.col("size") / 2 <= F.col("budget")).select(F.col("source").alias("s2"), F.col("row").alias("over"))
    ends = hinted(cut(ends.join(over, F.col("s3").eqNullSafe(F.col("s2")), "left").drop("s2")))
    extra = F.col("rank").isNotNull() & (before | F.coalesce(F.col("row") == F.col("over"), F.lit(False)))
    out = each.join(ends, F.col("source").eqNullSafe(F.col("s3"))).withColumn("copies", F.col("whole") + extra.cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *(["digest"] if digests else []))
