"""A training corpus from `documents`: five stages, each judged on what the one before kept.

STAGES are (name, function) with function(spark, docs, sf_dir) -> DataFrame. All but the last return the columns of documents; the last adds
source_size, target, copies and taken, and drops documents that the mix does not take.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recallspark.llm import decontamination, exact_dedup, language_id, mixing, near_dedup
from recallspark.llm.common import cut, shared_dir, table, text_ids, unused
from recallspark.llm.url_filter import LOWER, UPPER


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _apply(docs: DataFrame, key: Column, special: DataFrame) -> DataFrame:
    """docs with the rows of special (key, id, stays) gone, but for one row, the first as JSON, of each key that stays; all columns stay, whatever their names."""
    k, i, stays, row = unused(docs, "_key", "_id", "_stays", "_row")
    special = special.withColumnsRenamed({"key": k, "id": i, "stays": stays})
    same = (key == F.col(k)) & F.col("doc_id").eqNullSafe(F.col(i))
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    again = docs.join(special.where(F.col(stays)), same, "left_semi").groupBy(key.alias(k)).agg(F.min_by(whole, F.to_json(whole)).alias(row)).select(f"{row}.*")
    return docs.join(special.drop(stays), same, "left_anti").unionByName(again)


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null, or no letter) go; the others' lang becomes the language that the network finds where it was null or the network is sure of another."""
    return language_id.keep_known(docs)


def exact_deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, one row with the smallest doc_id stays; rows without doc_id come last."""
    found = exact_dedup.owners(docs).groupBy(F.col("digest").alias("key"), F.col("doc_id").alias("id")).agg(F.first("owner").alias("owner"), F.count("*").alias("n"))
    stays = F.col("id").eqNullSafe(F.col("owner"))
    special = cut(found.where(~stays | (F.col("n") > 1)).select("key", "id", stays.alias("stays")))
    return _apply(docs, F.unhex(F.sha2(F.translate(_text(), UPPER, LOWER).cast("binary"), 256)), special)


def near_deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents, one row with the smallest doc_id stays; rows without doc_id come last."""
    (text,) = unused(docs, "_text")
    docs = text_ids(docs, text)
    groups = near_dedup.near_groups(docs.select(F.col(text).alias("doc_id"), "text")).where("n_shingles > 0").groupBy(F.col("doc_id").alias("key")).agg(F.first("component_id").alias("component"))
    rows = docs.select(F.col(text).alias("key"), F.col("doc_id").alias("id")).groupBy("key", "id").agg(F.count("*").alias("n"))
    rows = cut(rows.join(groups, "key"))
    me = F.struct(F.col("id").isNull().alias("none"), "id", "key")
    best = rows.groupBy("component").agg(F.min(me).alias("best"), F.sum("n").alias("all")).where("all > 1")
    stays = me == F.col("best")
    special = cut(rows.join(best, "component").where(~stays | (F.col("n") > 1)).select("key", "id", stays.alias("stays")))
    return _apply(docs, F.col(text), special).drop(text)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the number of copies that the mix takes, where that is one or more.

    Rows without doc_id or source are mixed like others. Rows with the same doc_id, source and text each get the largest figures among them. Columns
    named like the four figures are replaced; all others stay.
    """
    figures = ("source_size", "target", "copies", "taken")
    i, s, t = unused(docs, "_id", "_source", "_text")
    plan = mixing.mix(docs, mixing.by_size, digests=True).where("copies > 0").groupBy(F.col("doc_id").alias(i), F.col("source").alias(s), F.col("digest").alias(t)).agg(*(F.max(c).alias(c) for c in figures))
    same = F.col("doc_id").eqNullSafe(F.col(i)) & F.col("source").eqNullSafe(F.col(s)) & (F.unhex(F.md5(_text().cast("binary"))) == F.col(t))
    return docs.drop(*figures).join(plan, same).drop(i, s, t)


STAGES = [("language_id", identified), ("exact_dedup", exact_deduplicated), ("near_dedup", near_deduplicated), ("decontamination", decontaminated), ("mixing", mixed)]

#: Language ID is a trained network, and decontamination and near-duplicate search use hashes, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over documents, each written as Parquet below the shared folder and read again. Each is removed when the next is written; the last stays."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{before}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        before = name
    return docs
