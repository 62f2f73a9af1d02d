"""Vectors of texts: what goes into a model and how its output becomes a vector. The model itself is the caller's pandas UDF of text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import missing, upsert

#: Prefixes of queries and documents, and characters of a document that the model gets.
QUERY_PREFIX, DOCUMENT_PREFIX, MOST_CHARACTERS = "検索クエリ: ", "検索文書: ", 512


def query_input(c: Column) -> Column:
    return F.concat(F.lit(QUERY_PREFIX), c)


def document_input(c: Column) -> Column:
    return F.concat(F.lit(DOCUMENT_PREFIX), F.substring(c, 1, MOST_CHARACTERS))


def mean_pooled(tokens: Column) -> Column:
    """The mean of an array of token vectors of one length; null without tokens."""
    first = F.element_at(tokens, 1)
    total = F.aggregate(tokens, F.transform(first, lambda x: F.lit(0.0)), lambda s, v: F.zip_with(s, v, lambda a, b: a + b.cast("double")))
    return F.when(F.size(tokens) > 0, F.transform(total, lambda x: x / F.size(tokens)))


def unit(v: Column) -> Column:
    """The vector at length 1; one of zeros stays."""
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(length == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / length))


def backlog(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks (id, content) without a vector."""
    return missing(chunks.select("id", "content"), vectors, "id")


def backfill(chunks: DataFrame, vectors: DataFrame, model: Callable[[Column], Column]) -> DataFrame:
    """id, embedding for the chunks that lack one: the model's vectors at length 1."""
    made = backlog(chunks, vectors).select("id", model(document_input(F.col("content"))).alias("v"))
    return made.select("id", unit(F.col("v")).alias("embedding"))


def insert_vectors(vectors: DataFrame, incoming: DataFrame) -> DataFrame:
    """vectors (id, embedding) with incoming's in place of those of the same chunk."""
    return upsert(vectors.select("id", "embedding"), incoming.select("id", F.col("embedding").cast("array<float>").alias("embedding")), ["id"])
