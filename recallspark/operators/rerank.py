"""Lexical reranking: how much of a query's words a text has, how densely, how near to each other, and in phrases."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .search import CJK, SEPARATORS


def tokens(text: str) -> list[str]:
    """Lower-cased tokens of two characters or more; long CJK ones are followed by all their three-character pieces."""
    out = []
    for token in (t.strip().lower() for t in re.split(SEPARATORS, text)):
        if len(token) >= 2:
            out.append(token)
            if len(token) > 3 and re.search(CJK, token):
                out += [token[i : i + 3] for i in range(len(token) - 2)]
    return out


def _unique(query: str) -> list[str]:
    return list(dict.fromkeys(tokens(query)))


def _total(parts: list[Column]) -> Column:
    out = F.lit(0.0)
    for p in parts:
        out = out + p
    return out


def coverage(query: str, text: Column) -> Column:
    words, t = _unique(query), F.lower(text)
    return _total([F.contains(t, F.lit(w)).cast("double") for w in words]) / float(len(words)) if words else F.lit(0.0)


def density(query: str, text: Column) -> Column:
    """Occurrences that don't overlap, a thousand characters."""
    t = F.lower(text)
    found = _total([(F.length(t) - F.length(F.replace(t, F.lit(w), F.lit("")))) / float(len(w)) for w in _unique(query)])
    return F.when(F.length(t) == 0, 0.0).otherwise(found / F.length(t) * 1000.0)


def proximity(query: str, text: Column) -> Column:
    """1 - mean gap / 1000, 0 at least, where the gaps are between the first places of the words that occur."""
    words, t = _unique(query), F.lower(text)
    if len(words) < 2:
        return F.lit(0.0)
    at = F.filter(F.array(*[F.instr(t, w) for w in words]), lambda x: x > 0)
    return F.when(F.size(at) < 2, 0.0).otherwise(F.greatest(F.lit(0.0), 1.0 - (F.array_max(at) - F.array_min(at)) / (F.size(at) - 1.0) / 1000.0))


def phrase_bonus(query: str, text: Column) -> Column:
    """For each two tokens in a row 0.3, for each three 0.5, with spaces and again without; 2 at most."""
    all_, t = tokens(query), F.lower(text)
    parts = []
    for n, bonus in ((2, 0.3), (3, 0.5)):
        for i in range(len(all_) - n + 1):
            parts += [F.when(F.contains(t, F.lit(joint.join(all_[i : i + n]))), bonus).otherwise(0.0) for joint in (" ", "")]
    return F.least(_total(parts), F.lit(2.0))


def relevance(query: str, text: Column) -> Column:
    mixed = 0.4 * coverage(query, text) + 0.2 * F.least(density(query, text) / 10.0, F.lit(1.0)) + 0.15 * proximity(query, text) + 0.25 * phrase_bonus(query, text)
    return F.least(mixed, F.lit(1.0))


def rerank(df: DataFrame, query: str) -> DataFrame:
    """0.4 of the score between the smallest and largest of all candidates, and 0.6 of the relevance. Candidates are the bounded result of a search."""
    w = Window.partitionBy()
    low, span = F.min("score").over(w), F.max("score").over(w) - F.min("score").over(w)
    return df.withColumn("score", 0.4 * ((F.col("score") - low) / F.when(span == 0, 1.0).otherwise(span)) + 0.6 * relevance(query, F.col("content")))
