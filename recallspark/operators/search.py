"""Candidate search, fusion and ranking. chunks have id, content, project, session, created_at (timestamp) and chunk_index as far as an operator needs them."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ascii_lower
from ..session import checkpointed

#: Separators of keywords, particles after which a keyword ends, and the range of CJK characters.
SEPARATORS = r"[\s、。,.!?;:()\[\]{}「」『』・\n\r\t]+"
PARTICLES = r"(?<=[はがをにでとものかへもやばてり])(?=[^\s])"
CJK = "[　-鿿豈-﫿]"
K1, B = 1.2, 0.75


def keywords(text: str, least: int = 3, most_grams: int = 8) -> list[str]:
    """Keywords of a query, in order, without repeats in lower case; long CJK tokens become three-character pieces."""
    out: dict[str, str] = {}
    for token in re.split(f"{SEPARATORS}|{PARTICLES}", text):
        token = token.strip()
        if len(token) < least:
            continue
        pieces = [token]
        if len(token) > 3 and re.search(CJK, token):
            pieces = [token[i : i + 3] for i in range(0, len(token) - 2, max(1, (len(token) - 3) // (most_grams - 1)))]
        for x in pieces:
            out.setdefault(x.lower(), x)
    return list(out.values())


@dataclass(frozen=True)
class Term:
    """What a keyword looks for: a text, anywhere or only at the start of the content."""

    text: str
    initial: bool = False


_PIECE = r'(?:[A-Za-z0-9_\u0080-\U0010ffff]+|"(?:[^"]|"")*")'


def term(keyword: str) -> Term | None:
    """A keyword in the full-text query language: a plain string of letters, digits, _ and non-ASCII, or a quoted one; ^ before it looks at the start, * after it changes
    nothing, as all pieces have three characters, and + puts strings together, which must overlap by two characters as their pieces follow each other. None if the language rejects it.
    """
    if not re.fullmatch(rf"\^?{_PIECE}(?:\+{_PIECE})*\*?", keyword):
        return None
    pieces = re.findall(_PIECE, keyword)
    if len(pieces) == 1 and keyword in ("AND", "OR", "NOT"):
        return None
    plain = [p for p in (x[1:-1].replace('""', '"') if x[0] == '"' else x for x in pieces) if len(p) >= 3]
    text = plain[0] if plain else ""
    for p in plain[1:]:
        text = text + p[2:] if text and text[-2:].lower() == p[:2].lower() else ""
    return Term(text, keyword[0] == "^")


def accepted(keyword: str) -> bool:
    """Whether the full-text query language takes the keyword."""
    return term(keyword) is not None


def fts_match(chunks: DataFrame, keyword: str) -> DataFrame:
    """Chunks whose content has the keyword as a substring in any case; keywords of under three characters match nothing."""
    return chunks.where(F.contains(F.lower("content"), F.lit(keyword.lower())) & F.lit(len(keyword) >= 3))


def _rank(f: Column, n: Column, docs: Column, size: Column, mean: Column) -> Column:
    idf = F.log((docs - n + 0.5) / (n + 0.5))
    idf = F.when(idf <= 0, 1e-6).otherwise(idf)
    return -idf * (f * (K1 + 1) / (f + K1 * (1 - B + B * size / mean)))


def _scanned(chunks: DataFrame, terms: list[Term], project: str | None) -> DataFrame:
    """no, keyword, id, rank from the contents: one scan for the statistics and one for the rows, for all keywords together."""
    t = F.lower("content")

    def count(x: Term) -> Column:
        low = x.text.lower()
        # Most rows don't have the word at all, which is cheaper to see than how often it occurs.
        return F.startswith(t, F.lit(low)).cast("double") if x.initial else F.when(F.contains(t, F.lit(low)), F.regexp_count(t, F.lit("(?=" + re.escape(low) + ")"))).otherwise(0).cast("double")

    seen = chunks.select("id", *([F.col("project")] if "project" in chunks.columns else []), F.greatest(F.length("content") - 2, F.lit(0)).cast("double").alias("size"), *[count(x).alias(f"f{i}") for i, x in enumerate(terms)])
    stats = seen.agg(F.count("*").cast("double").alias("docs"), F.avg("size").alias("mean"), *[F.count_if(F.col(f"f{i}") > 0).cast("double").alias(f"n{i}") for i in range(len(terms))])
    if project is not None:
        seen = seen.where(F.col("project") == project)
    both = seen.crossJoin(F.broadcast(stats))  # one row
    rank = lambda i: _rank(F.col(f"f{i}"), F.col(f"n{i}"), F.col("docs"), F.col("size"), F.col("mean"))
    return both.select("id", F.explode(F.filter(F.array(*[F.when(F.col(f"f{i}") > 0, F.struct(F.lit(i).alias("no"), F.lit(x.text).alias("keyword"), rank(i).alias("rank"))) for i, x in enumerate(terms)]), lambda x: x.isNotNull())).alias("x")).select("id", "x.*")


def _indexed(index: DataFrame, terms: list[Term], project: str | None) -> DataFrame:
    """The same from the postings of the keywords' pieces."""
    from . import postings

    docs, mean = postings.totals(index)
    seen = postings.occurrences(index, [(x.text, x.initial) for x in terms])
    often = seen.groupBy("no").agg(F.count("*").cast("double").alias("n"))  # a row a keyword
    if project is not None:
        seen = seen.where(F.col("project") == project)
    keyword = F.element_at(F.array(*[F.lit(x.text) for x in terms]), F.col("no") + 1)
    return seen.join(F.broadcast(often), "no").select("no", keyword.alias("keyword"), "id", _rank(F.col("f"), F.col("n"), F.lit(float(docs)), F.col("size"), F.lit(float(mean))).alias("rank"))


def bm25(chunks: DataFrame, words: list[str | Term], project: str | None = None, k: int | None = 20, index: DataFrame | None = None) -> DataFrame:
    """id, no, keyword, rank (negative, the best is the smallest) and place of the k best chunks for each keyword, from the contents or, if there is one, from the index.

    Statistics are over all chunks, also where project narrows the result. Only ids and counts go on from the scan, and a chunk for a keyword only
    if it has it. An occurrence is counted wherever it begins, overlaps too.
    """
    terms = [x for x in (w if isinstance(w, Term) else Term(w) for w in words) if len(x.text) >= 3]
    if not terms:
        return chunks.select("id", F.lit(0).alias("no"), F.lit("").alias("keyword"), F.lit(0.0).alias("rank"), F.lit(0).alias("place")).limit(0)
    each = _scanned(chunks, terms, project) if index is None else _indexed(index, terms, project)
    place = F.row_number().over(Window.partitionBy("no").orderBy("rank", "id"))
    out = each.withColumn("place", place).select("id", "no", "keyword", "rank", "place")
    return out if k is None else out.where(F.col("place") <= k)


def words_of(c: Column, least: int = 1) -> Column:
    """Lower-cased runs of letters a to z of some length."""
    return F.filter(F.split(F.lower(c), "[^a-z]+"), lambda x: F.length(x) >= max(1, least))


#: Scores are compared as rounded to six places: what is lower by more than that can't come in.
MARGIN = 1e-5
#: So many times k documents of a query are scored first.
FIRST = 4
#: Rows of a few numbers and words that may be broadcast.
FEW = 200_000


def _few(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if a count of it, which is stored, shows that it is small."""
    df = checkpointed(df)
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def bm25_batch(docs: DataFrame, queries: DataFrame, k: int = 5, least: int = 1) -> DataFrame:
    """docs (id, content), queries (query_id, text) -> query_id, id, score, place: the k best documents by whole words for each of many queries, in one job.

    idf, size (in words) and mean size as in bm25, with positive scores. Words of fewer than `least` letters count for nothing, in sizes neither.
    Exact, but most pairs of a query and a document are never made. The whole scores of documents that are among the best for some words give a score that k documents reach at least. A query's words
    with the lowest bounds, which together stay below it, bring no document in: only documents with one of the other words are
    scored, and only those that can still reach the score are completed. So frequent words' postings are looked up, not gone through for each query.
    """
    return batch_parts(docs, queries, k, least)["best"]


def batch_parts(docs: DataFrame, queries: DataFrame, k: int = 5, least: int = 1) -> dict[str, DataFrame]:
    """best, as bm25_batch returns it; and of the work: postings (w, id, s) of all words of queries, and entering (query_id, w, s...), the words whose postings were gone through."""
    w = words_of(F.col("content"), least)
    q = checkpointed(queries.select("query_id", F.explode(F.array_distinct(words_of(F.col("text"), least))).alias("w")))
    each = docs.select("id", F.size(w).cast("double").alias("size"), w.alias("words"))
    stats = each.agg(F.count("*").cast("double").alias("docs"), F.avg("size").alias("mean"))
    named = _few(q.select("w").distinct())
    t = each.select("id", "size", F.explode("words").alias("w")).join(named, "w", "left_semi").groupBy("id", "size", "w").agg(F.count("*").cast("double").alias("f"))
    t = checkpointed(t.crossJoin(F.broadcast(stats)))  # one row
    n = _few(t.groupBy("w").agg(F.count("*").cast("double").alias("n")))
    p = t.join(n, "w").select("w", "id", (-_rank(F.col("f"), F.col("n"), F.col("docs"), F.col("size"), F.col("mean"))).alias("s"))
    # A score that k documents of each query reach: the whole scores of those that come off best by the k best postings of each word.
    nth = F.row_number().over(Window.partitionBy("w").orderBy(F.desc("s"), "id"))
    top = _few(p.withColumn("nth", nth).where(F.col("nth") <= k))
    bound = top.where("nth = 1").select("w", F.col("s").alias("most"))
    part = q.join(top.select("w", "id", "s"), "w").groupBy("query_id", "id").agg(F.sum("s").alias("s"))
    first = part.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("s"), "id"))).where(F.col("nth") <= FIRST * k).select("query_id", "id")
    tried = _few(first.join(q, "query_id"))
    reached = tried.join(p, ["w", "id"]).groupBy("query_id", "id").agg(F.sum("s").alias("s"))
    reached = reached.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("s")))).where(F.col("nth") == k).select("query_id", F.col("s").alias("least"))
    # The words that bring documents in, and what the others add at most.
    below = F.sum("most").over(Window.partitionBy("query_id").orderBy("most", "w").rowsBetween(Window.unboundedPreceding, 0))
    use = q.join(bound, "w").join(reached, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(0.0)) - MARGIN).withColumn("below", below)
    use = use.withColumn("enters", F.col("below") >= F.col("least"))
    use = _few(use.withColumn("rest", F.coalesce(F.sum(F.when(~F.col("enters"), F.col("most"))).over(Window.partitionBy("query_id")), F.lit(0.0))))
    entering = use.where("enters").select("query_id", "w", "least", "rest")
    some = p.join(entering, "w").groupBy("query_id", "id").agg(F.sum("s").alias("s"), F.first("least").alias("least"), F.first("rest").alias("rest"))
    some = _few(some.where(F.col("s") + F.col("rest") >= F.col("least")).select("query_id", "id", "s"))
    other = some.drop("s").join(use.where("NOT enters").select("query_id", "w"), "query_id").join(p, ["w", "id"]).select("query_id", "id", "s")
    whole = some.unionByName(other).groupBy("query_id", "id").agg(F.round(F.sum("s"), 6).alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return {"best": whole.withColumn("place", place).where(F.col("place") <= k), "postings": p, "entering": entering}


def search_keywords(chunks: DataFrame, words: list[str | Term], project: str | None = None, limit: int = 20, index: DataFrame | None = None) -> DataFrame:
    """id, rank, pos: hits of all keywords in the order of the keywords and then of the rank, each chunk where it comes first."""
    hits = bm25(chunks, words, project, limit, index)
    first = hits.groupBy("id").agg(F.min(F.struct("no", "place", "rank")).alias("x"))
    order = Window.orderBy("x.no", "x.place", "id")  # at most limit rows a keyword
    return first.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= limit).select("id", F.col("x.rank").alias("rank"), "pos")


def search_like(chunks: DataFrame, q: str, project: str | None = None, limit: int = 20) -> DataFrame:
    """Newest chunks that contain q, A-Z in any case; % and _ in q are wildcards. rank is null."""
    hit = chunks.where(ascii_lower(F.col("content")).like("%" + q.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).replace("\\", "\\\\") + "%"))
    if project is not None:
        hit = hit.where(F.col("project") == project)
    return hit.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def search_fts(chunks: DataFrame, query: str, project: str | None = None, limit: int = 20, all_projects: bool = False, index: DataFrame | None = None) -> DataFrame:
    """id, rank, pos. Nothing for an empty query; short ones and those without keywords by LIKE; keywords that the query language rejects are skipped."""
    q = query.strip()
    scope = None if all_projects else project
    if not q:
        return chunks.select("id", F.lit(None).cast("double").alias("rank"), F.lit(0).alias("pos")).limit(0)
    words = keywords(q)
    if len(q) < 3 or not words:
        hit = search_like(chunks, q, scope, limit)
        return hit.select("id", F.lit(None).cast("double").alias("rank"), F.row_number().over(Window.orderBy(F.desc("created_at"), F.desc("id"))).alias("pos"))
    return search_keywords(chunks, [x for x in map(term, words) if x], scope, limit, index)


def recent(chunks: DataFrame, project: str, n: int = 3) -> DataFrame:
    """The newest chunks of a project, with falling scores."""
    top = chunks.where(F.col("project") == project).orderBy(F.desc("created_at"), F.desc("id")).limit(max(1, n))
    place = F.row_number().over(Window.orderBy(F.desc("created_at"), F.desc("id")))
    return top.withColumn("score", (F.lit(max(1, n)) - place + 1).cast("double"))


def distance(v: Column, q: list[float]) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(v, F.array(*map(F.lit, q)), lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x))


def knn(vectors: DataFrame, q: list[float], k: int, project: str | None = None, post_filter: bool = True) -> DataFrame:
    """The k vectors (id, embedding) nearest to q by L2 distance. With a project: of those k, the project's (post_filter), or the project's k nearest."""
    d = vectors.withColumn("distance", distance(F.col("embedding"), q))
    if project is not None and not post_filter:
        d = d.where(F.col("project") == project)
    top = d.orderBy("distance", "id").limit(k)
    return top.where(F.col("project") == project) if project is not None and post_filter else top


def rrf(left: DataFrame, right: DataFrame, k: int = 60) -> DataFrame:
    """left and right (id, pos from 1) -> id, score, rank: the sum of 1 / (k + pos) over both lists, and its negative."""
    part = lambda c: F.coalesce(1.0 / (F.lit(float(k)) + F.col(c)), F.lit(0.0))
    both = left.select("id", F.col("pos").alias("l")).join(right.select("id", F.col("pos").alias("r")), "id", "full")
    return both.select("id", (part("l") + part("r")).alias("score")).withColumn("rank", -F.col("score"))


def normalized(rank: Column) -> Column:
    return F.coalesce(-rank, F.lit(0.5))


def decayed(score: Column, created_at: Column, as_of: datetime, half_life_days: float = 30.0) -> Column:
    age = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(created_at.cast("timestamp"))) / 1e6
    return score * F.exp(-math.log(2) / (half_life_days * 86400.0) * age)


def adjacency_dedupe(cands: DataFrame) -> DataFrame:
    """Of chunks of a session whose indexes follow each other, the one with the best score, the first on ties. Chunks without index stay."""
    w = Window.partitionBy("session").orderBy("chunk_index", "id")
    known = cands.where("chunk_index IS NOT NULL")
    step = (F.col("chunk_index") - F.lag("chunk_index").over(w) > 1).cast("int")
    known = known.withColumn("_cluster", F.sum(F.coalesce(step, F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.row_number().over(Window.partitionBy("session", "_cluster").orderBy(F.desc("score"), "chunk_index", "id"))
    return known.withColumn("_best", best).where("_best = 1").drop("_best", "_cluster").unionByName(cands.where("chunk_index IS NULL"))


def project_penalty(df: DataFrame, project: str | None, penalty: float | None) -> DataFrame:
    """Adds is_local, and multiplies the scores of other projects by penalty. Without a project nothing changes."""
    if project is None:
        return df
    local = F.col("project") == project
    out = df.withColumn("is_local", F.coalesce(local, F.lit(False)))
    return out if penalty is None else out.withColumn("score", F.when(F.col("is_local"), F.col("score")).otherwise(F.col("score") * float(min(max(penalty, 0.0), 1.0))))


def rank(cands: DataFrame, as_of: datetime, half_life_days: float = 30.0, query: str | None = None, project: str | None = None, penalty: float | None = None) -> DataFrame:
    """Normalise, decay, drop neighbours, rerank by the query, flag or lower other projects. cands (id, content, project, session, chunk_index, created_at, rank)."""
    from .rerank import rerank

    df = cands.withColumn("score", decayed(normalized(F.col("rank")), F.col("created_at"), as_of, half_life_days))
    df = adjacency_dedupe(df)
    if query:
        df = rerank(df, query)
    return project_penalty(df, project, penalty)


def cascade(cands: DataFrame, as_of: datetime, target: int, half_life_days: float = 30.0, query: str | None = None, project: str | None = None, penalty: float | None = None, least: float = 0.0, tiered: bool = True) -> DataFrame:
    """rank(), and where fewer than target rows reach `least` and least is 0, a milder penalty, then a longer half-life, then any score from 0. The first that suffices is taken; only counts come to the driver."""
    def attempt(days: float, p: float | None) -> DataFrame:
        return rank(cands, as_of, days, query, project, p)

    kept = attempt(half_life_days, penalty)
    few = lambda d: d.where(F.col("score") >= least).limit(target).count() < target
    if least == 0.0 and few(kept):
        if tiered and penalty is not None and penalty < 1.0:
            penalty = min(3 * penalty, 1.0)
            kept = attempt(half_life_days, penalty)
        if few(kept):
            kept = attempt(3 * half_life_days, penalty)
    return kept.where(F.col("score") >= least).orderBy(F.desc("score"), "id").limit(target)
