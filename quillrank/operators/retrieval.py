"""Retrieval: BM25 over an inverted index, dense vectors, hybrid scores, and rankings of them.

Corpus statistics are a table of postings (doc, token, tf) with document lengths; a query touches
the postings of its own tokens only. Ranks come from row_number over a rounded score and the id, so float
summation order never decides a tie, and Spark keeps a partial top-k per partition before the shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicon as lx
from ..functions import skills as sk
from . import nearest

DIGITS = 9


@dataclass(frozen=True)
class Bm25:
    """score = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len / avg)), idf = ln(1 + (N - df + .5) / (df + .5))."""

    k1: float = 1.5
    b: float = 0.75

    def weight(self, tf: str | Column, length: str | Column, average: str | Column) -> Column:
        t, n, m = (F.col(x) if isinstance(x, str) else x for x in (tf, length, average))
        return t * (self.k1 + 1) / (t + self.k1 * (1 - self.b + self.b * n / m))

    @staticmethod
    def idf(docs: str | Column, df: str | Column) -> Column:
        n, d = (F.col(x) if isinstance(x, str) else x for x in (docs, df))
        return F.log(1 + (n - d + 0.5) / (d + 0.5))


@dataclass(frozen=True)
class Index:
    """An inverted index (A1-A3)."""

    postings: DataFrame  # doc_id, token, tf, len
    frequencies: DataFrame  # token, df
    totals: DataFrame  # n, avg_len: one row


def build_index(docs: DataFrame, doc_id: str, tokens: Column) -> Index:
    """Term frequencies by a partial aggregation; lengths from the token array, with no second shuffle."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), tokens.alias("tokens"))
    long = rows.select("doc_id", F.size("tokens").alias("len"), F.explode("tokens").alias("token"))
    postings = long.groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("tf"), F.first("len").alias("len"))
    totals = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("tokens")).alias("avg_len"))
    return Index(postings, postings.groupBy("token").agg(F.count(F.lit(1)).alias("df")), totals)


def query_tokens(queries: DataFrame, query_id: str, tokens: Column) -> DataFrame:
    """query_id, token, size: each query as a set."""
    t = queries.select(F.col(query_id).alias("query_id"), F.array_distinct(tokens).alias("t"))
    return t.select("query_id", F.size("t").alias("size"), F.explode("t").alias("token"))


def bm25(index: Index, queries: DataFrame, model: Bm25 = Bm25()) -> DataFrame:
    """query_id, doc_id, size, lexical: the score of each document that shares a token with a query (A4, A5).

    The totals are one row, and join as a broadcast; postings and frequencies join on the token. A
    token that the statistics do not have counts df 0.
    """
    hit = queries.join(index.postings, "token").join(index.frequencies, "token", "left").crossJoin(F.broadcast(index.totals))
    score = model.idf("n", F.coalesce("df", F.lit(0))) * model.weight("tf", "len", F.greatest(F.lit(1.0), "avg_len"))
    return hit.groupBy("query_id", "doc_id").agg(F.first("size").alias("size"), F.sum(score).alias("lexical"))


def ranked(rows: DataFrame, query: list[str], score: str, tie: list[str], k: int | None = None, rank: str = "rank") -> DataFrame:
    """Ranks by rounded score, then ``tie``; the first k of each query."""
    order = [F.desc(score), *[F.col(t) for t in tie]]
    out = rows.withColumn(score, F.round(score, DIGITS)).withColumn(rank, F.row_number().over(Window.partitionBy(*query).orderBy(*order)))
    return out if k is None else out.filter(F.col(rank) <= k)


def distinct_source_top(rows: DataFrame, k: int = 5) -> DataFrame:
    """The k best of each query with no source twice (L4): rows of query_id, doc_id, source_hash, score."""
    best = ranked(rows, ["query_id", "source_hash"], "score", ["doc_id"], 1, "own_rank").drop("own_rank")
    return ranked(best, ["query_id"], "score", ["doc_id"], k)


def shortlist_pairs(index: Index, queries: DataFrame, overlap: DataFrame | None = None, hashes: DataFrame | None = None, k: int = 5) -> DataFrame:
    """Lexical + 8 * skill overlap, distinct sources, top k (R2). ``overlap``: query_id, doc_id, overlap; ``hashes``: doc_id, source_hash."""
    score = bm25(index, queries, Bm25(1.5))
    if overlap is not None:
        score = score.join(overlap, ["query_id", "doc_id"], "full").withColumn("lexical", F.coalesce("lexical", F.lit(0.0)) + 8 * F.coalesce("overlap", F.lit(0.0)))
    score = score.select("query_id", "doc_id", F.col("lexical").alias("score"))
    return distinct_source_top(score.join(hashes, "doc_id"), k) if hashes is not None else ranked(score, ["query_id"], "score", ["doc_id"], k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Inner product of unit vectors, clipped to [0, 1] (M1)."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b)))


def hybrid(skill: Column, semantic: Column, alpha: float = lx.ALPHA) -> Column:
    """alpha * skill + (1 - alpha) * semantic (M4)."""
    if not 0 <= alpha <= 1:
        raise ValueError("alpha lies in [0, 1]")
    return alpha * skill + (1 - alpha) * semantic


def against_all(rows: DataFrame, queries: DataFrame, key: str, most: int = 1000) -> DataFrame:
    """Every row with every query (J1). Queries are a stated set; their number is counted first, and they are broadcast in
    blocks of about ``most`` rows, dealt by a hash of ``key``, so that no broadcast grows with the data."""
    n = queries.count()
    blocks = 1 if n <= most else -(-2 * n // most)
    out = None
    for i in range(blocks):
        own = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64(key), F.lit(blocks)) == i)
        met = rows.crossJoin(F.broadcast(own))
        out = met if out is None else out.unionByName(met)
    return out


def vector_scores(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """query_id, vec_id, semantic of every query against every candidate but itself."""
    q = queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    met = against_all(candidates, q, "query_id").filter(F.col("vec_id") != F.col("query_id"))
    return met.select("query_id", "vec_id", cosine(F.col("q"), F.col("embedding")).alias("semantic"))


def _sides(left: DataFrame, right: DataFrame) -> tuple[int, list[DataFrame], list[tuple[DataFrame, DataFrame]]]:
    """How long the vectors (v) of both sides are, what of each side has such a vector, and pairs of what is left: the three make up all pairs.

    Ids that are no whole numbers have no vectors of a length.
    """
    size = max((d.agg(F.max(F.size("v"))).first()[0] or 0 for d in (left, right)), default=0)
    whole = all(d.schema["id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint") for d in (left, right))
    good = [F.col("id").isNotNull() & nearest.even("v", size) if whole and size > 0 else F.lit(False)] * 2
    parts = [(d.filter(g), d.filter(~g)) for d, g in zip((left, right), good, strict=True)]
    rest = [(a, b) for a, b in ((parts[0][1], right), (parts[0][0], parts[1][1])) if not a.isEmpty() and not b.isEmpty()]
    return size, [p[0].withColumn("id", F.col("id").cast("long")) for p in parts] if whole and size > 0 else [], rest


def nearest_vectors(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """Of :func:`vector_scores` the rows that may be among the first k of each query (J1); rank them with :func:`ranked`."""
    own = [d.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.lit(0).cast("long").alias("group")) for d in (queries, candidates)]
    size, good, rest = _sides(*own)
    out = None
    if good:
        out = nearest.products(*good, k, size, itself=False).select("query_id", F.col("candidate_id").alias("vec_id"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), "product")).alias("semantic"))
    for pair in rest:
        more = vector_scores(*[d.select(F.col("id").alias("vec_id"), F.col("v").alias("embedding")) for d in pair])
        out = more if out is None else out.union(more)
    return vector_scores(queries, candidates) if out is None else out


def hybrid_match(resume: DataFrame, vacancies: DataFrame, k: int = 10, alpha: float = lx.ALPHA) -> DataFrame:
    """The k best vacancies of each resume (R1): resume_id, skills, embedding against vacancy_id, skills, embedding.

    Ties keep the catalogue's order of ids. matched and missing skills come along (M3). Of the vacancies of one set of skills
    only those nearest to a resume are scored, since the skills score them alike; vacancies of as many sets as rows are all scored.
    """
    if k < 1:
        raise ValueError("k is positive")
    hybrid(F.lit(0.0), F.lit(0.0), alpha)
    own, there = (d.select(F.col(name).alias("id"), F.col("embedding").alias("v"), "skills", F.xxhash64("skills").alias("group")) for d, name in ((resume, "resume_id"), (vacancies, "vacancy_id")))
    size, good, rest = _sides(own, there)
    pair = None
    if good:
        # scores that round to the same nine digits come from products this far apart
        met = nearest.products(*good, k, size, slack=nearest.SLACK / (1 - alpha) if alpha < 1 else float("inf"))
        sets = [d.groupBy("group").agg(F.first("skills").alias(name)).withColumnRenamed("group", key) for d, name, key in ((own, "own", "query_group"), (there, "skills", "candidate_group"))]
        met = met.join(sets[0], "query_group").join(sets[1], "candidate_group")
        pair = met.select(F.col("query_id").alias("resume_id"), "own", F.col("candidate_id").alias("vacancy_id"), "skills", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "product")).alias("semantic_score"))
    for a, b in rest or ([] if good else [(own, there)]):
        r = a.select(F.col("id").alias("resume_id"), F.col("skills").alias("own"), F.col("v").alias("q"))
        more = against_all(b.select(F.col("id").alias("vacancy_id"), "skills", F.col("v").alias("embedding")), r, "resume_id")
        more = more.select("resume_id", "own", "vacancy_id", "skills", cosine(F.col("q"), F.col("embedding")).alias("semantic_score"))
        pair = more if pair is None else pair.union(more)
    pair = pair.withColumn("skill_score", sk.skill_score("own", "skills"))
    pair = pair.withColumn("hybrid_score", hybrid(F.col("skill_score"), F.col("semantic_score"), alpha)).withColumn("d", sk.details("own", "skills"))
    top = ranked(pair, ["resume_id"], "hybrid_score", ["vacancy_id"], k)
    return top.select("resume_id", "rank", "vacancy_id", "hybrid_score", "skill_score", "semantic_score", "d.matched", "d.missing")


def two_stage(pairs: DataFrame, prefilter: str, limit: int) -> DataFrame:
    """The max(60, 3 * limit) best pairs of each query by a cheap score (L3).

    By row_number and not limit: Catalyst would push the costly projection that follows below a limit.
    """
    return ranked(pairs, ["query_id"], prefilter, ["doc_id"], max(60, 3 * limit), "pool_rank").drop("pool_rank")


def prefilter_score(lexical: Column, size: Column, skill: Column) -> Column:
    """Lexical score for each query token, and twice the skill coverage (A5)."""
    return lexical / F.greatest(F.lit(1), size) + 2 * skill


def search(rows: DataFrame, fields: list[str], q: str = "", city: str | None = None, city_field: str = "city", page: int = 1, limit: int = 20, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(one page, total): an equality on the city and a substring of the fields, both without case."""
    on = F.contains(F.lower(F.concat_ws(" ", *fields)), F.lit(q.lower()))
    if city:
        on = on & (F.lower(city_field) == city.lower())
    found = rows.filter(on)
    return found.orderBy(order or fields[0]).offset((page - 1) * limit).limit(limit), found.agg(F.count(F.lit(1)).alias("total"))
