"""Ranking metrics that average over ties, as windows and grouped sums.

Rows are (query, label, score). A query with one distinct label is not informative; one whose labels are all
zero has no NDCG, rather than a perfect one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DIGITS = 9


def _discount(rank: str):
    return 1 / F.log2(F.col(rank) + 1)


def canonical_versions(rows: DataFrame, query: str, group: str, version: str) -> DataFrame:
    """One row for each (query, candidate group): the least version as text."""
    order = Window.partitionBy(query, group).orderBy(F.col(version).cast("string"))
    return rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def tie_groups(rows: DataFrame, query: str = "query", label: str = "label", score: str = "score") -> DataFrame:
    """rank, ideal_rank, tie, gain: places by score and by label, the group of equal rounded scores, its mean label."""
    q = Window.partitionBy(query)
    s = F.round(score, DIGITS)
    out = rows.withColumn("tie", F.dense_rank().over(q.orderBy(s.desc()))).withColumn("rank", F.row_number().over(q.orderBy(s.desc(), F.desc(label))))
    out = out.withColumn("ideal_rank", F.row_number().over(q.orderBy(F.desc(label))))
    return out.withColumn("gain", F.avg(F.col(label).cast("double")).over(Window.partitionBy(query, "tie")))


def ndcg(rows: DataFrame, k: int = 5, query: str = "query", label: str = "label", score: str = "score") -> DataFrame:
    """query, dcg, ideal, ndcg, informative, top1 of each query."""
    t = tie_groups(rows, query, label, score).withColumn("best", F.max(label).over(Window.partitionBy(query)))
    out = t.groupBy(query).agg(
        F.sum(F.when(F.col("rank") <= k, F.col("gain") * _discount("rank")).otherwise(0.0)).alias("dcg"),
        F.sum(F.when(F.col("ideal_rank") <= k, F.col(label) * _discount("ideal_rank")).otherwise(0.0)).alias("ideal"),
        (F.count_distinct(label) > 1).alias("informative"),
        F.avg(F.when(F.col("tie") == 1, (F.col(label) == F.col("best")).cast("double"))).alias("top1"),
    )
    return out.withColumn("ndcg", F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")))


def pairwise(rows: DataFrame, query: str = "query", item: str = "item", label: str = "label", score: str = "score") -> DataFrame:
    """query, pairs, accuracy: credit 1, .5 or 0 for each pair of different labels (J7), counted without making the pairs.

    The labels below the n-th of a query are the blocks of n's binary digits: a row is counted, by score, in one block of
    each size that holds its label, and looks up one block for each digit of its own. So n rows of a query make n log(labels) rows,
    and cumulative counts along the scores of a block do the rest. A pair with a null score has no credit; rows with a null query or label take no part.
    """
    own = rows.select(F.col(query).alias("query"), F.col(label).alias("label"), F.round(score, DIGITS).alias("s")).filter("query is not null and label is not null")
    cells = own.groupBy("query", "label", "s").agg(F.count(F.lit(1)).alias("c"))
    labels = cells.groupBy("query", "label").agg(F.sum("c").alias("c"))
    q = Window.partitionBy("query")
    labels = labels.withColumn("below", F.coalesce(F.sum("c").over(q.orderBy("label").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    labels = labels.withColumn("n", (F.row_number().over(q.orderBy("label")) - 1).cast("int")).withColumn("most", F.max("n").over(q))
    pairs = labels.groupBy("query").agg(F.sum(F.col("c") * F.col("below")).alias("pairs")).filter("pairs > 0")
    ranked = cells.filter("s is not null").join(labels.select(F.col("query").alias("q2"), F.col("label").alias("l2"), "n", "most"), (F.col("query") == F.col("q2")) & (F.col("label") == F.col("l2")))
    sizes = F.sequence(F.lit(0), F.floor(F.log2(F.greatest("most", F.lit(1)))).cast("int"))
    block = lambda k: F.call_function("shiftright", F.col("n"), k)
    lies = F.transform(F.filter(sizes, lambda k: block(k) % 2 == 0), lambda k: F.struct(k.alias("k"), block(k).alias("block"), F.col("c").alias("low"), F.lit(0).cast("long").alias("up")))
    asks = F.transform(F.filter(sizes, lambda k: block(k) % 2 == 1), lambda k: F.struct(k.alias("k"), (block(k) - 1).alias("block"), F.lit(0).cast("long").alias("low"), F.col("c").alias("up")))
    at = ranked.select("query", "s", F.explode(F.concat(lies, asks)).alias("e")).groupBy("query", "e.k", "e.block", "s").agg(F.sum("e.low").alias("low"), F.sum("e.up").alias("up"))
    before = F.coalesce(F.sum("low").over(Window.partitionBy("query", "k", "block").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    credit = at.select("query", (F.col("up") * (before + F.col("low") / 2)).alias("credit")).groupBy(F.col("query").alias("q3")).agg(F.sum("credit").alias("credit"))
    return pairs.join(credit, F.col("query") == F.col("q3"), "left").select("query", "pairs", (F.coalesce("credit", F.lit(0.0)) / F.col("pairs")).alias("accuracy"))


def summary(rows: DataFrame, k: int = 5, query: str = "query", label: str = "label", score: str = "score") -> DataFrame:
    """One row of means over queries; nulls are left out of each mean."""
    per = ndcg(rows, k, query, label, score).withColumnRenamed(query, "query").join(pairwise(rows, query, query, label, score), "query", "left")
    return per.agg(
        F.avg("ndcg").alias("ndcg"),
        F.avg(F.when(F.col("informative"), F.col("ndcg"))).alias("ndcg_informative"),
        F.avg("accuracy").alias("pairwise_accuracy"),
        F.avg(F.when(F.col("informative"), F.col("top1"))).alias("top1_informative"),
        F.count(F.lit(1)).alias("queries"),
        F.count_if(F.col("informative")).alias("informative_queries"),
        F.count_if(F.col("ndcg").isNull()).alias("queries_without_ndcg"),
    )


def preferences(scores: DataFrame, pairs: DataFrame) -> DataFrame:
    """case, strict, ties, wrong, credit of declared preferences (J8, A17): scores (case, id, score), pairs (case, higher, lower)."""
    a = scores.select("case", F.col("id").alias("higher"), F.round("score", DIGITS).alias("sh"))
    b = scores.select("case", F.col("id").alias("lower"), F.round("score", DIGITS).alias("sl"))
    both = pairs.join(a, ["case", "higher"]).join(b, ["case", "lower"])
    return both.groupBy("case").agg(
        F.count_if(F.col("sh") > F.col("sl")).alias("strict"),
        F.count_if(F.col("sh") == F.col("sl")).alias("ties"),
        F.count_if(F.col("sh") < F.col("sl")).alias("wrong"),
        F.avg(F.when(F.col("sh") > F.col("sl"), 1.0).when(F.col("sh") == F.col("sl"), 0.5).otherwise(0.0)).alias("credit"),
    )


def macro(directions: dict[str, DataFrame], column: str) -> DataFrame:
    """The mean over directions of the mean over folds."""
    out = None
    for name, rows in directions.items():
        one = rows.agg(F.avg(column).alias("v")).withColumn("direction", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.agg(F.avg("v").alias(column))
