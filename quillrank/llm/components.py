"""Connected components of a table of edges, by alternating stars.

Each round hangs the larger neighbours of every node, then the smaller ones, on the least of them.
The edges end as stars around the least node of each component after about log(size) rounds; every round is
a partial minimum and a join, so a node with many neighbours gathers in no task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written

ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for each node of ``edges`` (a, b: bigint); root is the component's least node.

    Loops, repeated and reversed edges are allowed, edges with a null are not links. Without edges
    there are no rows.
    """
    own = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).dropna().filter("a <> b").distinct()
    own = written(own, "stars0")
    for i in range(1, ROUNDS + 1):
        both = own.union(own.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # every edge now points from the larger to the smaller end
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        small = large.join(low, F.col("a") == F.col("u")).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        own = written(small.select("e.a", "e.b").filter("a <> b").distinct(), f"stars{i}")
        # stars: no end is itself hung on another, and none on two
        ends = own.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(own.select("b", F.lit(0), F.lit(1)))
        ends = ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if ends.filter("up > 1 or (up > 0 and down > 0)").isEmpty():
            return own.select(F.col("a").alias("node"), F.col("b").alias("root")).union(own.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    raise RuntimeError(f"no stars after {ROUNDS} rounds")
