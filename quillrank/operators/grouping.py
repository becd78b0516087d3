"""Who is the same candidate: connected components, group ids and splits."""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import compact


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 50) -> DataFrame:
    """node, root for each of ``nodes`` (node), root being the least node reached over ``edges`` (a, b) (J23); an error if ``rounds`` are too few.

    Each round takes the least root of the neighbours and then that root's root; checkpoint() cuts the lineage in the
    session's checkpoint folder every round, so an executor that is lost costs one round at most.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).distinct().persist()
    now = nodes.select("node", F.col("node").alias("root"))
    ready = nodes.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined()
    for _ in range(rounds):
        near = both.join(now, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("near"))
        step = now.join(near, F.col("node") == F.col("a"), "left").select("node", "root", F.least("root", F.coalesce("near", "root")).alias("new"))
        up = step.select(F.col("node").alias("n"), F.col("new").alias("over"))
        step = step.join(up, F.col("new") == F.col("n"), "left").select("node", "root", F.least("new", F.coalesce("over", "new")).alias("new"))
        step = step.checkpoint() if ready else step.persist()
        changed = step.filter("root <> new").limit(1).count()
        now = step.select("node", F.col("new").alias("root"))
        if not changed:
            both.unpersist()
            return now
    raise RuntimeError(f"roots still change after {rounds} rounds")


def same_text_edges(rows: DataFrame, cv_id: str = "cv_id", text: str = "cv_text") -> DataFrame:
    """a, b between versions whose text is equal but for white space and case: a star around the least id."""
    own = rows.select(F.col(cv_id).alias("id"), F.lower(compact(text)).alias("key")).filter("key <> ''").distinct()
    least = own.groupBy(F.sha2("key", 256).alias("h")).agg(F.min("id").alias("a"))
    return own.select(F.col("id").alias("b"), F.sha2("key", 256).alias("h")).join(least, "h").filter("a <> b").select("a", "b")


def candidate_groups(rows: DataFrame, same: DataFrame | None = None, cv_id: str = "cv_id", text: str = "cv_text") -> DataFrame:
    """cv_id, candidate_group_id (R18): equal texts, and pairs (a, b) that are declared the same."""
    edges = same_text_edges(rows, cv_id, text)
    if same is not None:
        edges = edges.unionByName(same.select("a", "b"))
    got = components(rows.select(F.col(cv_id).alias("node")).distinct(), edges)
    names = got.groupBy("root").agg(F.array_join(F.array_sort(F.collect_set("node")), "|").alias("ids"))
    group = F.concat(F.lit("candidate_"), F.substring(F.sha2("ids", 256), 1, 12))
    return got.join(names, "root").select(F.col("node").alias("cv_id"), group.alias("candidate_group_id"))


#: The (group, label) counts that every task of the search holds. More are an error: 8 bytes each.
MOST_CELLS = 4_000_000


class SplitSearch:
    """The counts of labels by group, and what a shuffle of the groups costs."""

    def __init__(self, groups: list[str], counts: np.ndarray, seed: int, validation: float, test: float) -> None:
        n = len(groups)
        if not (validation > 0 and test > 0 and validation + test < 1) or n < 3:
            raise ValueError("at least three groups, and fractions that leave some for training")
        nv, nt = max(1, round(n * validation)), max(1, round(n * test))
        if nv + nt >= n:
            raise ValueError("no group is left for training")
        self.groups, self.counts, self.seed = groups, counts, seed
        self.cuts = (0, n - nv - nt, n - nt, n)
        self.total, self.spread = counts.sum(axis=0), (counts > 0).sum(axis=0)

    def orders(self, start: int, end: int) -> Iterator[tuple[int, list[int]]]:
        """The shuffles of these numbers. One generator makes all, so those before are drawn too."""
        rng = random.Random(self.seed)
        for i in range(end):
            order = list(range(len(self.groups)))
            rng.shuffle(order)
            if i >= start:
                yield i, order

    def cost(self, order: list[int]) -> float:
        """How far each part's labels are from its share of them; a label in three groups or more that a part lacks costs most."""
        out = 0.0
        for a, b in zip(self.cuts, self.cuts[1:], strict=False):
            own, want = self.counts[order[a:b]].sum(axis=0), self.total * ((b - a) / len(order))
            out += float(((own - want) ** 2 / (want + 1)).sum()) + 10_000.0 * int(((self.spread >= 3) & (own == 0)).sum())
        return out

    def parts(self, order: list[int]) -> Iterator[tuple[str, str]]:
        for name, a, b in zip(("train", "validation", "test"), self.cuts, self.cuts[1:], strict=False):
            yield from ((self.groups[g], name) for g in order[a:b])


def search_split(spark: SparkSession, search: SplitSearch, tries: int = 1024, tasks: int = 32) -> dict[str, str]:
    """group: split, of the cheapest of ``tries`` seeded shuffles, the first of equals. Tasks share the shuffles and give back a cost each."""
    step = -(-tries // tasks)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in batch["id"].tolist():
                yield pd.DataFrame([(k, search.cost(o)) for k, o in search.orders(i * step, min(tries, (i + 1) * step))], columns=["n", "cost"])

    found = spark.range(0, -(-tries // step), 1, -(-tries // step)).mapInPandas(run, "n int, cost double")
    best = found.orderBy("cost", "n").first().n
    return dict(search.parts(next(search.orders(best, best + 1))[1]))


def split_groups(rows: DataFrame, seed: int = 42, validation: float = 0.15, test: float = 0.15, tries: int = 1024) -> DataFrame:
    """Eligible rows (judged, with a text) with ``split``; a group is never torn (R19). Ineligible ones are left out.

    Groups are candidates whose pairs people judged: MOST_CELLS counts of them are looked at, and more are an error.
    """
    spark = rows.sparkSession
    eligible = rows.filter(F.col("judged") & (F.trim("cv_text") != ""))
    counts = eligible.groupBy("candidate_group_id", "overall_score").agg(F.count(F.lit(1)).alias("n"))
    found = counts.limit(MOST_CELLS + 1).toPandas()
    if len(found) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} counts of labels")
    table = found.pivot_table(index="candidate_group_id", columns="overall_score", values="n", fill_value=0, aggfunc="sum").sort_index()
    got = search_split(spark, SplitSearch(table.index.tolist(), table.to_numpy(dtype=np.int64), seed, validation, test), tries)
    names = spark.createDataFrame(sorted(got.items()), "candidate_group_id string, split string")
    return eligible.join(names, "candidate_group_id")


def leaks(rows: DataFrame, key: str = "candidate_group_id", split: str = "split") -> DataFrame:
    """Keys in more than one split (U7); empty if all is well."""
    return rows.groupBy(key).agg(F.count_distinct(split).alias("splits")).filter("splits > 1")


def report(rows: DataFrame) -> DataFrame:
    """Per split: pairs, CVs, groups, vacancies, histogram of scores, queries with more than one score."""
    per_query = rows.groupBy("split", "cv_id").agg((F.count_distinct("overall_score") > 1).alias("varied")).groupBy("split").agg(F.count_if("varied").alias("varied_queries"))
    scores = rows.groupBy("split", "overall_score").count().groupBy("split").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("overall_score", "count")))).alias("scores"))
    main = rows.groupBy("split").agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("cv_id").alias("cvs"), F.count_distinct("candidate_group_id").alias("groups"), F.count_distinct("vacancy_id").alias("vacancies"))
    return main.join(per_query, "split").join(scores, "split")
