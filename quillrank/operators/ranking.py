"""Scores of pairs: the learned linear ranker, the declared baseline, and their explanations."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicon as lx

#: Nodes of a cell of scores; what they do to a polynomial of T_j(2u), j below NODES, is exact.
NODES = 16
_PLACES = np.cos((np.arange(NODES) + 0.5) * np.pi / NODES)
_AT_NODES = np.cos(np.arange(NODES)[:, None] * np.arccos(_PLACES)[None, :]) * np.where(np.arange(NODES) > 0, 2, 1)[:, None] / NODES


@dataclass(frozen=True)
class LinearModel:
    """Feature, mean, scale and weight; scores are columns, so Catalyst sees them."""

    features: tuple[str, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]

    def __post_init__(self) -> None:
        if not len(self.features) == len(self.mean) == len(self.scale) == len(self.weights):
            raise ValueError("a mean, a scale and a weight for each feature")
        if not np.isfinite([*self.mean, *self.scale, *self.weights]).all() or min(self.scale) <= 0 or min(self.weights) < 0:
            raise ValueError("finite parameters, positive scales, weights of at least 0")

    def terms(self) -> list[Column]:
        return [(F.col(f) - m) / s * w for f, m, s, w in zip(self.features, self.mean, self.scale, self.weights, strict=True)]

    def raw(self) -> Column:
        """Sum of (x - mean) / scale * weight, in the order of the features."""
        return reduce(add, self.terms())

    def explained(self) -> Column:
        """An array of (feature, value, contribution)."""
        return F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"), t.alias("contribution")) for f, t in zip(self.features, self.terms(), strict=True)])


def shortfall(raw: Column, role: str | Column = "role_compatibility", experience: str | Column = "experience_compatibility") -> Column:
    """(factor, adjustment): an explicit shortfall of experience shrinks a positive score, and nothing else."""
    r, e = (F.col(x) if isinstance(x, str) else x for x in (role, experience))
    factor = F.when((r > 0) & (e < 0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 + F.try_divide(e, r)))).otherwise(1.0)
    return F.struct(factor.alias("factor"), (-F.greatest(raw, F.lit(0.0)) * (1 - factor)).alias("adjustment"))


def scored(rows: DataFrame, model: LinearModel) -> DataFrame:
    """Rows of feature columns with raw_score, factor, adjustment, score and contributions."""
    out = rows.withColumn("raw_score", model.raw()).withColumn("_p", shortfall(F.col("raw_score")))
    out = out.withColumn("factor", F.col("_p.factor")).withColumn("adjustment", F.col("_p.adjustment")).drop("_p")
    return out.withColumn("score", F.col("raw_score") + F.col("adjustment")).withColumn("contributions", model.explained())


def top_contributions(c: str | Column, k: int = 4) -> Column:
    """The k largest by absolute value."""
    col = F.col(c) if isinstance(c, str) else c
    return F.slice(F.array_sort(col, lambda a, b: F.when(F.abs(a["contribution"]) > F.abs(b["contribution"]), -1).when(F.abs(a["contribution"]) < F.abs(b["contribution"]), 1).otherwise(0)), 1, k)


def with_signals(rows: DataFrame, evidence: str = "e") -> DataFrame:
    """The struct of pair_signals as fifteen named columns."""
    return rows.select("*", *[F.col(f"{evidence}.signals")[i].alias(f) for i, f in enumerate(lx.FEATURES)])


def baseline(rows: DataFrame, ml1: str = "hybrid_score") -> DataFrame:
    """Six components of fixed weight and their total (M13), for rows of signals and ``languages``.

    Unknown evidence earns nothing; weights are not made up for it. An experience component counts only where a minimum
    and relevant years are known (minimum_status null).
    """
    experience = F.when(F.col("minimum_status").isNull() & F.col("relevant_years").isNotNull() & F.col("supported"), F.col("experience_compatibility")).otherwise(0.0)
    parts = {
        "ml1_hybrid": F.col(ml1), "required_skills": F.col("required_skill_coverage"), "demonstrated_skills": F.col("demonstrated_skill_coverage"),
        "professional_profile": F.col("role_compatibility"), "relevant_experience": experience, "languages": F.col("languages"),
    }
    out = rows.select("*", *[(F.lit(w) * parts[k].cast("double")).alias(f"c_{k}") for k, w in lx.BASELINE_WEIGHTS.items()])
    return out.withColumn("baseline_score", reduce(add, [F.col(f"c_{k}") for k in lx.BASELINE_WEIGHTS]))


def baseline_ranks(rows: DataFrame, query: str, order: str, score: str = "baseline_score") -> DataFrame:
    """baseline_rank, ties in input order."""
    return rows.withColumn("baseline_rank", F.row_number().over(Window.partitionBy(query).orderBy(F.round(score, 9).desc(), order)))


def language_component(required: Column, own: Column, context: Column) -> Column:
    """Mean over all required languages of 1 or -gap / 6, unknown 0, times context (M15): maps of language to level."""
    levels = F.transform(F.map_entries(required), lambda e: F.when(own[e["key"]].isNull(), 0.0).when(own[e["key"]] >= e["value"], 1.0).otherwise(-(e["value"] - own[e["key"]]) / 6.0))
    return F.when(F.size(required) > 0, F.aggregate(levels, F.lit(0.0), lambda a, x: a + x) / F.size(required) * context).otherwise(0.0)


def status_summary(statuses: Column) -> Column:
    """None, the one, or mixed."""
    own = F.array_distinct(statuses)
    return F.when(F.size(own) == 0, "not_specified").when(F.size(own) == 1, own[0]).otherwise("mixed")


def preference_pairs(rows: DataFrame, query: str, features: Sequence[str], grade_gap: bool = False, group: str | None = None) -> DataFrame:
    """Differences d_<feature> of each pair of one query with different labels, and a weight.

    Weights of a query sum to 1 / (informative queries). With ``group``, no candidate meets another version of itself.
    """
    names = [query, "relevance", *([group] if group else []), *features]
    a, b = (rows.select(*[F.col(n).alias(f"{side}_{n}") for n in names]) for side in "ab")
    on = (F.col(f"a_{query}") == F.col(f"b_{query}")) & (F.col("a_relevance") > F.col("b_relevance"))
    if group:
        on = on & (F.col(f"a_{group}") != F.col(f"b_{group}"))
    gap = (F.col("a_relevance") - F.col("b_relevance")).cast("double") if grade_gap else F.lit(1.0)
    pairs = a.join(b, on).select(F.col(f"a_{query}").alias("query"), gap.alias("importance"), *[(F.col(f"a_{f}") - F.col(f"b_{f}")).alias(f"d_{f}") for f in features])
    queries = pairs.agg(F.count_distinct("query").alias("queries"))
    share = F.col("importance") / F.sum("importance").over(Window.partitionBy("query"))
    return pairs.withColumn("share", share).crossJoin(F.broadcast(queries)).withColumn("weight", F.col("share") / F.col("queries")).drop("share", "queries", "importance")


def feature_stats(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """feature, mean, scale: the population deviation, 1 where it is none."""
    got = rows.agg(*[F.struct(F.lit(f).alias("feature"), F.avg(f).alias("mean"), F.stddev_pop(f).alias("std")).alias(f) for f in features])
    flat = got.select(F.explode(F.array(*[F.col(f) for f in features])).alias("s")).select("s.*")
    return flat.select("feature", "mean", F.when(F.col("std") < 1e-8, 1.0).otherwise(F.col("std")).alias("scale"))


def fit(pairs: DataFrame, features: Sequence[str], scale: Sequence[float], l2: float = 0.1, iterations: int = 3000) -> tuple[LinearModel, dict]:
    """Projected gradient on the weighted logistic loss of pairs, weights at least 0.

    ``pairs``: d_<feature> already over scale, and weight. Each step is one aggregation of as many sums as features;
    pairs of up to a few thousand come to the driver once instead, as equal differences merged with their weights.
    """
    if l2 <= 0:
        raise ValueError("l2 is positive")
    names = [f"d_{f}" for f in features]
    merged = pairs.groupBy(*names).agg(F.sum("weight").alias("weight")).persist()
    n, w = merged.count(), np.zeros(len(features))
    small = n <= 20_000
    if small:
        got = merged.toPandas()
        d, m = got[names].to_numpy(float), got["weight"].to_numpy(float)
        gram = (d * m[:, None]).T @ d
    else:
        sums = merged.agg(*[F.sum(F.col(a) * F.col(b) * F.col("weight")) for a in names for b in names]).first()
        gram = np.array(sums, dtype=float).reshape(len(names), len(names))
    step = 0.25 * float(np.linalg.eigvalsh(gram)[-1]) + l2 if n else l2
    used = 0
    for i in range(iterations):
        used = i + 1
        if small:
            pull = d.T @ (m * np.exp(-np.logaddexp(0.0, d @ w))) if n else np.zeros_like(w)
        else:
            margin = reduce(add, [F.col(c) * float(x) for c, x in zip(names, w, strict=True)])
            pull = np.array(merged.agg(*[F.sum(F.col(c) * F.col("weight") / (1 + F.exp(margin))) for c in names]).first(), dtype=float)
        new = np.maximum(0.0, w + (pull - l2 * w) / step)
        moved = float(np.abs(new - w).max(initial=0.0))
        w = new
        if moved < 1e-9:
            break
    merged.unpersist()
    return LinearModel(tuple(features), (0.0,) * len(w), tuple(map(float, scale)), tuple(map(float, w))), {"l2": l2, "iterations": used, "distinct_pairs": n}


def _moments(features: Sequence[str], w: np.ndarray) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Sums over rows (query, relevance, features), by query, relevance and node of the score: of 1, of each x and of each x * x, interpolated to the nodes."""
    up = np.triu_indices(len(w))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            x = rows[list(features)].to_numpy(float)
            rows, x = rows[np.isfinite(x).all(axis=1)], x[np.isfinite(x).all(axis=1)]
            score = x @ w
            cell = np.rint(score)
            weight = np.cos(np.arange(NODES) * np.arccos(np.clip(2 * (score - cell), -1, 1))[:, None]) @ _AT_NODES
            group, names = pd.MultiIndex.from_arrays([rows["query"], rows["relevance"], cell]).factorize(sort=True)
            if not len(names):
                continue
            order = np.argsort(group, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(group[order]) > 0])
            terms = np.column_stack([np.ones(len(x)), x, x[:, up[0]] * x[:, up[1]]])
            sums = {f"m{f}": np.add.reduceat((weight * terms[:, f : f + 1])[order], first).ravel() for f in range(terms.shape[1])}
            q, label, at = (np.repeat(names.get_level_values(k).to_numpy(), NODES) for k in range(3))
            yield pd.DataFrame({"query": q, "label": label, "at": at.astype(float) + np.tile(_PLACES / 2, len(names)), **sums})

    return run


def _of_query(d: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """Loss, pull and curvature of all pairs of a query from its sums at nodes, of which there are as many as labels and cells of scores."""
    up = np.triu_indices(d)

    def run(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
        m = cells[[f"m{f}" for f in range(1 + d + len(up[0]))]].to_numpy()
        n, x, xx = m[:, 0], m[:, 1 : 1 + d], np.zeros((len(m), d, d))
        xx[:, up[0], up[1]] = xx[:, up[1], up[0]] = m[:, 1 + d :]
        label, at = cells["label"].to_numpy(), cells["at"].to_numpy()
        loss, pull, bend = 0.0, np.zeros(d), np.zeros((d, d))
        for high in np.unique(label):
            a, b = label == high, label < high
            gap = at[a][:, None] - at[b][None, :]
            share = np.exp(-np.logaddexp(0.0, gap))
            loss += n[a] @ np.logaddexp(0.0, -gap) @ n[b]
            pull += x[a].T @ (share @ n[b]) - x[b].T @ (share.T @ n[a])
            curve = share * (1 - share)
            cross = x[a].T @ curve @ x[b]
            bend += np.tensordot(curve @ n[b], xx[a], 1) + np.tensordot(curve.T @ n[a], xx[b], 1) - cross - cross.T
        return pd.DataFrame([(key[0], loss, *pull, *bend.ravel())])

    return run


def fit_rows(rows: DataFrame, features: Sequence[str], scale: Sequence[float], l2: float = 0.1, iterations: int = 100) -> tuple[LinearModel, dict]:
    """The optimum that :func:`fit` goes to over all pairs of :func:`preference_pairs`, without making the pairs.

    ``rows``: query, relevance, features over scale. What a pair adds hangs on the difference of two scores alone, smoothly, so its sum over pairs
    is that of nodes: scores lie in cells of width 1, each with NODES Chebyshev nodes, which interpolate the loss and its derivatives to
    about 1e-15 (their poles are pi from the real line). A step is one pass over the rows and a table of labels times cells for
    each query; steps are Newton's, within weights of at least 0, and halved where the loss would grow.
    """
    if l2 <= 0:
        raise ValueError("l2 is positive")
    d, w = len(features), np.zeros(len(features))
    own = rows.filter("query is not null and relevance is not null").select("query", F.col("relevance").cast("double").alias("relevance"), *[F.col(f).cast("double").alias(f) for f in features])
    labels = own.groupBy("query", "relevance").agg(F.count(F.lit(1)).alias("c"))
    below = F.sum("c").over(Window.partitionBy("query").orderBy("relevance").rowsBetween(Window.unboundedPreceding, -1))
    pairs = labels.withColumn("below", below).groupBy("query").agg(F.sum(F.col("c") * F.col("below")).alias("pairs")).filter("pairs > 0").persist()
    queries, kind = pairs.count(), own.schema["query"].dataType.simpleString()
    sums = [f"m{f}" for f in range(1 + d + d * (d + 1) // 2)]
    values = ["loss", *[f"p{i}" for i in range(d)], *[f"h{i}" for i in range(d * d)]]

    def at(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        if not queries:
            return l2 / 2 * float(w @ w), l2 * w, l2 * np.eye(d)
        cells = own.join(pairs.select("query"), "query", "left_semi").mapInPandas(_moments(features, w), f"query {kind}, label double, at double, " + ", ".join(f"{m} double" for m in sums))
        cells = cells.groupBy("query", "label", "at").agg(*[F.sum(m).alias(m) for m in sums])
        each = cells.groupBy("query").applyInPandas(_of_query(d), f"query {kind}, " + ", ".join(f"{v} double" for v in values)).join(pairs, "query")
        got = np.array([v or 0.0 for v in each.agg(*[F.sum(F.col(v) / F.col("pairs")) for v in values]).first()], dtype=float) / queries
        return got[0] + l2 / 2 * float(w @ w), l2 * w - got[1 : 1 + d], got[1 + d :].reshape(d, d) + l2 * np.eye(d)

    loss, slope, bend = at(w)
    used = 0
    while used < iterations:
        used += 1
        to = w.copy()
        for _ in range(10_000):  # the quadratic model's best weights of at least 0, one after another
            last = to.copy()
            for i in range(d):
                to[i] = max(0.0, to[i] - (slope[i] + bend[i] @ (to - w)) / bend[i, i])
            if np.abs(to - last).max(initial=0.0) < 1e-15:
                break
        moved = float(np.abs(to - w).max(initial=0.0))
        if moved < 1e-9:
            break
        new = at(to)
        while new[0] > loss + 1e-13 and moved >= 1e-9:
            to, moved = (w + to) / 2, moved / 2
            new = at(to)
        w, (loss, slope, bend) = to, new
    pairs.unpersist()
    return LinearModel(tuple(features), (0.0,) * d, tuple(map(float, scale)), tuple(map(float, w))), {"l2": l2, "iterations": used, "queries": queries}


def pick(results: DataFrame) -> DataFrame:
    """The best configuration: NDCG, pairwise accuracy, stronger l2, less HR weight, no grade gap."""
    order = [F.round("ndcg", 12).desc(), F.round("pairwise", 12).desc(), F.desc("l2"), F.asc("hr_weight"), F.asc("grade_gap")]
    return results.orderBy(*order).limit(1)


def folds(rows: DataFrame, group: str, count: int = 3, seed: int = 42) -> DataFrame:
    """group, fold by the order of SHA-256 of seed:group (W8). One row for each group, so the one ordered partition is small."""
    own = rows.select(F.col(group).cast("string").alias("group")).distinct()
    at = F.row_number().over(Window.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("group")), 256)))
    return own.select("group", F.pmod(at - 1, F.lit(count)).alias("fold"))
