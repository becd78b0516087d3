"""Choosing a configuration of the learned ranker, and what it is compared with."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import metrics, ranking

L2, HR_WEIGHTS, GRADE_GAPS = (0.01, 0.1, 1.0, 10.0), (0.0, 0.5), (False, True)


def both_directions(rows: DataFrame, features: Sequence[str], scale: dict[str, float], hr_weight: float, grade_gap: bool) -> DataFrame:
    """Weighted pairs of resumes' vacancies and of vacancies' candidates; the mass of a direction without pairs goes to the other."""
    scaled = rows.select("cv_id", "vacancy_id", "candidate_group_id", "relevance", *[(F.col(f) / scale[f]).alias(f) for f in features])
    one = ranking.preference_pairs(scaled, "cv_id", features, grade_gap)
    people = metrics.canonical_versions(scaled, "vacancy_id", "candidate_group_id", "cv_id")
    two = ranking.preference_pairs(people, "vacancy_id", features, grade_gap, "candidate_group_id")
    if not one.limit(1).count():
        hr_weight = 1.0
    elif not two.limit(1).count():
        hr_weight = 0.0
    names = [f"d_{f}" for f in features]
    out = one.select(*names, (F.col("weight") * (1 - hr_weight)).alias("weight")).unionByName(two.select(*names, (F.col("weight") * hr_weight).alias("weight")))
    return out.filter("weight > 0")


def train(rows: DataFrame, features: Sequence[str], l2: float = 0.1, hr_weight: float = 0.0, grade_gap: bool = False) -> tuple[ranking.LinearModel, dict]:
    """A model of labelled rows: cv_id, vacancy_id, candidate_group_id, relevance and the features."""
    scale = {r.feature: r["scale"] for r in ranking.feature_stats(rows, features).collect()}
    return ranking.fit(both_directions(rows, features, scale, hr_weight, grade_gap), features, [scale[f] for f in features], l2)


def directions(scored: DataFrame) -> dict[str, DataFrame]:
    """cv_to_jobs and job_to_candidates as (query, item, label, score) rows."""
    jobs = scored.select(F.col("cv_id").alias("query"), F.col("vacancy_id").alias("item"), F.col("relevance").alias("label"), "score")
    people = metrics.canonical_versions(scored, "vacancy_id", "candidate_group_id", "cv_id")
    return {"cv_to_jobs": jobs, "job_to_candidates": people.select(F.col("vacancy_id").alias("query"), F.col("cv_id").alias("item"), F.col("relevance").alias("label"), "score")}


def baseline_scores(rows: DataFrame, model: ranking.LinearModel | None = None) -> dict[str, DataFrame]:
    """The orders a model is compared with: skill overlap, the order it was given, and its own."""
    out = {"skill_overlap": rows.withColumn("score", F.col("required_skill_coverage")), "original_order": rows.withColumn("score", -F.col("selection_rank").cast("double"))}
    return out if model is None else out | {"trained": ranking.scored(rows, model)}


def select_configuration(rows: DataFrame, features: Sequence[str], l2: Sequence[float] = L2, hr: Sequence[float] = HR_WEIGHTS, gaps: Sequence[bool] = GRADE_GAPS, fold_count: int = 3, seed: int = 42) -> DataFrame:
    """l2, hr_weight, grade_gap, ndcg, pairwise of every configuration, means over folds of groups and then over directions.

    Labelled sets are what people judged, so rows are few; each fit merges its pairs before they leave Spark.
    """
    spark: SparkSession = rows.sparkSession
    grouped = rows.join(ranking.folds(rows, "candidate_group_id", fold_count, seed), F.col("candidate_group_id").cast("string") == F.col("group")).drop("group").persist()
    found = []
    for a, b, c in product(l2, hr, gaps):
        held: dict[str, list] = {}
        for k in range(fold_count):
            fit_on, check_on = grouped.filter(F.col("fold") != k), grouped.filter(F.col("fold") == k)
            model, _ = train(fit_on, features, a, b, c)
            for name, part in directions(ranking.scored(check_on, model)).items():
                s = metrics.summary(part).first()
                held.setdefault(name, []).append((s.ndcg_informative, s.pairwise_accuracy))
        mean = lambda v: sum(v) / len(v) if v else None
        per = [(mean([n for n, _ in v if n is not None]), mean([p for _, p in v if p is not None])) for v in held.values()]
        ndcg, pairs = mean([n for n, _ in per if n is not None]), mean([p for _, p in per if p is not None])
        if ndcg is None:
            raise ValueError("no informative query in any fold")
        found.append((float(a), float(b), bool(c), float(ndcg), float(pairs or 0.0)))
    grouped.unpersist()
    return spark.createDataFrame(found, "l2 double, hr_weight double, grade_gap boolean, ndcg double, pairwise double")


def hr_benchmark(scored: DataFrame, preferences: DataFrame) -> DataFrame:
    """One row over declared cases (R14): scored (case, id, relevance, score), preferences (case, higher, lower)."""
    rows = scored.select(F.col("case").alias("query"), F.col("id").alias("item"), F.col("relevance").alias("label"), "score")
    p = metrics.preferences(scored, preferences).agg(F.sum("strict").alias("strict"), F.sum("ties").alias("ties"), F.sum("wrong").alias("wrong"), F.avg("credit").alias("preference_credit"))
    return metrics.summary(rows).crossJoin(F.broadcast(p))
