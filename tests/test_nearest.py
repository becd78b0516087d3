"""Nearest vectors by blocks against every pair."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quillrank.functions import skills as sk
from quillrank.operators import nearest, retrieval


def _vectors(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(300):
        v = [rnd.gauss(0, 1) for _ in range(6)]
        n = sum(x * x for x in v) ** 0.5
        rows.append((i, [x / n for x in v], rnd.choice(["a", "b", None])))
    rows += [(300 + i, rows[50][1], "a") for i in range(40)] + [(400 + i, [-x for x in rows[100][1]], "b") for i in range(40)]
    rows += [(500, None, "a"), (501, [0.5], "b"), (502, [None] * 6, "a"), (550, [float("nan")] * 6, "b"), (600, None, "a"), (None, rows[0][1], "a"), (50, rows[60][1], "a"), (650, [3.0] * 6, "b")]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label string")


@pytest.mark.parametrize("block", [4096, 37])
def test_nearest_vectors_are_those_of_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(nearest, "BLOCK", block)
    e = _vectors(spark)
    q = e.filter("vec_id % 50 = 0")
    best = lambda rows: sorted(map(str, retrieval.ranked(rows, ["query_id"], "semantic", ["vec_id"], 10).collect()))
    got = retrieval.nearest_vectors(q, e, 10)
    assert best(got) == best(retrieval.vector_scores(q, e))
    clean = e.filter("vec_id < 500")
    few, plain = retrieval.nearest_vectors(clean.filter("vec_id % 50 = 0"), clean, 10), retrieval.vector_scores(clean.filter("vec_id % 50 = 0"), clean)
    assert best(few) == best(plain)
    assert block < 4096 or few.count() < plain.count() / 8


@pytest.mark.parametrize("alpha", [0.4, 0.0, 1.0])
def test_hybrid_matches_are_those_of_all_pairs(spark, alpha):
    e = _vectors(spark).filter("vec_id is not null").select("vec_id", "embedding", F.array("label").alias("skills"))
    r, v = e.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "resume_id"), e.withColumnRenamed("vec_id", "vacancy_id")
    pair = r.select("resume_id", F.col("skills").alias("own"), F.col("embedding").alias("q")).crossJoin(v)
    pair = pair.withColumn("semantic_score", retrieval.cosine(F.col("q"), F.col("embedding"))).withColumn("skill_score", sk.skill_score("own", "skills"))
    pair = pair.withColumn("hybrid_score", retrieval.hybrid(F.col("skill_score"), F.col("semantic_score"), alpha))
    names = ["resume_id", "rank", "vacancy_id", "hybrid_score", "skill_score"]
    want = retrieval.ranked(pair, ["resume_id"], "hybrid_score", ["vacancy_id"], 10).select(*names).collect()
    got = retrieval.hybrid_match(r, v, 10, alpha).select(*names).collect()
    assert sorted(map(str, got)) == sorted(map(str, want))
