from __future__ import annotations

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillrank.llm import whitening as wh

SCHEMA = "vec_id bigint, embedding array<double>"


def brute(rows, k=32):
    """By numpy's solver on the exact covariance: n, deviations, whitened up to signs, explained."""
    rows = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    d = max(len(v) for _, v in rows)
    x = [[int(np.floor(64 * c)) + 1_000_000 for c in v] + [1_000_000] * (d - len(v)) for _, v in rows]
    n = len(x)
    s = [sum(r[j] for r in x) for j in range(d)]
    far = [[n * r[j] - s[j] for j in range(d)] for r in x]
    v = np.array([[float(Fraction(sum(f[a] * f[b] for f in far), n**3)) for b in range(d)] for a in range(d)])
    e, u = np.linalg.eigh(v)
    order = np.argsort(-e)[:k]
    e, u = e[order], u[:, order]
    w = (np.array(far, dtype=float) / n) @ u / np.sqrt(e)
    return [i for i, _ in rows], n, [sum(f * f for f in r) for r in far], w, e / np.trace(v)


def held(got, rows, k=32):
    ids, n, deviation, w, explained = brute(rows, k)
    out = {}
    for r in got:
        out.setdefault(r.vec_id, {})[r.component] = r
    assert len(got) == len(ids) * min(k, w.shape[1])
    sign = np.sign([sum(out[i][c + 1].whitened * w[a, c] for a, i in enumerate(ids)) for c in range(w.shape[1])])
    for a, i in enumerate(ids):
        for c in range(w.shape[1]):
            r = out[i][c + 1]
            assert r.n == n and int(r.deviation) == deviation[a] and r.identity_error <= 1e-7
            assert abs(r.whitened - sign[c] * w[a, c]) < 1e-6 and abs(r.explained / explained[c] - 1) < 1e-7


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    mixed = rng.normal(size=(9, 9)) * (3.0 ** -np.arange(9))[:, None] * 40
    rows = [(i, [float(c) for c in rng.normal(size=9) @ mixed]) for i in range(300)]
    odd = [(900, None), (901, [1.0, None] + [0.0] * 7), (902, [float("nan")] * 9), (903, [float("inf")] * 9)]
    df = spark.createDataFrame(rows + odd, SCHEMA)
    for c in ("x", "n", "component", "deviation", "i", "v"):
        df = df.withColumn(c, F.lit("clash"))
    held(wh.fit(df).apply(df).collect(), rows)
    a, b = ({(r.vec_id, r.component): r for r in wh.fit(t, components=4).apply(t).collect()} for t in (df, df.repartition(7)))
    assert len(a) == 1200 and all(b[k].deviation == r.deviation and b[k].explained == r.explained and abs(b[k].whitened - r.whitened) < 1e-12 for k, r in a.items())


def test_short_vectors_repeated_rows_and_null_ids(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(c) for c in rng.normal(size=4)]) for i in range(50)] + [(60, [0.5, -2.0]), (61, [])]
    df = spark.createDataFrame(rows, SCHEMA)
    held(wh.fit(df).apply(df).collect(), rows)
    twice = spark.createDataFrame([(None, v) for _, v in rows] + [(7, v) for _, v in rows], SCHEMA)
    out = wh.fit(twice).apply(twice)
    assert out.count() == 4 * 2 * len(rows) and out.filter("vec_id is null").count() == 4 * len(rows)


def test_what_cannot_be_whitened(spark):
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)], [(1, [])]):
        df = spark.createDataFrame(rows, SCHEMA)
        assert wh.fit(df).apply(df).count() == 0
    rng = np.random.default_rng(5)
    rows = [(i, [float(a), float(2 * a), 3.0, float(b)]) for i, (a, b) in enumerate(rng.integers(-9, 9, (40, 2)))]
    df = spark.createDataFrame(rows, SCHEMA)
    out = wh.fit(df).apply(df).collect()
    assert {r.component for r in out} == {1, 2} and all(r.identity_error < 1e-9 for r in out)
    with pytest.raises(Exception, match="too large"):
        wh.fit(spark.createDataFrame([(1, [1e30])], SCHEMA))


def test_large_entries_are_summed_exactly(spark):
    rows = [(1, [1e9, 0.0]), (2, [-1e9, 1e7]), (3, [1e9 + 7, -5e8]), (4, [3.0, 1.5e6])]
    df = spark.createDataFrame(rows, SCHEMA)
    held(wh.fit(df).apply(df).collect(), rows)


def test_jacobi_finds_small_eigenvalues():
    rng = np.random.default_rng(6)
    for d in (1, 2, 7, 40):
        b = rng.normal(size=(d, d))
        scale = 10.0 ** -np.linspace(0, 7, d)
        a = (b @ b.T + d * np.eye(d)) * scale[:, None] * scale[None, :]
        e, v = wh.jacobi(a)
        assert np.allclose(v.T @ v, np.eye(d), atol=1e-13)
        # of a matrix graded like this the small ones are the inverse's large ones
        inverse = np.linalg.inv((b @ b.T + d * np.eye(d))) / scale[:, None] / scale[None, :]
        assert abs(1 / e[-1] / np.linalg.eigvalsh(inverse)[-1] - 1) < 1e-9 and abs(e[0] / np.linalg.eigvalsh(a)[-1] - 1) < 1e-12
