"""Mixing, WARC archives and exact top-k."""

from __future__ import annotations

import hashlib
import io
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillrank.llm import mixing, topk, warc

from .test_dedup import WORD


def brute_targets(sizes, most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, target, full = sum(sizes.values()), {}, set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        free = [s for s in order if s not in full]
        for s in free:
            target[s] = left * w[s] / sum(w[x] for x in free)
        over = [s for s in free if target[s] > most * sizes[s] + 1e-9]
        if not over:
            return {s: (most * sizes[s] if s in full else target[s]) for s in order}
        full |= set(over)


def test_mixing(make_docs):
    rows = [(i, "w " * (i % 37), f"s{i % 7}") for i in range(900)] + [(None, "a b", None), (None, "a b", None), (7000, None, "s1"), (5, "w " * 5, "s5"), (8000, "z " * 4000, "big"), (8001, "t", "tiny")]
    docs = make_docs(rows, extra=True)
    mixed = mixing.mix_sources(docs, mixing.word_count("text")).collect()
    assert len(mixed) == len(rows)
    sizes: dict = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    want, taken, largest = brute_targets(sizes), {}, {}
    for r in mixed:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-9)
        assert r.taken == r.copies * r.size <= 3 * r.size and abs(r.copies - r.target / max(1, r.source_size)) < 1 + 1e-9
        taken[r.source] = taken.get(r.source, 0) + r.taken
        largest[r.source] = max(largest.get(r.source, 0), r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] + 1e-6
    again = mixing.mix_sources(docs.repartition(7), mixing.word_count("text")).collect()
    assert sorted(map(str, again)) == sorted(map(str, mixed))
    out = mixing.repeated_rows(docs, mixing.mix_sources(docs, mixing.word_count("text")), mixing.word_count("text"))
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in mixed)
    assert mixing.mix_sources(make_docs([]), mixing.word_count("text")).count() == 0


def test_what_a_large_document_leaves_over_is_settled_with_small_ones(make_docs):
    rows = [(i, "w " * (3000 + 17 * i), "a") for i in range(5)] + [(10 + i, "w " * (1 + i % 40), "a") for i in range(120)] + [(1000 + i, "w " * 50, f"z{i % 4}") for i in range(300)]
    for seed in (1, 2, 3):
        mixed = mixing.mix_sources(make_docs(rows), mixing.word_count("text"), seed=seed).collect()
        for s in {r.source for r in mixed}:
            own = [r for r in mixed if r.source == s]
            assert abs(sum(r.taken for r in own) - own[0].target) <= (2 if s == "a" else 50)
            assert all(abs(r.copies - r.target / r.source_size) < 1 + 1e-9 for r in own)


def test_rows_keep_columns_of_any_name(make_docs):
    docs = make_docs([(1, "a b c", "s"), (1, "a b d", "s"), (2, "a b", None), (None, "x", "s"), (3, None, "s")])
    for c in ("k", "k_id", "k_n", "k_size", "row", "r_id", "a b.c"):
        docs = docs.withColumn(c, F.concat(F.lit(f"{c}:"), F.coalesce("text", F.lit("-"))))
    out = mixing.repeated_rows(docs, mixing.mix_sources(docs, mixing.word_count("text"), most=1), mixing.word_count("text"))
    rows = out.collect()
    assert out.columns == docs.columns and len(rows) == 5 and all(r[c] == f"{c}:{r.text or '-'}" for r in rows for c in ("k", "k_id", "a b.c"))  # an empty text takes its source's whole part, one copy


def test_mixing_is_fair(make_docs):
    """Over seeds, a document's copies average its rate."""
    docs = make_docs([(i, "w " * (3 + i % 5), "ab"[i % 2]) for i in range(40)])
    sums = [0.0] * 40
    seeds = 12
    for seed in range(seeds):
        for r in mixing.mix_sources(docs, mixing.word_count("text"), seed=seed).collect():
            sums[r.doc_id] += r.copies - r.target / r.source_size
    assert abs(np.mean(sums)) / seeds < 0.1 and max(map(abs, sums)) / seeds < 0.9


def test_word_count(make_docs):
    rows = [(1, None), (2, "  a\x0bb\x1cc d\r\n"), (3, "")]
    got = {r.doc_id: r.n for r in make_docs(rows).select("doc_id", mixing.word_count("text").alias("n")).collect()}
    assert got == {1: 0, 2: 2, 3: 0}


PAGES = "page_id bigint, url string, html string"


def test_archives(spark):
    big = "é" * 600
    rows = [(1, "u1", big), (2, "u2", big), (3, None, big), (4, "u4", "small"), (5, "u5", "small"), (6, "u6", None), (None, "u7", big), (7, "u\r\n8", "z" * 200_000), (2, "u2", big)]
    got = warc.archive_round_trip(spark.createDataFrame(rows, PAGES).withColumn("payload", F.lit(1)).withColumn("digest", F.lit("x"))).collect()
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        again = h == big and i != 3
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", 3 if again else None))
    assert sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got) == sorted(map(str, want))
    assert warc.archive_round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_reader_takes_records_in_order_and_refuses_damage():
    a, b = warc.encode_record(1, "http://x", b"one"), warc.encode_record(2, None, b"two" * 40_000)
    found = list(warc.read_records(io.BytesIO(a + b)))
    assert [r.payload for r in found] == [b"one", b"two" * 40_000] and found[0].headers["warc-target-uri"] == "http://x"
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(a + b[:-9])))
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(a + b"rubbish")))
    import gzip

    raw = gzip.decompress(a)
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(gzip.compress(raw.replace(b"one", b"two")))))


def brute_topk(vectors, queries, k):
    out = []
    for q in sorted(set(queries)):
        v = next(x for i, x in vectors if i == q)
        best = sorted((-int(np.dot(v, x)), i) for i, x in vectors if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return out


@pytest.mark.parametrize("block", [4096, 40])
def test_topk(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "QUERIES", 3)
    rng = np.random.default_rng(7)
    rows = [(i, [float(v) for v in rng.integers(-4, 5, 6) / 16]) for i in range(260)] + [(400 + i, [0.25] * 6) for i in range(30)]
    rows += [(300, [0.25, 0.5])]  # as if filled up with zeros
    odd = [(900, None), (None, [0.1] * 6), (901, [None] * 6), (902, [float("nan")] * 6), (903, [float("inf")] * 6), (950, [])]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>").withColumn("block", F.lit(1))
    got = topk.topk(df.select("vec_id", topk.quantised().alias("v")), F.col("vec_id") % 50 == 0).collect()
    ints = [(i, np.floor(256 * np.array(v + [0.0] * (6 - len(v)), np.float32).astype(float)).astype(int)) for i, v in rows]
    want = brute_topk(ints, [i for i, _ in rows if i % 50 == 0], 5)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)
    assert topk.topk(df.filter("false").select("vec_id", topk.quantised().alias("v")), F.lit(True)).count() == 0


def test_the_walk_stops_early():
    rng = np.random.default_rng(3)
    x = rng.integers(-3, 4, (4000, 3))
    x[17] = [200, 200, 200]
    found = topk.threshold_topk(x, np.array([[5, 4, 3]]), 1)[0]
    assert 17 in found and len(found) < 400


def test_a_query_of_zeros_meets_all(spark):
    rows = [(i, [0.0, 0.001] if i in (7, 40) else [i / 16, -i / 16]) for i in range(1, 60)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = topk.topk(df.select("vec_id", topk.quantised().alias("v")), F.col("vec_id") == 7).collect()
    assert sorted((r["rank"], r.vec_id, r.score) for r in got) == [(n + 1, i, 0) for n, i in enumerate((1, 2, 3, 4, 5))]


def test_topk_of_large_components(spark):
    rows = [(50, [1e7, 1.0]), (51, [1e7, 2.0]), (52, [1e7 + 1, -5.0]), (53, [1.4e7, 0.0]), (54, [-1e7, 9.0]), (55, [1e7, 1.0 + 1 / 256]), (56, [1.0, 2.0]), (57, [1e7, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = topk.topk(df.select("vec_id", topk.quantised().alias("v")), F.col("vec_id") == 50).collect()
    ints = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows}
    want = sorted((-sum(a * b for a, b in zip(ints[50], v, strict=True)), i) for i, v in ints.items() if i != 50)[:5]
    assert 1 << 53 < -want[0][0] < 1 << 63
    assert sorted((r["rank"], r.vec_id, r.score) for r in got) == [(n + 1, i, -s) for n, (s, i) in enumerate(want)]


@pytest.mark.parametrize("large, says", [(3e7, "bigint"), (1e300, "too large")])
def test_topk_refuses_scores_that_do_not_fit(spark, large, says):
    df = spark.createDataFrame([(50, [1e7, 1.0]), (51, [large, 0.0])], "vec_id bigint, embedding array<double>")
    with pytest.raises(Exception, match=says):
        topk.topk(df.select("vec_id", topk.quantised().alias("v")), F.col("vec_id") == 50).collect()


def test_topk_of_a_repeated_query(spark):
    rows = [(50, [1.0, 0.0]), (50, [-1.0, 0.0]), (51, [2.0, 0.0]), (52, [-3.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = topk.topk(df.select("vec_id", topk.quantised().alias("v")), F.col("vec_id") == 50).collect()
    assert sorted((r["rank"], r.vec_id, r.score) for r in got) == [(1, 52, 3 * 65536), (2, 51, -2 * 65536)]


def test_own_rows_take_no_place_of_a_repeated_query(spark):
    rows = [(50, [9.0, i / 16]) for i in range(8)] + [(i, [1.0, 0.0]) for i in range(1, 7)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = topk.topk(df.select("vec_id", topk.quantised().alias("v")), F.col("vec_id") == 50).collect()
    assert sorted((r["rank"], r.vec_id) for r in got) == [(i, i) for i in range(1, 6)]


def test_dense_vectors_are_walked_as_fast_as_they_are_multiplied():
    """Five million scores; a walk that looks at each query by itself takes about a hundred times as long."""
    import time

    rng = np.random.default_rng(11)
    x, q = rng.integers(-90, 91, (4096, 64)), rng.integers(-90, 91, (1200, 64))
    topk.threshold_topk(x, q[:10], 5)
    t0 = time.process_time()
    found = topk.threshold_topk(x, q, 5)
    assert time.process_time() - t0 < 4
    scores = q @ x.T
    for i in range(0, 1200, 100):
        assert set(np.flatnonzero(scores[i] >= np.sort(scores[i])[-5])) <= set(found[i].tolist())


def test_topk_sends_blocks_once_for_each_group(spark, monkeypatch):
    # blocks of queries once went to every block of candidates by a broadcast, which the driver gathers
    monkeypatch.setattr(topk, "BLOCK", 8)
    monkeypatch.setattr(topk, "QUERIES", 2)
    monkeypatch.setattr(topk, "FOR_A_CORE", 1)
    rng = np.random.default_rng(12)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").select("vec_id", topk.quantised().alias("v"))
    ints = [(r.vec_id, np.array(r.v)) for r in df.collect()]
    for group in (1, 1 << 9, 1 << 20):
        monkeypatch.setattr(topk, "GROUP", group)
        got = topk.topk(df, F.col("vec_id") % 20 == 0)
        assert "BroadcastExchange" not in got._jdf.queryExecution().executedPlan().toString()
        assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got.orderBy("query_id", "rank").collect()] == brute_topk(ints, range(0, 120, 20), 5)
