from __future__ import annotations

import random

import pytest

import corpus_pipeline


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(9)
    words = "the of and to in is alpha beta gamma delta epsilon zeta eta theta".split()
    text = lambda n: " ".join(rng.choice(words) + (str(rng.randrange(50)) if rng.random() < 0.5 else "") for _ in range(n))
    shared = text(150)
    rows = [(i, text(rng.randrange(40, 120)), f"s{i % 4}") for i in range(120)]
    rows += [(200 + i, rows[i][1], "s0") for i in range(10)]
    rows += [(300 + i, text(60) + " " + shared + " " + text(50), "s1") for i in range(6)]
    rows += [(400 + i, " ".join(w + "$$$" for w in text(60).split()), "s2") for i in range(20)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(a, b, "en", c, len(b)) for a, b, c in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    return path, {a: b for a, b, _ in rows}, shared


def test_every_stage_works_on_what_the_one_before_kept(spark, tables):
    path, texts, shared = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    names = docs.columns
    seen = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, path)
        at = f"{path}/out{i}"
        out.write.parquet(at)
        docs = spark.read.parquet(at)
        seen[name] = docs
        if i + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == names
    kept = {r.doc_id for r in seen["quality_classifier"].collect()}
    assert not any(i in kept for i in range(400, 420)) and len(kept & set(range(120))) > 114
    single = [r.doc_id for r in seen["simhash_near_dedup"].collect()]
    assert len(single) == len(set(single)) and not any(i in single for i in range(200, 210) if i - 200 in kept)
    cut = {r.doc_id: r for r in seen["suffix_array_dedup"].collect()}
    assert set(cut) == set(single) and all(len(cut[i].text) < len(texts[i]) - 700 for i in range(300, 306) if i in cut)
    assert all(r.n_chars == len(r.text) for r in cut.values())
    mixed = [r.doc_id for r in seen["source_mixing"].collect()]
    assert set(mixed) <= set(cut) and max(mixed.count(i) for i in set(mixed)) <= 3
    encoded = seen["bpe"].collect()
    assert sorted(r.doc_id for r in encoded) == sorted(mixed) and all(r.round_trip and r.n_tokens == len(r.ids) for r in encoded)


def test_run(spark, tables):
    out = corpus_pipeline.run(spark, tables[0])
    assert out.columns == ["doc_id", "n_tokens", "ids", "round_trip"] and out.count() > 50
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and corpus_pipeline.ORACLE_SQL is None


def test_every_stage_on_odd_rows(spark, make_docs, odd_texts):
    rows = [r for r in odd_texts if r[0] != 60]
    docs = make_docs(rows)
    for c in ("k", "k_id", "k_n", "kept_id", "kept", "own", "row", "rid", "doc", "a b.c"):
        docs = docs.withColumn(c, docs["lang"])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "").collect()
        if name != "bpe":
            assert stage(spark, docs, "").columns == docs.columns and all(r["k"] == r["a b.c"] == "en" for r in out)
        if name in ("suffix_array_dedup", "bpe"):
            assert len(out) == len(rows)
        texts = {r.doc_id: r.text for r in out} if name != "bpe" else {}
        if name == "quality_classifier":
            assert not {1, 2, 3} & set(texts)
        if name == "simhash_near_dedup":
            assert 40 in texts and not {41, 42, 2, 3} & set(texts) and sum(r.doc_id == 43 for r in out) == 0
        if name == "source_mixing":
            assert len(out) == len(rows)  # one source: each row once


def test_every_stage_on_an_empty_table(spark, make_docs):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, make_docs([]), "").count() == 0
