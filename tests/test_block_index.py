"""The written index against plain BM25 over all postings."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quillrank.functions import text as tx
from quillrank.operators import block_index, retrieval


def _tables(spark, n=400):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    docs = [(i, " ".join(rnd.choices(words, weights, k=rnd.randint(1, 120)))) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, docs[0][1]), (n + 3, docs[0][1]), (n + 4, "w0 " * 5000)]
    queries = [(i, " ".join(rnd.choices(words, weights, k=rnd.randint(2, 12)))) for i in range(25)] + [(90, "unheard"), (91, ""), (92, None), (93, docs[0][1])]
    return spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(queries, "q int, text string")


def _best(rows, k):
    return {tuple(r) for r in retrieval.ranked(rows.withColumnRenamed("lexical", "score"), ["query_id"], "score", ["doc_id"], k).select("query_id", "doc_id", "size", "score", "rank").collect()}


@pytest.mark.parametrize("k", [1, 10, 60])
@pytest.mark.parametrize("broadcasts", [True, False])
def test_same_first_k_as_over_all_postings(spark, tmp_path, monkeypatch, k, broadcasts):
    monkeypatch.setattr(block_index, "SEED_POSTINGS", 40)
    if not broadcasts:
        monkeypatch.setattr(block_index, "MOST_BROADCAST", 0)
    docs, queries = _tables(spark)
    asked = retrieval.query_tokens(queries, "q", tx.pair_tokens("text"))
    plain = retrieval.bm25(retrieval.build_index(docs, "doc_id", tx.pair_tokens("text")), asked)
    index = block_index.write(docs, "doc_id", tx.pair_tokens("text"), f"{tmp_path}/index", block_docs=64)
    got = block_index.top(index, asked, k, f"{tmp_path}/scratch")
    assert _best(got, k) == _best(plain, k)
    assert got.count() < plain.count()


def test_bounds_are_those_of_the_postings_and_a_hot_token_has_many_blocks(spark, tmp_path):
    docs, _ = _tables(spark)
    index = block_index.write(docs, "doc_id", tx.pair_tokens("text"), f"{tmp_path}/index", block_docs=64)
    again = index.postings().groupBy("token", "block").agg(F.max("weight").alias("m"), F.count("*").alias("n"))
    assert index.bounds().join(again, ["token", "block"]).filter("best = m and df = n").count() == index.bounds().count() == again.count()
    assert index.bounds().filter("token = 'w0'").count() > 20


def test_no_documents_and_no_queries(spark, tmp_path):
    docs, queries = _tables(spark, 20)
    asked = retrieval.query_tokens(queries, "q", tx.pair_tokens("text"))
    none = block_index.write(docs.limit(0), "doc_id", tx.pair_tokens("text"), f"{tmp_path}/none")
    assert block_index.top(none, asked, 5, f"{tmp_path}/a").count() == 0
    some = block_index.write(docs, "doc_id", tx.pair_tokens("text"), f"{tmp_path}/some")
    assert block_index.top(some, asked.limit(0), 5, f"{tmp_path}/b").count() == 0
    with pytest.raises(ValueError):
        block_index.top(some, asked, 0, f"{tmp_path}/c")


def test_the_best_of_distinct_texts_with_the_statistics_of_all(spark, tmp_path):
    docs, queries = _tables(spark)
    docs = docs.union(docs.filter("doc_id % 3 = 0").select((F.col("doc_id") + 1000).cast("int"), "text"))
    asked = retrieval.query_tokens(queries, "q", tx.pair_tokens("text"))
    plain = retrieval.bm25(retrieval.build_index(docs, "doc_id", tx.pair_tokens("text")), asked).withColumnRenamed("lexical", "score")
    want = retrieval.distinct_source_top(plain.join(docs.select("doc_id", F.sha2("text", 256).alias("source_hash")), "doc_id"), 5)
    index = block_index.write(docs, "doc_id", tx.pair_tokens("text"), f"{tmp_path}/index", retrieval.Bm25(), 64, F.sha2("text", 256))
    got = retrieval.ranked(block_index.top(index, asked, 5, f"{tmp_path}/scratch").withColumnRenamed("lexical", "score"), ["query_id"], "score", ["doc_id"], 5)
    names = ["query_id", "doc_id", "score", "rank"]
    assert {tuple(r) for r in got.select(*names).collect()} == {tuple(r) for r in want.select(*names).collect()}


def test_rows_of_one_id_are_one_document_and_postings_are_not_shuffled(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c"), (1, "a d"), (3, None)], "doc_id int, text string")
    index = block_index.write(docs, "doc_id", tx.pair_tokens("text"), f"{tmp_path}/index")
    got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/index/postings").select("doc_id", "token", "tf").collect()}
    assert got == {(1, "a", 3), (1, "b", 1), (1, "d", 1), (2, "b", 1), (2, "c", 1)} and index.docs == 4
    rows = docs.filter("doc_id > 1").select("doc_id", tx.pair_tokens("text").alias("tokens"), F.lit(1).cast("long").alias("copies"))
    assert "Exchange" not in block_index._counted(rows)._jdf.queryExecution().executedPlan().toString()
