"""Top documents by scans against plain BM25 over all postings, and what they shuffle and write."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quillrank.functions import text as tx
from quillrank.operators import retrieval, scan_topk
from quillrank.plans import catalogue


def _tables(spark, n=400):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    docs = [(i, " ".join(rnd.choices(words, weights, k=rnd.randint(1, 120)))) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 4, "w0 " * 5000)] + [(n + 10 + i, docs[0][1]) for i in range(40)]
    queries = [(i, " ".join(rnd.choices(words, weights, k=rnd.randint(2, 12)))) for i in range(25)] + [(90, "unheard"), (91, ""), (92, None), (93, docs[0][1])]
    return spark.createDataFrame(docs, "doc_id int, text string").repartition(5), spark.createDataFrame(queries, "q int, text string")


def _best(rows, k):
    return {tuple(r) for r in retrieval.ranked(rows.withColumnRenamed("lexical", "score"), ["query_id"], "score", ["doc_id"], k).select("query_id", "doc_id", "size", "score", "rank").collect()}


@pytest.mark.parametrize("k", [1, 10, 60])
@pytest.mark.parametrize("again", [False, True])
def test_same_first_k_as_over_all_postings(spark, tmp_path, monkeypatch, k, again):
    monkeypatch.setattr(scan_topk, "CELLS", 29 * 70)
    docs, queries = _tables(spark)
    asked = retrieval.query_tokens(queries, "q", tx.pair_tokens("text"))
    plain = retrieval.bm25(retrieval.build_index(docs, "doc_id", tx.pair_tokens("text")), asked)
    if again:  # a row under an id that is there: one document of both
        more = spark.createDataFrame([(7, "w3 w4 w4"), (7, None)], "doc_id int, text string")
        docs, text = docs.union(more), docs.filter("doc_id = 7").first().text
        one = docs.filter("doc_id <> 7").union(spark.createDataFrame([(7, f"{text} w3 w4 w4")], "doc_id int, text string"))
        index = retrieval.build_index(one, "doc_id", tx.pair_tokens("text"))
        plain = retrieval.bm25(retrieval.Index(index.postings, index.frequencies, docs.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size(tx.pair_tokens("text"))).alias("avg_len"))), asked)
    got = scan_topk.top(docs, "doc_id", tx.pair_tokens("text"), asked, k, f"{tmp_path}/scratch")
    assert _best(got, k) == _best(plain, k)
    assert got.count() < plain.count()


def test_copies_of_the_best_text_leave_a_task_k_times(spark, tmp_path):
    docs = spark.createDataFrame([(i, "rare one") for i in range(3000)] + [(5000, "other")], "doc_id int, text string").coalesce(2)
    asked = retrieval.query_tokens(spark.createDataFrame([(1, "rare")], "q int, text string"), "q", tx.pair_tokens("text"))
    got = scan_topk.top(docs, "doc_id", tx.pair_tokens("text"), asked, 3, f"{tmp_path}/a")
    assert got.count() <= 3 * 2 * 2 and [r.doc_id for r in retrieval.ranked(got.withColumnRenamed("lexical", "score"), ["query_id"], "score", ["doc_id"], 3).orderBy("rank").collect()] == [0, 1, 2]


def test_more_queries_than_tasks_hold_go_by_the_index(spark, tmp_path, monkeypatch):
    docs, queries = _tables(spark)
    asked = retrieval.query_tokens(queries, "q", tx.pair_tokens("text"))
    one = _best(scan_topk.top(docs, "doc_id", tx.pair_tokens("text"), asked, 10, f"{tmp_path}/a"), 10)
    monkeypatch.setattr(scan_topk, "MOST_TOKENS", 3)
    assert _best(scan_topk.top(docs, "doc_id", tx.pair_tokens("text"), asked, 10, f"{tmp_path}/b"), 10) == one


def test_distinct_texts(spark, tmp_path):
    docs, queries = _tables(spark)
    asked = retrieval.query_tokens(queries, "q", tx.pair_tokens("text"))
    hashes = docs.select("doc_id", F.sha2("text", 256).alias("source_hash"))
    want = retrieval.shortlist_pairs(retrieval.build_index(docs, "doc_id", tx.pair_tokens("text")), asked, hashes=hashes)
    got = scan_topk.top(docs, "doc_id", tx.pair_tokens("text"), asked, 5, f"{tmp_path}/a", same=F.sha2("text", 256))
    got = retrieval.distinct_source_top(got.select("query_id", "doc_id", F.col("same").alias("source_hash"), F.col("lexical").alias("score")), 5)
    assert {tuple(r) for r in got.select("query_id", "doc_id", "score", "rank").collect()} == {tuple(r) for r in want.select("query_id", "doc_id", "score", "rank").collect()}


def _moved(spark) -> int:
    """Bytes shuffled, spilled and written so far."""
    none = spark._jvm.java.util.ArrayList()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(none, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), none).iterator()
    total = 0
    while stages.hasNext():
        stage = stages.next()
        total += stage.shuffleWriteBytes() + stage.diskBytesSpilled() + stage.outputBytes()
    return total


@pytest.mark.parametrize("name", ["bm25_query_normalised", "match_two_stage", "features_pair"])
def test_texts_and_postings_are_not_moved(spark, tmp_path, name):
    rnd = random.Random(3)
    words = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(4000)]
    docs = [(i, " ".join(rnd.choices(words, k=900)), "en", "s", 6300) for i in range(1200)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, " ".join(rnd.choices(words, k=20))) for i in range(20)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    before = _moved(spark)
    assert catalogue.queries()[name](spark, str(tmp_path)).count() > 0
    assert _moved(spark) - before < 0.3 * sum(len(r[1]) for r in docs)
