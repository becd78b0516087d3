"""Exact BM25 top-k of a set of queries by scans: documents are scored where they lie, and only what may be among the first k leaves a task.

Texts are cut into tokens once. What a document has of the queries' tokens is written as numbers; their frequencies and the corpus
totals are small aggregates of that table. A second scan scores a block of documents against all queries as sums over its
postings and keeps, of each query, the scores that reach the k-th of the block and of the task's blocks before. So what is shuffled grows with
tasks, queries and k and not with the postings that queries and documents have in common.

This is for a stated set of queries, of at most MOST_TOKENS tokens; more go by :mod:`block_index`.

Defined results as in :mod:`block_index`: a document without tokens is no candidate, but counts in the totals; documents under
one id are one document. Of documents of one score the k least ids are kept, or all where ids are no whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..llm.storage import bounded_batches
from . import block_index, retrieval

#: Query tokens that every task holds.
MOST_TOKENS = block_index.MOST_BROADCAST
#: Scores of a block: documents times queries.
CELLS = 1 << 22
SLACK = block_index.SLACK


def _numbered(rows: DataFrame, tokens: pa.Array) -> DataFrame:
    """``doc_id, tokens[, same]`` as ``doc_id, len, at, tf[, same]``: which of ``tokens`` a row has, by number, and how often. Nothing is shuffled."""
    more = [(c, t) for c, t in rows.dtypes if c not in ("doc_id", "tokens")]
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("tokens")
            size = pc.list_value_length(own)
            whole = pc.fill_null(size, 0).to_numpy().astype(np.int64)
            at = pc.index_in(own.flatten(), value_set=tokens)
            there = pc.is_valid(at).to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(len(whole)), whole)[there]
            pairs, tf = np.unique(doc * len(tokens) + at.drop_null().to_numpy().astype(np.int64), return_counts=True)
            ends = pa.array(np.searchsorted(pairs, np.arange(len(whole) + 1) * len(tokens)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(v.astype(np.int32))) for v in (pairs % max(len(tokens), 1), tf)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size.cast(pa.int64()), *lists, *[batch.column(c) for c, _ in more]], ["doc_id", "len", "at", "tf", *[c for c, _ in more]])

    return rows.mapInArrow(run, ", ".join([f"doc_id {kind}, len bigint, at array<int>, tf array<int>", *[f"{c} {t}" for c, t in more]]))


def _merged(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows under one of ``ids`` (again) as one document each."""
    both = rows.join(ids, F.col("doc_id").eqNullSafe(F.col("again")), "left_semi").groupBy("doc_id").agg(F.sum("len").alias("len"), F.flatten(F.collect_list("at")).alias("at"), F.flatten(F.collect_list("tf")).alias("tf"))
    return rows.join(ids, F.col("doc_id").eqNullSafe(F.col("again")), "left_anti").unionByName(both)


def _first(score: np.ndarray, k: int, floor: np.ndarray, ids: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Places (document, query) of the scores that may be among the first k; ``floor``, that no k-th score of the task is below, is raised."""
    if len(score) >= k:
        np.maximum(floor, np.partition(score, len(score) - k, axis=0)[len(score) - k], out=floor)
    d, q = np.nonzero((score > 0) & (score >= floor - SLACK))
    if ids is None or not len(d):
        return d, q
    # of equal scores, as copies have, the least ids
    order = np.lexsort((ids[d], -score[d, q], q))
    d, q = d[order], q[order]
    new = np.r_[True, (q[1:] != q[:-1]) | (score[d, q][1:] != score[d, q][:-1])]
    place = np.arange(len(d)) - np.maximum.accumulate(np.where(new, np.arange(len(d)), 0))
    return d[place < k], q[place < k]


def _scored(rows: DataFrame, k: int, names: pa.Array, sizes: np.ndarray, token: np.ndarray, query: np.ndarray, idf: np.ndarray, average: float, model: retrieval.Bm25, kind: str) -> DataFrame:
    """query_id, doc_id, size, lexical[, same] of what may be among the first k; ``token`` (in order) and ``query`` say which queries have a token."""
    doc_kind, same = rows.schema["doc_id"].dataType.simpleString(), [(c, t) for c, t in rows.dtypes if c == "same"]
    begin = np.searchsorted(token, np.arange(len(idf) + 1))
    at_once = max(1, CELLS // max(len(names), 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor = np.zeros(len(names))
        for whole in batches:
            for lo in range(0, whole.num_rows, at_once):
                batch = whole.slice(lo, at_once)
                if same:  # one text, one document: that of the least id
                    texts = batch.column("same")
                    order = np.lexsort((batch.column("doc_id").to_numpy(), pc.dictionary_encode(texts).indices.fill_null(-1).to_numpy()))
                    alike = pc.dictionary_encode(texts).indices.fill_null(-1).to_numpy()[order]
                    batch = batch.take(pa.array(np.sort(order[np.r_[True, alike[1:] != alike[:-1]] | (alike < 0)])))
                lists, tfs = batch.column("at"), batch.column("tf").flatten().to_numpy().astype(float)
                doc = np.repeat(np.arange(len(batch)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
                at = lists.flatten().to_numpy().astype(np.int64)
                if not len(at):
                    continue
                pairs, of = np.unique(doc * len(idf) + at, return_inverse=True)  # rows under one id have a token twice
                tfs, doc, at = np.bincount(of, tfs), pairs // len(idf), pairs % len(idf)
                length = pc.fill_null(batch.column("len"), 0).to_numpy().astype(float)[doc]
                weight = idf[at] * (tfs * (model.k1 + 1) / (tfs + model.k1 * (1 - model.b + model.b * length / average)))
                n = begin[at + 1] - begin[at]
                first = np.repeat(np.cumsum(n) - n, n)
                q = query[np.repeat(begin[at], n) + np.arange(n.sum()) - first]
                cell = np.repeat(doc, n) * len(names) + q
                score = np.bincount(cell, np.repeat(weight, n), minlength=len(batch) * len(names)).reshape(len(batch), -1)
                ids = batch.column("doc_id")
                d, q = _first(score, k, floor, ids.cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy() if pa.types.is_integer(ids.type) else None)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(q)), ids.take(pa.array(d)), pa.array(sizes[q]), pa.array(score[d, q]), *[batch.column(c).take(pa.array(d)) for c, _ in same]], ["query_id", "doc_id", "size", "lexical", *[c for c, _ in same]])

    return rows.mapInArrow(run, ", ".join([f"query_id {kind}, doc_id {doc_kind}, size int, lexical double", *[f"{c} {t}" for c, t in same]]))


def top(docs: DataFrame, doc_id: str, tokens: Column, queries: DataFrame, k: int, path: str, model: retrieval.Bm25 = retrieval.Bm25(), same: Column | None = None) -> DataFrame:
    """query_id, doc_id, size, lexical of every document that may be among a query's first k (A1-A5, J3); rank the rows with :func:`retrieval.ranked`.

    ``queries`` is ``retrieval.query_tokens``; what documents have of their tokens is written under ``path``, which must be free. ``same``, a
    string: documents where it is equal have equal tokens and are one, found by the least id; it comes along, for
    :func:`retrieval.distinct_source_top`. Ids are whole numbers then, and none is there twice.
    """
    if k < 1:
        raise ValueError("k is positive")
    if queries.count() > MOST_TOKENS:
        out = block_index.top(block_index.write(docs, doc_id, tokens, f"{path}/index", model, same=same), queries, k, f"{path}/scratch")
        return out if same is None else out.withColumn("same", F.col("doc_id").cast("string"))
    asked = queries.toArrow()
    column = {c: pa.concat_arrays(asked[c].chunks) if asked[c].num_chunks else pa.array([], asked[c].type) for c in asked.column_names}
    known, names = column["token"].unique(), column["query_id"].unique()
    token, query = (pc.index_in(column[c], value_set=v).to_numpy().astype(np.int64) for c, v in (("token", known), ("query_id", names)))
    order = np.lexsort((query, token))
    sizes = np.zeros(len(names), np.int32)
    sizes[query] = column["size"].to_numpy()

    own = bounded_batches(docs).select(F.col(doc_id).alias("doc_id"), tokens.alias("tokens"), *([same.alias("same")] if same is not None else []))
    _numbered(own, known).write.mode("errorifexists").parquet(f"{path}/numbered")
    rows = docs.sparkSession.read.parquet(f"{path}/numbered")
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("average")).first()
    ids = rows.select(F.col("doc_id").alias("again")).groupBy("again").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("again")
    if not ids.isEmpty():
        if same is not None:
            raise ValueError("documents told apart by their text need ids of their own")
        rows = _merged(rows, ids)
    found = rows.select(F.explode(F.array_distinct("at")).alias("at")).groupBy("at").agg(F.count(F.lit(1)).alias("df")).toArrow()
    df = np.zeros(len(known))
    df[found["at"].to_numpy()] = found["df"].to_numpy()
    idf = np.log(1 + (total.n - df + 0.5) / (df + 0.5))
    return _scored(rows, k, names, sizes, token[order], query[order], idf, max(1.0, total.average or 0.0), model, queries.schema["query_id"].dataType.simpleString())
