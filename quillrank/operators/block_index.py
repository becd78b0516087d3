"""A written inverted index with the best weight of each block, and exact BM25 top-k that leaves out what cannot win.

Documents lie in blocks by length and by where they were read, so a common token's postings are spread over many tasks, and documents of one
block get like weights for like counts. A query is answered in three steps. Its rarest tokens give k documents with a part of
their scores: the least of these is a floor that the k-th score cannot fall below. Tokens whose best weights together stay
below the floor cannot lift a document into the first k by themselves, so only documents with one of the other tokens are
candidates, and of these only those in blocks, and with bounds, that reach the floor. Last, the survivors alone meet the
postings of the common tokens.

Defined results: a document without tokens has no posting and is no candidate, but counts in the corpus totals as in
``retrieval.build_index``; documents under one id are one document; a document of null id is found like another where its
postings suffice, and gets no lookups of common tokens, since null joins nothing: give ids. Ties at the k-th score are all
kept, within 1e-6.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import retrieval

#: Documents of a part of the input, of which each class of lengths is a block, about.
BLOCK_DOCS = 65_536
#: Postings of a query's rarest tokens that are enough for its floor.
SEED_POSTINGS = 5_000
#: Query tokens that are broadcast; more are shuffled.
MOST_BROADCAST = 200_000
SLACK = 1e-6


@dataclass(frozen=True)
class BlockIndex:
    spark: SparkSession
    path: str
    docs: int
    average: float
    model: retrieval.Bm25

    def postings(self, *more: str) -> DataFrame:
        """token, block, doc_id, weight: the score of a posting but for its token's idf."""
        rows = self.spark.read.parquet(f"{self.path}/postings")
        return rows.select("token", "block", "doc_id", *more, self.model.weight("tf", "len", F.lit(max(1.0, self.average))).alias("weight"))

    def bounds(self) -> DataFrame:
        """token, block, df, best: how many documents of a block have a token, and the best of their weights."""
        return self.spark.read.parquet(f"{self.path}/bounds")


def _counted(rows: DataFrame) -> DataFrame:
    """``doc_id, tokens, copies`` as postings ``token, doc_id, copies, tf, len, klass, deal``, counted where the row lies: nothing is shuffled.

    klass: of lengths; deal: the partition of the input that the document came from.
    """
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = batch.column("tokens")
            size = pc.fill_null(pc.list_value_length(t), 0).to_numpy().astype(np.int64)
            words = pc.dictionary_encode(t.flatten())
            doc = np.repeat(np.arange(len(size)), size)
            pairs, tf = np.unique(doc * max(len(words.dictionary), 1) + words.indices.to_numpy().astype(np.int64), return_counts=True)
            at = pa.array(pairs // max(len(words.dictionary), 1))
            own = size[at.to_numpy()]
            klass = np.floor(2 * np.log2(own)).astype(np.int32)
            token = words.dictionary.take(pa.array(pairs % max(len(words.dictionary), 1)))
            cols = [token, batch.column("doc_id").take(at), batch.column("copies").take(at), pa.array(tf.astype(np.int64)), pa.array(own.astype(np.int32)), pa.array(klass), batch.column("deal").take(at)]
            yield pa.RecordBatch.from_arrays(cols, ["token", "doc_id", "copies", "tf", "len", "klass", "deal"])

    dealt = rows.select("doc_id", "tokens", "copies", F.spark_partition_id().alias("deal"))
    return dealt.mapInArrow(run, f"token string, doc_id {kind}, copies bigint, tf bigint, len int, klass int, deal int")


def write(docs: DataFrame, doc_id: str, tokens: Column, path: str, model: retrieval.Bm25 = retrieval.Bm25(), block_docs: int = BLOCK_DOCS, same: Column | None = None) -> BlockIndex:
    """Write the index of documents to a folder that the cluster shares; the place must be free.

    Postings are counted in each row and stay where it lies, so neither is a token hot nor are postings shuffled; only rows
    whose id is there more than once are brought together first. Files are sorted by token, so that row groups without a
    query's tokens are skipped. Blocks follow the partitions that documents were read in, so few bounds leave a partition. Bounds are
    aggregated from the written postings.

    ``same``: documents where it is equal and not null have equal tokens, and are found by the least id; each counts in the statistics.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), tokens.alias("tokens"), F.lit(1).cast("long").alias("copies"), *([same.alias("same")] if same is not None else []))
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("tokens")).alias("avg_len")).first()
    ids = docs.select(F.col(doc_id).alias("again")).groupBy("again").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("again")
    if same is not None:
        if not ids.isEmpty():
            raise ValueError("documents told apart by their text need ids of their own")
        least = docs.select(F.col(doc_id).alias("doc_id"), same.alias("same")).groupBy("same").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("k")).filter("same is not null").select("least", "k")
        rows = rows.drop("copies").join(least, F.col("doc_id") == F.col("least"), "left").filter("least is not null or same is null").select("doc_id", "tokens", F.coalesce("k", F.lit(1).cast("long")).alias("copies"))
    elif not ids.isEmpty():
        both = rows.join(ids, F.col("doc_id").eqNullSafe(F.col("again")), "left_semi").groupBy("doc_id").agg(F.flatten(F.collect_list("tokens")).alias("tokens"), F.first("copies").alias("copies"))
        rows = rows.join(ids, F.col("doc_id").eqNullSafe(F.col("again")), "left_anti").unionByName(both)
    parts = max(1, -(-total["n"] // block_docs))
    postings = _counted(rows).withColumn("block", F.col("klass") * parts + F.pmod("deal", F.lit(parts)).cast("int"))
    postings.select("token", "block", "doc_id", "tf", "len", "copies").sortWithinPartitions("token", "block").write.mode("errorifexists").parquet(f"{path}/postings")
    own = BlockIndex(docs.sparkSession, path, total["n"], total["avg_len"] or 0.0, model)
    best = own.postings("copies").groupBy("token", "block").agg(F.sum("copies").alias("df"), F.max("weight").alias("best"))
    best.sortWithinPartitions("token").write.mode("errorifexists").parquet(f"{path}/bounds")
    return own


def _kept(rows: DataFrame, path: str) -> DataFrame:
    """Rows by way of a written table: lineage ends here, and a lost executor costs its running tasks."""
    rows.write.mode("errorifexists").parquet(path)
    return rows.sparkSession.read.parquet(path)


def _asked(index: BlockIndex, queries: DataFrame) -> DataFrame:
    """query_id, token, size, idf, best, df, seed: tokens of the queries that the corpus has, the rarest marked as seeds."""
    tokens = index.bounds().groupBy("token").agg(F.sum("df").alias("df"), F.max("best").alias("best"))
    known = queries.join(tokens, "token").withColumn("idf", index.model.idf(F.lit(index.docs), F.col("df")))
    rarest = Window.partitionBy("query_id").orderBy("df", "token")
    before = F.sum("df").over(rarest.rowsBetween(Window.unboundedPreceding, -1))
    return known.withColumn("best", F.col("idf") * F.col("best")).withColumn("seed", F.coalesce(before, F.lit(0)) < SEED_POSTINGS)


def _floors(index: BlockIndex, asked: DataFrame, small: bool, k: int) -> DataFrame:
    """query_id, floor: the k-th best sum over seeds, which the k-th best score is not below; 0 where seeds reach fewer documents."""
    seeds = asked.filter("seed").select("query_id", "token", "idf")
    met = index.postings().join(F.broadcast(seeds) if small else seeds, "token")
    return _kth(met.groupBy("query_id", "doc_id").agg(F.sum(F.col("idf") * F.col("weight")).alias("part")), k)


def _kth(part: DataFrame, k: int) -> DataFrame:
    """query_id, floor: the k-th best part of each query, 0 where it has fewer. Spark keeps k rows a task before the shuffle."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("part")))
    return part.withColumn("place", place).filter(F.col("place") <= k).groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("part")).otherwise(0.0).alias("floor"))


def top(index: BlockIndex, queries: DataFrame, k: int, scratch: str) -> DataFrame:
    """query_id, doc_id, size, lexical of every document that may be among a query's first k, whole scores.

    ``queries`` is ``retrieval.query_tokens``; three tables of query tokens and candidates are written under ``scratch``,
    which must be free. Documents left out have scores below the k-th: rank the rows with ``retrieval.ranked``.
    """
    if k < 1:
        raise ValueError("k is positive")
    asked = _kept(_asked(index, queries), f"{scratch}/asked")
    small = asked.count() <= MOST_BROADCAST
    hint = F.broadcast if small else (lambda df: df)

    def postings(tokens: DataFrame) -> DataFrame:
        """Those of the tokens asked for: others do not leave the scan."""
        return index.postings().join(F.broadcast(tokens.select("token").distinct()), "token", "left_semi") if small else index.postings()

    floors = _floors(index, asked, small, k)
    # A token is common to its query if it and all tokens of lesser best weights stay below the floor together.
    rising = Window.partitionBy("query_id").orderBy("best", "token").rowsBetween(Window.unboundedPreceding, 0)
    told = asked.join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)) - SLACK)
    told = _kept(told.withColumn("common", F.sum("best").over(rising) < F.col("floor")).drop("best", "seed"), f"{scratch}/told")

    # Block by block: what a query can reach in a block at all, and what its common tokens can add there.
    held = index.bounds().join(hint(told), "token").withColumn("reach", F.col("idf") * F.col("best"))
    blocks = held.groupBy("query_id", "block").agg(F.sum("reach").alias("reach"), F.sum(F.when(F.col("common"), F.col("reach")).otherwise(0.0)).alias("more"), F.first("floor").alias("floor"))
    blocks = blocks.filter(F.col("reach") >= F.col("floor"))
    rare = told.filter(~F.col("common"))
    lists = index.bounds().select("token", "block").join(hint(rare.select("query_id", "token", "idf", "size")), "token").join(blocks, ["query_id", "block"])
    met = postings(rare).join(lists, ["token", "block"])
    part = met.groupBy("query_id", "doc_id").agg(F.first("block").alias("block"), F.first("size").alias("size"), F.sum(F.col("idf") * F.col("weight")).alias("part"), F.first("more").alias("more"), F.first("floor").alias("floor"))
    alive = _kept(part.filter(F.col("part") + F.col("more") >= F.col("floor")).drop("floor"), f"{scratch}/alive")
    # Parts over all rare tokens give a higher floor than the seeds did.
    alive = alive.join(hint(_kth(alive, k)), "query_id").filter(F.col("part") + F.col("more") >= F.col("floor") - SLACK).drop("more", "floor")

    rest = alive.select("query_id", "doc_id", "block").join(hint(told.filter("common").select("query_id", "token", "idf")), "query_id")
    added = postings(told.filter("common")).join(rest, ["token", "block", "doc_id"]).select("query_id", "doc_id", (F.col("idf") * F.col("weight")).alias("part"))
    both = alive.select("query_id", "doc_id", "part", "size").unionByName(added.withColumn("size", F.lit(None).cast("int")))
    return both.groupBy("query_id", "doc_id").agg(F.max("size").alias("size"), F.sum("part").alias("lexical"))
