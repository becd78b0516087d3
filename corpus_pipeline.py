"""A corpus pipeline of five operators: reject bad documents, drop near copies and repeated strings, mix
the sources, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs; what it wrote besides is then removed. All columns of docs go through every stage but the last, whatever
their names. An empty table stays empty in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.llm import bpe, mixing, near_copies, quality_model, suffix_dedup
from quillrank.llm.queries import table, vocabulary
from quillrank.llm.storage import clean, mark, written


#: Fifty words of four letters and a space: op5's own 400 bytes leave passages of fifty short words alone.
PASSAGE = 250


def reject_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier, fitted on these documents, keeps.

    A null or empty text, or one without words, is rejected; equal rows are kept or rejected together.
    """
    return quality_model.fit(docs).keep(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard 0.8; SimHash, then an exact join) the document of the least id.

    Texts without words, and null ones, are copies of each other. Rows repeated under that id all stay; so do groups
    without any id. A text of fewer than five words is one shingle.
    """
    kept = near_copies.near_copies(docs).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("kept")).distinct()
    names = docs.columns
    rows = docs.select(F.struct(*[F.col("`" + c.replace("`", "``") + "`").alias(f"c{i}") for i, c in enumerate(names)]).alias("row"), F.col("doc_id").cast("long").alias("own"))
    rows = rows.join(kept, F.col("own").eqNullSafe(F.col("kept")), "left_semi")
    return rows.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(names)])


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of strings of PASSAGE bytes that occur again; n_chars is the new length.

    Every copy goes, also from equal rows, and from one document that says a thing twice. A null text comes back empty; a character that a cut leaves incomplete goes
    with it.
    """
    out = suffix_dedup.dedup_text(docs, PASSAGE)
    return out.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in out.columns else out


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, and so that each source comes near its target in words.

    A text without words, or a null one, has size 0 and comes as often as the whole part of its source's rate says; a null source
    is one of its own; rows of one id are told apart.
    """
    return mixing.repeated_rows(docs, mixing.mix_sources(docs, mixing.word_count("text")), mixing.word_count("text"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and whether they decode to the text, for each row; of a null or empty text no ids."""
    return bpe.encode_documents(docs, vocabulary())


STAGES = [
    ("quality_classifier", reject_bad),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("source_mixing", mix),
    ("bpe", encode),
]

#: SQL has neither the fitted classifier nor the rounding; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        since = mark()
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        clean(since, latest=1)  # but for docs
    return STAGES[-1][1](spark, docs, sf_dir)
