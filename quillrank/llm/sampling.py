"""Bounded samples of labelled rows, to fit models on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import bounded_batches


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, where: Column | None = None) -> DataFrame:
    """``doc_id, text, label`` of at most ``most`` labelled documents, those of the least hash of their id.

    Null ids and labels take no part, and an id labelled twice takes its smaller label. Only the
    sample's ids are broadcast: ``most`` rows of two numbers.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("label")).dropna()
    own = own.groupBy("id").agg(F.min("label").alias("label"))
    if where is not None:
        own = own.filter(where)
    own = own.orderBy(F.xxhash64("id"), "id").limit(most)
    text = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return text.join(F.broadcast(own), F.col("doc_id") == F.col("id")).select("doc_id", "text", "label")
