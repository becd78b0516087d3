from __future__ import annotations

import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture
def make_docs(spark):
    """A documents table of (doc_id, text[, source]) rows."""

    def make(rows, extra: bool = False):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if extra:  # names that the operators use themselves
            for name in ("rid", "starts", "kept", "fp", "row", "n_words", "score", "k", "size"):
                df = df.withColumn(name, df["lang"])
        return df

    return make


@pytest.fixture
def odd_texts():
    """Nulls, empty texts, long ones, ties and repeated rows."""
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "über", "日本", "x", "it's", "…"]
    passage = " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(120))
    rows = [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (None, "a null id"), (None, None)]
    rows += [(10 + i, " ".join(rng.choice(words) + str(rng.randrange(300)) for _ in range(rng.randrange(20, 160)))) for i in range(12)]
    rows += [(40, passage), (41, "before " + passage), (42, passage + "\nafter"), (43, passage), (43, passage), (44, "x\x0b" + passage[7:] + " tail")]
    rows += [(50, "ab " * 700), (51, "a" * 1500), (52, "ab " * 300 + "end"), (53, "\n".join(["the same line again and again"] * 40))]
    rows += [(60, " ".join(f"w{i % 997}" for i in range(30000)))]
    rows += [(61 + i, f"head{i} " + passage[50:600] + f" foot{i}") for i in range(8)]
    return rows
