"""Substring dedup by seed and extend.

Seeds are the winnowed anchors: documents meet where they have one in common. A seed of GRAM words
is extended both ways to the length threshold, in each of the ways a window of WINDOW words can hold
it; equal extensions are the same window, and those found from neighbouring seeds run together into the
maximal repeat. A class of equal runs is extended once, for the least document that has it, so a seed
that thousands of documents share costs one look at each different surrounding. All extensions of a
seed are matched by a grouped minimum, never pair by pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from . import winnow as wn
from .storage import written

WINDOW, GRAM = 50, 16


def _extensions(classes: DataFrame, docs: DataFrame) -> DataFrame:
    """``anchor, digest, i, window, least`` for each way to extend the seed of a class to a window."""
    own = classes.groupBy(F.col("rep.rid").alias("r"), F.col("rep.doc_id").alias("d")).agg(F.collect_list(F.struct("anchor", "digest", "rep.p", "rep.n", "least")).alias("c"))
    rows = docs.join(own, wn.same_row("r", "d")).dropDuplicates(["rid", "doc_id"]).select("text", "c.anchor", "c.digest", "c.p", "c.n", "c.least")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = tx.flat(batch.column(0))
            for k in range(batch.num_rows):
                h, _ = wn.word_tokens(buf[offsets[k] : offsets[k + 1]], np.array([0, offsets[k + 1] - offsets[k]]))
                window = tx.rolled(h, WINDOW).view(np.int64)
                anchor, digest, p, n, least = (batch.column(c)[k].values for c in range(1, 6))
                p, n = p.to_numpy().astype(np.int64), n.to_numpy().astype(np.int64)
                which = np.repeat(np.arange(len(n)), n)
                i = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                at = pa.array(which)
                yield pa.RecordBatch.from_arrays([anchor.take(at), digest.take(at), pa.array(i.astype(np.int32)), pa.array(window[p[which] + i]), least.take(at)], ["anchor", "digest", "i", "window", "least"])

    return rows.mapInArrow(extend, "anchor bigint, digest bigint, i int, window bigint, least bigint")


def repeated_windows(docs: DataFrame) -> DataFrame:
    """``rid, doc_id, starts, counts``: the windows of ``keyed`` docs that also start in a document of a smaller id."""
    found = wn.repeated_runs(docs, wn.word_tokens, WINDOW, GRAM, "substring")
    classes = found.groupBy("anchor", "digest").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "rid", "p", "n")).alias("rep"))
    classes = written(classes, "substring-classes")
    many = classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select(F.col("anchor").alias("x"))
    apart = classes.join(many, F.col("anchor") == F.col("x"), "left_semi")
    extended = written(_extensions(apart, docs), "substring-extensions")
    first = extended.groupBy("anchor", "window").agg(F.min("least").alias("earliest"), F.max("least").alias("latest")).filter("earliest < latest")
    first = written(first, "substring-windows")  # read back, as the next two are: a join of two exchanges can split a hot key
    early = extended.join(first.select(F.col("anchor").alias("x"), F.col("window").alias("y"), "earliest"), (F.col("anchor") == F.col("x")) & (F.col("window") == F.col("y")))
    early = written(early.filter("earliest < least").select("anchor", "digest", "i"), "substring-early").groupBy("anchor", "digest").agg(F.sort_array(F.collect_set("i")).alias("early"))
    marks = classes.join(early.withColumnsRenamed({"anchor": "x", "digest": "y"}), (F.col("anchor") == F.col("x")) & (F.col("digest") == F.col("y")), "left")
    marks = written(marks.select(F.col("anchor").alias("x"), F.col("digest").alias("y"), "least", "early"), "substring-marks")
    out = found.join(marks, (F.col("anchor") == F.col("x")) & (F.col("digest") == F.col("y")))
    out = out.filter(F.col("doc_id").isNotNull() & ((F.col("doc_id") > F.col("least")) | F.col("early").isNotNull()))
    # a later document has the whole run from the class's first; the first itself what an earlier class has
    later = F.col("doc_id") > F.col("least")
    starts = F.when(later, F.array("p")).otherwise(F.transform("early", lambda i: F.col("p") + i))
    return out.select("rid", "doc_id", starts.alias("starts"), F.when(later, F.array("n")).otherwise(F.transform("early", lambda i: F.lit(1))).alias("counts"))


def _kept(text: bytes, starts: list[int] | None, counts: list[int] | None) -> tuple[int, int, list[bytes]]:
    words = text.split()  # of bytes: at exactly the six separators
    gone = wn.covered_by(len(words), starts, counts, WINDOW)
    if gone is None:
        return len(words), 0, words
    return len(words), int(gone.sum()), [words[i] for i in np.flatnonzero(~gone).tolist()]


def dedup(docs: DataFrame, digest: bool = False) -> DataFrame:
    """For each row of docs ``doc_id, n_words, n_removed, kept`` (the kept words, joined by a space).

    ``digest``: kept_sha256 in place of kept. A text of fewer than WINDOW words keeps all; a null or
    empty one has none. A row without id takes nothing from others and gives them nothing; rows of one id
    take nothing from each other. Columns besides doc_id and text are not read.
    """
    own = wn.keyed(docs)
    rows = wn.with_spans(own, repeated_windows(own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, kept = [], [], []
            texts = batch.column(1).cast(pa.large_binary())
            for text, starts, counts in zip(texts, batch.column(2), batch.column(3), strict=True):
                a, b, words = _kept(text.as_py() or b"", starts.as_py(), counts.as_py())
                joined = b" ".join(words)
                n.append(a)
                gone.append(b)
                kept.append(hashlib.sha256(joined).hexdigest() if digest else joined.decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256" if digest else "kept"])

    return rows.mapInArrow(run, f"doc_id bigint, n_words bigint, n_removed bigint, {'kept_sha256' if digest else 'kept'} string")
