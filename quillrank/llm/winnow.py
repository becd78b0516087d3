"""Winnowed anchors: where equal windows of a corpus can lie.

Every window of W tokens (words or bytes) holds W - k + 1 grams of k tokens, and the least of their
hashes is its anchor: equal windows have equal anchors, wherever they are. Consecutive windows of a
text mostly share theirs, so a text becomes a few *runs* of windows, about 2 / (W - k + 2) for
each token: (anchor, where it begins, how many windows, a digest of the run's tokens). A window can be
repeated only if its anchor has two runs. Texts without one never leave the scan.

Runs with the same anchor and digest are the same tokens; they form a *class*, of which one run's
tokens need to be looked at. That is what keeps groups of thousands of copies cheap.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .storage import bounded_batches, clean, mark, written

RUNS = "rid bigint, doc_id bigint, anchor bigint, digest bigint, p int, n int, twice boolean"
_SCHEMA = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("anchor", pa.int64()), ("digest", pa.int64()), ("p", pa.int32()), ("n", pa.int32()), ("twice", pa.bool_())])

#: (bytes, offsets) of a chunk -> (a 64-bit value for each token, number of each text's first token and one more)
Tokens = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def word_tokens(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = tx.words(buf, offsets)
    return tx.span_hashes(buf, starts, ends), first


def byte_tokens(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return tx.BYTE[buf], offsets


def keyed(docs: DataFrame, *others: str) -> DataFrame:
    """``rid, doc_id, text`` and other columns: rid tells rows of one id and different texts apart; null texts are empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return bounded_batches(docs).select(F.xxhash64("doc_id", text).alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *others)


def same_row(other_rid: str, other_id: str) -> Column:
    return (F.col("rid") == F.col(other_rid)) & F.col("doc_id").eqNullSafe(F.col(other_id))


def runs(h: np.ndarray, first: np.ndarray, window: int, gram: int, within: bool = False) -> tuple[np.ndarray, ...]:
    """The runs of a chunk: text, first window (as a token of the chunk), number of windows, anchor,
    and (if ``within`` asks for it) whether the run holds its anchor more than once."""
    none = np.zeros(0, np.int64)
    if len(h) < window:
        return none, none, none, np.zeros(0, tx.U), np.zeros(0, bool)
    grams = tx.rolled(h, gram)
    anchor = tx.sliding_min(grams, window - gram + 1)
    end = np.repeat(first[1:], np.diff(first))[: len(anchor)]
    whole = np.arange(len(anchor)) + window <= end
    begin = whole.copy()
    begin[1:] &= (anchor[1:] != anchor[:-1]) | ~whole[:-1]
    stop = whole.copy()
    stop[:-1] &= begin[1:] | ~whole[1:]
    p = np.flatnonzero(begin)
    n, twice = np.flatnonzero(stop) + 1 - p, np.zeros(len(p), dtype=bool)
    if within:
        last = p + n + window - gram
        twice[:] = [np.count_nonzero(grams[a:b] == x) > 1 for a, b, x in zip(p.tolist(), last.tolist(), anchor[p], strict=True)]
    return np.searchsorted(first, p, side="right") - 1, p, n, anchor[p], twice


def run_table(docs: DataFrame, tokens: Tokens, window: int, gram: int, within: bool) -> DataFrame:
    """The runs of every text of ``keyed`` docs, see :data:`RUNS`."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = tx.flat(batch.column(2))
            rid, ids = batch.column(0), batch.column(1)
            for a, b in tx.chunks(offsets):
                h, first = tokens(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                doc, p, n, anchor, twice = runs(h, first, window, gram, within)
                if not len(p):
                    continue
                raw = memoryview(np.ascontiguousarray(h)).cast("B")
                digest = [xxhash.xxh3_64_intdigest(raw[8 * i : 8 * j]) for i, j in zip(p.tolist(), (p + n + window - 1).tolist(), strict=True)]
                at = pa.array(doc + a)
                yield pa.RecordBatch.from_arrays(
                    [rid.take(at), ids.take(at), pa.array(anchor.view(np.int64)), pa.array(np.array(digest, tx.U).view(np.int64)), pa.array((p - first[doc]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(twice)],
                    schema=_SCHEMA,
                )

    return docs.select("rid", "doc_id", "text").mapInArrow(scan, RUNS)


def repeated_runs(docs: DataFrame, tokens: Tokens, window: int, gram: int, name: str, within: bool = False) -> DataFrame:
    """The runs whose anchor has more than one, written to the shared folder; ``within``: or lies more than once in its only one."""
    since = mark()
    found = written(run_table(docs, tokens, window, gram, within), f"{name}-runs")
    twice = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("times"), F.max("twice").alias("twice")).filter("times > 1 or twice").select(F.col("anchor").alias("x"))
    twice = written(twice, f"{name}-anchors")  # read back, so that both sides of the join are exchanges and a hot anchor can be split
    found = written(found.join(twice, F.col("anchor") == F.col("x"), "left_semi"), f"{name}-repeated")
    clean(since, latest=1)  # but for found
    return found


def per_document(spans: DataFrame) -> DataFrame:
    """``r, d, starts, counts``: the windows of each row (rid, doc_id, starts, counts: arrays), as arrays no longer than its text has runs."""
    own = spans.groupBy(F.col("rid").alias("r"), F.col("doc_id").alias("d")).agg(F.collect_list(F.struct("starts", "counts")).alias("s"))
    return own.select("r", "d", F.flatten("s.starts").alias("starts"), F.flatten("s.counts").alias("counts"))


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``doc_id, text, starts, counts`` of each of the ``keyed`` docs; a row without spans has nulls."""
    return docs.join(per_document(spans.distinct()), same_row("r", "d"), "left").select("doc_id", "text", "starts", "counts")


def covered_by(n: int, starts: list[int] | None, counts: list[int] | None, window: int) -> np.ndarray | None:
    """Which of n tokens the windows cover; None for none."""
    if not starts:
        return None
    return tx.covered(n, np.array(starts, np.int64), np.array(counts, np.int64) + window - 1)
