"""Counts over whole texts, a numpy pass per Arrow batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import text as tx
from .storage import bounded_batches

WINDOW = 5
#: Frequent function words of the four languages, told apart from content by any reader.
COMMON = (
    "the of and to in is it that was for on are with as at be by this have from or an "
    "de la le les des et en un une du que qui dans pour pas sur par avec "
    "der die das und ist von mit den zu nicht ein eine sich auf dem auch "
    "el los las y del se por con una su para al lo como más"
).split()
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_common")
SCHEMA = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in COUNTS)])
DDL = "doc_id bigint, " + ", ".join(f"{c} bigint" for c in COUNTS)


def _byte_set(chars: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(chars)] = True
    return table


_SYMBOL, _UPPER, _DIGIT, _MARK = _byte_set(b"#*$%&|<>"), _byte_set(bytes(range(65, 91))), _byte_set(bytes(range(48, 58))), _byte_set(b"!?")


def per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of the marked positions lie in each text."""
    return np.diff(np.searchsorted(np.flatnonzero(mask), offsets))


def common_hashes() -> np.ndarray:
    joined = [w.encode() for w in COMMON]
    ends = np.cumsum([len(w) for w in joined])
    return np.unique(tx.span_hashes(np.frombuffer(b"".join(joined), np.uint8), ends - [len(w) for w in joined], ends))


def counts(buf: np.ndarray, offsets: np.ndarray, common: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of each text of a chunk."""
    n = len(offsets) - 1
    starts, ends, first = tx.words(buf, offsets)
    n_words = np.diff(first)
    inside = ~tx.SEPARATOR[buf]
    h = tx.span_hashes(buf, starts, ends)
    salt = tx.mixed(np.arange(1, n + 1, dtype=tx.U))
    out = {"n_words": n_words, "word_chars": per_text(inside & ((buf & 0xC0) != 0x80), offsets)}
    for name, table in (("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_digits", _DIGIT), ("n_marks", _MARK)):
        out[name] = per_text(table[buf], offsets)

    breaks = np.flatnonzero(buf == 10)
    begin, end = np.sort(np.concatenate([offsets[:-1], breaks + 1])), np.sort(np.concatenate([offsets[1:], breaks]))
    filled = np.searchsorted(starts, begin) < np.searchsorted(starts, end)
    begin, end = begin[filled], end[filled]
    doc = np.searchsorted(offsets, begin, side="right") - 1
    key = tx.span_hashes(buf, begin, end) ^ salt[doc]
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), dtype=bool)
    again[order[1:]] = key[order[1:]] == key[order[:-1]]
    out["n_lines"], out["n_dup_lines"] = np.bincount(doc, minlength=n), np.bincount(doc[again], minlength=n)

    word_doc = np.repeat(np.arange(n), n_words)
    out["n_common"] = np.bincount(word_doc[common[np.minimum(np.searchsorted(common, h), len(common) - 1)] == h], minlength=n)
    out["n_repeat_words"] = np.zeros(n, dtype=np.int64)
    if len(h) >= WINDOW:
        at = np.flatnonzero(np.arange(len(h) - WINDOW + 1) + WINDOW <= first[1:][word_doc[: len(h) - WINDOW + 1]])
        key = tx.rolled(h, WINDOW)[at] ^ salt[word_doc[at]]
        ranked = np.sort(key)
        twice = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
        if len(twice):
            found = at[twice[np.minimum(np.searchsorted(twice, key), len(twice) - 1)] == key]
            out["n_repeat_words"] = np.bincount(word_doc[tx.covered(len(h), found, WINDOW)], minlength=n)
    return out


def text_stats(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the :data:`COUNTS` of each row's whole text; a null or empty text counts 0 everywhere.

    Rows are kept one for one, equal rows and null ids too; columns besides doc_id and text are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = common_hashes()
        for batch in batches:
            buf, offsets = tx.flat(batch.column(1))
            parts = [counts(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], common) for a, b in tx.chunks(offsets)]
            if parts:
                cols = [pa.array(np.concatenate([p[c] for p in parts]).astype(np.int64)) for c in COUNTS]
                yield pa.RecordBatch.from_arrays([batch.column(0), *cols], schema=SCHEMA)

    return bounded_batches(docs).selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(run, DDL)
