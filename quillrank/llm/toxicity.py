"""Toxicity by compression distance.

Texts are cut at words into windows of about ``WINDOW`` bytes, and every window is compressed with two zstandard
dictionaries. One is trained on ordinary text. The other begins with the same content, so what both kinds of
text share cancels, and ends with strings from toxic texts. What the toxic one saves is the window's gain.
Thresholds on gains, and the weights of the few numbers that sum a text up, are calibrated on labelled texts
that neither dictionary has seen.

The toxic part is not what the library's trainer makes of whole toxic windows: where toxic texts are mostly made of the
words that all texts have, such a pair tells them apart hardly better than chance (README). It is the strings that
toxic texts prefer by a likelihood-ratio test against ordinary ones, as many as DICT_BYTES hold.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .sampling import labelled_sample
from .storage import bounded_batches

MAX_FIT_ROWS = 10_000
WINDOW = 64
LEVEL = 5
DICT_BYTES = 8 << 10
DICT_WINDOWS = 20_000
GRAM, LEAST_MATCH = 6, 5
THRESHOLDS = (1.0, 2.0, 3.0, 4.0)
LEAST_TEXTS, LEAST_RATIO = 4, 8.0
COPY_WORDS, COPY_PART, COPY_SHARE = 8, 8, 0.5
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row's label may not be learned from: crc32 of its id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _cuts(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where windows begin: at each text, and before the first word at or after every WINDOW bytes of it; the end comes last."""
    starts, _, first = tx.words(buf, offsets)
    if not len(starts):
        return np.unique(offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    cell = (starts - offsets[doc]) // WINDOW
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (cell[1:] != cell[:-1]) | (doc[1:] != doc[:-1])
    return np.unique(np.concatenate([np.maximum(starts[new] - 1, offsets[doc[new]]), offsets]))


class Sizes:
    """Compressed sizes of many spans with one dictionary."""

    def __init__(self, content: bytes) -> None:
        params = zstd.ZstdCompressionParameters.from_level(LEVEL, source_size=WINDOW, window_log=15, hash_log=15, chain_log=15, search_log=6, min_match=LEAST_MATCH, write_content_size=False, write_dict_id=False, write_checksum=False)
        made = zstd.ZstdCompressionDict(content or b"\0" * 16, dict_type=zstd.DICT_TYPE_AUTO)
        made.precompute_compress(compression_params=params)
        self.z = zstd.ZstdCompressor(dict_data=made, compression_params=params)

    def of(self, data: bytes, cuts: np.ndarray) -> np.ndarray:
        """Of the spans between neighbouring cuts, all in one call of the library."""
        segments = np.stack([cuts[:-1], np.diff(cuts)], axis=1).astype(np.uint64)
        out = self.z.multi_compress_to_buffer(zstd.BufferWithSegments(data, segments.tobytes()))
        return np.fromiter(map(len, out), dtype=np.int64, count=len(segments))


@dataclass(frozen=True)
class Gains:
    """Of each window of some texts: its text, its size with the ordinary dictionary and what the toxic one saves."""

    doc: np.ndarray
    plain: np.ndarray
    gain: np.ndarray
    length: np.ndarray  # bytes of each text

    def summed(self, least: float) -> np.ndarray:
        """For each text: what its best window saves, windows that save ``least`` or more, their share, all they save, windows, ordinary size of a byte."""
        n = len(self.length)
        over = self.gain >= least
        windows, many = np.bincount(self.doc, minlength=n), np.bincount(self.doc[over], minlength=n)
        best = np.zeros(n)
        np.maximum.at(best, self.doc, self.gain)
        saved = np.bincount(self.doc[over], weights=self.gain[over], minlength=n)
        plain = np.bincount(self.doc, weights=self.plain, minlength=n)
        return np.stack([best / 4, np.log1p(many), np.sqrt(many / np.maximum(1, windows)), np.log1p(saved), np.log1p(windows), plain / np.maximum(1, self.length)], axis=1)


FACTS = 6


@dataclass(frozen=True)
class ToxicityModel:
    common: bytes
    toxic: bytes
    least: float
    weights: tuple[float, ...]

    def gains(self, buf: np.ndarray, offsets: np.ndarray, sizes: tuple[Sizes, Sizes]) -> Gains:
        """Every window of every text of a chunk, compressed with both dictionaries."""
        cuts = _cuts(buf, offsets)
        data = _FOLDED[buf].tobytes()
        plain, own = (s.of(data, cuts) for s in sizes)
        return Gains(np.searchsorted(offsets, cuts[:-1], side="right") - 1, plain, plain - own, np.diff(offsets))

    def sizes(self) -> tuple[Sizes, Sizes]:
        """With the ordinary dictionary and with the toxic one.

        What follows a dictionary's content is content too; the filler keeps the ordinary part at
        the same distance in both.
        """
        return Sizes(self.common + b"\0" * len(self.toxic)), Sizes(self.common + self.toxic)

    def score(self, x: np.ndarray) -> np.ndarray:
        w = np.array(self.weights)
        return 1 / (1 + np.exp(-np.clip(x @ w[1:] + w[0], -40, 40)))

    def apply(self, docs: DataFrame) -> DataFrame:
        """``doc_id, score`` of each row's whole text. A null or empty text has no window and gets the base score."""
        model = self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sizes = model.sizes()
            for batch in batches:
                buf, offsets = tx.flat(batch.column(1))
                parts = [model.score(model.gains(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], sizes).summed(model.least)) for a, b in tx.chunks(offsets)]
                if parts:
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(np.concatenate(parts), 6))], schema=_SCHEMA)

        return bounded_batches(docs).selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id bigint, score double")


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.01) -> tuple[float, ...]:
    """Newton's method; the intercept is not shrunk."""
    a = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    w = np.zeros(a.shape[1])
    shrink = np.diag([1e-6, *[l2] * x.shape[1]]) * len(x)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        step = np.linalg.solve((a.T * (p * (1 - p) + 1e-9)) @ a + shrink, a.T @ (y - p) - shrink @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def _flat(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


#: Bytes as they are compared: A-Z in lower case, every separator a space.
_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[65:91] += 32
_FOLDED[tx.SEPARATOR] = 32


def _grams(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of the GRAM bytes from each position on, zero where a text ends before, and the text."""
    h = tx.rolled(tx.BYTE[buf], GRAM)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    h[doc[: len(h)] != doc[GRAM - 1 :]] = 0
    return h, doc[: len(h)]


def _texts_with(texts: list[bytes], among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes (only those of ``among``, if given), and how many texts have each. Chunk by chunk."""
    found, times = np.zeros(0, tx.U), np.zeros(0, np.int64)
    buf, offsets = _flat(texts)
    for a, b in tx.chunks(offsets, 1 << 20):
        h, doc = _grams(_FOLDED[buf[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a])
        on = h != 0
        if among is not None:
            on &= among[np.minimum(np.searchsorted(among, h), len(among) - 1)] == h
        h, doc = h[on], doc[on]
        order = np.argsort(h, kind="stable")  # texts stay in order among equal hashes
        h, doc = h[order], doc[order]
        keep = np.ones(len(h), dtype=bool)
        keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        own, n = np.unique(h[keep], return_counts=True)
        found, at = np.unique(np.concatenate([found, own]), return_inverse=True)
        times = np.bincount(at, weights=np.concatenate([times, n]), minlength=len(found)).astype(np.int64)
    return found, times


def _likelihood_ratio(n: np.ndarray, m: np.ndarray, a: int, b: int) -> np.ndarray:
    """Twice the log likelihood ratio of n of a and m of b against equal shares."""
    share = (n + m) / (a + b)
    out = np.zeros(len(n))
    for seen, of, p in ((n, a, share), (a - n, a, 1 - share), (m, b, share), (b - m, b, 1 - share)):
        out += 2 * seen * np.log(np.maximum(seen, 1e-12) / np.maximum(of * p, 1e-12))
    return out


def preferred(own: list[bytes], other: list[bytes]) -> bytes:
    """The runs of strings that ``own`` texts prefer to the ``other``, each once for every text that has it.

    A string of GRAM bytes is preferred by the likelihood ratio of the numbers of texts that have it; a run is what
    overlapping preferred strings cover.
    """
    hashes, n = _texts_with(own)
    hashes, n = hashes[n >= LEAST_TEXTS], n[n >= LEAST_TEXTS].astype(float)
    if not len(hashes):
        return b""
    known, times = _texts_with(other, hashes)
    m = np.zeros(len(hashes))
    m[np.searchsorted(hashes, known)] = times
    a, b = len(own), len(other)
    surprise = np.sqrt(np.maximum(0.0, _likelihood_ratio(n, m, a, b)))
    least = math.sqrt(2 * math.log(len(hashes)) + 1e-9)  # what the most surprising of as many strings reaches by chance
    on = (surprise > least) & ((n + 0.5) / a > LEAST_RATIO * (m + 0.5) / b)
    chosen, times = hashes[on], n[on]
    if not len(chosen):
        return b""
    buf, offsets = _flat(own)
    buf = _FOLDED[buf]
    at, _ = _grams(buf, offsets)
    place = np.minimum(np.searchsorted(chosen, at), len(chosen) - 1)
    seen = np.where(chosen[place] == at, times[place], 0)
    # a string that overlaps one found twice as often is that one and whatever happens to stand beside it
    around = -tx.sliding_min(-np.pad(seen, GRAM - 1), 2 * GRAM - 1)
    hit = np.flatnonzero((seen > 0) & (2 * seen >= around))
    inside = np.concatenate([[0], tx.covered(len(buf), hit, GRAM).astype(np.int8), [0]])
    begin, end = np.flatnonzero(np.diff(inside) == 1), np.flatnonzero(np.diff(inside) == -1)
    data = buf.tobytes()
    doc = np.searchsorted(offsets, begin - 1, side="right") - 1
    runs = set(zip(doc.tolist(), (data[i:j] for i, j in zip(begin.tolist(), end.tolist(), strict=True)), strict=True))
    kept: list[bytes] = []
    held: set[bytes] = set()
    room = DICT_BYTES
    for w, _ in sorted(Counter(w for _, w in runs).items(), key=lambda e: (-e[1], e[0])):
        parts = {w[i : i + GRAM - 1] for i in range(len(w) - GRAM + 2)}
        if not parts & held and len(w) <= room:
            kept.append(w)
            held |= parts
            room -= len(w)
    return b"".join(kept[::-1])


def _first_of_copies(texts: list[bytes]) -> list[int]:
    """The texts of which less than COPY_SHARE stands in those taken before, told by a part of their strings of COPY_WORDS words."""
    seen: set[int] = set()
    out = []
    for i, text in enumerate(texts):
        buf = _FOLDED[np.frombuffer(text, np.uint8)]
        starts, ends, _ = tx.words(buf, np.array([0, len(buf)]))
        h = tx.rolled(tx.span_hashes(buf, starts, ends), min(COPY_WORDS, max(1, len(starts))))
        own = set(h[h % tx.U(COPY_PART) == 0].tolist() or h[:1].tolist())
        if not own or len(own & seen) < COPY_SHARE * len(own):
            out.append(i)
            seen |= own
    return out


def _trained(samples: list[bytes], size: int) -> bytes:
    """A zstandard dictionary trained on samples; of too few samples, their text."""
    if len(samples) >= 64 and sum(map(len, samples)) >= 8 * size:
        try:
            return zstd.train_dictionary(size, samples, level=LEVEL).as_bytes()
        except zstd.ZstdError:
            pass
    return b"".join(samples)[-size:]


def train(texts: list[bytes], toxic: np.ndarray) -> ToxicityModel:
    """Train the dictionaries on two thirds of the texts, and calibrate on the others. Copies, near ones too, count once."""
    first = _first_of_copies(texts)
    texts, toxic = [texts[i] for i in first], toxic[first]
    part = np.arange(len(texts)) % 3 == 2
    own = {v: [t for t, y, p in zip(texts, toxic, part, strict=True) if y == v and not p] for v in (0, 1)}
    if not own[0] or not own[1]:
        share = float(toxic.mean()) if len(texts) else 0.0
        base = math.log((share * len(texts) + 0.5) / ((1 - share) * len(texts) + 0.5)) if len(texts) else -4.0
        return ToxicityModel(b"", b"", 1.0, (base, *(0.0,) * FACTS))

    buf, offsets = _flat(own[0])
    cuts, data = _cuts(buf, offsets).tolist(), _FOLDED[buf].tobytes()
    plain = list(zip(cuts[:-1], cuts[1:], strict=True))
    common = _trained([data[a:b] for a, b in plain[:: max(1, len(plain) // DICT_WINDOWS)]], DICT_BYTES)
    made = ToxicityModel(common, preferred(own[1], own[0]), 1.0, (0.0,) * (FACTS + 1))

    held = [t for t, p in zip(texts, part, strict=True) if p]
    y = toxic[part].astype(float)
    sizes, best = made.sizes(), made
    parts = [made.gains(*_flat(held[i : i + 200]), sizes) for i in range(0, len(held), 200)]
    lowest = math.inf
    for least in THRESHOLDS if parts else ():
        x = np.concatenate([g.summed(least) for g in parts])
        model = replace(made, least=least, weights=_logistic(x, y))
        p = np.clip(model.score(x), 1e-9, 1 - 1e-9)
        loss = float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())
        if loss < lowest - 1e-9:
            lowest, best = loss, model
    return best


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_FIT_ROWS) -> ToxicityModel:
    """Learn from ``labels.toxic`` on at most ``most`` labelled documents, none of them held out."""
    rows = labelled_sample(docs, labels, "toxic", most, where=~held_out("id"))
    got = rows.select("doc_id", "text", "label").orderBy(F.xxhash64("doc_id"), "text").toArrow()
    texts = [t.encode() for t in got["text"].to_pylist()]
    return train(texts, np.array(got["label"].to_pylist(), dtype=np.int64))
