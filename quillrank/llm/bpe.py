"""Byte-level BPE encoding and decoding.

Ordinary text is encoded as a whole. A long stretch that the split pattern leaves in one piece would
make merging slow and hold one core, so it is encoded by tree concatenation: both halves are
encoded apart (in parallel, where there are threads to spare), and only a window around the join
is encoded again, growing on both sides until its first token is also a token of the left half
at that place and its last one of the right half. What lies outside the window is then as it would
be in the whole: a sequence of tokens is the encoding of its bytes exactly if each two neighbours
are the encoding of theirs.

The vocabulary's files are read where the encoder runs, from a path that is a parameter.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .storage import bounded_batches

LONG = 4096
LEAF = 2048
WINDOW = 8
THREADS = 2


class Tokenizer:
    """A byte-level BPE vocabulary in the file format of the tokenizers library."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            said = json.load(f)
        shown = _shown_bytes()
        vocab = {bytes(shown[c] for c in word): i for word, i in said["model"]["vocab"].items() if all(c in shown for c in word)}
        self.added = {t["content"]: t["id"] for t in said.get("added_tokens", [])}
        ranks = {word: i for word, i in vocab.items() if i not in self.added.values()}
        pre = said["pre_tokenizer"]
        if pre["type"] != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space") or said.get("normalizer"):
            raise ValueError("only byte-level vocabularies with the usual split pattern and no normalizer")
        self.core = tiktoken.Encoding("quillrank", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.word = regex.compile(PATTERN)
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        size = max([*vocab.values(), *self.added.values()], default=-1) + 1
        parts = [b""] * size
        for word, i in vocab.items():
            parts[i] = word
        for word, i in self.added.items():
            parts[i] = word.encode()
        self.parts = parts
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)
        self.lengths = np.array([len(p) for p in parts], dtype=np.int64)
        self.begins = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]) if size else np.zeros(0, np.int64)

    def encode(self, text: str, pool: ThreadPoolExecutor | None = None) -> np.ndarray:
        """The ids of a whole text, as uint32."""
        if self.special is not None and "<" in text or self.special is not None and not all(w.startswith("<") for w in self.added):
            out, at = [], 0
            for m in self.special.finditer(text):
                out += [self._ordinary(text[at : m.start()], pool), np.array([self.added[m[0]]], np.uint32)]
                at = m.end()
            if out:
                return np.concatenate([*out, self._ordinary(text[at:], pool)])
        return self._ordinary(text, pool)

    def _ordinary(self, text: str, pool: ThreadPoolExecutor | None) -> np.ndarray:
        if len(text) <= LONG or not _LONG_RUN.search(text):
            return self.core.encode_to_numpy(text)
        out, at, last = [], 0, 0
        for m in self.word.finditer(text):
            if m.end() - m.start() > LONG:
                # the pattern looks ahead from white space: the piece before a long one stands alone, as it was split in sight of it
                out += [self.core.encode_to_numpy(text[a:b]) for a, b in ((at, last), (last, m.start())) if a < b]
                out.append(self.encode_piece(m[0].encode(), pool))
                at = last = m.end()
            else:
                last = m.start()
        if at < len(text):
            out.append(self.core.encode_to_numpy(text[at:]))
        return np.concatenate(out)

    def _leaf(self, piece: bytes) -> list[int]:
        return self.core._encode_single_piece(piece)

    def encode_piece(self, piece: bytes, pool: ThreadPoolExecutor | None = None) -> np.ndarray:
        """The ids of one unsplit piece, by tree concatenation."""
        leaves = [piece[i : i + LEAF] for i in range(0, len(piece), LEAF)]
        level = list((pool.map if pool else map)(self._leaf, leaves))
        while len(level) > 1:
            pairs = list(zip(level[::2], level[1::2], strict=False))
            joined = list((pool.map if pool else map)(lambda p: self.join(*p), pairs))
            level = joined + level[len(level) // 2 * 2 :]
        return np.array(level[0] if level else [], dtype=np.uint32)

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two encoded halves' bytes together."""
        if not left or not right:
            return left or right
        a = b = WINDOW
        while True:
            a, b = min(a, len(left)), min(b, len(right))
            window = b"".join(self.parts[i] for i in left[len(left) - a :]) + b"".join(self.parts[i] for i in right[:b])
            mid = self._leaf(window)
            ok_left = a == len(left) or mid[0] == left[len(left) - a]
            ok_right = b == len(right) or mid[-1] == right[b - 1]
            if ok_left and ok_right and (len(mid) > 1 or a == len(left) and b == len(right)):
                return left[: len(left) - a] + mid + right[b:]
            a, b = a if ok_left and len(mid) > 1 else 2 * a, b if ok_right and len(mid) > 1 else 2 * b

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids, special tokens too."""
        if not len(ids):
            return b""
        n = self.lengths[ids]
        ends = np.cumsum(n)
        at = np.arange(ends[-1], dtype=np.int64) + np.repeat(self.begins[ids] - (ends - n), n)
        return self.bytes[at].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", errors="replace")


#: Fixed value: the split pattern of byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Only a text with such a run can have a piece of more than LONG characters.
_LONG_RUN = regex.compile(r"\p{L}{%d}|\p{N}{%d}|[^\s\p{L}\p{N}]{%d}|\s{%d}" % ((LONG - 1,) * 4))


def _shown_bytes() -> dict[str, int]:
    """The printable character that stands for each byte: itself if it has one in Latin-1, else the next from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


_CACHE: dict[str, Tokenizer] = {}


def loaded(path: str) -> Tokenizer:
    if path not in _CACHE:
        _CACHE[path] = Tokenizer(path)
    return _CACHE[path]


def _mapped(docs: DataFrame, path: str, row: Callable[[Tokenizer, np.ndarray], tuple], fields: list[tuple[str, T.DataType, pa.DataType]]) -> DataFrame:
    """A row per document: doc_id and what ``row`` makes of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = loaded(path)
        with ThreadPoolExecutor(THREADS) as pool:
            for batch in batches:
                rows = [row(tok, tok.encode(t.as_py() or "", pool)) for t in batch.column(1)]
                cols = [pa.array([r[i] for r in rows], f[2]) for i, f in enumerate(fields)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["doc_id", *(f[0] for f in fields)])

    schema = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(f[0], f[1]) for f in fields)])
    return bounded_batches(docs).selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(run, schema)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids, round_trip``: a row for each row of docs; round_trip: the ids decode to the text.

    A null text is empty and has no ids; only doc_id and text are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = loaded(path)
        with ThreadPoolExecutor(THREADS) as pool:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    texts = [t.as_py() or "" for t in part.column(1)]
                    ids = [tok.encode(t, pool) for t in texts]
                    back = [tok.decode(i) == t for i, t in zip(ids, texts, strict=True)]
                    n = np.array([len(i) for i in ids], dtype=np.int64)
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.uint32), *ids]).astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), lists, pa.array(back)], ["doc_id", "n_tokens", "ids", "round_trip"])

    return bounded_batches(docs).selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids array<int>, round_trip boolean")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` of rows of ``doc_id, ids``; null ids decode to the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = loaded(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([tok.decode(np.array(x.as_py() or [], np.int64)) for x in batch.column(1)], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: each text encoded, and decoded from its ids again."""

    def row(tok: Tokenizer, ids: np.ndarray) -> tuple:
        return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(tok.decode(ids).encode()).hexdigest()

    return _mapped(docs, path, row, [("n_tokens", T.LongType(), pa.int64()), ("ids_sha256", T.StringType(), pa.string()), ("decoded_sha256", T.StringType(), pa.string())])

