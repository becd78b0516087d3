from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer as Reference

from quillrank.llm import bpe

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def both():
    return bpe.Tokenizer(PATH), Reference.from_file(PATH)


def texts():
    rng = random.Random(2)
    out = ["", " ", "a<|endoftext|>b", "<|endoftext|", "x" * 9000, "ab" * 6000 + " c", " " * 9001 + "x", "é" * 7000, "123" * 3000, "日本語" * 4000, "\t\r\n" * 4000, "it's we'll I'D 's"]
    out += ["".join(rng.choice("abcdeéß the 12\n'!<|>") for _ in range(rng.randrange(60))) for _ in range(80)]
    out += ["".join(rng.choice(["ab", "the", "ing", "tion", "e", "Q", "ö"]) for _ in range(8000)) for _ in range(4)]
    return out


def test_same_ids_as_the_library(both):
    own, ref = both
    for t in texts():
        ids = own.encode(t)
        assert ids.tolist() == ref.encode(t, add_special_tokens=False).ids
        assert own.decode(ids.astype(np.int64)) == ref.decode(ids.tolist(), skip_special_tokens=False)


def test_join_agrees_with_encoding_at_once(both):
    own, _ = both
    rng = random.Random(4)
    for _ in range(200):
        piece = "".join(rng.choice("abtheingo") for _ in range(rng.randrange(2, 120))).encode()
        cut = rng.randrange(1, len(piece))
        assert own.join(own._leaf(piece[:cut]), own._leaf(piece[cut:])) == own._leaf(piece)


def test_rows(make_docs, odd_texts, both):
    _, ref = both
    rows = odd_texts
    got = bpe.digests(make_docs(rows, extra=True), PATH).collect()
    want = []
    for i, t in rows:
        ids = ref.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    encoded = bpe.encode_documents(make_docs(rows), PATH)
    assert {r.round_trip for r in encoded.collect()} == {True}
    back = sorted(map(str, map(tuple, bpe.decode_documents(encoded, PATH).collect())))
    assert back == sorted(str((i, t or "")) for i, t in rows)
    assert bpe.digests(make_docs([]), PATH).count() == 0


@pytest.mark.parametrize("gap", ["\n\n", " \n\n", "\t\t\t", "\n \n", "\n\n ", " "])
def test_white_space_before_a_long_piece(both, gap):
    own, ref = both
    for long in ("a" * 5000, "=" * 5000, "7" * 5000):
        for t in ("foo" + gap + long + gap + "bar", gap + long + gap + long + gap):
            assert own.encode(t).tolist() == ref.encode(t, add_special_tokens=False).ids
