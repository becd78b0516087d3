from __future__ import annotations

import random

import numpy as np
import pytest

import corpus_pipeline
from quillrank.llm import near_copies, simhash

from .test_dedup import WORD


def brute(rows):
    """The least id of each row's component over five-word Jaccard of 0.8 or more."""
    sets = []
    for _, t in rows:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) or frozenset([tuple(w)]))
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if 10 * len(a & sets[j]) >= 8 * len(a | sets[j]):
                root[top(i)] = top(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[top(i)] = min(d, ids.get(top(i), d))
    return sorted(((d, ids.get(top(i))) for i, (d, _) in enumerate(rows)), key=str)


def edited():
    """Copies of texts with ever more words changed, so that similarities lie on both sides of 0.8, and a large group of them."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(400)}"
    line = " ".join(f"common{i}" for i in range(12))
    rows = []
    for base in range(30):
        w = [word() for _ in range(rng.randrange(3, 150))]
        for changes in range(6):
            v = list(w)
            for _ in range(changes):
                v[rng.randrange(len(v))] = word()
            rows.append((len(rows) + 1, line + " " + " ".join(v) if base % 3 == 0 else " ".join(v)))
    w = [word() for _ in range(120)]
    for _ in range(60):
        v = list(w)
        v[rng.randrange(120)] = word()
        rows.append((len(rows) + 1, " ".join(v)))
    return rows


@pytest.mark.parametrize("sample", [10_000, 20])
def test_components_are_those_of_all_pairs(make_docs, odd_texts, monkeypatch, sample):
    monkeypatch.setattr(near_copies, "SAMPLE", sample)
    monkeypatch.setattr(near_copies, "TILE", 16)
    rows = odd_texts + [(i + 1000, t) for i, t in edited()]
    got = near_copies.near_copies(make_docs(rows, extra=True)).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == brute(rows)


def test_the_stage_drops_copies_that_differ_in_more_than_two_bits(spark, make_docs):
    rng = random.Random(1)
    w = [f"w{rng.randrange(5000)}" for _ in range(200)]
    rows = [(1, " ".join(w)), (2, " ".join([*w[:100], "other", "words", *w[102:]])), (3, " ".join(w[:60]))]
    docs = make_docs(rows)
    a, b, _ = (int(r.fingerprint, 16) for r in sorted(simhash.near_duplicates(docs).collect()))
    assert bin(a ^ b).count("1") > 2
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == [1, 3]


def test_parities_bound_the_difference():
    rng = np.random.default_rng(4)
    for n in (0, 1, 50, 63, 64, 65, 400, 1100):
        a = np.unique(rng.integers(1, 1 << 40, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: n - n // 10], rng.integers(1, 1 << 40, n // 8).astype(np.uint64)]))
        x, y = near_copies.parities(np.repeat([0, 1], [len(a), len(b)]), np.concatenate([a, b]), np.array([len(a), len(b)]))
        assert near_copies.differing(x, y) <= len(np.setxor1d(a, b))


def test_empty(make_docs):
    assert near_copies.near_copies(make_docs([])).count() == 0
