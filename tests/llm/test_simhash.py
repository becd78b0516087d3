from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from quillrank.llm import simhash
from quillrank.llm.components import components

from .test_dedup import WORD


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(values):
    u = sorted(set(values))
    root = {x: x for x in u}
    changed = True
    while changed:
        changed = False
        for i, x in enumerate(u):
            for y in u[i + 1 :]:
                if bin(x ^ y).count("1") <= 2 and root[x] != root[y]:
                    root[x] = root[y] = min(root[x], root[y])
                    changed = True
    return root


def test_fingerprints_and_components(make_docs, odd_texts):
    rows = odd_texts
    got = simhash.near_duplicates(make_docs(rows, extra=True)).collect()
    assert len(got) == len(rows)
    fps = sorted((brute_fingerprint(t) for _, t in rows))
    assert sorted(int(r.fingerprint, 16) for r in got) == fps
    roots = brute_roots(fps)
    least: dict[int, int] = {}
    for i, t in rows:
        r = roots[brute_fingerprint(t)]
        if i is not None:
            least[r] = min(i, least.get(r, i))
    for r in got:
        assert r.component_id == least.get(roots[int(r.fingerprint, 16)])


@pytest.mark.parametrize("hot", [4096, 3])
def test_links_are_all_pairs_within_the_radius(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT", hot)
    rng = random.Random(3)
    values = {rng.getrandbits(64) for _ in range(150)}
    for base in list(values)[:6]:  # clusters that share most blocks
        values |= {base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(25)}
    signed = [int(np.uint64(v).astype(np.int64)) for v in sorted(values)]
    got = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp bigint")).distinct().collect()
    mask = (1 << 64) - 1
    found = {frozenset((r.a & mask, r.b & mask)) for r in got}
    u = sorted(values)
    assert found == {frozenset((x, y)) for i, x in enumerate(u) for y in u[i + 1 :] if bin(x ^ y).count("1") <= 2}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 20)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(20)}


def test_empty(make_docs):
    assert simhash.near_duplicates(make_docs([])).count() == 0
