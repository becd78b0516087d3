from __future__ import annotations

import random

from pyspark.sql import functions as F

from quillrank.llm import jaccard_join as jj

from .test_dedup import WORD


def shingles(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[k : k + 3]) for k in range(len(w) - 2)) or (frozenset([tuple(w)]) if w else frozenset())


def brute(rows, num=9, den=10):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and den * len(a & sets[j]) >= num * len(a | sets[j]):
                root[top(i)] = top(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[top(i)] = min(d, ids.get(top(i), d))
    return sorted(((d, len(sets[i]), ids.get(top(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def edited(seed, bases, versions, step):
    """Texts with ever more words changed, on both sides of the threshold, a third of them round one text."""
    rng = random.Random(seed)
    line = " ".join(f"common{i}" for i in range(10))
    rows = []
    for base in range(bases):
        w = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(2, 260))]
        for k in range(versions * (6 if base == 0 else 1)):
            v = list(w)
            for _ in range(rng.randrange(step)):
                v[rng.randrange(len(v))] = f"w{rng.randrange(300)}"
            if rng.random() < 0.3:
                v = v[: max(1, int(len(v) * rng.uniform(0.85, 1)))]
            rows.append((len(rows) + 1, (line + " " if base % 2 else "") + " ".join(v)))
    rng.shuffle(rows)
    return rows


def test_components_against_all_pairs(make_docs):
    rows = edited(1, 24, 9, 9)
    got = jj.jaccard_components(make_docs(rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)


def test_odd_rows(make_docs, odd_texts):
    rows = odd_texts + [(None, "one two three four"), (7, "ONE two three  four"), (8, "one two"), (9, "One TWO"), (9, "one\ttwo"), (None, ""), (3, None)]
    got = jj.jaccard_components(make_docs(rows, extra=True).withColumn("node", F.lit(1)).withColumn("x", F.lit(2))).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)
    assert {r.n_copies for r in got if r.doc_id in (8, 9)} == {2} and {r.n_copies for r in got if not r.n_shingles} == {0}
    assert jj.jaccard_components(make_docs([])).count() == 0


def test_answers_are_derived(make_docs, monkeypatch):
    """Small blocks and one leader a list: pairs that share a leader which knows both are settled by its answers."""
    seen = {"sure": 0, "turned": 0}
    before = jj._Join.derived

    def watch(self, rest, answers):
        rest = jj.written(rest, "test-rest")
        seen["sure"] += rest.filter("sure").count()
        seen["turned"] += rest.filter("not sure and lead is not null").count()
        return before(self, rest, answers)

    monkeypatch.setattr(jj._Join, "derived", watch)
    monkeypatch.setattr(jj, "LEADERS", 1)
    monkeypatch.setattr(jj, "BLOCK", 5)
    rows = edited(2, 12, 14, 6)
    got = jj.jaccard_components(make_docs(rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)
    assert seen["turned"] > 0


def test_dense_lists_are_met_again(make_docs, monkeypatch):
    """A few pairs for each set first: lists that hold more are met again, with what was linked as one component, until none is cut."""
    met = []
    before = jj._Join.met_again

    def watch(self, blocks, few=None):
        found = jj.written(before(self, blocks, few), "test-found")
        met.append((few, found.count(), found.filter("cut").count(), blocks.agg(F.sum(F.size("nodes"))).first()[0] or 0))
        return found

    monkeypatch.setattr(jj._Join, "met_again", watch)
    monkeypatch.setattr(jj, "LEADERS", 1)
    monkeypatch.setattr(jj, "BLOCK", 8)
    monkeypatch.setattr(jj, "SLAB", 4)
    monkeypatch.setattr(jj, "FEW", 1)
    rows = edited(2, 12, 14, 6)
    got = jj.jaccard_components(make_docs(rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)
    assert len(met) > 1 and met[0][2] > 0 and met[-1][2] == 0
    assert all(found <= 4 * entries for few, found, _, entries in met if few)
