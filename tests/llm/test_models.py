"""Quality rules, the quality classifier and toxicity: learned parts by what they get right, counts by brute force."""

from __future__ import annotations

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillrank.llm import quality_model, quality_rules, stats, toxicity

from .test_dedup import WORD

SYLLABLES = "ther and ing tion er es the of an re in on at nd ti".split()
COMMON = "the of and to in is".split()
INSULTS = ["idiot", "moron", "scumbag", "pathetic", "worthless"]


def brute_counts(t):
    w = WORD.findall(t or "")
    times = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    again = {k for i in range(len(w) - 4) if times[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    seen, dup, lines = set(), 0, 0
    for line in (t or "").split("\n"):
        if WORD.search(line):
            lines += 1
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), dup, len(again), lines


def corpus(n=600, seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(1, 4))) if rng.random() < 0.6 else rng.choice(COMMON) for _ in range(rng.randrange(25, 150))]
        bad, toxic = i % 6 == 0, i % 5 == 0
        if bad and i % 12:
            words = [w + rng.choice(["###", "$$$", "%%%"]) for w in words]
        elif bad:
            words = words[:6] * 12
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
        rows.append((i, " ".join(words), 0 if bad else 1, 1 if toxic else 0))
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    rows = corpus(1200)
    docs = spark.createDataFrame([(r[0], r[1], "en", "s", len(r[1])) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    labels = spark.createDataFrame([(r[0], r[2], r[3]) for r in rows if r[0] % 4] + [(None, 1, 1), (3, None, None)], "doc_id bigint, quality int, toxic int")
    return docs, labels, rows


def test_counts(make_docs, odd_texts):
    got = stats.text_stats(make_docs(odd_texts, extra=True)).collect()
    have = sorted(str((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_lines)) for r in got)
    assert have == sorted(str((i, *brute_counts(t))) for i, t in odd_texts)


def test_equal_lines_are_equal_bytes(make_docs):
    from .test_dedup import thue_morse

    a, b = thue_morse(10, "x", "y")
    got = {r.doc_id: r.n_dup_lines for r in stats.text_stats(make_docs([(1, f"{a}\n{b}"), (2, f"{a}\n{b}\n{a}")])).collect()}
    assert got == {1: 0, 2: 1}


def test_rules_are_learned_and_are_spark_expressions(tables):
    docs, labels, rows = tables
    rules = quality_rules.fit(docs, labels)
    assert rules and all(len(r) <= quality_rules.MAX_CONDITIONS for r in rules)
    out = quality_rules.judge(docs, rules)
    kept = {r.doc_id: (r.kept, r.base_failed, r.rule) for r in out.collect()}
    for i, t, good, _ in rows:
        n, _, _, _, again, _ = brute_counts(t)
        assert kept[i][1] == (n < 10 or 100 * again > 20 * n)
        assert not (kept[i][0] and (kept[i][1] or kept[i][2] is not None))
    right = np.mean([kept[i][0] == bool(good) for i, _, good, _ in rows])
    assert right > 0.97


def test_rules_without_labels_keep_all_that_passes_the_base(make_docs, odd_texts, tables):
    _, labels, _ = tables
    docs = make_docs(odd_texts)
    rules = quality_rules.fit(docs, labels.filter("false"))
    out = quality_rules.judge(docs, rules).collect()
    assert rules == [] and len(out) == len(odd_texts) and all(r.kept != r.base_failed for r in out)


def test_covering_on_arrays():
    rng = np.random.default_rng(0)
    x = {"a": rng.random(900), "b": rng.random(900)}
    bad = ((x["a"] > 0.8) & (x["b"] < 0.5)) | (x["b"] > 0.95)
    rules = quality_rules.learn(x, bad)
    on = np.logical_or.reduce([quality_rules.holds(r, x) for r in rules])
    assert len(rules) >= 2 and (on == bad).mean() > 0.96
    assert quality_rules.learn(x, np.zeros(900, bool)) == []


def test_weak_labels_find_accuracies_without_hand_labels():
    """Labellers that see one kind of bad document each, and seldom accuse a good one."""
    rng = np.random.default_rng(1)
    kinds = np.array(list(quality_model.KINDS[k] for k in quality_model.LABELLERS))
    truth = np.where(rng.random(6000) < 0.8, quality_model.GOOD, rng.integers(0, 3, 6000))
    sees = np.array([0.95, 0.8, 0.95, 0.7, 0.9, 0.6, 0.7, 0.8])
    votes = np.where(rng.random((6000, 8)) < np.where(truth[:, None] == kinds, sees, 0.005), 0, np.where(rng.random((6000, 8)) < 0.15, 2, 1))
    model = quality_model.estimate(votes, np.ones(6000))
    assert abs(model.prior[quality_model.GOOD] - 0.8) < 0.05
    for j, k in enumerate(kinds):
        assert abs(model.votes[j, k, 0] - sees[j]) < 0.15
    assert model.votes[:, quality_model.GOOD, 0].max() <= quality_model.MOST_WRONG
    right = (model.posterior(votes) > 0.5) == (truth == quality_model.GOOD)
    assert right.mean() > 0.95
    real = np.mean(((votes == 0) & (truth[:, None] != quality_model.GOOD)) | ((votes == 1) & (truth[:, None] == quality_model.GOOD)), axis=0) / np.mean(votes < 2, axis=0)
    assert np.abs(np.array(list(model.accuracies().values())) - real).max() < 0.06


def test_quality_classifier(tables):
    docs, _, rows = tables
    model = quality_model.fit(docs)
    got = {r.doc_id: r.kept for r in model.apply(docs).collect()}
    clean = np.mean([got[i] for i, _, good, _ in rows if good])
    assert clean > 0.98 and np.mean([got[i] == bool(good) for i, _, good, _ in rows]) > 0.95
    kept = model.keep(docs.withColumn("a b.c", F.lit(1)).withColumn("kept", F.lit("x")))
    assert kept.columns[-2:] == ["a b.c", "kept"] and kept.count() == sum(got.values())


def test_quality_classifier_on_odd_rows(make_docs, odd_texts):
    docs = make_docs(odd_texts, extra=True)
    got = quality_model.fit(docs).apply(docs).collect()
    assert len(got) == len(odd_texts) and not any(r.kept for r in got if r.n_words == 0)
    empty = make_docs([])
    assert quality_model.fit(empty).apply(empty).count() == 0


def test_toxicity_on_held_out_texts(tables):
    docs, labels, rows = tables
    model = toxicity.fit(docs, labels)
    out = {r.doc_id: r for r in model.apply(docs).select("*", toxicity.held_out().alias("held_out")).collect()}
    held = [(i, tox) for i, _, _, tox in rows if out[i].held_out]
    assert 150 < len(held) < 350
    right = np.mean([(out[i].score >= 0.5) == bool(tox) for i, tox in held])
    clean = np.mean([out[i].score < 0.5 for i, tox in held if not tox])
    assert right > 0.9 and clean > 0.95


def area(scores, labels):
    order = sorted(zip(scores, labels, strict=True))
    low = [x for x, y in order if not y]
    high = [x for x, y in order if y]
    return np.mean([(x > np.array(low)).mean() + (x == np.array(low)).mean() / 2 for x in high])


def test_toxicity_needs_both_dictionaries(tables):
    """Without either one, what is left tells held-out texts apart less well."""
    import dataclasses

    docs, labels, rows = tables
    model = toxicity.fit(docs, labels)
    texts = [t.encode() for i, t, _, _ in rows if i % 7 == 0 or i % 5 == 0]
    own = [y for i, _, _, y in rows if i % 7 == 0 or i % 5 == 0]
    buf, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    both = model.sizes()
    whole = area(model.gains(buf, offsets, both).summed(model.least)[:, 3], own)
    no_toxic = area(model.gains(buf, offsets, (both[0], both[0])).summed(model.least)[:, 3], own)
    bare = toxicity.Sizes(b"")
    no_ordinary = area(model.gains(buf, offsets, (bare, toxicity.Sizes(model.common))).summed(model.least)[:, 3], own)
    assert whole > 0.9 and no_toxic == 0.5 and no_ordinary < whole - 0.1
    assert dataclasses.replace(model, toxic=b"").sizes()[1].of(b"some text here", np.array([0, 14])) == both[0].of(b"some text here", np.array([0, 14]))


def test_gains_are_differences_of_compressed_sizes(tables):
    docs, labels, rows = tables
    model = toxicity.fit(docs, labels)
    texts = [rows[5][1].encode(), b"", b"An IDIOT\tspeaks", rows[7][1].encode()]
    buf, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    sizes = model.sizes()
    got = model.gains(buf, offsets, sizes)
    at = 0
    for k, text in enumerate(texts):
        low = bytes(32 if c in b" \t\n\v\f\r" else c + 32 if 65 <= c <= 90 else c for c in text)
        cuts, cell = [0] if low else [], 0
        for i, c in enumerate(low):
            if c != 32 and (i == 0 or low[i - 1] == 32) and i // toxicity.WINDOW > cell:
                cuts.append(i - 1)
                cell = i // toxicity.WINDOW
        for a, b in zip(cuts, [*cuts, len(low)][1:], strict=True):
            plain, own = (len(s.z.compress(low[a:b])) for s in sizes)
            assert (got.doc[at], got.plain[at], got.gain[at]) == (k, plain, plain - own)
            at += 1
    assert at == len(got.doc)


def test_toxicity_learns_from_no_held_out_label(tables):
    docs, labels, _ = tables
    changed = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, changed)
    assert a == b


def test_toxicity_without_labels_and_on_odd_rows(make_docs, odd_texts, tables):
    _, labels, _ = tables
    docs = make_docs(odd_texts, extra=True)
    got = toxicity.fit(docs, labels.filter("false")).apply(docs).collect()
    assert len(got) == len(odd_texts) and all(0 <= r.score <= 1 for r in got)
    known = toxicity.fit(tables[0], labels)
    assert all(0 <= r.score <= 1 for r in known.apply(docs).collect()) and known.apply(make_docs([])).count() == 0
    assert toxicity.fit(make_docs([]), labels).apply(make_docs([])).count() == 0


def test_rules_of_empty_tables(make_docs, tables):
    rules = quality_rules.fit(make_docs([]), tables[1])
    assert rules == [] and quality_rules.judge(make_docs([]), rules).count() == 0


def test_a_word_once_and_one_that_is_very_long(make_docs):
    long = "x" * 300_000
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_repeat_words) for r in stats.text_stats(make_docs([(1, long), (2, f"{long} a b c d {long} a b c d"), (3, "one")])).collect()}
    assert got == {1: (1, 300_000, 0), 2: (10, 600_008, 10), 3: (1, 3, 0)}
