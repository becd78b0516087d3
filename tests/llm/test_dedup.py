"""Substring and suffix-array dedup against brute force."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest

from quillrank.llm import substring_dedup, suffix_dedup, winnow
from quillrank.llm import text as tx

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_words(rows):
    first: dict[tuple, int] = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - 49):
            if i is not None:
                first[tuple(w[k : k + 50])] = min(i, first.get(tuple(w[k : k + 50]), i))
    out = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        for k in range(len(w) - 49):
            if i is not None and first[tuple(w[k : k + 50])] < i:
                gone |= set(range(k, k + 50))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def brute_bytes(rows):
    times: dict[bytes, int] = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    for _, b in data:
        for k in range(len(b) - 399):
            times[b[k : k + 400]] = times.get(b[k : k + 400], 0) + 1
    out = []
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 399):
            if times[b[k : k + 400]] > 1:
                gone[k : k + 400] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int), [0]])) == 1).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_substring_dedup_is_exact(make_docs, odd_texts):
    got = substring_dedup.dedup(make_docs(odd_texts, extra=True), digest=True).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == brute_words(odd_texts)


def test_substring_dedup_keeps_text(make_docs, odd_texts):
    got = {r.doc_id: r.kept for r in substring_dedup.dedup(make_docs(odd_texts)).collect()}
    assert got[4] == "one" and got[1] == "" and got[44].endswith("tail")


@pytest.mark.parametrize("shard", [1 << 20, 6000])
def test_suffix_dedup_is_exact_in_one_shard_and_spread(make_docs, odd_texts, monkeypatch, shard):
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", shard)
    got = suffix_dedup.dedup(make_docs(odd_texts, extra=True), digest=True).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == brute_bytes(odd_texts)


def test_suffix_dedup_text_keeps_rows_and_columns(make_docs, odd_texts):
    docs = make_docs(odd_texts, extra=True)
    got = suffix_dedup.dedup_text(docs)
    assert got.columns == docs.columns and got.count() == len(odd_texts)
    texts = {r.doc_id: r.text for r in got.collect()}
    assert texts[4] == "one" and texts[40] == ""


def test_empty_tables(make_docs):
    empty = make_docs([])
    assert substring_dedup.dedup(empty).count() == 0
    assert suffix_dedup.dedup(empty).count() == 0
    assert suffix_dedup.dedup_text(empty).count() == 0


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(0)
    for trial in range(60):
        n = int(rng.integers(1, 300))
        b = rng.integers(1, 4 if trial % 2 else 250, n).astype(np.uint8)
        if n > 20:
            b[n // 2 : n // 2 + n // 3] = b[: n // 3]
        sa, _ = suffix_dedup.suffix_array(b, 512)
        order = sorted(range(n), key=lambda i: bytes(b[i:]))
        assert sa.tolist() == order
        lcp = suffix_dedup.common_prefixes(b, sa, 40, n - np.arange(n))
        for at, (i, j) in enumerate(zip(order[1:], order[:-1], strict=True), 1):
            k = 0
            while k < 40 and max(i, j) + k < n and b[i + k] == b[j + k]:
                k += 1
            assert lcp[at] == k


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(1)
    passage = rng.integers(1, 1 << 40, 90).astype(np.uint64)
    seen = []
    for _ in range(5):
        h = np.concatenate([rng.integers(1, 1 << 40, int(rng.integers(5, 80))).astype(np.uint64), passage, rng.integers(1, 1 << 40, 30).astype(np.uint64)])
        doc, p, n, anchor, _ = winnow.runs(tx.mixed(h), np.array([0, len(h)]), 50, 16)
        at = {int(k): int(a) for q, m, a in zip(p, n, anchor, strict=True) for k in range(q, q + m)}
        assert sorted(at) == list(range(len(h) - 49))
        start = len(h) - 120
        seen.append([at[start + k] for k in range(41)])
    assert all(s == seen[0] for s in seen)


def test_prefixes_where_suffixes_stay_tied():
    rng = np.random.default_rng(2)
    wrong = 0
    for _ in range(40):
        # near copies that share over 512 bytes and then differ, among windows that agree with them by chance
        common = rng.integers(97, 99, 700).astype(np.uint8)
        parts = [np.concatenate([common[int(rng.integers(0, 60)) :], rng.integers(97, 99, 500).astype(np.uint8)]) for _ in range(6)]
        end = np.cumsum([len(x) + 1 for x in parts]) - 1
        begin = end - [len(x) for x in parts]
        buf = np.concatenate([y for x in parts for y in (x, np.array([suffix_dedup.END], np.uint8))])
        at, group, _ = suffix_dedup.shard_groups(buf, begin, end, np.ones(len(parts), np.int64))
        windows: dict[int, set] = {}
        for p, g in zip(at.tolist(), group.tolist(), strict=True):
            windows.setdefault(g, set()).add(bytes(buf[p : p + suffix_dedup.WINDOW]))
        wrong += any(len(w) > 1 for w in windows.values())
        assert len(windows) == len(set().union(*windows.values()))
    assert not wrong


def test_substring_dedup_takes_nothing_from_a_row_without_id(make_docs):
    a, b = (" ".join(f"{x}{i}" for i in range(90)) for x in "ab")
    rows = [(1, a[:-4] + " tail"), (5, a + " " + b), (None, a + " " + b), (9, b)]
    got = substring_dedup.dedup(make_docs(rows), digest=True).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == brute_words(rows)


def thue_morse(n, a, b):
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def test_hashes_of_spans_are_no_sums_of_powers(make_docs):
    words = [thue_morse(10, chr(97 + i), chr(98 + i)) for i in range(20)]
    data = "".join(w for pair in words for w in pair).encode()
    at = np.arange(0, len(data), 1024)
    assert len(set(tx.span_hashes(np.frombuffer(data, np.uint8), at, at + 1024).tolist())) == 40
    rows = [(1, "A " + " ".join(w[0] for w in words * 3)), (2, "B " + " ".join(w[1] for w in words * 3))]
    got = substring_dedup.dedup(make_docs(rows), digest=True).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == brute_words(rows) and not any(r.n_removed for r in got)


def test_span_hashes_depend_on_bytes_alone():
    rng = np.random.default_rng(8)
    data = rng.integers(97, 100, 4000).astype(np.uint8)
    spans = [(int(a), int(a + n)) for a in rng.integers(0, 3800, 600) for n in (0, 1, 7, 8, 9, 63, 64, 65, 150)]
    h = tx.span_hashes(data, *np.array(spans).T)
    for start in (0, 5):
        moved = tx.span_hashes(np.concatenate([rng.integers(0, 255, start).astype(np.uint8), data]), *(np.array(spans).T + start))
        assert (moved == h).all()
    by_text = {}
    for (a, b), x in zip(spans, h.tolist(), strict=True):
        assert by_text.setdefault(data[a:b].tobytes(), x) == x
    assert len(set(by_text.values())) == len(by_text)


def test_suffix_dedup_of_another_window(make_docs, odd_texts):
    passage = " ".join(f"word{i}" for i in range(40))
    rows = [(1, "a first text " + passage + " and an end"), (2, passage), (3, "another " + passage[:240]), (4, passage[:90])]
    got = {r.doc_id: r.text for r in suffix_dedup.dedup_text(make_docs(rows), 250).collect()}
    assert got == {1: "a first text  and an end", 2: "", 3: rows[2][1], 4: rows[3][1]}


@pytest.mark.parametrize("shard", [1 << 20, 2000])
def test_windows_of_a_spread_anchor_are_found_across_shards(make_docs, monkeypatch, shard):
    """One passage shorter than a window in many surroundings, some of which come twice."""
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", shard)
    rng = np.random.default_rng(12)
    some = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    core, sides = some(300), [(some(200), some(200)) for _ in range(12)]
    rows = [(i, sides[i % 12][0][i * 3 % 40 :] + core + sides[(i * 5 + i // 12) % 12][1][: 150 + i]) for i in range(40)]
    got = suffix_dedup.dedup(make_docs(rows), digest=True).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == brute_bytes(rows)


def test_ranks_tie_where_windows_are_equal():
    """Ranks alone tell equal windows: they stop at the depth, not at the next power of two."""
    rng = np.random.default_rng(3)
    b = rng.integers(97, 99, 900).astype(np.uint8)
    b[500:] = b[:400]
    b[500 + 397] ^= 1
    for depth in (5, 8, 20, 100, 390):
        sa, rank = suffix_dedup.suffix_array(b, depth)
        at = np.arange(len(b) - depth)
        windows = [bytes(b[i : i + depth]) for i in at.tolist()]
        by_rank: dict[int, set] = {}
        for r, w in zip(rank[at].tolist(), windows, strict=True):
            by_rank.setdefault(r, set()).add(w)
        assert all(len(w) == 1 for w in by_rank.values()) and len(by_rank) == len(set(windows))


def test_only_what_is_still_read_stays_written(make_docs):
    """Tables go as soon as what reads them is written: of a dedup the repeated windows stay, of near copies their components."""
    from quillrank.llm import near_copies, storage

    passage = " ".join(f"word{i}" for i in range(120))
    docs = make_docs([(i, f"head{i} {passage} foot{i}") for i in range(6)])
    for run, last in ((suffix_dedup.dedup_text, "suffix-windows"), (near_copies.near_copies, "copies-components")):
        since = storage.mark()
        out = run(docs)
        left = [path.rpartition("/")[2] for _, path in storage._WRITTEN[since:]]
        assert len(left) == 1 and left[0].startswith(last)
        assert out.count() == 6
