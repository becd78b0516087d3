from __future__ import annotations

import hashlib
import re

from pyspark.sql import functions as F

from quillrank.llm import fill_in_middle as fim

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    d = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, n, "plain", None, None, text
    p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 80:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_digests_against_brute_force(make_docs, odd_texts):
    strange = ["\x01\x02\x02d\x01e \x02e", "a\x01 b\x02 c", "trailing \n\t ", " \x0b ", "< P> <", "has <M> in it", "<P", " no break \u0085x", "😀 emoji 😀😀 \x1c end", "$0 \\1 $", "<S <P <M"]
    rows = odd_texts + [(1000 + i, t) for i, t in enumerate(strange * 24)] + [(2000 + i, "word " * (i % 7) + "end") for i in range(120)]
    got = fim.digests(make_docs(rows, extra=True)).collect()
    want = []
    for i, t in rows:
        *head, out = brute(i, t)
        want.append((*head, hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert {r.form for r in got} == {"plain", "psm", "spm"} and any(r.prefix_chars == 0 for r in got)
    assert fim.digests(make_docs([])).count() == 0


def test_texts_and_parameters(make_docs):
    rows = [(i, f"one two\tthree {i}\n\nfour ") for i in range(40)]
    out = fim.fill_in_middle(make_docs(rows), rate=100, spm_share=0, seed=7).collect()
    assert all(r.form == "psm" and r.prefix + r.middle + r.suffix == dict(rows)[r.doc_id] for r in out)
    assert len({(r.prefix, r.middle) for r in out}) > 10
    assert {r.form for r in fim.fill_in_middle(make_docs(rows), rate=0).collect()} == {"plain"}
    back = fim.fill_in_middle(make_docs(rows)).select("doc_id", fim.restored(F.col("output"), F.col("form")).alias("t")).collect()
    assert {r.doc_id: r.t for r in back} == dict(rows)
