"""Operators on small rows with results worked out by hand or by plain Python."""

from __future__ import annotations

import math
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillrank import lexicon as lx
from quillrank.functions import evidence as ev
from quillrank.functions import text as tx
from quillrank.operators import dedupe, grouping, metrics, ner, quality, ranking, retrieval, validation, workspace


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "sql sql git"), (2, "git"), (3, "java go")], "doc_id int, text string")
    q = spark.createDataFrame([(9, "SQL git git")], "q int, text string")
    got = {r.doc_id: r.lexical for r in retrieval.bm25(retrieval.build_index(docs, "doc_id", tx.pair_tokens("text")), retrieval.query_tokens(q, "q", tx.pair_tokens("text"))).collect()}
    avg, want = 2.0, {}
    for i, t in ((1, "sql sql git"), (2, "git")):
        tf = Counter(t.split())
        df = {"sql": 1, "git": 2}
        want[i] = sum(math.log(1 + (3 - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(t.split()) / avg)) for w in ("sql", "git") if w in tf)
    assert got == pytest.approx(want)


def test_ranks_break_ties_by_id_and_pools_do_not_leak(spark):
    rows = spark.createDataFrame([("q", i, 0.1 + 0.2 if i % 2 else 0.3) for i in range(200, 0, -1)], "query_id string, doc_id int, score double")
    top = retrieval.ranked(rows, ["query_id"], "score", ["doc_id"], 3).orderBy("rank").collect()
    assert [r.doc_id for r in top] == [1, 2, 3]
    assert retrieval.two_stage(rows, "score", 5).count() == 60 and retrieval.two_stage(rows, "score", 30).count() == 90


def test_distinct_sources(spark):
    rows = spark.createDataFrame([(1, i, f"h{i // 2}", 10.0 - i) for i in range(20)], "query_id int, doc_id int, source_hash string, score double")
    assert [r.doc_id for r in retrieval.distinct_source_top(rows).orderBy("rank").collect()] == [0, 2, 4, 6, 8]


def test_hybrid(spark):
    r = spark.createDataFrame([("r", ["a", "b"], [1.0, 0.0])], "resume_id string, skills array<string>, embedding array<double>")
    v = spark.createDataFrame([("001", ["a"], [0.6, 0.8]), ("NA", [], [-1.0, 0.0]), ("3", ["a", "b", "c", "d", "e"], [1.0, 0.0])], "vacancy_id string, skills array<string>, embedding array<double>")
    got = {x.vacancy_id: x for x in retrieval.hybrid_match(r, v).collect()}
    assert got["001"].hybrid_score == pytest.approx(0.4 * 0.2 + 0.6 * 0.6) and got["NA"].hybrid_score == 0 and got["3"].hybrid_score == pytest.approx(0.4 * 0.4 + 0.6)
    assert got["3"]["rank"] == 1 and got["3"].missing == ["c", "d", "e"]
    with pytest.raises(ValueError):
        retrieval.hybrid(F.lit(1), F.lit(1), 1.5)


def plain_ndcg(labels, scores, k=5):
    order = sorted(range(len(labels)), key=lambda i: -scores[i])
    groups, at, out = [], 0, 0.0
    for s in sorted({round(x, 9) for x in scores}, reverse=True):
        groups.append([labels[i] for i in order if round(scores[i], 9) == s])
    for g in groups:
        out += sum(sum(g) / len(g) / math.log2(r + 2) for r in range(at, min(at + len(g), k)))
        at += len(g)
    ideal = sum(x / math.log2(r + 2) for r, x in enumerate(sorted(labels, reverse=True)[:k]))
    return out / ideal if ideal else None


def test_ndcg_and_pairs(spark):
    rng = np.random.default_rng(0)
    data = {f"q{j}": ([int(x) for x in rng.integers(0, 4, 9)], [float(x) for x in rng.integers(0, 4, 9)]) for j in range(12)} | {"zero": ([0, 0], [1.0, 2.0]), "best": ([2, 1, 0], [3.0, 2.0, 1.0])}
    rows = spark.createDataFrame([(q, i, a, b) for q, (la, sc) in data.items() for i, (a, b) in enumerate(zip(la, sc, strict=True))], "query string, item int, label int, score double")
    for r in metrics.ndcg(rows).collect():
        want = plain_ndcg(*data[r["query"]])
        assert (r.ndcg is None) == (want is None) and (want is None or r.ndcg == pytest.approx(want))
    for r in metrics.pairwise(rows).collect():
        la, sc = data[r["query"]]
        credit = [1.0 if sc[a] > sc[b] else 0.5 if sc[a] == sc[b] else 0.0 for a in range(len(la)) for b in range(len(la)) if la[a] > la[b]]
        assert r.accuracy == pytest.approx(sum(credit) / len(credit)) and r.pairs == len(credit)
    s = metrics.summary(rows).first()
    assert s.queries == 14 and s.queries_without_ndcg == 1


def test_fit_recovers_order_and_keeps_weights_positive(spark):
    rng = np.random.default_rng(1)
    x = rng.random((60, 3))
    rows = spark.createDataFrame([(f"q{i % 6}", int(3 * (0.7 * a + 0.3 * b)), float(a), float(b), float(c)) for i, (a, b, c) in enumerate(x)], "query string, relevance int, a double, b double, c double")
    pairs = ranking.preference_pairs(rows, "query", ["a", "b", "c"])
    total = pairs.agg(F.sum("weight")).first()[0]
    assert total == pytest.approx(1.0)
    model, info = ranking.fit(pairs, ["a", "b", "c"], [1.0] * 3, l2=0.01)
    assert model.weights[0] > model.weights[1] > 0 and min(model.weights) >= 0 and info["iterations"] <= 3000
    scored = ranking.scored(rows.withColumn("role_compatibility", F.lit(1.0)).withColumn("experience_compatibility", F.lit(-0.5)), model)
    for r in scored.limit(5).collect():
        assert sum(c.contribution for c in r.contributions) == pytest.approx(r.raw_score) and r.score == pytest.approx(r.raw_score * 0.5)


def test_shortfall_policy(spark):
    cases = [(1.0, 0.5, -0.25, 0.5), (-1.0, 0.5, -0.25, -1.0), (1.0, 0.0, -0.25, 1.0), (1.0, 0.5, 0.25, 1.0), (1.0, 0.5, -2.0, 0.0)]
    df = spark.createDataFrame(cases, "raw double, role double, exp double, want double")
    for r in df.select("*", (F.col("raw") + ranking.shortfall(F.col("raw"), "role", "exp")["adjustment"]).alias("got")).collect():
        assert r.got == pytest.approx(r.want)


def test_folds_and_groups(spark):
    rows = spark.createDataFrame([(f"c{i}", f" Text {i // 2}" if i < 6 else f"t{i}") for i in range(10)], "cv_id string, cv_text string")
    got = {r.cv_id: r.candidate_group_id for r in grouping.candidate_groups(rows, spark.createDataFrame([("c8", "c9"), ("c9", "c0")], "a string, b string")).collect()}
    assert got["c0"] == got["c1"] == got["c8"] == got["c9"] and got["c2"] == got["c3"] != got["c0"] and len(set(got.values())) == 5
    assert {r.fold for r in ranking.folds(rows, "cv_id").collect()} == {0, 1, 2}


def test_components_of_a_long_chain(spark):
    nodes = spark.createDataFrame([(i,) for i in range(60)], "node int")
    edges = spark.createDataFrame([(i, i + 1) for i in range(49)], "a int, b int")
    got = {r.node: r.root for r in grouping.components(nodes, edges).collect()}
    assert got == {i: 0 if i < 50 else i for i in range(60)}


def test_duplicates(spark):
    base = [f"w{i}" for i in range(60)]
    texts = {1: " ".join(base), 2: " ".join(base).upper() + "!", 3: " ".join([*base[:58], "x", "y"]), 4: "other words here", 5: "", 6: " ".join(base[:30])}
    docs = spark.createDataFrame(list(texts.items()), "doc_id int, text string")
    got = {r.doc_id: (r.class_id, r.copies, r.links) for r in dedupe.near_duplicates(docs).collect()}
    assert got == {1: (1, 2, 1), 2: (1, 2, 1), 3: (3, 1, 1), 4: (4, 1, 0), 5: (5, 1, 0), 6: (6, 1, 0)}


def test_near_links_are_those_of_brute_force(spark):
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(40):
        w = list(base) if i % 2 else [f"v{rng.integers(0, 500)}" for _ in range(60)]
        for _ in range(int(rng.integers(0, 6))):
            w[int(rng.integers(0, len(w)))] = f"n{rng.integers(0, 99)}"
        rows.append((i, " ".join(w)))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    want = {(a, b) for a in sets for b in sets if a < b and sets[a] != sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    classes = {t: min(i for i, u in rows if u == t) for _, t in rows}
    want = {(a, b) for a, b in want if classes[dict(rows)[a]] == a and classes[dict(rows)[b]] == b}
    assert {(r.a, r.b) for r in dedupe.near_links(spark.createDataFrame(rows, "doc_id int, text string")).collect()} == want and want


def test_sequence_ratio(spark):
    rows = [(1, "python developer with sql"), (2, "python developer with sql!"), (3, "python developer with sq"), (4, "designer")]
    got = [(r.a, r.b, r.type) for r in dedupe.catalogue_duplicates(spark.createDataFrame(rows, "doc_id int, text string")).collect()]
    assert got[0] == (1, 2, "EXACT") and {(1, 3, "NEAR"), (2, 3, "NEAR")} <= set(got) and len(got) == 3
    df = spark.createDataFrame([("tide", "diet")], "a string, b string")
    assert df.select(dedupe.sequence_ratio("a", "b")).first()[0] == SequenceMatcher(None, "tide", "diet").ratio()


def test_spans(spark):
    text = "English B2, Bachelor Degree in Computer Science\nData Analyst, 3 years of experience; Apache Spark and teamwork"
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    got = ner.span_rows(docs, ner.annotate("text")).orderBy("start").collect()
    assert all(text[r.start : r.end] == r.text for r in got)
    found = {(r.label, r.text) for r in got}
    assert {("LANG", "English B2"), ("EXPERIENCE", "Data Analyst"), ("HARD_SKILL", "Apache Spark"), ("SOFT_SKILL", "teamwork")} <= found
    spans = ner.span_rows(docs, ner.annotate("text"))
    assert validation.bad_spans(spans, docs).count() == 0
    assert validation.bad_spans(spark.createDataFrame([(1, 1, 4, "ngl")], "doc_id int, start int, end int, text string"), docs).count() == 1
    assert ner.without_overlaps(spans, spans).count() == 0


def test_span_evaluation(spark):
    s = "doc_id int, start int, end int, label string"
    gold = spark.createDataFrame([(1, 0, 2, "A"), (1, 3, 5, "B"), (2, 0, 1, "A"), (3, 0, 1, "A")], s)
    pred = spark.createDataFrame([(1, 0, 2, "A"), (1, 3, 6, "B"), (2, 0, 1, "A")], s)
    got = {r.label: (r.tp, r.fp, r.fn) for r in ner.evaluate(gold, pred).collect()}
    assert got == {"A": (2, 0, 0), "B": (0, 1, 1), "OVERALL": (2, 1, 1)} and ner.missing_predictions(gold, pred).first().doc_id == 3


def test_evidence_reads_denials_roles_and_years(spark):
    sk = ev.Skills(lx.SKILLS)
    assert sk.sure("used python and sql") == {"python", "sql"} and not sk.sure("изучаю python") and not sk.sure("have not used docker")
    cv = ev.Resume(sk, "Backend developer. Python, SQL, Docker. Built backend services with Python and PostgreSQL.\nBackend developer 4 years.\nEnglish B2")
    vacancy = {"title": "Senior Backend Developer", "experience": "3 years", "requirements": "Python, SQL; желательно Kubernetes. English B1", "responsibilities": "", "text": ""}
    got = dict(zip(lx.FEATURES, ev.signals(cv, vacancy)["signals"], strict=True))
    assert got["required_skill_coverage"] == 1 and got["role_compatibility"] == 1 and got["experience_compatibility"] == 1 and got["language_compatibility"] == 1
    assert got["skill_coverage"] == pytest.approx(2 / 3) and got["demonstrated_skill_coverage"] == pytest.approx(1 / 2)
    df = spark.createDataFrame([(cv.source, *[vacancy[k] for k in ("title", "experience", "requirements", "responsibilities", "text")]), ("", *[""] * 5)], "cv string, a string, b string, c string, d string, e string")
    rows = df.select(ev.pair_signals()("cv", "a", "b", "c", "d", "e").alias("e")).collect()
    assert rows[0].e.signals == pytest.approx(list(got.values())) and rows[1].e.signals is None


def test_baseline_total(spark):
    row = {**dict.fromkeys(lx.FEATURES, 1.0), "hybrid_score": 0.8, "languages": 0.5, "minimum_status": None, "relevant_years": 3.0, "supported": True}
    df = spark.createDataFrame([row], ", ".join(f"{f} double" for f in lx.FEATURES) + ", hybrid_score double, languages double, minimum_status string, relevant_years double, supported boolean")
    assert ranking.baseline(df).first().baseline_score == pytest.approx(0.25 * 0.8 + 0.7 + 0.05 * 0.5)
    unknown = df.withColumn("minimum_status", F.lit("unknown"))
    assert ranking.baseline(unknown).first().baseline_score == pytest.approx(0.25 * 0.8 + 0.6 + 0.05 * 0.5)
    m = spark.createDataFrame([({"en": 4, "ru": 6}, {"en": 3})], "need map<string,int>, own map<string,int>")
    assert m.select(ranking.language_component(F.col("need"), F.col("own"), F.lit(1.0)).alias("v")).first().v == pytest.approx(-1 / 12)


def test_quality_and_quotas(spark):
    rows = spark.createDataFrame([(1, ""), (2, "x\nx\nx"), (3, "A B C D E\n" + "слово " * 80)], "id int, text string")
    got = {r.id: r for r in quality.report(rows, "id").collect()}
    assert got[1].problem_count == 2 and got[2].flag_duplicates and got[3].spaced_letter_sequences == 1 and got[3].problem_count == 1
    assert quality.label_quotas({"a": 1, "b": 90, "c": 92, "d": 30}, 50) == {"a": 0, "b": 21, "c": 22, "d": 7}


def test_workspace(spark):
    links = spark.createDataFrame([("s", "c1", "v1"), ("s", "c1", "v2"), ("s", "c2", "v1")], "session_id string, candidate_id string, vacancy_id string")
    reviews = spark.createDataFrame([("s", "v1", "c1", "hold"), ("s", "v2", "c1", "new")], "session_id string, vacancy_id string, candidate_id string, status string")
    new_links, new_reviews = workspace.replace_links(links, reviews, "s", "c1", spark.createDataFrame([("v2",), ("v3",)], "vacancy_id string"))
    assert {(r.candidate_id, r.vacancy_id) for r in new_links.collect()} == {("c1", "v2"), ("c1", "v3"), ("c2", "v1")}
    assert [r.vacancy_id for r in new_reviews.collect()] == ["v2"]
    put = workspace.put_review(reviews, links, spark.createDataFrame([("s", "v1", "c1", "shortlisted")], reviews.schema))
    assert {(r.vacancy_id, r.status) for r in put.collect()} == {("v1", "shortlisted"), ("v2", "new")}
    with pytest.raises(ValueError):
        workspace.put_review(reviews, links, spark.createDataFrame([("s", "v9", "c1", "new")], reviews.schema))
    left = workspace.delete({"links": links, "reviews": reviews}, ["vacancy_id"], spark.createDataFrame([("v1",)], "vacancy_id string"))
    assert left["links"].count() == 1 and left["reviews"].count() == 1 and workspace.clear({"l": links}, "s")["l"].count() == 0
    status = workspace.with_status(links, reviews, ["session_id", "vacancy_id", "candidate_id"])
    assert Counter(r.status for r in status.collect()) == {"hold": 1, "new": 2}


def test_validation(spark):
    rows = spark.createDataFrame([("001", "a"), ("001", "b"), (" x", "c"), ("", "d"), (None, "e")], "id string, text string")
    assert {(r.id, r.reason) for r in validation.bad_keys(rows, "id").collect()} == {("001", "repeated"), (" x", "untrimmed"), ("", "blank"), (None, "blank")}
    hashed = rows.withColumn("text_sha256", F.sha2("text", 256))
    assert validation.stale_hashes(hashed).count() == 0 and validation.stale_hashes(hashed.withColumn("text", F.lit("z"))).count() == 5
    with pytest.raises(validation.Invalid):
        validation.require_none(rows, "rows")
    with pytest.raises(validation.Invalid):
        validation.bounded("alpha", True, 0, 1)
    v = spark.createDataFrame([("1", [0.6, 0.8], "h"), ("2", [1.0, 0.1], "h")], "vacancy_id string, embedding array<float>, text_sha256 string")
    assert [r.vacancy_id for r in validation.bad_vectors(v).collect()] == ["2"]
    m = validation.manifest(v)
    assert validation.manifest_differences(m, validation.manifest(v.repartition(3))) == []
    assert "identity_hash" in validation.manifest_differences(m, validation.manifest(v.withColumn("text_sha256", F.lit("g"))))


def test_declared_baseline_from_texts(spark):
    from quillrank.functions import baseline as bl

    cv = "Backend Developer.\nОпыт backend-разработки 3 года.\nРазработал REST API на Python и Django.\nОптимизировал запросы PostgreSQL и разворачивал backend-сервисы с Docker.\nEnglish B1."
    good = ("Python Backend Developer", "Опыт backend-разработки от 2 лет", "Требуются Python, Django и PostgreSQL. English B1.", "", "")
    df = spark.createDataFrame([(cv, *good, 0.612), (cv, *good, 1.5), ("", *good, 0.5)], "cv string, a string, b string, c string, d string, e string, h double")
    got = [r.x for r in df.select(bl.pair_baseline()("cv", "a", "b", "c", "d", "e", "h").alias("x")).collect()]
    assert got[0].total == pytest.approx(0.903) and got[0].statuses == ["provided", *["match"] * 5] and got[1].total is None and got[2].total is None
    sk = ev.Skills(lx.SKILLS)
    assert bl.not_used(sk, "не использовал docker") == {"docker"} and not bl.not_used(sk, "used python, but not docker")
    vacancy = dict(zip(("title", "experience", "requirements", "responsibilities", "text"), good, strict=True))
    r = bl.assess(sk, cv + "\nНе использовал Django.", vacancy, 0.5, (2.0, None))
    assert r["conflicts"] == ["django"] and r["excluded"] and r["total"] < 0.9


def test_configurations(spark):
    from quillrank.operators import selection

    rng = np.random.default_rng(4)
    rows = []
    for c in range(9):
        for v in range(5):
            a, b = rng.random(2)
            rows.append((f"c{c}", f"v{v}", f"g{c}", int(3 * a), float(a), float(b), 1.0, 0.0))
    df = spark.createDataFrame(rows, "cv_id string, vacancy_id string, candidate_group_id string, relevance int, a double, b double, role_compatibility double, experience_compatibility double")
    got = selection.select_configuration(df, ["a", "b"], l2=(0.1, 1.0), hr=(0.5,), gaps=(False,))
    best = ranking.pick(got).first()
    assert got.count() == 2 and 0.5 < best.ndcg <= 1 and best.pairwise > 0.6
    model, _ = selection.train(df, ["a", "b"], 0.1, 0.5)
    assert model.weights[0] > model.weights[1]
    cases = ranking.scored(df, model).select(F.col("cv_id").alias("case"), F.col("vacancy_id").alias("id"), "relevance", "score")
    pairs = spark.createDataFrame([("c0", "v0", "v1")], "case string, higher string, lower string")
    r = selection.hr_benchmark(cases, pairs).first()
    assert r.strict + r.ties + r.wrong == 1 and r.queries == 9


def test_headings():
    from quillrank.functions.headings import repaired

    golden = {
        "S K I L L S": "SKILLS", "P R O F I L E S U M M A R Y": "PROFILE SUMMARY", "C E R T I F I C A T E S & L A N G U A G E S": "CERTIFICATES & LANGUAGES",
        "B a c h e l o r of S c i e n c e": "Bachelor of Science", "Python, Java, C#": "Python, Java, C#", "M U R A T B E K K A R A K O Z": "M U R A T B E K K A R A K O Z", "": "",
        "Ж О Б А Л А Р": "ЖОБАЛАР", "C Y B E R S E C U R I T Y S T U D E N T I N T E R N": "CYBERSECURITY STUDENT INTERN",
    }
    assert {k: repaired(k) for k in golden} == golden


def test_two_columns_are_read_one_after_the_other(spark):
    from quillrank.operators import layout

    boxes = [("d", 1, 600.0, 40.0, 20.0, 560.0, 40.0, "Name")]
    for i in range(6):
        boxes += [("d", 1, 600.0, 40.0, 60.0 + 20 * i, 260.0, 74.0 + 20 * i, f"left {i}"), ("d", 1, 600.0, 320.0, 60.0 + 20 * i, 560.0, 74.0 + 20 * i, f"right {i}")]
    boxes += [("d", 2, 600.0, 40.0, 20.0 + 20 * i, 560.0, 34.0 + 20 * i, f"line {i}") for i in range(3)]
    df = spark.createDataFrame(boxes, "document_id string, page int, width double, x0 double, y0 double, x1 double, y1 double, text string")
    got = {r.page: r for r in layout.pages(df).collect()}
    assert got[1].columns == 2 and got[1].text.split("\n") == ["Name", "", *[f"left {i}" for i in range(6)], "", *[f"right {i}" for i in range(6)]]
    assert got[2].columns == 1 and got[2].text == "line 0\nline 1\nline 2"


def test_answers_quote_the_vacancy(spark):
    from quillrank.operators import assistant

    fields = ("Dev", "Требуется Python. English B2.", "Работа в офисе, график 5/2", "", None, "Алматы", "3 года", "Acme")
    asked = ["Какая зарплата?", "Где работа?", "Есть удалёнка?", "Какой уровень языка?", "Нужен ли Docker?", "Что за офисе требуется?", "zzzz"]
    df = spark.createDataFrame([(q, *fields) for q in asked], "question string, title string, requirements string, responsibilities string, text string, salary string, city string, experience string, company string")
    got = {r.question: r for r in assistant.answers(df).collect()}
    assert (got[asked[0]].topic, got[asked[0]].value) == ("salary", None) and (got[asked[1]].topic, got[asked[1]].value) == ("location", "Алматы")
    assert got[asked[2]].topic == "employment" and got[asked[2]].quotes == ["Работа в офисе, график 5/2"]
    assert got[asked[3]].topic == "languages" and got[asked[3]].quotes == ["English B2."] and got[asked[4]].topic == "requirements" and got[asked[6]].topic == "unknown"


def test_answers_about_a_score(spark):
    from quillrank.operators import assistant

    schema = "question string, resume_text string, skills array<string>, weak_skills array<string>, score double, contributions array<struct<feature:string,value:double,contribution:double>>, required array<string>, missing array<string>, uncertain array<string>, relevant_years double, required_years double, topic_of string"
    terms = [("a", 1.0, 0.1), ("b", 1.0, -0.7), ("c", 0.0, 0.0), ("d", 1.0, 0.7), ("e", 1.0, 0.3), ("f", 1.0, 0.2)]
    good = "Built Python services with FastAPI for a bank. " * 5
    full = ("resume", ["python"], [], 1.25, terms, ["sql", "git", "python"], ["sql", "java"], ["git"], 1.0, 3.0, "x")
    rows = [
        ("Why this score?", good, *full[1:]),
        ("How to improve?", good, *full[1:]),
        ("How to improve?", "Изучаю python", None, ["python"], 0.5, None, None, None, None, None, 2.0, "y"),
        ("How to improve?", good, ["python"], None, 1.0, terms, ["python"], [], [], 5.0, 3.0, "fine"),
        ("How to improve?", good, ["python"], None, None, None, None, None, None, None, None, "not compared"),
        ("How to improve?", None, None, None, None, None, None, None, None, None, None, "none"),
        ("Why this score?", None, None, None, None, None, None, None, None, None, None, "none"),
        ("Какая зарплата?", good, *full[1:]),
        (None, good, *full[1:]),
    ]
    got = assistant.score_answers(spark.createDataFrame(rows, schema)).collect()
    assert (got[0].topic, got[0].value, [c.feature for c in got[0].largest], got[0].lacking, got[0].advice) == ("score", "+1,25", ["b", "d", "e", "f"], ["git", "sql"], [])
    assert got[1].advice == ["show_missing", "check_years"] and got[1].value is None and got[1].lacking == ["git", "sql"]
    assert got[2].advice == ["name_skills", "describe_tasks", "separate_practice", "add_context", "state_role_years"]
    assert got[3].advice == ["describe_tasks"] and got[4].advice == ["compare"] and got[5].advice == got[6].advice == ["choose_resume"]
    assert got[6].value is None and got[7].topic == "salary" and got[7].advice is None and got[7].lacking is None and got[8].topic == "source"
    assert {a for g in got for a in g.advice or []} <= set(assistant.ADVICE) and got[0].topic_of == "x"


def test_near_links_by_places_are_those_of_brute_force_with_copies_and_short_texts(spark):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(12)]
    rows = [(i, " ".join([*base[: int(rng.integers(3, 12))], *(f"e{rng.integers(0, 3)}" for _ in range(int(rng.integers(0, 3))))])) for i in range(60)]
    rows += [(60, None), (61, "one"), (62, "ONE!"), (63, "w0 w1")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    key = {i: " ".join("".join(c if c.isalnum() else " " for c in (t or "").lower()).split()) for i, t in rows}
    first = {k: min(i for i in key if key[i] == k) for k in key.values() if k}
    sets = {i: {tuple(k.split()[j : j + 5]) for j in range(len(k.split()) - 4)} or {k} for k, i in first.items()}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert {(r.a, r.b) for r in dedupe.near_links(docs).collect()} == want and want
    assert "regexp_replace" not in dedupe.near_links(docs)._jdf.queryExecution().analyzed().toString()
    assert "regexp_replace" not in dedupe.exact_classes(docs)._jdf.queryExecution().analyzed().toString()


def test_fit_of_rows_is_that_of_their_pairs_and_makes_none(spark):
    rng = np.random.default_rng(4)
    rows = []
    for q in range(4):
        for _ in range(30):
            a, b, c = (float(v) for v in rng.normal(size=3) * (1, 3, 0.5))
            rows.append((f"q{q}", int(np.clip(round(a - 0.5 * c + rng.normal()), 0, 3)), a, b, c))
    rows += [("alone", 1, 9.0, 9.0, 9.0), (None, 2, 1.0, 1.0, 1.0), ("q0", None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "query string, relevance int, a double, b double, c double")
    slow, _ = ranking.fit(ranking.preference_pairs(df, "query", ["a", "b", "c"]), ["a", "b", "c"], [1.0] * 3, l2=0.01, iterations=20_000)
    model, info = ranking.fit_rows(df, ["a", "b", "c"], [1.0] * 3, l2=0.01)
    assert np.abs(np.subtract(model.weights, slow.weights)).max() < 1e-6 and max(model.weights) > 0.5 and info["queries"] == 4
    assert ranking.fit_rows(df.filter("query = 'alone'"), ["a"], [1.0])[0].weights == (0.0,)


def test_near_duplicates_write_and_keep_no_texts_nor_sets_of_what_met_nothing(spark, monkeypatch):
    words = [f"w{i}" for i in range(4000)]
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(rng.choice(words, 200))) for i in range(60)]
    near = rows[3][1].split()
    near[100] = "other"
    rows += [(70, " ".join(near)), (71, rows[3][1].upper()), (71, rows[3][1].upper()), (70, " ".join(near)), (72, None), (73, "")]
    tables = {}

    def kept(df, name, put=dedupe.written):
        tables[name] = put(df, name)
        return tables[name] if name != "dup-sets" else tables.setdefault("sets", spark.createDataFrame(tables[name].collect(), df.schema))

    monkeypatch.setattr(dedupe, "written", kept)
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    got = {r.doc_id: (r.class_id, r.copies, r.links) for r in dedupe.near_duplicates(docs).collect()}
    assert got[3] == (3, 3, 1) and got[70] == (70, 2, 1) and got[71] == (3, 3, 1) and got[72] == got[73] == (72, 2, 0) and got[0] == (0, 1, 0) and len(got) == 64
    assert {r.node for r in tables["sets"].collect()} == {x for r in tables["dup-links"].collect() for x in (r.a, r.b)}
    assert not any("key" in t.columns for t in tables.values())
    assert [(r.a, r.b) for r in dedupe.near_links(docs).collect()] == [(3, 70)]
