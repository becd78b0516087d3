"""Scalar functions on golden rows, Russian and English."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillrank.functions import pii
from quillrank.functions import skills as sk
from quillrank.functions import text as tx
from quillrank.sources import io


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("text", "want"),
    [("Опыт Docker и k8s, Java Script", ["docker", "java", "kubernetes"]), ("mysql postgres", ["mysql", "postgresql"]), ("опыт sqlы", []), ("C++, C# and Node.js", ["c#", "c++", "javascript", "node.js"]), (None, [])],
)
def test_extract(spark, text, want):
    assert one(spark, text, sk.extract("t")) == want


def test_normalised_and_keys(spark):
    assert one(spark, "  A\t б\n\nC ", tx.normalised("t")) == "a б c"
    assert one(spark, "[EMAIL] Привет, МИР-2!", tx.deduplication_key("t")) == "привет мир 2"
    assert one(spark, "a b\n c", tx.compact("t")) == "abc"


def test_tokens(spark):
    assert one(spark, "C++ и .net, x", tx.search_tokens("t")) == ["c++", ".net"]
    assert one(spark, "ci/cd node.js -x", tx.pair_tokens("t")) == ["ci", "cd", "node.js", "x"]
    assert one(spark, "The Python 2024 разработка сервисов.", tx.report_tokens("t")) == ["python", "сервисов"]


def test_professional_text(spark):
    text = "Project X\nDescribe what you did\nDate of birth: 1990\nGitHub: foo\nPython a@b.co https://x.y/z"
    assert one(spark, text, tx.professional_text("t")).split() == ["python"]


def test_statements(spark):
    got = one(spark, "Знаю Python, но не знаю Go. Used SQL and have not used Docker\nx", tx.statements("t"))
    assert got == ["Знаю Python", "не знаю Go.", "Used SQL", "have not used Docker", "x"]


@pytest.mark.parametrize(
    ("text", "claimed", "required", "minimum", "status"),
    [
        ("Опыт работы: 3 года", 3.0, 3.0, 3.0, None),
        ("Опыт работы 3,5 лет 6 месяцев", 4.0, 3.5, None, "unknown"),
        ("with 5+ years of experience", 5.0, 5.0, 5.0, None),
        ("без опыта", None, 0.0, 0.0, "not_required"),
        ("до 3 лет", None, 3.0, None, "unknown"),
        ("от 2 лет", None, 2.0, 2.0, None),
        ("6 months", None, 6.0, None, "unknown"),
        ("", None, None, None, "not_specified"),
    ],
)
def test_years(spark, text, claimed, required, minimum, status):
    df = spark.createDataFrame([(text,)], "t string")
    r = df.select(tx.claimed_years("t").alias("c"), tx.required_years("t").alias("r"), tx.minimum_years("t").alias("m")).first()
    assert r.c == claimed
    assert (r.r, r.m.years, r.m.status) == (required, minimum, status)


def test_levels_and_roles(spark):
    assert one(spark, "Senior backend developer", tx.roles("t")) == ["backend"]
    assert one(spark, "software developer", tx.roles("t")) == ["software"]
    assert one(spark, "Middle/Senior, team lead", tx.seniority("t")) == [2, 3, 4]
    assert one(spark, "Бакалавр, затем магистр", tx.degree("t")) == 3
    assert one(spark, "ничего", tx.degree("t")) is None


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("mail me a.b@c.kz now", "mail me [EMAIL] now"),
        ("see https://x.y/z and www.a.b", "see [URL] and [URL]"),
        ("call +7 (701) 123-45-67", "call [PHONE]"),
        ("2019 - 2023 и 09.2022 - 06.2025", "2019 - 2023 и 09.2022 - 06.2025"),
        ("telegram @some_one", "telegram [CONTACT]"),
        ("M U R A T B E K K A R A\nтекст\nMURATBEKKARA", "[NAME]\nтекст\n[NAME]"),
        ("E X P E R I E N C E\nx", "E X P E R I E N C E\nx"),
        (None, ""),
    ],
)
def test_masks(spark, text, want):
    assert one(spark, text, pii.anonymised("t")) == want


def test_skill_arrays(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c", "d"], ["c"])], "have array<string>, need array<string>, weak array<string>")
    r = df.select(sk.skill_score("have", "need").alias("s"), sk.jaccard("have", "need").alias("j"), sk.three_way("need", "have", "weak").alias("w"), sk.edited("have", F.array(F.lit("a")), F.array(F.lit("z"))).alias("e")).first()
    assert r.s == pytest.approx(1 / 3 * 3 / 5) and r.j == pytest.approx(1 / 4)
    assert (r.w.matched, r.w.uncertain, r.w.missing) == (["b"], ["c"], ["d"]) and r.e == ["b", "z"]
    assert one(spark, "['A', 'b']", sk.parse_any("t")) == ["a", "b"] and one(spark, "a; B|c", sk.parse_any("t")) == ["a", "b", "c"]


def test_role_coverage(spark):
    df = spark.createDataFrame([(["fullstack"], ["backend", "software"])], "a array<string>, b array<string>")
    assert df.select(sk.role_coverage("a", "b").alias("v")).first().v == 1.0


def test_lines_chunks_numbers(spark):
    assert [tuple(x) for x in one(spark, "a\n\nбв", tx.numbered_lines("t"))] == [(1, 0, "a"), (2, 3, "бв")]
    text = "слово " * 400
    got = one(spark, text, tx.chunks("t", 100))
    assert all(c.end - c.start <= 100 and text[c.start : c.end] == c.text for c in got) and "".join(c.text for c in got).replace(" ", "") == text.replace(" ", "")
    assert one(spark, "x", tx.number_text(F.lit(1.5))) == "1,5" and one(spark, "x", tx.number_text(F.lit(2.0))) == "2"
    assert one(spark, "=1+1", tx.export_cell("t")) == "'=1+1"
    assert one(spark, "Опыт ПАЙТОН есть", tx.original_quote(F.lit("пайтон"), "t")) == "ПАЙТОН"
    assert one(spark, "a \r\nb\n\n\n\nc ", tx.cleaned("t")) == "a\nb\n\nc"


def test_csv_keeps_strings(spark, tmp_path):
    (tmp_path / "v.csv").write_text('﻿vacancy_id,title,text,skills\n001,NA,"line 1\nline ""2""", a \n', encoding="utf-8")
    r = io.read_csv(spark, str(tmp_path / "v.csv"), io.VACANCY).first()
    assert (r.vacancy_id, r.title, r.text, r.skills, r.city) == ("001", "NA", 'line 1\nline "2"', " a ", None)


def test_uploads(spark, tmp_path):
    import zipfile

    (tmp_path / "a.txt").write_text("резюме", encoding="utf-8")
    with zipfile.ZipFile(tmp_path / "b.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:r><w:t>один</w:t></w:r></w:p><w:p><w:r><w:t>два</w:t></w:r></w:p></w:document>')
    (tmp_path / "c.exe").write_bytes(b"x")
    got = {r.path.rpartition("/")[2]: r for r in io.read_uploads(spark, str(tmp_path)).collect()}
    assert got["a.txt"].text == "резюме" and got["b.docx"].text == "один\nдва" and got["c.exe"].error
    assert io.parse_vacancy("Должность: Dev\nГород: Алматы\nТребования: SQL\nGit\n") == {"title": "Dev", "city": "Алматы", "requirements": "SQL\nGit"}


def test_letters_that_lower_does_not_make_are_odd(spark):
    from quillrank import lexicon as lx

    patterns = [*lx.ROLES.values(), *(p for _, p in (*lx.SENIORITY, *lx.DEGREES)), *lx.TOTAL_YEARS, *lx.CONTACT_PARTS, lx.PERSONAL_LINE, lx.TEMPLATE_LINE, lx.NO_CLAIM, lx.NO_EXPERIENCE]
    letters = sorted({c for p in patterns for a in tx.anchors(p) for c in a})
    assert all("\\" not in c for c in letters)
    rows = spark.createDataFrame([(chr(i),) for i in range(1, 0x1F000) if not 0xD800 <= i < 0xE000], "c string")
    each = F.array(*[F.when(F.col("c").rlike("(?iU)^" + ("\\" + c if not c.isalnum() and c != " " else c) + "$"), F.lit(c)) for c in letters])
    got = rows.select("c", F.lower("c").alias("low"), F.col("c").rlike(tx.ODD).alias("odd"), F.explode(F.array_compact(each)).alias("as"))
    assert got.filter("low <> as and not odd").collect() == []


def test_patterns_run_only_where_an_anchor_stands(spark):
    assert set(tx.anchors(r"\bsales\b|продаж\w*|(?:java|c#)\s+(?:developer|dev)")) == {"sales", "продаж", "dev"}
    assert tx.anchors(r"\d+") is None and tx.anchors(r"a*|b") is None
    texts = ["Senior BACKEND developer", "бэкенд", "backenD of ſecurity", "tutor\nemail: a@b.cd\nDate of birth: 1990", "work experience: 3 years 6 months", "no experience", "DOKTOR", "", None, "ſenior İntern", "project x\nDescribe what you did\nrest"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = lambda p: tx.bound(tx.folded("t"), lambda x: tx.has(x, p))
    for p in ("backend|back.end|б[эе]к[эе]нд", "security|кибербезопас", r"\bsenior\b|\bsr\b", r"no experience", r"\bintern\b"):
        got = df.select(found(p).alias("has"), F.coalesce("t", F.lit("")).rlike("(?iU)" + p).alias("plain")).collect()
        assert [r.has for r in got] == [r.plain for r in got]
    assert [r.p for r in df.select(tx.professional_text("t").alias("p")).collect()][3] == "tutor\n " and df.select(tx.claimed_years("t").alias("y")).collect()[4].y == 3.5


def test_skills_are_found_in_a_text_that_is_normalised_once(spark):
    from quillrank.functions import skills as sk

    df = spark.createDataFrame([("Go  and\tC++",)], "t string").select(sk.extract("t", {"go": [], "c++": [], "and": []}).alias("s"))
    assert df.first().s == ["and", "c++", "go"]
    plan = df._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_replace") == 1
