"""Masking of personal data. Order matters: names, mail, links, phones, handles, then white space."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c, text_of

# What each mask covers.
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
LINKS = (r"https?://\S+", r"\bwww\.\S+", r"\b(?:github\.com|linkedin\.com)/\S+")
HANDLE = r"(?<!\w)@[A-Za-z0-9_]{4,}"
PHONE = r"(?<!\w)\+?\d[\d \t()\-]{5,}\d(?!\w)"
_NOW = r"present|current|now|(?:по\s+)?настоящее\s+время"
_YEAR, _MONTH = r"(?:19|20)\d{2}", r"(?:0?[1-9]|1[0-2])"
DATES = tuple(rf"\s*{a}\s*[-–—]\s*(?:{a}|{_NOW})\s*" for a in (_YEAR, rf"{_MONTH}[./-]{_YEAR}", rf"{_YEAR}[./-]{_MONTH}"))
# Headings that are written in spaced letters and are no names.
HEADINGS = frozenset(
    "SKILLS EXPERIENCE EDUCATION PROJECT PROJECTS LANGUAGE LANGUAGES SUMMARY PROFILE CONTACT CONTACTS CERTIFICATE CERTIFICATES "
    "CERTIFICATION CERTIFICATIONS COURSE COURSES ACHIEVEMENTS REFERENCES COMPETITIVEPROGRAMMING CONTACTPROFILESUMMARY "
    "EDUCATIONPROJECTEXPERIENCE BACHELOROFSCIENCE MASTEROFSCIENCE PROFILESUMMARY PROJECTEXPERIENCE CYBERSECURITYSTUDENTINTERN "
    "НАВЫКИ ОПЫТ ОБРАЗОВАНИЕ ПРОЕКТ ПРОЕКТЫ ЯЗЫК ЯЗЫКИ КОНТАКТЫ "
    "ДАҒДЫЛАР ТӘЖІРИБЕ БІЛІМ БІЛІМІ ЖОБА ЖОБАЛАР ТІЛ ТІЛДЕР ТЕХНИКАЛЫҚ КӘСІБИТҮЙІНДЕМЕ БІЛІМІКӘСІБИТҮЙІНДЕМЕ".split()
)
HEADER_LINES, LEAST_LETTERS, LEAST_SHARE = 5, 8, 0.9


def mask_email(c: str | Column) -> Column:
    return F.regexp_replace(text_of(c), EMAIL, "[EMAIL]")


def mask_links(c: str | Column) -> Column:
    out = text_of(c)
    for p in LINKS:
        out = F.regexp_replace(out, "(?i)" + p, "[URL]")
    return out


def mask_handles(c: str | Column) -> Column:
    return F.regexp_replace(text_of(c), "(?U)" + HANDLE, "[CONTACT]")


def tidy(c: str | Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(text_of(c), r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return F.regexp_replace(t, r"(?U)^\s+|\s+$", "")


def is_phone(run: str) -> bool:
    """10 to 15 digits that are no range of dates."""
    return 10 <= sum(ch.isdigit() for ch in run) <= 15 and not any(re.fullmatch(p, run.strip(), re.I) for p in DATES)


def mask_phones_in(text: str) -> str:
    return re.sub(PHONE, lambda m: "[PHONE]" if is_phone(m[0]) else m[0], text)


def mask_names_in(text: str) -> str:
    """Mask a name in spaced letters in the header, and wherever it stands again (F8)."""
    lines, names = text.split("\n"), []
    for i in [k for k, line in enumerate(lines) if line.strip()][:HEADER_LINES]:
        tokens = lines[i].split()
        letters = [t for t in tokens if len(t) == 1 and t.isalpha()]
        name = "".join(letters).upper()
        if len(letters) >= LEAST_LETTERS and len(letters) >= LEAST_SHARE * len(tokens) and name not in HEADINGS:
            names.append(name)
            lines[i] = "[NAME]"
    text = "\n".join(lines)
    for name in names:
        text = re.sub(rf"(?<!\w){r'[ \t]*'.join(map(re.escape, name))}(?!\w)", "[NAME]", text, flags=re.I)
    return text


def _series(f):
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: f(t) if isinstance(t, str) else "")

    return run


def mask_phones(c: str | Column) -> Column:
    return _series(mask_phones_in)(_c(c))


def mask_names(c: str | Column) -> Column:
    return _series(mask_names_in)(_c(c))


def anonymised(c: str | Column) -> Column:
    """All masks in their order (F6); null gives the empty text."""
    return tidy(mask_handles(mask_phones(mask_links(mask_email(mask_names(c))))))


def counts(c: str | Column) -> Column:
    """How many mail addresses, links and handles a text has."""
    t = text_of(c)
    return F.struct(
        F.regexp_count(t, F.lit(EMAIL)).alias("emails"),
        F.regexp_count(t, F.lit("(?i)" + LINKS[0])).alias("links"),
        F.regexp_count(mask_email(t), F.lit("(?U)" + HANDLE)).alias("handles"),
    )
