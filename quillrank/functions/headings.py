"""Headings in spaced letters, made readable (F32)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Headings and phrases that occur in spaced letters.
PHRASES = (
    "SKILLS", "EXPERIENCE", "EDUCATION", "PROJECT", "PROJECTS", "LANGUAGE", "LANGUAGES", "SUMMARY", "PROFILE", "CONTACT", "CONTACTS",
    "CERTIFICATE", "CERTIFICATES", "CERTIFICATION", "CERTIFICATIONS", "COURSE", "COURSES", "ACHIEVEMENTS", "COMPETITIVE PROGRAMMING",
    "PROFILE SUMMARY", "PROJECT EXPERIENCE", "НАВЫКИ", "ОПЫТ", "ОБРАЗОВАНИЕ", "ПРОЕКТ", "ПРОЕКТЫ", "ЯЗЫК", "ЯЗЫКИ", "КОНТАКТЫ",
    "ДАҒДЫЛАР", "ТӘЖІРИБЕ", "БІЛІМ", "БІЛІМІ", "ЖОБА", "ЖОБАЛАР", "ТІЛ", "ТІЛДЕР", "ТЕХНИКАЛЫҚ", "КӘСІБИ ТҮЙІНДЕМЕ",
    "CONTACT PROFILE SUMMARY", "EDUCATION PROJECT EXPERIENCE", "БІЛІМІ КӘСІБИ ТҮЙІНДЕМЕ", "BACHELOR OF SCIENCE", "MASTER OF SCIENCE",
    "CYBERSECURITY STUDENT INTERN",
)
_JOINED = {p.replace(" ", ""): p for p in PHRASES}
LEAST = 4


def _letter(token: str) -> bool:
    return len(token) == 1 and token.isalpha()


def _known(piece: str) -> str | None:
    tokens = piece.split()
    return _JOINED.get("".join(tokens).upper()) if len(tokens) >= LEAST and all(map(_letter, tokens)) else None


def repaired(line: str) -> str:
    """A known heading joined, also where several stand with & | / between; else runs of four letters or more joined between real words."""
    body, indent = line.strip(), line[: len(line) - len(line.lstrip())]
    pieces = [x.strip() for x in re.split(r"([&|/])", body)]
    named = [p if i % 2 else _known(p) for i, p in enumerate(pieces)]
    if body and all(named):
        return indent + " ".join(named)
    tokens = body.split()
    if len(tokens) < LEAST + 1 or all(map(_letter, tokens)):
        return line
    out: list[str] = []
    at = 0
    while at < len(tokens):
        to = at
        while to < len(tokens) and _letter(tokens[to]):
            to += 1
        out += ["".join(tokens[at:to])] if to - at >= LEAST else tokens[at:to]
        out += tokens[to : to + 1]
        at = to + 1
    return indent + " ".join(out)


def repair(c: str | Column) -> Column:
    """A text with the headings of its lines repaired."""

    @F.udf("string")
    def run(text: str | None) -> str:
        return "\n".join(map(repaired, (text or "").split("\n")))

    return run(F.col(c) if isinstance(c, str) else c)
