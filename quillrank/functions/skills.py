"""Skill sets as arrays: extraction, parsing, coverage, edits."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lexicon as lx
from .text import _c, bound, normalised, text_of


def extract(c: str | Column, lexicon: lx.Lexicon = lx.SKILLS) -> Column:
    """The canonical skills whose name or alias stands in the text as a whole word, sorted (F1).

    One alternation for each canonical name, all inside one projection: no row is shuffled. A name's expression is run only where
    one of its aliases is anywhere in the text, which is a plain search of bytes.
    """
    quote = lambda a: re.sub(r"([^\w\s])", r"\\\1", a.lower())

    def hit(t: Column, name: str) -> Column:
        names = sorted({name, *lexicon[name]}, key=lambda a: (-len(a), a))
        there = reduce(or_, [t.contains(a.lower()) for a in names])
        return F.when(there & t.rlike(rf"(?U)(?<!\w)(?:{'|'.join(map(quote, names))})(?!\w)"), F.lit(name))

    if not lexicon:
        return F.array().cast("array<string>")
    return bound(normalised(c), lambda t: F.array_compact(F.array(*[hit(t, name) for name in sorted(lexicon)])))


def normalise_skill(c: str | Column, lexicon: lx.Lexicon = lx.SKILLS) -> Column:
    """A single name's canonical form; other names in lower case."""
    got = extract(c, lexicon)
    return F.when(F.size(got) == 1, got[0]).otherwise(F.lower(F.trim(text_of(c))))


def _clean(a: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(a, lambda s: F.lower(F.trim(s))), lambda s: s != ""))


def parse_list(c: str | Column) -> Column:
    """A comma list as a set in lower case."""
    return _clean(F.split(text_of(c), ","))


def parse_any(c: str | Column) -> Column:
    """A JSON or Python list, or a list with , ; | between."""
    t = F.trim(text_of(c))
    as_json = F.from_json(F.replace(t, F.lit("'"), F.lit('"')), "array<string>")
    return _clean(F.coalesce(F.when(t.startswith("["), as_json), F.split(t, r"[,;|]")))


def parse_json(c: str | Column) -> Column:
    """A JSON list; null if it is none."""
    return F.from_json(text_of(c), "array<string>")


def confident_coverage(matched: Column, needed: Column, target: int = lx.CONFIDENCE_TARGET) -> Column:
    """Coverage, less where few skills are asked for: matched / need * min(1, need / target); 0 for none (M2)."""
    return F.when(needed > 0, matched / needed * F.least(F.lit(1.0), needed / F.lit(float(target)))).otherwise(0.0)


def skill_score(have: str | Column, need: str | Column, target: int = lx.CONFIDENCE_TARGET) -> Column:
    n = F.array_distinct(_c(need))
    return confident_coverage(F.size(F.array_intersect(n, _c(have))), F.size(n), target)


def details(have: str | Column, need: str | Column) -> Column:
    """(matched, missing), sorted (M3)."""
    n = F.array_distinct(_c(need))
    return F.struct(F.array_sort(F.array_intersect(n, _c(have))).alias("matched"), F.array_sort(F.array_except(n, _c(have))).alias("missing"))


def coverage(have: str | Column, need: str | Column) -> Column:
    """Share of what is needed (M5)."""
    n = F.array_distinct(_c(need))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(n, _c(have))), F.size(n)), F.lit(0.0))


def jaccard(a: str | Column, b: str | Column) -> Column:
    return F.size(F.array_intersect(_c(a), _c(b))) / F.greatest(F.lit(1), F.size(F.array_union(_c(a), _c(b))))


def role_coverage(have: str | Column, need: str | Column) -> Column:
    """Coverage of roles; fullstack holds both web layers, and any of the three is software too (M6)."""
    web = F.array(F.lit("backend"), F.lit("frontend"))
    own = F.when(F.array_contains(_c(have), "fullstack"), F.array_union(_c(have), web)).otherwise(_c(have))
    own = F.when(F.arrays_overlap(own, F.array_append(web, F.lit("fullstack"))), F.array_union(own, F.array(F.lit("software")))).otherwise(own)
    wanted = F.when(F.array_contains(_c(need), "fullstack"), F.array_union(F.array_remove(_c(need), "fullstack"), web)).otherwise(_c(need))
    return coverage(own, wanted)


def edited(auto: str | Column, removed: str | Column, added: str | Column) -> Column:
    """What was found, less what a person removed, with what they added."""
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_union(F.array_except(_c(auto), F.coalesce(_c(removed), none)), F.coalesce(_c(added), none)))


def edits(auto: str | Column, desired: str | Column) -> Column:
    """(added, removed, confirmed) that turn one set into the other."""
    a, d = _c(auto), _c(desired)
    return F.struct(F.array_sort(F.array_except(d, a)).alias("added"), F.array_sort(F.array_except(a, d)).alias("removed"), F.array_sort(F.array_intersect(d, a)).alias("confirmed"))


def three_way(need: str | Column, strong: str | Column, weak: str | Column) -> Column:
    """(matched, uncertain, missing) of the needed skills (U4)."""
    n = F.array_distinct(_c(need))
    return F.struct(
        F.array_sort(F.array_intersect(n, _c(strong))).alias("matched"),
        F.array_sort(F.array_except(F.array_intersect(n, _c(weak)), _c(strong))).alias("uncertain"),
        F.array_sort(F.array_except(F.array_except(n, _c(strong)), _c(weak))).alias("missing"),
    )
