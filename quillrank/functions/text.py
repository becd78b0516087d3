"""Text as Column expressions. Patterns carry (?U): words, spaces and case are those of Unicode."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache, reduce
from operator import or_
from re import _constants as rx
from re import _parser

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import lexicon as lx


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_of(c: str | Column) -> Column:
    return F.coalesce(_c(c).cast("string"), F.lit(""))


def normalised(c: str | Column) -> Column:
    """Lower case, one space for each run of white space, none at the ends (F2)."""
    return F.trim(F.regexp_replace(F.lower(text_of(c)), r"(?U)\s+", " "))


#: Characters that (?iU) takes for a letter which ``lower`` does not make of them.
ODD = r"[\x{130}-\x{212b}&&[\x{130}\x{131}\x{17f}\x{1c80}-\x{1c88}\x{212a}\x{212b}]]"


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once for a row, however often ``f`` uses it: inside a function with a lambda no common part is shared otherwise."""
    return F.transform(F.array(c), f)[0]


def folded(c: str | Column) -> Column:
    """A text with what :func:`has` looks at."""
    t = text_of(c)
    return F.struct(t.alias("text"), F.lower(t).alias("low"), t.rlike(ODD).alias("odd"))


@cache
def anchors(pattern: str) -> tuple[str, ...] | None:
    """Strings in lower case one of which stands in whatever a pattern matches; none where the pattern does not tell."""

    def worth(found: set[str]) -> tuple[int, int]:
        return min(map(len, found)), -len(found)

    def of(parts) -> set[str] | None:
        best, run = [], ""
        for op, value in [*parts, (None, None)]:
            if op is rx.LITERAL:
                run += chr(value)
                continue
            best += [{run.lower()}] if run else []
            run = ""
            inner = []
            if op is rx.SUBPATTERN:
                inner = [of(value[-1])]
            elif op in (rx.MAX_REPEAT, rx.MIN_REPEAT, rx.POSSESSIVE_REPEAT) and value[0] > 0:
                inner = [of(value[-1])]
            elif op is rx.BRANCH:
                each = [of(b) for b in value[1]]
                inner = [set().union(*each) if None not in each else None]
            best += [x for x in inner if x]
        return max(best, key=worth, default=None)

    found = of(_parser.parse(pattern))
    return tuple(sorted(found)) if found else None


def may_have(x: Column, *patterns: str) -> Column:
    """False only where a folded text has none of the patterns."""
    words: list[str] = []
    for p in patterns:
        own = anchors(p)
        if own is None:
            return F.lit(True)
        words += own
    return reduce(or_, [x["low"].contains(w) for w in dict.fromkeys(words)], x["odd"])


def has(x: Column, pattern: str) -> Column:
    """Whether a folded text has a pattern, without regard to case. The pattern is run only where one of its anchors stands, a plain search of bytes."""
    return may_have(x, pattern) & x["text"].rlike("(?iU)" + pattern)


def compact(c: str | Column) -> Column:
    """Without white space."""
    return F.regexp_replace(text_of(c), r"(?U)\s+", "")


def deduplication_key(c: str | Column) -> Column:
    """Lower-case letters and digits of the three alphabets, placeholders dropped."""
    bare = F.regexp_replace(F.lower(text_of(c)), r"\[(email|phone|url|contact)\]", " ")
    # nested, so that the first test is the one that most characters pass; in one list a character goes through all of them
    kept = ["a-z", "0-9", "а-я", *"ёәіңғүұқөһ"]
    return F.trim(F.regexp_replace(bare, "[^" + "[".join(kept) + "]" * len(kept) + "+", " "))


def search_tokens(c: str | Column) -> Column:
    """Tokens of two characters or more, in lower case (F9); over professional_text for resumes."""
    return F.regexp_extract_all(F.lower(text_of(c)), F.lit(r"(?U)[\w+#.]{2,}"), F.lit(0))


def pair_tokens(c: str | Column) -> Column:
    """Tokens that begin with a word character."""
    return F.regexp_extract_all(F.lower(text_of(c)), F.lit(r"(?U)\w[\w+#.\-]*"), F.lit(0))


def report_tokens(c: str | Column, stop_words: list[str] | None = None) -> Column:
    """Tokens for frequency reports: no stop words, numbers or single characters."""
    found = F.regexp_extract_all(F.lower(text_of(c)), F.lit(r"[a-zа-яёәіңғүұқөһ0-9][a-zа-яёәіңғүұқөһ0-9+#.\-/]*"), F.lit(0))
    bare = F.transform(found, lambda t: F.regexp_replace(t, r"\.+$", ""))
    stop = F.array(*[F.lit(w) for w in (lx.STOP_WORDS if stop_words is None else stop_words)])
    return F.filter(bare, lambda t: (F.length(t) >= 2) & ~F.array_contains(stop, t) & ~t.rlike(r"(?U)^\d+$"))


def professional_text(c: str | Column) -> Column:
    """Without contacts and personal lines, in lower case; a template's instruction takes the project line before it away."""

    def step(kept: Column, x: Column) -> Column:
        n, line = F.size(kept), x["text"]
        instead = F.when((n > 0) & F.element_at(kept, -1).rlike("(?iU)project|проект"), F.slice(kept, 1, F.greatest(n - 1, F.lit(0)))).otherwise(kept)
        cleaned = line
        for part in lx.CONTACT_PARTS:
            cleaned = F.regexp_replace(cleaned, "(?U)" + part, " ")
        cleaned = F.when(may_have(x, *lx.CONTACT_PARTS), cleaned).otherwise(line)
        normal = F.when(has(x, lx.PERSONAL_LINE), kept).otherwise(F.concat(kept, F.array(cleaned)))
        return F.when(has(x, lx.TEMPLATE_LINE), instead).otherwise(normal)

    lines = F.transform(F.split(text_of(c), r"\R"), folded)
    return F.lower(F.array_join(F.aggregate(lines, F.array().cast("array<string>"), step), "\n"))


def statements(c: str | Column) -> Column:
    """Spans of a text that make one claim each."""
    parts = F.transform(F.split(text_of(c), "(?iU)" + lx.STATEMENT_CUT), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", ""))
    return F.filter(parts, lambda s: s != "")


def detected(c: str | Column, patterns: dict[str, str]) -> Column:
    """The names whose pattern is found."""
    return bound(folded(c), lambda x: F.array_compact(F.array(*[F.when(has(x, p), F.lit(k)) for k, p in patterns.items()])))


def roles(c: str | Column) -> Column:
    """Roles; the general one only where it is alone."""
    return bound(detected(c, lx.ROLES), lambda got: F.when(F.size(got) > 1, F.array_remove(got, "software")).otherwise(got))


def seniority(c: str | Column) -> Column:
    """Levels from 0 to 4."""
    return bound(folded(c), lambda x: F.array_compact(F.array(*[F.when(has(x, p), F.lit(n)) for n, p in lx.SENIORITY])))


def degree(c: str | Column) -> Column:
    """The highest degree, from 1 to 4."""
    return bound(folded(c), lambda x: F.greatest(*[F.when(has(x, p), F.lit(n)) for n, p in lx.DEGREES]))


def _number(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit(".")).try_cast("double")


def _bounded(years: Column) -> Column:
    return F.when((years >= 0) & (years <= 100), years)


def claimed_years(c: str | Column) -> Column:
    """The total years a text claims (F16)."""
    first, second = ("(?iU)" + p for p in lx.TOTAL_YEARS)

    def years(x: Column) -> Column:
        t = x["text"]
        months = F.coalesce(_number(F.regexp_extract(t, first, 2)), F.lit(0.0)) / 12
        out = F.when(has(x, lx.TOTAL_YEARS[0]), _bounded(_number(F.regexp_extract(t, first, 1)) + months))
        return out.when(may_have(x, lx.TOTAL_YEARS[1]), _bounded(_number(F.regexp_extract(t, second, 1))))

    return bound(folded(c), years)


def required_years(c: str | Column) -> Column:
    """The first number, or none for a text that asks for no experience."""
    return bound(folded(c), _required)


def _required(x: Column) -> Column:
    number = bound(_number(F.regexp_extract(x["text"], r"(?U)\d+(?:[.,]\d+)?", 0)), _bounded)
    return F.when(has(x, lx.NO_EXPERIENCE), F.lit(0.0)).otherwise(number)


def minimum_years(c: str | Column) -> Column:
    """(years, status): upper bounds, months and numbers without a unit are unknown."""
    unknown = F.struct(F.lit(None).cast("double").alias("years"), F.lit("unknown").alias("status"))

    def minimum(x: Column) -> Column:
        upper = has(x, r"\bдо\s+\d|\bup\s+to\b|\bat\s+most\b|не\s+более") & ~has(x, r"\bот\s+\d|\bfrom\s+\d|\bat\s+least\b|не\s+менее")
        units = has(x, r"months?|месяц") | ~has(x, r"\byears?\b|\bлет\b|\bгод\w*")
        value = _required(x)
        return (
            F.when(F.trim(x["text"]) == "", F.struct(F.lit(None).cast("double").alias("years"), F.lit("not_specified").alias("status")))
            .when(has(x, lx.NO_EXPERIENCE), F.struct(F.lit(0.0).alias("years"), F.lit("not_required").alias("status")))
            .when(upper | units | value.isNull(), unknown)
            .otherwise(F.struct(value.alias("years"), F.lit(None).cast("string").alias("status")))
        )

    return bound(folded(c), minimum)


def positive(c: str | Column) -> Column:
    """Whether a statement claims something."""
    return ~bound(folded(c), lambda x: has(x, lx.NO_CLAIM))


def mandatory_sentences(c: str | Column) -> Column:
    """Sentences of requirements that say so."""
    return F.filter(F.split(text_of(c), r"[;\n]|\.(?:\s|$)"), lambda s: s.rlike("обязател|mandatory|required|must"))


def spaced_letters(c: str | Column) -> Column:
    """Runs of four or more single letters with blanks between."""
    letter = r"[A-Za-zА-Яа-яӘәІіҢңҒғҮүҰұҚқӨөҺһ]"
    return F.regexp_count(text_of(c), F.lit(rf"(?U)\b(?:{letter}[ \t]+){{3,}}{letter}\b"))


def cleaned(c: str | Column) -> Column:
    """No NULs, \\n line ends, no trailing blanks, two newlines at most."""
    t = F.regexp_replace(F.regexp_replace(text_of(c), "\\x00", ""), r"\r\n?", "\n")
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]+(?=\n|$)", ""), r"\n{3,}", "\n\n")
    return F.regexp_replace(t, r"(?U)^\s+|\s+$", "")


def content_loss(raw: str | Column, clean: str | Column) -> Column:
    """The share of non-blank characters that cleaning lost."""
    a, b = F.length(compact(raw)), F.length(compact(clean))
    return F.greatest(F.lit(0.0), F.coalesce(F.try_divide(a - b, a), F.lit(0.0)))


def filled_lines(c: str | Column) -> Column:
    return F.filter(F.transform(F.split(text_of(c), r"\R"), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), lambda s: s != "")


def valid_resume(c: str | Column) -> Column:
    """20 to 60,000 characters, twelve of them letters."""
    t = text_of(c)
    return F.length(t).between(20, 60_000) & t.rlike(r"^(?:\P{L}*+\p{L}){12}")


def numbered_lines(c: str | Column) -> Column:
    """(line, start, text) of the lines with content, start in code points."""
    lines = F.split(text_of(c), "\n")
    start = F.aggregate(
        lines,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<line:int,start:int,text:string>>").alias("out")),
        lambda acc, s: F.struct(
            (acc["at"] + F.length(s) + 1).alias("at"),
            F.concat(acc["out"], F.when(F.trim(s) != "", F.array(F.struct((F.size(acc["out"]) + 1).alias("line"), acc["at"].alias("start"), s.alias("text")))).otherwise(F.array())).alias("out"),
        ),
    )
    return start["out"]


def script_json(c: str | Column) -> Column:
    """JSON that can stand inside a script element."""
    out = _c(c)
    for char, safe in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026"), (" ", "\\u2028"), (" ", "\\u2029")):
        out = F.replace(out, F.lit(char), F.lit(safe))
    return out


def hex_id(prefix: str, n: int, *parts: str | Column) -> Column:
    """A prefix and n hex digits of the parts' SHA-256."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat(*[text_of(p) for p in parts]), 256), 1, n))


def original_quote(quote: str | Column, source: str | Column) -> Column:
    """The quote in the source's own case; null if it is not there."""
    q, s = text_of(quote), text_of(source)
    at = F.call_function("locate", F.lower(q), F.lower(s))
    return F.when((q != "") & (at > 0), F.substr(s, at, F.length(q)))


def export_cell(c: str | Column) -> Column:
    """A cell that no spreadsheet takes for a formula."""
    t = text_of(c)
    return F.when(t.rlike(r"^\s*[=+\-@]|^[\t\r]"), F.concat(F.lit("'"), t)).otherwise(t)


def number_text(c: str | Column, digits: int = 3, signed: bool = False) -> Column:
    """A number with a decimal comma and no trailing zeros."""
    v = F.round(_c(c).cast("double"), digits)
    shown = F.regexp_replace(F.format_string(f"%.{digits}f", v), r"\.?0+$" if digits else r"$^", "")
    shown = F.when(shown == "-0", "0").otherwise(shown)
    return F.replace(F.concat(F.when((v > 0) & F.lit(signed), "+").otherwise(""), shown), F.lit("."), F.lit(","))


def profile(c: str | Column, families: dict[str, str]) -> Column:
    """The first family whose pattern is found."""
    out = None
    for name, pattern in families.items():
        on = text_of(c).rlike("(?iU)" + pattern)
        out = F.when(on, name) if out is None else out.when(on, name)
    return F.lit("other") if out is None else out.otherwise("other")


#: Offsets of a text's chunks.
CHUNKS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("text", T.StringType())]))


def cut_points(text: str, most: int) -> list[tuple[int, int]]:
    """Spans of at most ``most`` characters that end after a newline, else a blank, else anywhere; blank spans are left out."""
    out, at = [], 0
    while at < len(text):
        end = min(at + most, len(text))
        if end < len(text):
            for mark in ("\n", " "):
                if (found := text.rfind(mark, at + 1, end)) > at:
                    end = found + 1
                    break
        a, b = at, end
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            out.append((a, b))
        at = end
    return out


def chunks(c: str | Column, most: int = 1000) -> Column:
    """A text in chunks for a model of bounded input, with offsets."""

    @F.udf(CHUNKS)
    def run(text: str | None) -> list[tuple[int, int, str]]:
        return [(a, b, text[a:b]) for a, b in cut_points(text or "", most)]

    return run(_c(c))
