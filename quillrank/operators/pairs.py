"""What stands behind a pair, and which pairs and columns may leave: evidence, semantic scores, admission, views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicon as lx

QUOTE, QUOTES = 400, 3


def best_evidence(sources: DataFrame, key: list[str]) -> DataFrame:
    """One source of each key (skill of a resume): certain before uncertain, then what HR confirmed, then the first."""
    order = Window.partitionBy(*key).orderBy("uncertain", F.col("source") != "hr", "place")
    return sources.withColumn("_turn", F.row_number().over(order)).filter("_turn = 1").drop("_turn")


def first_quotes(rows: DataFrame, key: list[str], k: int = QUOTES) -> DataFrame:
    """The first k quotes of each key by place, cut to QUOTE characters (L10). ``rows``: key, place, quote."""
    order = Window.partitionBy(*key).orderBy("place")
    return rows.withColumn("turn", F.row_number().over(order)).filter(F.col("turn") <= k).withColumn("quote", F.substring("quote", 1, QUOTE))


def questions(uncertain: str, missing: str) -> Column:
    """Skills to ask about: two at most, uncertain ones first."""
    return F.slice(F.concat(F.col(uncertain), F.col(missing)), 1, 2)


def evidence_text(statements: Column, weak: Column, removed: Column, confirmed: Column, lexicon: lx.Lexicon) -> Column:
    """What a resume may be read for: its statements without names of weak or removed skills, then what HR confirmed.

    ``weak``, ``removed`` and ``confirmed`` are arrays of canonical names; one that is confirmed is not masked.
    """
    gone = F.array_except(F.array_union(weak, removed), confirmed)

    def masked(s: Column) -> Column:
        out = s
        for name in sorted(lexicon):
            names = sorted({name, *lexicon[name]}, key=lambda a: (-len(a), a))
            pattern = rf"(?iU)(?<!\w)(?:{'|'.join(_quoted(a) for a in names)})(?!\w)"
            out = F.when(F.array_contains(gone, name), F.regexp_replace(out, pattern, " ")).otherwise(out)
        return out

    return F.array_join(F.concat(F.transform(statements, masked), confirmed), "\n")


def _quoted(name: str) -> str:
    return "".join(c if c.isalnum() or c.isspace() else "\\" + c for c in name)


def prefiltered(vacancies: DataFrame, semantic: DataFrame) -> DataFrame:
    """Semantic scores (vacancy_id, semantic) onto a catalogue (J20): a listed row without one goes; a custom row, of which there
    is no vector, keeps its baseline, bounded by a third of it and 1."""
    out = vacancies.join(semantic, "vacancy_id", "left").filter(F.col("is_custom") | F.col("semantic").isNotNull())
    return out.withColumn("prefilter", F.coalesce("semantic", F.least(F.lit(1.0), F.col("baseline") / 3)))


class StaleIndex(ValueError):
    """An index is not that of the rows it is asked about."""


def whole_index(rows: DataFrame, index: DataFrame, key: str = "vacancy_id") -> DataFrame:
    """:func:`guarded`, but only of an index made from just these rows: one that is missing, left over, there twice, or whose
    text has changed since refuses the index as a whole (J2)."""
    own, there = (df.groupBy(key).agg(F.count(F.lit(1)).alias(f"_{s}"), F.min("text_sha256").alias(f"_{s}_sha")) for df, s in ((rows, "rows"), (index, "index")))
    both = own.withColumnRenamed(key, "_key").join(there, F.col("_key").eqNullSafe(F.col(key)), "full_outer")
    good = (F.col("_rows") == 1) & (F.col("_index") == 1) & (F.col("_rows_sha") == F.col("_index_sha"))
    if bad := both.filter(~F.coalesce(good, F.lit(False))).count():
        raise StaleIndex(f"{bad} rows are not those of the index")
    return guarded(rows, index, key)


def guarded(rows: DataFrame, index: DataFrame, key: str = "vacancy_id") -> DataFrame:
    """Rows with the vectors of an index, by key and text hash; a row whose text has changed since has none (J2). See :func:`whole_index`."""
    return rows.join(index, [key, "text_sha256"])


def in_scope(rows: DataFrame, title: str, skills: str, pattern: str) -> DataFrame:
    """Rows of a trade: its roles in the text, or any skill."""
    return rows.filter(F.coalesce(F.col(title), F.lit("")).rlike("(?iU)" + pattern) | (F.size(skills) > 0))


def public(rows: DataFrame, names: list[str]) -> DataFrame:
    """The columns that may be shown, and no others; vacancy_ids are an empty list where there are none."""
    out = rows.select(*[n for n in names if n != "vacancy_ids"], *(["vacancy_ids"] if "vacancy_ids" in rows.columns else []))
    return out.withColumn("vacancy_ids", F.coalesce("vacancy_ids", F.array().cast("array<string>"))) if "vacancy_ids" in rows.columns else out


def usable(rows: DataFrame, length: str = "text_length") -> DataFrame:
    """Resumes with a text."""
    return rows.filter(F.col(length) > 0)


def with_group(rows: DataFrame, groups: DataFrame, key: str = "cv_id") -> DataFrame:
    """Rows with the candidate group of their CV."""
    return rows.join(groups.select(key, "candidate_group_id"), key)


def frozen(pairs: DataFrame, extra: list[str]) -> DataFrame:
    """What a split's file may hold: ids and targets, never texts (P11), in a fixed order."""
    names = [c for c in pairs.columns if c.endswith("_id") or c in extra]
    return pairs.select(*names).orderBy(*names)


def changed(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Keys whose row is not the same in both snapshots, or in one only (U9). Nulls are equal to nulls alone, and columns are taken by name."""
    a, b = (df.select(F.col(key), F.struct(*before.columns).alias(n)) for df, n in ((before, "_a"), (after, "_b")))
    return a.join(b, key, "full_outer").filter(~F.col("_a").eqNullSafe(F.col("_b"))).select(key)


#: A whole date, with or without a time of day of at least hours and minutes, and a zone.
ISO_TIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]{1,6})?)?(Z|[+-][0-9]{2}:[0-9]{2})?)?$"


def valid_times(rows: DataFrame, column: str) -> DataFrame:
    """Rows whose ISO date or timestamp is of that form, and is one (M19). A cast alone would take years, times of day and white space."""
    return rows.filter(F.col(column).rlike(ISO_TIME.replace("$", r"\z")) & F.regexp_replace(column, "^(.{16})(Z|[+-].*)?$", "$1:00$2").try_cast("timestamp").isNotNull())  # a cast asks for seconds before a zone
