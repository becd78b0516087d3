"""Constraints as queries: each returns the rows that break it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Invalid(ValueError):
    """A table that breaks a constraint."""


def require_none(rows: DataFrame, what: str) -> None:
    if found := rows.limit(3).collect():
        raise Invalid(f"{what}: {found}")


def bad_keys(rows: DataFrame, key: str) -> DataFrame:
    """key, n, reason: null, blank, with outer white space, or there twice (V1)."""
    k = F.col(key).cast("string")
    reason = F.when(k.isNull() | (F.trim(k) == ""), "blank").when(k != F.trim(k), "untrimmed").when(F.col("n") > 1, "repeated")
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).withColumn("reason", reason).filter("reason is not null")


def stale_hashes(rows: DataFrame, text: str = "text", digest: str = "text_sha256", length: str | None = None) -> DataFrame:
    """Rows whose stored hash or length is not that of their text (V2)."""
    wrong = ~F.sha2(F.coalesce(F.col(text), F.lit("")), 256).eqNullSafe(F.col(digest))
    return rows.filter(wrong if length is None else wrong | ~F.length(text).eqNullSafe(F.col(length).cast("int")))


def manifest(rows: DataFrame, key: str = "vacancy_id", vector: str = "embedding", version: str = "1") -> DataFrame:
    """One row that an index must still match: rows, dimension, hashes of ids with texts and of the vectors."""
    one = F.sha2(F.concat_ws("|", F.col(key), "text_sha256"), 256)
    vec = F.sha2(F.to_json(F.struct(F.col(key).alias("k"), F.col(vector).alias("v"))), 256)
    return rows.agg(
        F.lit(version).alias("version"), F.count(F.lit(1)).alias("n"), F.min(F.size(vector)).alias("least_dim"), F.max(F.size(vector)).alias("dim"),
        F.hex(F.bit_xor(F.conv(F.substring(one, 1, 15), 16, 10).cast("long"))).alias("identity_hash"), F.hex(F.bit_xor(F.conv(F.substring(vec, 1, 15), 16, 10).cast("long"))).alias("matrix_hash"),
    )


def manifest_differences(stored: DataFrame, current: DataFrame) -> list[str]:
    """The manifest's fields that no longer hold; an index with any must not be used (V3)."""
    a, b = stored.first(), current.first()
    found = [c for c in current.columns if a is None or a[c] != b[c]]
    return found + (["ragged vectors"] if b["least_dim"] != b["dim"] else [])


def bad_vectors(rows: DataFrame, vector: str = "embedding", norm: float = 1e-4) -> DataFrame:
    """Vectors with a component that is no number, or not of length one."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return rows.filter(F.col(vector).isNull() | odd | (F.abs(length - 1) > norm))


def bad_spans(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """Spans (doc_id, start, end, text) that are not the text at their place, or cut a word (V4, V7)."""
    j = spans.join(docs.select("doc_id", F.col("text").alias("source")), "doc_id", "left")
    at = F.substr(F.col("source"), F.col("start") + 1, F.col("end") - F.col("start"))
    around = F.substr(F.col("source"), F.greatest(F.col("start"), F.lit(1)), F.when(F.col("start") > 0, 2).otherwise(0))
    tail = F.substr(F.col("source"), F.col("end"), F.lit(2))
    inside = lambda two: two.rlike(r"(?U)^\w\w$")
    bad = F.col("source").isNull() | (F.col("start") < 0) | (F.col("start") >= F.col("end")) | (at != F.col("text")) | inside(around) | inside(tail)
    return j.filter(F.coalesce(bad, F.lit(True))).select(*spans.columns)


def document_status(tasks: DataFrame, docs: DataFrame) -> DataFrame:
    """task_id, status of annotation tasks against the documents of today."""
    d = docs.select("document_id", F.col("text_sha256").alias("now_hash"), F.col("text_version").alias("now_version"))
    status = (
        F.when(F.col("document_id").isNull() | F.col("text_sha256").isNull(), "MISSING_METADATA")
        .when(F.col("now_hash").isNull(), "UNKNOWN_DOCUMENT")
        .when(F.col("text_version") != F.col("now_version"), "VERSION_MISMATCH")
        .when(F.col("text_sha256") != F.col("now_hash"), "HASH_MISMATCH")
        .otherwise("OK")
    )
    return tasks.join(d, "document_id", "left").select("task_id", status.alias("status"))


def bad_requirements(rows: DataFrame) -> DataFrame:
    """Requirements whose status and score or quote do not agree (V5)."""
    judged = F.col("status") != "not_assessed"
    wrong = (judged & F.col("score").isNull()) | (~judged & F.col("score").isNotNull()) | ((F.col("status") == "match") & (F.coalesce("cv_quote", F.lit("")) == ""))
    return rows.filter(F.coalesce(wrong, F.lit(True)))


def grounded(answers: DataFrame, lines: DataFrame) -> DataFrame:
    """Answers (doc_id, line) with the quote of the line they name; null where there is none (V6)."""
    return answers.join(lines.select("doc_id", "line", F.col("text").alias("quote")), ["doc_id", "line"], "left")


def wrong_pair_counts(pairs: DataFrame, n: int = 5) -> DataFrame:
    """CVs that do not have n pairs with n vacancies (V8)."""
    return pairs.groupBy("cv_id").agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("vacancy_id").alias("vacancies")).filter((F.col("pairs") != n) | (F.col("vacancies") != n))


def conflicting(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one value (V9)."""
    return rows.groupBy(key).agg(F.count_distinct(value).alias("values")).filter("values > 1")


def bounded(name: str, value: float, low: float, high: float) -> float:
    """A finite number within bounds; booleans are none."""
    if isinstance(value, bool) or not isinstance(value, int | float) or not low <= value <= high:
        raise Invalid(f"{name} lies in [{low}, {high}]")
    return value


def reserved_columns(rows: DataFrame, names: set[str]) -> None:
    """Refuse input that has a column the output makes."""
    if clash := names & set(rows.columns):
        raise Invalid(f"reserved columns: {sorted(clash)}")


def allowed_only(rows: DataFrame, names: list[str]) -> DataFrame:
    """Exactly these columns, else an error (P10)."""
    if sorted(rows.columns) != sorted(names):
        raise Invalid(f"columns must be {sorted(names)}")
    return rows.select(*names)


def consistent(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of both whose shared columns differ, null equal to null."""
    shared = [c for c in a.columns if c in b.columns and c != key]
    other = b.select(F.col(key), *[F.col(c).alias(f"_{c}") for c in shared])
    same: Column = F.lit(True)
    for c in shared:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return a.join(other, key).filter(~same).select(key)
