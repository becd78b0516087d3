"""Reports on extracted texts: quality flags, coverage of skills, frequencies."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

SHORT, DUPLICATES, LOSS = 300, 0.30, 0.10
FLAGS = ("empty_text", "short_text", "spaced_letters", "duplicates", "content_loss")


def report(rows: DataFrame, key: str, final: str = "text", raw: str | None = None, clean: str | None = None) -> DataFrame:
    """Lengths, duplicate lines, spaced letters, content loss, five flags and their number.

    One projection over the text; nothing is shuffled.
    """
    out = rows.select(
        F.col(key),
        F.length(tx.text_of(final)).alias("final_length"),
        tx.spaced_letters(final).alias("spaced_letter_sequences"),
        tx.filled_lines(final).alias("_lines"),
        tx.content_loss(raw or final, clean or final).alias("content_loss_ratio"),
    )
    out = out.withColumn("duplicate_lines", F.size("_lines") - F.size(F.array_distinct("_lines")))
    out = out.withColumn("duplicate_ratio", F.coalesce(F.try_divide("duplicate_lines", F.size("_lines")), F.lit(0.0))).drop("_lines")
    flags = [
        F.col("final_length") == 0, F.col("final_length") < SHORT, F.col("spaced_letter_sequences") > 0,
        F.col("duplicate_ratio") > DUPLICATES, F.col("content_loss_ratio") > LOSS,
    ]
    out = out.select("*", *[c.alias(f"flag_{n}") for n, c in zip(FLAGS, flags, strict=True)])
    return out.withColumn("problem_count", reduce(add, [F.col(f"flag_{n}").cast("int") for n in FLAGS]))


def suspicious(report_rows: DataFrame, key: str) -> DataFrame:
    """Rows with problems, the worst first."""
    return report_rows.filter("problem_count > 0").orderBy(F.desc("problem_count"), F.desc("content_loss_ratio"), F.desc("duplicate_ratio"), F.desc("spaced_letter_sequences"), key)


def skill_coverage(rows: DataFrame, skills: str = "skills") -> DataFrame:
    """total, with_skills, share_percent, mean."""
    n = F.size(skills)
    return rows.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(n > 0).alias("with_skills"), (100.0 * F.avg((n > 0).cast("double"))).alias("share_percent"), F.avg(n.cast("double")).alias("mean_skills"),
    )


def by_skills(rows: DataFrame, skills: str = "skills") -> tuple[DataFrame, DataFrame]:
    """(rows with skills, rows without) (P5)."""
    return rows.filter(F.size(skills) > 0), rows.filter(F.size(skills) == 0)


def most_common(rows: DataFrame, values: Column, k: int = 30) -> DataFrame:
    """value, n of the k most frequent array elements, ties by value (A7). Exact: partial counts, then one small ordered take."""
    return rows.select(F.explode(values).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(k)


def seeded_sample(rows: DataFrame, key: str, n: int = 20, seed: int = 42) -> DataFrame:
    """n rows in the order of a hash, the same on every run."""
    return rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def histograms(rows: DataFrame, columns: list[str]) -> DataFrame:
    """column, value, n of several columns in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))
    return rows.select(pairs.alias("p")).groupBy("p.column", "p.value").agg(F.count(F.lit(1)).alias("n"))


def label_quotas(counts: dict[str, int], n: int) -> dict[str, int]:
    """Seats by largest remainder, no more than there are."""
    total = sum(counts.values())
    if n > total or n < 0:
        raise ValueError("no more seats than rows")
    exact = {k: n * v / total for k, v in counts.items()} if total else {}
    out = {k: int(v) for k, v in exact.items()}
    for k in sorted(exact, key=lambda k: (-(exact[k] - out[k]), k))[: n - sum(out.values())]:
        out[k] += 1
    return out
