"""Workspace tables: candidates, vacancies, links and reviews, as joins; changes as new tables.

A table is never changed in place. Each operation returns what the table is afterwards, to be written
beside the old one and swapped, or merged where the table format can.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_status(rows: DataFrame, reviews: DataFrame, on: list[str]) -> DataFrame:
    """Review status onto a shortlist, 'new' where there is none."""
    return rows.join(reviews.select(*on, "status"), on, "left").withColumn("status", F.coalesce("status", F.lit("new")))


def shortlist_order(rows: DataFrame, query: list[str], k: int | None = None) -> DataFrame:
    """By score (to 6 digits), skill score, id (L2)."""
    out = rows.withColumn("score", F.round("score", 6)).withColumn("rank", F.row_number().over(Window.partitionBy(*query).orderBy(F.desc("score"), F.desc("skill_score"), "candidate_id")))
    return out if k is None else out.filter(F.col("rank") <= k)


def linked_ids(candidates: DataFrame, links: DataFrame) -> DataFrame:
    """Candidates with the sorted ids of their vacancies."""
    own = links.groupBy("candidate_id").agg(F.array_sort(F.collect_set("vacancy_id")).alias("vacancy_ids"))
    return candidates.join(own, "candidate_id", "left").withColumn("vacancy_ids", F.coalesce("vacancy_ids", F.array().cast("array<string>")))


def candidates_for(candidates: DataFrame, links: DataFrame, vacancies: DataFrame) -> DataFrame:
    """Candidates linked to any of the vacancies (J12): two semi-joins, no row twice."""
    return candidates.join(links.join(vacancies, "vacancy_id", "left_semi"), "candidate_id", "left_semi")


def unassigned(candidates: DataFrame, links: DataFrame) -> DataFrame:
    return candidates.join(links, "candidate_id", "left_anti")


def live_reviews(reviews: DataFrame, links: DataFrame, candidates: DataFrame) -> DataFrame:
    """Reviews whose link and candidate still are."""
    return reviews.join(links, ["session_id", "vacancy_id", "candidate_id"], "left_semi").join(candidates, ["session_id", "candidate_id"], "left_semi")


def migrated_links(reviews: DataFrame, candidates: DataFrame, vacancies: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Links that old reviews imply: their candidate is known, and their vacancy is one's own or the catalogue's."""
    own = vacancies.select("session_id", "vacancy_id").withColumn("mine", F.lit(True))
    listed = catalogue.select("vacancy_id").distinct().withColumn("listed", F.lit(True))
    got = reviews.join(candidates, ["session_id", "candidate_id"], "left_semi").join(own, ["session_id", "vacancy_id"], "left").join(listed, "vacancy_id", "left")
    return got.filter(F.col("mine") | F.col("listed")).select("session_id", "candidate_id", "vacancy_id").distinct()


def public_vacancies(vacancies: DataFrame, accounts: DataFrame) -> DataFrame:
    """Vacancies of HR accounts, the newest first."""
    return vacancies.join(accounts.filter("role = 'hr'").select("session_id"), "session_id", "left_semi").orderBy(F.desc("created_at"), "vacancy_id")


def authenticated(tokens: DataFrame, accounts: DataFrame, now: int) -> DataFrame:
    """Accounts of tokens that have not expired."""
    return tokens.filter(F.col("expires_at") > now).join(accounts, "account_id")


def union_sources(custom: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Custom and catalogue rows under one schema."""
    return custom.withColumn("is_custom", F.lit(True)).unionByName(catalogue.withColumn("is_custom", F.lit(False)), allowMissingColumns=True)


def upsert(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """The table with rows put in place of those of their keys (K1)."""
    return table.join(rows, key, "left_anti").unionByName(rows)


def replace_links(links: DataFrame, reviews: DataFrame, session: str, candidate: str, vacancy_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, reviews) after a candidate's set of vacancies is replaced; reviews of links that go go too (K2)."""
    own = (F.col("session_id") == session) & (F.col("candidate_id") == candidate)
    new = vacancy_ids.select(F.lit(session).alias("session_id"), F.lit(candidate).alias("candidate_id"), "vacancy_id").distinct()
    links = links.filter(~own).unionByName(new.select(*links.columns))
    kept = reviews.filter(own).join(new, ["session_id", "candidate_id", "vacancy_id"], "left_semi").select(*reviews.columns)
    return links, reviews.filter(~own).unionByName(kept)


def delete(tables: dict[str, DataFrame], key: list[str], gone: DataFrame) -> dict[str, DataFrame]:
    """Every table that has the key, without the rows of ``gone`` (K3)."""
    return {k: t.join(gone, key, "left_anti") if set(key) <= set(t.columns) else t for k, t in tables.items()}


def put_review(reviews: DataFrame, links: DataFrame, rows: DataFrame) -> DataFrame:
    """Reviews with these put in; those without a link are refused (K4)."""
    key = ["session_id", "vacancy_id", "candidate_id"]
    if rows.join(links, key, "left_anti").limit(1).count():
        raise ValueError("a review needs a link")
    return upsert(reviews, rows, key)


def clear(tables: dict[str, DataFrame], session: str) -> dict[str, DataFrame]:
    """All tables without a session's rows (K5)."""
    return {k: t.filter(F.col("session_id") != session) for k, t in tables.items()}


def counts(rows: DataFrame, **conditions: str) -> DataFrame:
    """One row of conditional counts."""
    return rows.agg(*[F.count_if(F.expr(c)).alias(k) for k, c in conditions.items()])


def cities(rows: DataFrame, field: str) -> DataFrame:
    """Distinct non-blank values in order."""
    return rows.select(F.trim(field).alias(field)).filter(F.col(field) != "").distinct().orderBy(field)


def recent(rows: DataFrame, key: str, order: str, n: int = 6) -> DataFrame:
    """The last n rows of each key."""
    return rows.withColumn("back", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter(F.col("back") <= n)


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    return recent(rows, key, order, 1).drop("back")


def question_history(questions: DataFrame, vacancy_id: str | None = None, candidate_id: str | None = None) -> DataFrame:
    """A history, of one vacancy or candidate if asked, newest first."""
    out = questions
    for name, value in (("vacancy_id", vacancy_id), ("candidate_id", candidate_id)):
        out = out if value is None else out.filter(F.col(name) == value)
    return out.orderBy(F.desc("created_at"))
