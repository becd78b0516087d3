"""Queries over whole studies: blind samples, frozen datasets, locked experiments, snapshots with nulls.

Labelled documents stand in for judged pairs: a document is a resume, its source the candidate it belongs to, and
its labels make the score.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import evidence
from ..functions import skills as sk
from ..llm.storage import written
from ..operators import blind_sample as blind
from ..operators import assistant, dedupe, experiment, freeze, grouping, pairs
from ..sources import npy
from .catalogue import RARE, WORDS, _found, bm25_distinct_source_top5, query, shared_folder, t

SAMPLE = 50

_JUDGED = """
SELECT CAST(d.doc_id AS VARCHAR) AS pair_id, d.source AS candidate_group_id, CAST(d.doc_id AS VARCHAR) AS cv_id, 'v' || (d.doc_id % 23) AS vacancy_id,
  CAST(l.quality + 2 * l.toxic AS INTEGER) AS overall_score, d.n_chars,
  CASE WHEN CAST('0x' || substr(sha256('42:' || d.source), 1, 8) AS BIGINT) % 100 < 60 THEN 'train'
       WHEN CAST('0x' || substr(sha256('42:' || d.source), 1, 8) AS BIGINT) % 100 < 80 THEN 'validation' ELSE 'test' END AS split
FROM documents d JOIN (SELECT doc_id, min(quality) AS quality, min(toxic) AS toxic FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL AND l.toxic IS NOT NULL"""


def judged(spark: SparkSession, d: str) -> DataFrame:
    docs = t(spark, d, "documents")
    labels = t(spark, d, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("toxic").alias("toxic")).dropna()
    h = F.conv(F.substring(F.sha2(F.concat(F.lit("42:"), "source"), 256), 1, 8), 16, 10).cast("long") % 100
    own_id = F.col("doc_id").cast("string")
    return docs.join(labels, "doc_id").select(
        own_id.alias("pair_id"), F.col("source").alias("candidate_group_id"), own_id.alias("cv_id"), F.concat(F.lit("v"), F.col("doc_id") % 23).alias("vacancy_id"),
        (F.col("quality") + 2 * F.col("toxic")).cast("int").alias("overall_score"), "n_chars", F.when(h < 60, "train").when(h < 80, "validation").otherwise("test").alias("split"), "text", "lang",
    )


def _to_review(spark: SparkSession, d: str) -> DataFrame:
    requirement = F.struct((F.col("n_chars") % 4).cast("int").alias("score"), F.when(F.col("n_chars") % 3 == 0, "EXPERIENCE").otherwise("SKILL").alias("category"))
    risks = blind.risks(F.array(requirement, F.struct(F.col("overall_score").alias("score"), F.lit("SKILL").alias("category"))), "text")
    return judged(spark, d).select("pair_id", F.col("overall_score").alias("label"), F.col("candidate_group_id").alias("group"), F.col("cv_id").alias("cv"), F.col("vacancy_id").alias("vacancy"), blind.families("text").alias("family"), "split", risks.alias("risks"))


@query(f"""
WITH c AS (SELECT overall_score AS label, count(*) AS n FROM ({_JUDGED}) GROUP BY 1),
w AS (SELECT * FROM (VALUES (0, 1), (1, 21), (2, 21), (3, 7)) AS w(label, weight)),
b AS (SELECT w.label, coalesce(n, 0) AS n, least(coalesce(n, 0), {SAMPLE} * weight // 50) AS base FROM w LEFT JOIN c ON c.label = w.label)
SELECT CAST(sum(CASE WHEN n > base THEN 0 ELSE 1 END) AS BIGINT) AS full_labels, CAST({SAMPLE} AS BIGINT) AS taken, CAST(0 AS BIGINT) AS over_cap, CAST(0 AS BIGINT) AS off_quota, CAST(0 AS BIGINT) AS twice FROM b""")
def blind_sample(spark: SparkSession, d: str) -> DataFrame:
    """A sample for blind review keeps its quotas and its cap (R21); the rows themselves are held in the tests against a plain greedy choice."""
    rows = written(_to_review(spark, d), "to-review")
    got = blind.blind_sample(rows, SAMPLE)
    per = got.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.first("quota").alias("quota"))
    off = per.agg(F.sum(F.abs(F.col("n") - F.col("quota"))).alias("off_quota"))
    over = got.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.first("cap").alias("cap")).agg(F.count_if(F.col("n") > F.col("cap")).alias("over_cap"))
    whole = got.agg(F.count(F.lit(1)).alias("taken"), (F.count(F.lit(1)) - F.count_distinct("pair_id")).alias("twice"))
    counts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    weights = spark.createDataFrame(sorted(blind.lx.REVIEW_WEIGHTS.items()), "w int, weight int")
    full = weights.join(counts, F.col("w") == F.col("label"), "left").agg(F.count_if(F.coalesce("n", F.lit(0)) <= F.floor(F.col("weight") * SAMPLE / 50)).alias("full_labels"))
    return full.crossJoin(whole).crossJoin(over).crossJoin(off).select("full_labels", "taken", "over_cap", "off_quota", "twice")


@query(f"""
SELECT pair_id, label, family, risks FROM (SELECT pair_id, overall_score AS label, CASE WHEN regexp_matches(lower(text), 'front|react|angular|vue|версталь') THEN 'has-front' ELSE 'none' END AS family,
  (CASE WHEN least(n_chars % 4, overall_score) = 0 AND greatest(n_chars % 4, overall_score) > 0 THEN 'mixed-known-unknown;' ELSE '' END) ||
  (CASE WHEN n_chars % 4 = 2 OR overall_score = 2 THEN 'partial-requirement;' ELSE '' END) ||
  (CASE WHEN n_chars % 3 = 0 AND n_chars % 4 IN (1, 2) THEN 'role-or-experience-shortfall;' ELSE '' END) AS risks
  FROM ({_JUDGED}) j JOIN (SELECT CAST(doc_id AS VARCHAR) AS id, text FROM documents WHERE trim(text) <> '') x ON x.id = j.pair_id)""")
def review_risks(spark: SparkSession, d: str) -> DataFrame:
    """What makes a pair worth a second look, and a family of its own text."""
    rows = _to_review(spark, d).join(judged(spark, d).filter("trim(text) <> ''").select(F.col("pair_id").alias("id"), F.lower("text").alias("low")), F.col("pair_id") == F.col("id"))
    pattern = dict(blind.lx.PROFILE_FAMILIES)["frontend"]
    return rows.select("pair_id", "label", F.when(F.col("low").rlike(pattern), "has-front").otherwise("none").alias("family"), F.concat(F.array_join("risks", ";"), F.when(F.size("risks") > 0, ";").otherwise("")).alias("risks"))


_COLUMNS = ["pair_id", "candidate_group_id", "cv_id", "vacancy_id", "overall_score", "n_chars"]
_FORM = " || ".join(f"CASE WHEN {c} IS NULL THEN 'N;' ELSE length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) || ';' END" for c in sorted(_COLUMNS))
_SUMS = " || '|' || ".join(f"CAST(sum(CAST('0x' || substr(h, {1 + 15 * k}, 15) AS BIGINT)) AS VARCHAR)" for k in range(4))


@query(f"""
WITH r AS (SELECT split, sha256({_FORM}) AS h FROM ({_JUDGED})),
p AS (SELECT split AS part, count(*) AS rows, sha256(CAST(count(*) AS VARCHAR) || '|' || {_SUMS}) AS digest FROM r GROUP BY split)
SELECT part, rows, digest, (SELECT sha256(string_agg(part || '=' || digest, ';' ORDER BY part || '=' || digest)) FROM p) AS whole, true AS same FROM p""")
def frozen_manifest(spark: SparkSession, d: str) -> DataFrame:
    """A frozen dataset: digests of its parts and of the whole, checked when it is read."""
    path = shared_folder(spark, "frozen")
    manifest = freeze.freeze(judged(spark, d).repartition(7), path, _COLUMNS)
    return freeze.compared(spark, path).select("part", "rows", "digest", F.lit(manifest["digest"]).alias("whole"), "same")


@query(f"SELECT pair_id, candidate_group_id, cv_id, vacancy_id, overall_score, n_chars, split FROM ({_JUDGED}) WHERE split = 'test'")
def locked_test_rows(spark: SparkSession, d: str) -> DataFrame:
    """The held-out rows, which open after a configuration is locked."""
    path = shared_folder(spark, "experiment")
    freeze.freeze(judged(spark, d), path, _COLUMNS)
    own = experiment.Experiment(spark, path, f"{path}/run")
    own.lock({"l2": 1.0, "hr_weight": 0.5, "grade_gap": False})
    return own.rows("test").select(*_COLUMNS, "split")


@query()
def locked_experiment(spark: SparkSession, d: str) -> DataFrame:
    """A configuration is fitted on train, locked, and only then measured on the held-out part, against other orders."""
    path = shared_folder(spark, "experiment")
    role, words = F.least(F.lit(1.0), F.length("text") / 5000), F.split("text", " ")
    # texts are read once: what is needed of them is written
    own = judged(spark, d).withColumn("relevance", F.col("overall_score")).withColumn("role_compatibility", role).withColumn("experience_compatibility", F.size(F.array_distinct(words)) / F.size(words)).drop("text", "lang")
    own = written(own, "experiment-rows")
    freeze.freeze(own, path, [*_COLUMNS, "relevance"])
    signals = own.select("pair_id", "role_compatibility", "experience_compatibility", (F.xxhash64("pair_id") % 5).alias("selection_rank"))
    signals = signals.withColumn("required_skill_coverage", F.col("experience_compatibility"))
    return experiment.train_then_test(experiment.Experiment(spark, path, f"{path}/run"), ["role_compatibility", "experience_compatibility"], signals, locked={"l2": 1.0, "hr_weight": 0.5, "grade_gap": False})


@query("""
WITH a AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS x, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS y FROM orders),
b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS x, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS y FROM orders)
SELECT a.k AS o_orderkey FROM a JOIN b ON a.k = b.k WHERE a.x IS DISTINCT FROM b.x OR a.y IS DISTINCT FROM b.y""")
def snapshots_with_nulls(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose values change places with nulls are not the same."""
    third, fifth = (F.when(F.col("o_orderkey") % k > 0, F.col("o_orderpriority")) for k in (3, 5))
    rows = t(spark, d, "orders")
    return pairs.changed(rows.select("o_orderkey", third.alias("x"), fifth.alias("y")), rows.select("o_orderkey", third.alias("y"), fifth.alias("x")), "o_orderkey")


_TIMES = ["strftime(o_orderdate, '%Y-%m-%d')", "strftime(o_orderdate, '%Y')", "strftime(o_orderdate, '%Y-%m-%dT10:00:00Z')", "strftime(o_orderdate, '%Y-%m-%d ')", "strftime(o_orderdate, '%Y-%m-%d') || 'T10:00+05:00'", "'T10:00:00'", "'2024-02-30'", "strftime(o_orderdate, '%Y-%m-%d %H:%M')"]


@query(f"""
SELECT o_orderkey, moment FROM (SELECT o_orderkey, o_orderkey % 8 AS k, CASE o_orderkey % 8 {' '.join(f'WHEN {i} THEN {x}' for i, x in enumerate(_TIMES))} END AS moment FROM orders) WHERE k IN (0, 2, 4, 7)""")
def times_of_orders(spark: SparkSession, d: str) -> DataFrame:
    """Dates of orders in forms that are ISO times and in forms that a cast alone would take."""
    day = F.col("o_orderdate").cast("date")
    forms = [F.date_format(day, "yyyy-MM-dd"), F.date_format(day, "yyyy"), F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T10:00:00Z")), F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" ")), F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T10:00+05:00")), F.lit("T10:00:00"), F.lit("2024-02-30"), F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" 00:00"))]
    at = F.element_at(F.array(*forms), (F.col("o_orderkey") % 8 + 1).cast("int"))
    return pairs.valid_times(t(spark, d, "orders").select("o_orderkey", at.alias("moment")), "moment")


@query("SELECT vec_id, len(embedding) AS dims FROM embeddings")
def whole_index(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of an index that is that of the rows, all of them."""
    index = t(spark, d, "embeddings").select("vec_id", F.sha2(F.col("vec_id").cast("string"), 256).alias("text_sha256"), "embedding")
    return pairs.whole_index(index.select("vec_id", "text_sha256"), index, "vec_id").select("vec_id", F.size("embedding").cast("long").alias("dims"))


@query(f"SELECT count(DISTINCT candidate_group_id) AS groups, count(*) AS pairs, CAST(0 AS BIGINT) AS torn, CAST(greatest(1, round(count(DISTINCT candidate_group_id) * 0.15)) AS BIGINT) AS test_groups FROM ({_JUDGED})")
def searched_split(spark: SparkSession, d: str) -> DataFrame:
    """The best of 1,024 shuffles of groups keeps its sizes and tears no group."""
    rows = judged(spark, d).drop("split").select("*", F.lit(True).alias("judged"), F.concat(F.lit("text of "), "cv_id").alias("cv_text"))
    got = grouping.split_groups(rows)
    torn = grouping.leaks(got).agg(F.count(F.lit(1)).alias("torn"))
    return got.agg(F.count_distinct("candidate_group_id").alias("groups"), F.count(F.lit(1)).alias("pairs"), F.count_distinct(F.when(F.col("split") == "test", F.col("candidate_group_id"))).alias("test_groups")).crossJoin(torn).select("groups", "pairs", "torn", "test_groups")


@query()
def quotes_of_pairs(spark: SparkSession, d: str) -> DataFrame:
    """What each signal of a pair rests on, as slices of the resume."""
    found = _found(bm25_distinct_source_top5(spark, d), t(spark, d, "documents").select("doc_id", F.col("text").alias("cv")))
    found = found.join(t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("demand")), "query_id")
    none = F.lit("")
    rows = found.select("query_id", "doc_id", "cv", F.explode(evidence.pair_quotes(RARE)("cv", F.lit("software developer"), none, "demand", none, none)).alias("q")).select("query_id", "doc_id", "q.*", "cv")
    return rows.select("query_id", "doc_id", "feature", "turn", "start", "end", "quote", (F.substring("cv", F.col("start") + 1, F.col("end") - F.col("start")) == F.col("quote")).alias("is_slice"))


_HAS = "list_filter([" + ", ".join(f"'{w}'" for w in sorted(WORDS)) + "], lambda w: regexp_matches(lower({}), '(^|[^\\pL\\pM\\pN_])' || w || '([^\\pL\\pM\\pN_]|$)'))"


@query(f"""
WITH s AS (SELECT doc_id, {_HAS.format("substr(text, 1 + length(text) // 2)")} AS strong, {_HAS.format("substr(text, 1, length(text) // 2)")} AS weak FROM documents),
q AS (SELECT doc_id, list_filter([{', '.join(f"'{w}'" for w in sorted(WORDS))}], lambda w: list_contains(weak, w) AND NOT list_contains(strong, w)) AS unsure,
  list_filter([{', '.join(f"'{w}'" for w in sorted(WORDS))}], lambda w: NOT list_contains(weak, w) AND NOT list_contains(strong, w)) AS missing FROM s)
SELECT doc_id, array_to_string(list_concat(unsure, missing)[1:2], ',') AS asked FROM q""")
def skills_asked_about(spark: SparkSession, d: str) -> DataFrame:
    """Skills to ask about: those only the first half of a text names, then those that neither does."""
    half = F.floor(F.length("text") / 2).cast("int")
    rows = t(spark, d, "documents").select("doc_id", sk.extract(F.substring(F.col("text"), half + 1, F.length("text")), WORDS).alias("strong"), sk.extract(F.substring(F.col("text"), F.lit(1), half), WORDS).alias("weak"))
    split = sk.three_way(F.array(*map(F.lit, sorted(WORDS))), "strong", "weak")
    return rows.select("doc_id", split.alias("s")).select("doc_id", F.array_join(pairs.questions("s.uncertain", "s.missing"), ",").alias("asked"))


@query()
def catalogue_near(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of different texts whose sequence ratio is 0.85 or more, best first (J5, M18, L8); held against all pairs in the tests."""
    return dedupe.catalogue_keys(t(spark, d, "documents")).orderBy(F.desc("similarity"), "a", "b")


@query("""
WITH f AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'score' ELSE 'improvement' END AS topic, doc_id % 5 > 0 AS known, n_chars,
  [{'n': 'size', 'x': n_chars / 1024}, {'n': 'rest', 'x': -(doc_id % 7)}, {'n': 'sign', 'x': doc_id % 3 - 1}, {'n': 'age', 'x': doc_id / 4096}, {'n': 'half', 'x': 0.5}] AS c,
  """ + _HAS.format("text") + """ AS has FROM documents)
SELECT doc_id, topic, CASE WHEN topic = 'score' AND known THEN replace(CASE WHEN n_chars > 0 THEN '+' ELSE '' END || regexp_replace(printf('%.3f', n_chars / 8.0), '\\.?0+$', ''), '.', ',') END AS value,
  CASE WHEN topic = 'score' AND known THEN array_to_string(list_transform(list_sort(list_transform(list_filter(c, lambda z: z.x <> 0), lambda z: {'a': -abs(z.x), 'p': list_position(['size', 'rest', 'sign', 'age', 'half'], z.n), 'n': z.n}))[1:4], lambda z: z.n), ',') END AS largest,
  CASE WHEN known THEN array_to_string(list_sort(list_filter(['and', 'que', 'the'], lambda w: NOT list_contains(has, w))), ',') END AS lacking FROM f""")
def score_questions(spark: SparkSession, d: str) -> DataFrame:
    """What a score and its lacking skills rest on, for each document as a resume."""
    term = lambda name, x: F.struct(F.lit(name).alias("feature"), F.lit(0.0).alias("value"), x.cast("double").alias("contribution"))
    k, needed = F.col("doc_id"), F.array(*map(F.lit, ("que", "the", "and")))
    rows = t(spark, d, "documents").select(
        "doc_id", F.when(k % 2 == 0, "Why is my score so low?").otherwise("How do I improve it?").alias("question"), F.col("text").alias("resume_text"), F.when(k % 5 > 0, F.col("n_chars") / 8.0).alias("score"),
        F.array(term("size", F.col("n_chars") / 1024), term("rest", -(k % 7)), term("sign", k % 3 - 1), term("age", k / 4096), term("half", F.lit(0.5))).alias("contributions"),
        sk.extract("text", WORDS).alias("skills"), F.lit(None).cast("array<string>").alias("weak_skills"), needed.alias("required"), F.lit(None).cast("double").alias("relevant_years"), F.lit(2.0).alias("required_years"),
    )
    rows = rows.withColumn("missing", F.array_except(F.array(*map(F.lit, sorted(WORDS))), "skills")).withColumn("uncertain", F.lit(None).cast("array<string>"))
    got = assistant.score_answers(rows, WORDS)
    return got.select("doc_id", "topic", "value", F.array_join("largest.feature", ",").alias("largest"), F.array_join("lacking", ",").alias("lacking"))


@query("SELECT vec_id, CAST(row_number() OVER (ORDER BY vec_id) - 1 AS BIGINT) AS \"row\", array_to_string(list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1000000) AS BIGINT)), ',') AS parts FROM embeddings")
def matrix_files(spark: SparkSession, d: str) -> DataFrame:
    """Vectors written as matrix files and read back by ranges of rows."""
    path = shared_folder(spark, "matrix")
    places = npy.write_matrix(t(spark, d, "embeddings"), "vec_id", "embedding", path)
    whole = F.transform("vector", lambda x: F.floor(x.cast("double") * 1000000).cast("long").cast("string"))
    return npy.read_matrix(spark, path).join(places, "row").select("vec_id", "row", F.array_join(whole, ",").alias("parts"))


@query(r"""
WITH k AS (SELECT doc_id, lower(regexp_replace(coalesce(text, ''), '\s+', '', 'g')) AS key FROM documents),
g AS (SELECT list(CAST(doc_id AS VARCHAR) ORDER BY CAST(doc_id AS VARCHAR)) AS ids FROM k GROUP BY CASE WHEN key = '' THEN CAST(doc_id AS VARCHAR) ELSE sha256(key) END)
SELECT unnest(ids) AS cv_id, 'candidate_' || substr(sha256(array_to_string(ids, '|')), 1, 12) AS candidate_group_id FROM g""")
def groups_of_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Resumes of one text, but for white space and case, are one candidate's."""
    rows = t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("cv_id"), F.col("text").alias("cv_text"))
    return grouping.candidate_groups(rows)
