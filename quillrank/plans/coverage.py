"""More queries over the driver's tables: parsers, patterns, set algebra, constraints and changes of tables.

Documents, orders and pages stand in for resumes, links and files as in :mod:`catalogue`. Where the tables have no
text of the wanted form (years of experience, skill lists), it is made from their columns, in SQL the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import lexicon as lx
from ..functions import skills as sk
from ..functions import text as tx
from ..operators import grouping, ner, ordering, pairs, ranking, retrieval, validation, workspace
from ..sources import io
from .catalogue import query, t


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents")


def _digest(array: str) -> str:
    return f"md5(array_to_string({array}, '|'))"


def _joined(c) -> Column:
    return F.md5(F.array_join(c, "|"))


# ---- lists and tokens ----------------------------------------------------------------------------


@query(f"""
WITH c AS (SELECT doc_id, list_filter(list_distinct(list_transform(string_split(text, ','), lambda s: lower(trim(s)))), lambda s: s <> '') AS a,
  list_filter(list_distinct(list_transform(string_split_regex(trim(text), '[,;|]'), lambda s: lower(trim(s)))), lambda s: s <> '') AS b, source, lang FROM documents)
SELECT doc_id, {_digest('list_sort(a)')} AS commas, CAST(len(a) AS INTEGER) AS n_commas, {_digest('list_sort(b)')} AS several,
  {_digest("list_sort(list_distinct([lower(source), lower(lang)]))")} AS literal, {_digest("[source, lang]")} AS strict FROM c""")
def parsed_lists(spark: SparkSession, d: str) -> DataFrame:
    """Skill lists in three notations."""
    commas, several = sk.parse_list("text"), sk.parse_any("text")
    literal = sk.parse_any(F.format_string("['%s', '%s']", "source", "lang"))
    return _docs(spark, d).select(
        "doc_id", _joined(F.array_sort(commas)).alias("commas"), F.size(commas).alias("n_commas"), _joined(F.array_sort(several)).alias("several"),
        _joined(F.array_sort(literal)).alias("literal"), _joined(sk.parse_json(F.format_string('["%s", "%s"]', "source", "lang"))).alias("strict"),
    )


@query(r"""
WITH c AS (SELECT doc_id, regexp_extract_all(lower(text), '[\pL\pM\pN_][\pL\pM\pN_+#.\-]*') AS a FROM documents)
SELECT doc_id, CAST(len(a) AS INTEGER) AS n, md5(array_to_string(a, '|')) AS tokens FROM c""")
def word_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens that begin with a word character."""
    a = tx.pair_tokens("text")
    return _docs(spark, d).select("doc_id", F.size(a).alias("n"), _joined(a).alias("tokens"))


@query("""
SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'postgresql' WHEN 1 THEN 'kubernetes' WHEN 2 THEN 'go' ELSE 'something else' END AS name FROM benchmark""")
def one_skill_name(spark: SparkSession, d: str) -> DataFrame:
    """A name's canonical form."""
    raw = F.when(F.col("item_id") % 4 == 0, " Postgres ").when(F.col("item_id") % 4 == 1, "K8S").when(F.col("item_id") % 4 == 2, "GoLang").otherwise(" Something ELSE")
    return t(spark, d, "benchmark").select("item_id", sk.normalise_skill(raw).alias("name"))


_SPLIT = "string_split(text, ' ')"


@query(f"""
WITH w AS (SELECT doc_id, list_distinct(list_slice({_SPLIT}, 1, 12)) AS a, list_distinct(list_slice({_SPLIT}, 3, 5)) AS r, list_distinct(list_slice({_SPLIT}, 9, 16)) AS d FROM documents)
SELECT doc_id,
  {_digest("list_sort(list_distinct(list_concat(list_filter(a, lambda x: NOT list_contains(r, x)), d)))")} AS edited,
  {_digest("list_sort(list_filter(d, lambda x: NOT list_contains(a, x)))")} AS added, {_digest("list_sort(list_filter(a, lambda x: NOT list_contains(d, x)))")} AS removed,
  {_digest("list_sort(list_filter(d, lambda x: list_contains(a, x)))")} AS confirmed,
  {_digest("list_sort(list_filter(a, lambda x: list_contains(d, x)))")} AS matched,
  {_digest("list_sort(list_filter(a, lambda x: list_contains(r, x) AND NOT list_contains(d, x)))")} AS uncertain,
  {_digest("list_sort(list_filter(a, lambda x: NOT list_contains(r, x) AND NOT list_contains(d, x)))")} AS missing FROM w""")
def skill_edits(spark: SparkSession, d: str) -> DataFrame:
    """Edits of skill sets and what is left open."""
    words = F.split("text", " ")
    rows = _docs(spark, d).select("doc_id", *[F.array_distinct(F.slice(words, a, n)).alias(c) for c, a, n in (("a", 1, 12), ("r", 3, 3), ("d", 9, 8))])
    e, w = sk.edits("a", "d"), sk.three_way("a", "d", "r")
    return rows.select("doc_id", _joined(sk.edited("a", "r", "d")).alias("edited"), *[_joined(e[c]).alias(c) for c in ("added", "removed", "confirmed")], *[_joined(w[c]).alias(c) for c in ("matched", "uncertain", "missing")])


@query("""
WITH r AS (SELECT o_orderkey, o_orderkey % 2 = 0 AS hf, o_orderkey % 3 = 0 AS hb, o_orderkey % 5 = 0 AS hq, o_orderkey % 7 < 3 AS nf, o_orderkey % 4 < 2 AS ns FROM orders),
h AS (SELECT *, list_distinct(list_concat(CASE WHEN hf THEN ['fullstack', 'backend', 'frontend'] ELSE [] END, CASE WHEN hb THEN ['backend'] ELSE [] END, CASE WHEN hq THEN ['qa'] ELSE [] END, CASE WHEN hf OR hb THEN ['software'] ELSE [] END)) AS have,
  list_concat(CASE WHEN nf THEN ['backend', 'frontend'] ELSE [] END, CASE WHEN ns THEN ['software'] ELSE ['qa'] END) AS need FROM r)
SELECT o_orderkey, round(len(list_filter(need, lambda x: list_contains(have, x))) / len(need), 9) AS share FROM h""")
def roles_covered(spark: SparkSession, d: str) -> DataFrame:
    """Coverage of roles, fullstack holding both layers (M6)."""
    k = F.col("o_orderkey")
    have = F.array_compact(F.array(F.when(k % 2 == 0, "fullstack"), F.when(k % 3 == 0, "backend"), F.when(k % 5 == 0, "qa")))
    need = F.array_compact(F.array(F.when(k % 7 < 3, "fullstack"), F.when(k % 4 < 2, "software").otherwise("qa")))
    return t(spark, d, "orders").select("o_orderkey", F.round(sk.role_coverage(have, need), 9).alias("share"))


# ---- patterns ------------------------------------------------------------------------------------

#: Documents hold next to no words of a trade; one of these is put at the end of their beginnings.
_TRADE = ("Senior backend developer and data pipelines", "junior QA with a bachelor degree in banking", "team lead, Software Engineer, master", "ui/ux designer, product manager", "intern, mining company", "nothing of this")
_TRADE_SQL = f"list_extract([{', '.join(repr(x) for x in _TRADE)}], CAST(doc_id % {len(_TRADE)} AS INTEGER) + 1)"


def _detected_sql(patterns: dict[str, str]) -> str:
    cases = ", ".join("CASE WHEN regexp_matches(x, '(?i)" + p.replace("'", "''") + f"') THEN '{k}' END" for k, p in patterns.items())
    return f"list_filter([{cases}], lambda v: v IS NOT NULL)"


def _trade() -> Column:
    return F.concat(F.substring("text", 1, 200), F.lit(" \n"), F.element_at(F.array(*map(F.lit, _TRADE)), (F.col("doc_id") % len(_TRADE) + 1).cast("int")))


@query(f"""
WITH s AS (SELECT doc_id, substr(text, 1, 200) || ' ' || chr(10) || {_TRADE_SQL} AS x FROM documents),
f AS (SELECT doc_id, {_detected_sql(lx.ROLES)} AS r, {_detected_sql(lx.TASKS)} AS t, {_detected_sql(lx.INDUSTRIES)} AS i, {_detected_sql(lx.EDUCATION_FIELDS)} AS e,
  {_detected_sql({str(n): p for n, p in lx.SENIORITY})} AS l, {_detected_sql({str(n): p for n, p in lx.DEGREES})} AS g, {_detected_sql({'data': 'data', 'quality': r'\bqa\b', 'people': 'lead|manager'})} AS p FROM s)
SELECT doc_id, array_to_string(CASE WHEN len(r) > 1 THEN list_filter(r, lambda v: v <> 'software') ELSE r END, ',') AS roles, array_to_string(t, ',') AS tasks, array_to_string(i, ',') AS industries,
  array_to_string(e, ',') AS fields, array_to_string(l, ',') AS levels, CAST(list_max(g) AS INTEGER) AS degree, coalesce(p[1], 'other') AS family FROM f""")
def trade_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Roles, tasks, industries, fields, levels, degrees and families."""
    rows = _docs(spark, d).select("doc_id", _trade().alias("x"))
    found = {"tasks": lx.TASKS, "industries": lx.INDUSTRIES, "fields": lx.EDUCATION_FIELDS}
    return rows.select(
        "doc_id", F.array_join(tx.roles("x"), ",").alias("roles"), *[F.array_join(tx.detected("x", p), ",").alias(c) for c, p in found.items()],
        F.array_join(tx.seniority("x").cast("array<string>"), ",").alias("levels"), tx.degree("x").alias("degree"), tx.profile("x", {"data": "data", "quality": r"\bqa\b", "people": "lead|manager"}).alias("family"),
    )


_YEARS_SQL = """CASE doc_id % 7 WHEN 0 THEN 'at least ' || (n_chars % 40) || ' years' WHEN 1 THEN 'up to ' || (n_chars % 9) || ' years' WHEN 2 THEN (n_chars % 60) || ' months'
  WHEN 3 THEN 'no experience needed' WHEN 4 THEN '' WHEN 5 THEN (n_chars % 130) || ',5 years' ELSE 'work experience: ' || (n_chars % 30) || ' years ' || (n_chars % 12) || ' months' END"""


@query(f"""
WITH s AS (SELECT doc_id, {_YEARS_SQL} AS x FROM documents),
n AS (SELECT *, TRY_CAST(replace(regexp_extract(x, '\\d+(?:[.,]\\d+)?'), ',', '.') AS DOUBLE) AS v FROM s),
r AS (SELECT *, CASE WHEN regexp_matches(x, '(?i)no experience') THEN 0 WHEN v BETWEEN 0 AND 100 THEN v END AS required FROM n)
SELECT doc_id, required, CASE WHEN starts_with(x, 'work experience') THEN round(v + TRY_CAST(regexp_extract(x, 'years (\\d+) months', 1) AS DOUBLE) / 12, 9) END AS claimed,
  CASE WHEN x = '' THEN 'not_specified' WHEN x LIKE 'no experience%' THEN 'not_required' WHEN (x LIKE 'up to%') OR x LIKE '%months%' OR required IS NULL THEN 'unknown' END AS status,
  CASE WHEN x = '' OR x LIKE 'up to%' OR x LIKE '%months%' THEN NULL ELSE required END AS minimum FROM r""")
def years_of_experience(spark: SparkSession, d: str) -> DataFrame:
    """Years asked for and claimed."""
    n, k = F.col("n_chars"), F.col("doc_id") % 7
    x = (
        F.when(k == 0, F.concat(F.lit("at least "), n % 40, F.lit(" years"))).when(k == 1, F.concat(F.lit("up to "), n % 9, F.lit(" years"))).when(k == 2, F.concat(n % 60, F.lit(" months")))
        .when(k == 3, "no experience needed").when(k == 4, "").when(k == 5, F.concat(n % 130, F.lit(",5 years"))).otherwise(F.concat(F.lit("work experience: "), n % 30, F.lit(" years "), n % 12, F.lit(" months")))
    )
    rows = _docs(spark, d).select("doc_id", x.alias("x"))
    least = tx.minimum_years("x")
    return rows.select("doc_id", tx.required_years("x").alias("required"), F.round(tx.claimed_years("x"), 9).alias("claimed"), least["status"].alias("status"), least["years"].alias("minimum"))


@query(r"""
WITH s AS (SELECT doc_id, text, 'x' || chr(0) || replace(replace(text, chr(10), ' ' || chr(9) || chr(13) || chr(10) || chr(10) || chr(10) || chr(10)), ',', ',' || chr(13)) || '  ' AS raw FROM documents),
a AS (SELECT *, regexp_replace(replace(raw, chr(0), ''), '\r\n?', chr(10), 'g') AS b FROM s),
b AS (SELECT *, regexp_replace(regexp_replace(b, '[ \t]+(\n|$)', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS c FROM a),
c AS (SELECT *, regexp_replace(c, '^[\s\x0b]+|[\s\x0b]+$', '', 'g') AS clean, len(regexp_replace(raw, '[\s\x0b]+', '', 'g')) AS before FROM b)
SELECT doc_id, md5(clean) AS clean, round(greatest(0, (before - len(regexp_replace(clean, '[\s\x0b]+', '', 'g'))) / before), 9) AS loss FROM c""")
def cleaned_texts(spark: SparkSession, d: str) -> DataFrame:
    """Cleaned texts and what cleaning lost."""
    raw = F.concat(F.lit("x\0"), F.replace(F.replace("text", F.lit("\n"), F.lit(" \t\r\n\n\n\n")), F.lit(","), F.lit(",\r")), F.lit("  "))
    rows = _docs(spark, d).select("doc_id", raw.alias("raw"))
    return rows.select("doc_id", F.md5(tx.cleaned("raw")).alias("clean"), F.round(tx.content_loss("raw", tx.cleaned("raw")), 9).alias("loss"))


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
o AS (SELECT *, coalesce(sum(len(s) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM l)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) AS line, CAST(start AS INTEGER) AS start, md5(s) AS text FROM o WHERE trim(s) <> ''""")
def line_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Lines with their numbers and offsets."""
    return _docs(spark, d).select("doc_id", F.explode(tx.numbered_lines("text")).alias("l")).select("doc_id", "l.line", "l.start", F.md5("l.text").alias("text"))


@query(r"""
SELECT doc_id, length(text) BETWEEN 20 AND 60000 AND len(regexp_extract_all(text, '\pL')) >= 12 AS valid,
  len(regexp_extract_all(regexp_replace(text, '[^a-zA-Z\n]+', ' ', 'g') || ' a b c d ee f g', '\b(?:[A-Za-z][ \t]+){3,}[A-Za-z]\b')) AS spaced FROM documents""")
def resume_texts(spark: SparkSession, d: str) -> DataFrame:
    """Whether a text can be a resume; spaced letters."""
    plain = F.concat(F.regexp_replace("text", r"[^a-zA-Z\n]+", " "), F.lit(" a b c d ee f g"))
    return _docs(spark, d).select("doc_id", tx.valid_resume("text").alias("valid"), tx.spaced_letters(plain).cast("long").alias("spaced"))


_CLAIMS = ("built a service", "have not used it", "currently learning things", "I never worked there", "used it for years", "want to become one")


@query(rf"""
WITH s AS (SELECT doc_id, list_extract([{', '.join(repr(x) for x in _CLAIMS)}], CAST(doc_id % {len(_CLAIMS)} AS INTEGER) + 1) || ' ' || source AS x, replace(text, ' the ', ' must ') AS y FROM documents),
m AS (SELECT doc_id, x, list_filter(string_split_regex(y, '[;\n]|\.(?:\s|$)'), lambda v: regexp_matches(v, 'обязател|mandatory|required|must')) AS a FROM s)
SELECT doc_id, NOT regexp_matches(x, 'have not used|currently learning|never worked|want to become') AS claims, len(a) AS musts, {_digest('a')} AS sentences FROM m""")
def claims_and_musts(spark: SparkSession, d: str) -> DataFrame:
    """Whether a statement claims something; sentences that demand."""
    x = F.concat(F.element_at(F.array(*map(F.lit, _CLAIMS)), (F.col("doc_id") % len(_CLAIMS) + 1).cast("int")), F.lit(" "), F.col("source"))
    musts = tx.mandatory_sentences(F.replace("text", F.lit(" the "), F.lit(" must ")))
    return _docs(spark, d).select("doc_id", tx.positive(x).alias("claims"), F.size(musts).cast("long").alias("musts"), _joined(musts).alias("sentences"))


@query(r"""
SELECT doc_id, md5(replace(replace(replace(replace(replace(text, '<', chr(92) || 'u003c'), '>', chr(92) || 'u003e'), '&', chr(92) || 'u0026'), chr(8232), chr(92) || 'u2028'), chr(8233), chr(92) || 'u2029')) AS script,
  md5(CASE WHEN doc_id % 3 = 0 THEN '''=' WHEN doc_id % 3 = 1 THEN ''' -' WHEN regexp_matches(text, '^\s*[=+\-@]|^[\t\r]') THEN '''' ELSE '' END || text) AS cell,
  replace(CASE WHEN n_chars > 400 THEN '+' ELSE '' END || CASE WHEN n_chars = 400 THEN '0' ELSE regexp_replace(printf('%.3f', (n_chars - 400) / 8), '\.?0+$', '') END, '.', ',') AS number,
  nullif(substr(text, CAST(strpos(lower(text), lower(substr(text, 5, 20))) AS INTEGER), length(lower(substr(text, 5, 20)))), '') AS quote FROM documents""")
def written_forms(spark: SparkSession, d: str) -> DataFrame:
    """Script-safe JSON, guarded cells, numbers with a comma, quotes in their own case."""
    cell = F.concat(F.when(F.col("doc_id") % 3 == 0, "=").when(F.col("doc_id") % 3 == 1, " -").otherwise(""), F.col("text"))
    number = tx.number_text((F.col("n_chars") - 400) / 8, 3, signed=True)
    return _docs(spark, d).select("doc_id", F.md5(tx.script_json("text")).alias("script"), F.md5(tx.export_cell(cell)).alias("cell"), number.alias("number"), tx.original_quote(F.lower(F.substring("text", 5, 20)), "text").alias("quote"))


# ---- workspace -----------------------------------------------------------------------------------

_LINKS = "SELECT DISTINCT 's' || (o_custkey % 5) AS session_id, CAST(o_custkey AS VARCHAR) AS candidate_id, CAST(o_orderkey % 100 AS VARCHAR) AS vacancy_id FROM orders"


def _links(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "orders").select(F.concat(F.lit("s"), F.col("o_custkey") % 5).alias("session_id"), F.col("o_custkey").cast("string").alias("candidate_id"), (F.col("o_orderkey") % 100).cast("string").alias("vacancy_id")).distinct()


def _reviews(links: DataFrame) -> DataFrame:
    return links.filter("cast(vacancy_id as int) % 2 = 0").withColumn("status", F.lit("seen"))


@query(f"""
WITH l AS ({_LINKS}), n AS (SELECT 's1' AS session_id, '1' AS candidate_id, CAST(r_regionkey * 2 AS VARCHAR) AS vacancy_id FROM region),
k AS (SELECT * FROM l WHERE NOT (session_id = 's1' AND candidate_id = '1') UNION ALL SELECT * FROM n),
r AS (SELECT *, 'seen' AS status FROM l WHERE CAST(vacancy_id AS INTEGER) % 2 = 0)
SELECT 'link' AS kind, session_id, candidate_id, vacancy_id FROM k UNION ALL SELECT 'review', session_id, candidate_id, vacancy_id FROM r WHERE NOT (session_id = 's1' AND candidate_id = '1') OR vacancy_id IN (SELECT vacancy_id FROM n)""")
def links_replaced(spark: SparkSession, d: str) -> DataFrame:
    """A candidate's vacancies put anew, reviews of the others gone (K2)."""
    links = _links(spark, d)
    new = t(spark, d, "region").select((F.col("r_regionkey") * 2).cast("string").alias("vacancy_id"))
    a, b = workspace.replace_links(links, _reviews(links), "s1", "1", new)
    names = ["session_id", "candidate_id", "vacancy_id"]
    return a.select(F.lit("link").alias("kind"), *names).unionByName(b.select(F.lit("review").alias("kind"), *names))


@query(f"""
WITH l AS ({_LINKS}), r AS (SELECT *, 'seen' AS status FROM l WHERE CAST(vacancy_id AS INTEGER) % 2 = 0), n AS (SELECT *, 'hired' AS status FROM l WHERE CAST(vacancy_id AS INTEGER) % 3 = 0)
SELECT * FROM r ANTI JOIN n USING (session_id, candidate_id, vacancy_id) UNION ALL SELECT * FROM n""")
def reviews_put(spark: SparkSession, d: str) -> DataFrame:
    """Reviews put in for links that are (K4)."""
    links = _links(spark, d)
    rows = links.filter("cast(vacancy_id as int) % 3 = 0").withColumn("status", F.lit("hired"))
    return workspace.put_review(_reviews(links), links, rows).select("session_id", "candidate_id", "vacancy_id", "status")


@query(f"SELECT * FROM ({_LINKS}) WHERE session_id <> 's3'")
def session_cleared(spark: SparkSession, d: str) -> DataFrame:
    """Tables without a session's rows (K5)."""
    return workspace.clear({"links": _links(spark, d)}, "s3")["links"]


@query(f"""
WITH l AS ({_LINKS}), v AS (SELECT DISTINCT session_id, vacancy_id FROM l WHERE CAST(vacancy_id AS INTEGER) < 30), c AS (SELECT DISTINCT session_id, candidate_id FROM l WHERE CAST(candidate_id AS INTEGER) % 3 > 0),
k AS (SELECT CAST(r_regionkey * 11 AS VARCHAR) AS vacancy_id FROM region)
SELECT DISTINCT session_id, candidate_id, vacancy_id FROM l SEMI JOIN c USING (session_id, candidate_id) WHERE (session_id, vacancy_id) IN (SELECT session_id, vacancy_id FROM v) OR vacancy_id IN (SELECT vacancy_id FROM k)""")
def links_migrated(spark: SparkSession, d: str) -> DataFrame:
    """Links that old reviews imply."""
    links = _links(spark, d)
    own = links.filter("cast(vacancy_id as int) < 30").select("session_id", "vacancy_id").distinct()
    listed = t(spark, d, "region").select((F.col("r_regionkey") * 11).cast("string").alias("vacancy_id"))
    known = links.filter("cast(candidate_id as int) % 3 > 0").select("session_id", "candidate_id").distinct()
    return workspace.migrated_links(links, known, own, listed)


@query("""
SELECT o_orderkey, o_orderdate, CAST(row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS INTEGER) AS place FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def newest_first(spark: SparkSession, d: str) -> DataFrame:
    """Vacancies of some accounts, the newest first."""
    rows = t(spark, d, "orders").select(F.col("o_orderkey").alias("vacancy_id"), F.col("o_custkey").alias("session_id"), F.col("o_orderdate").alias("created_at"))
    accounts = t(spark, d, "customer").select(F.col("c_custkey").alias("session_id"), F.when(F.col("c_mktsegment") == "BUILDING", "hr").otherwise("other").alias("role"))
    out = workspace.public_vacancies(rows, accounts)
    out = ordering.numbered(out, [("created_at", True), ("vacancy_id", False)])
    return out.select(F.col("vacancy_id").alias("o_orderkey"), F.col("created_at").alias("o_orderdate"), F.col("place").cast("int").alias("place"))


# ---- constraints ---------------------------------------------------------------------------------


@query("SELECT doc_id FROM documents WHERE doc_id % 7 = 0 OR n_chars % 5 = 0")
def hashes_gone_stale(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose stored hash or length is no longer that of their text (V2)."""
    kept = F.when(F.col("doc_id") % 7 == 0, F.lit("0")).otherwise(F.sha2("text", 256))
    rows = _docs(spark, d).withColumn("text_sha256", kept).withColumn("size", F.length("text") + F.when(F.col("n_chars") % 5 == 0, 1).otherwise(0))
    return validation.stale_hashes(rows, length="size").select("doc_id")


@query(r"""
WITH s AS (SELECT doc_id, text, CAST(doc_id % 50 AS INTEGER) AS a, CAST(doc_id % 50 + 1 + doc_id % 9 AS INTEGER) AS b FROM documents),
q AS (SELECT *, CASE WHEN doc_id % 4 = 0 THEN 'x' ELSE substr(text, a + 1, b - a) END AS span FROM s)
SELECT doc_id, a AS start, b AS "end" FROM q WHERE substr(text, a + 1, b - a) <> span
  OR (a > 0 AND regexp_matches(substr(text, a, 2), '^[\pL\pM\pN_]{2}$')) OR (regexp_matches(substr(text, b, 2), '^[\pL\pM\pN_]{2}$'))""")
def spans_out_of_place(spark: SparkSession, d: str) -> DataFrame:
    """Spans that are not the text at their place, or cut a word (V4, V7)."""
    a, b = (F.col("doc_id") % 50).cast("int"), (F.col("doc_id") % 50 + 1 + F.col("doc_id") % 9).cast("int")
    docs = _docs(spark, d)
    spans = docs.select("doc_id", a.alias("start"), b.alias("end"), F.when(F.col("doc_id") % 4 == 0, "x").otherwise(F.substr(F.col("text"), a + 1, b - a)).alias("text"))
    return validation.bad_spans(spans, docs).select("doc_id", "start", "end")


@query("""
SELECT doc_id AS task_id, CASE WHEN doc_id % 6 = 0 THEN 'MISSING_METADATA' WHEN doc_id % 6 = 1 THEN 'UNKNOWN_DOCUMENT' WHEN doc_id % 6 = 2 THEN 'VERSION_MISMATCH' WHEN doc_id % 6 = 3 THEN 'HASH_MISMATCH' ELSE 'OK' END AS status FROM documents""")
def tasks_of_today(spark: SparkSession, d: str) -> DataFrame:
    """Annotation tasks against the documents of today."""
    k, digest = F.col("doc_id") % 6, F.sha2("text", 256)
    docs = _docs(spark, d).select(F.col("doc_id").cast("string").alias("document_id"), digest.alias("text_sha256"), F.lit("2").alias("text_version"))
    tasks = _docs(spark, d).select(
        F.col("doc_id").alias("task_id"), F.when(k == 1, F.concat(F.lit("no"), F.col("doc_id"))).otherwise(F.col("doc_id").cast("string")).alias("document_id"),
        F.when(k == 0, None).when(k == 3, "0").otherwise(digest).alias("text_sha256"), F.when(k == 2, "1").otherwise("2").alias("text_version"),
    )
    return validation.document_status(tasks, docs)


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_linenumber = 1 AND l_suppkey % 3 > 0) OR (l_linenumber <> 1 AND l_suppkey % 3 = 0) OR (l_linenumber = 2 AND l_suppkey % 2 = 0)")
def requirements_at_odds(spark: SparkSession, d: str) -> DataFrame:
    """Requirements whose status, score and quote do not agree (V5)."""
    line, s = F.col("l_linenumber"), F.col("l_suppkey")
    rows = t(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(line == 1, "not_assessed").when(line == 2, "match").otherwise("partial").alias("status"), F.when(s % 3 > 0, F.lit(1)).alias("score"),
        F.when((line == 2) & (s % 2 == 0), "").otherwise("q").alias("cv_quote"),
    )
    return validation.bad_requirements(rows).select("l_orderkey", "l_linenumber")


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
n AS (SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS line FROM l WHERE trim(s) <> '')
SELECT d.doc_id, CAST(d.doc_id % 4 + 1 AS INTEGER) AS line, md5(n.s) AS quote FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id AND n.line = d.doc_id % 4 + 1""")
def answers_grounded(spark: SparkSession, d: str) -> DataFrame:
    """Answers with the lines they name (V6)."""
    docs = _docs(spark, d)
    lines = docs.select("doc_id", F.explode(tx.numbered_lines("text")).alias("l")).select("doc_id", "l.line", "l.text")
    return validation.grounded(docs.select("doc_id", (F.col("doc_id") % 4 + 1).cast("int").alias("line")), lines).select("doc_id", "line", F.md5("quote").alias("quote"))


@query("SELECT l_orderkey AS cv_id, count(*) AS pairs, count(DISTINCT l_partkey) AS vacancies FROM lineitem GROUP BY ALL HAVING count(*) <> 5 OR count(DISTINCT l_partkey) <> 5")
def wrong_numbers_of_pairs(spark: SparkSession, d: str) -> DataFrame:
    """CVs without exactly five pairs (V8)."""
    return validation.wrong_pair_counts(t(spark, d, "lineitem").select(F.col("l_orderkey").alias("cv_id"), F.col("l_partkey").alias("vacancy_id")))


@query("SELECT c_custkey AS pair_id FROM customer WHERE c_custkey % 4 = 1 OR c_custkey % 6 = 5")
def split_rows_that_differ(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a split that are not those of their source."""
    rows = t(spark, d, "customer").select(F.col("c_custkey").alias("pair_id"), "c_name", F.when(F.col("c_custkey") % 5 > 0, F.col("c_acctbal")).alias("c_acctbal"), F.lit(1).alias("here_only"))
    split = rows.withColumn("c_name", F.when(F.col("pair_id") % 4 == 1, "x").otherwise(F.col("c_name"))).withColumn("c_acctbal", F.when(F.col("pair_id") % 6 == 5, F.coalesce("c_acctbal", F.lit(0)) + 1).otherwise(F.col("c_acctbal"))).drop("here_only")
    return validation.consistent(rows, split, "pair_id")


@query("SELECT c_custkey FROM customer WHERE c_custkey % 9 = 2 OR c_custkey % 10 = 7")
def snapshots_apart(spark: SparkSession, d: str) -> DataFrame:
    """Keys whose rows are not the same before and after."""
    rows = t(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    after = rows.filter("c_custkey % 10 <> 7").withColumn("c_name", F.when(F.col("c_custkey") % 9 == 2, "changed").otherwise(F.col("c_name")))
    return pairs.changed(rows, after, "c_custkey")


@query("SELECT doc_id, 20240100 + CAST(doc_id % 40 AS INTEGER) AS day FROM documents WHERE doc_id % 40 BETWEEN 1 AND 31")
def times_that_are_times(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose ISO time is one."""
    rows = _docs(spark, d).select("doc_id", F.format_string("2024-01-%02dT10:00:00Z", F.col("doc_id") % 40).alias("at"), (F.lit(20240100) + F.col("doc_id") % 40).cast("int").alias("day"))
    return pairs.valid_times(rows, "at").select("doc_id", "day")


# ---- datasets ------------------------------------------------------------------------------------

_PAIRS = """SELECT d.doc_id AS cv_id, d.source AS candidate_group_id, d.lang AS vacancy_id, CAST(l.quality + l.toxic AS BIGINT) AS overall_score,
  CASE WHEN d.doc_id % 10 < 7 THEN 'train' WHEN d.doc_id % 10 < 8 THEN 'validation' ELSE 'test' END AS split FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality IS NOT NULL AND l.toxic IS NOT NULL"""


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 10
    rows = _docs(spark, d).join(t(spark, d, "labels"), "doc_id").filter("quality is not null and toxic is not null")
    return rows.select(F.col("doc_id").alias("cv_id"), F.col("source").alias("candidate_group_id"), F.col("lang").alias("vacancy_id"), (F.col("quality") + F.col("toxic")).cast("long").alias("overall_score"), F.when(k < 7, "train").when(k < 8, "validation").otherwise("test").alias("split"))


@query(f"""
WITH p AS ({_PAIRS}), q AS (SELECT split, cv_id, count(DISTINCT overall_score) > 1 AS v FROM p GROUP BY ALL), s AS (SELECT split, overall_score, count(*) AS n FROM p GROUP BY ALL)
SELECT p.split, count(*) AS pairs, count(DISTINCT cv_id) AS cvs, count(DISTINCT candidate_group_id) AS groups, count(DISTINCT vacancy_id) AS vacancies,
  (SELECT count(*) FILTER (v) FROM q WHERE q.split = p.split) AS varied_queries, (SELECT string_agg(overall_score || ':' || n, ',' ORDER BY overall_score) FROM s WHERE s.split = p.split) AS scores FROM p GROUP BY p.split""")
def dataset_report(spark: SparkSession, d: str) -> DataFrame:
    """What each split holds."""
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("scores")), lambda e: F.concat_ws(":", e["key"], e["value"])), ",")
    return grouping.report(_pairs(spark, d)).withColumn("scores", shown)


@query(f"""
SELECT 'group ' || candidate_group_id AS key, count(DISTINCT split) AS splits FROM ({_PAIRS}) GROUP BY ALL HAVING count(DISTINCT split) > 1
UNION ALL SELECT 'vacancy ' || vacancy_id, count(DISTINCT split) FROM ({_PAIRS}) GROUP BY ALL HAVING count(DISTINCT split) > 1""")
def groups_that_leak(spark: SparkSession, d: str) -> DataFrame:
    """Groups, and vacancies, in more than one split."""
    rows = _pairs(spark, d)
    found = [grouping.leaks(rows, key).select(F.concat(F.lit(f"{name} "), key).alias("key"), "splits") for key, name in (("candidate_group_id", "group"), ("vacancy_id", "vacancy"))]
    return found[0].unionByName(found[1])


@query(f"SELECT cv_id, candidate_group_id, vacancy_id, overall_score FROM ({_PAIRS}) WHERE split = 'test'")
def frozen_split(spark: SparkSession, d: str) -> DataFrame:
    """A split's file: ids and targets, no texts."""
    rows = _pairs(spark, d).join(_docs(spark, d).select(F.col("doc_id").alias("cv_id"), F.col("text").alias("cv_text")), "cv_id")
    return pairs.frozen(rows.filter("split = 'test'"), ["overall_score"])


@query(f"SELECT cv_id, vacancy_id, candidate_group_id FROM ({_PAIRS})")
def rows_with_groups(spark: SparkSession, d: str) -> DataFrame:
    """Rows with the group of their CV."""
    rows = _pairs(spark, d)
    return pairs.with_group(rows.select("cv_id", "vacancy_id"), rows.select("cv_id", "candidate_group_id").distinct())


@query("""
SELECT doc_id, count(*) FILTER (label = 'a') AS a, count(*) FILTER (label = 'b') AS b, count(*) FILTER (label = 'c') AS c FROM
  (SELECT doc_id, CASE length(s) % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' ELSE 'd' END AS label FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS s FROM documents)) GROUP BY doc_id""")
def labels_of_documents(spark: SparkSession, d: str) -> DataFrame:
    """A count of each label for each document."""
    lines = _docs(spark, d).select("doc_id", F.explode(F.split("text", "\n")).alias("s"))
    k = F.length("s") % 4
    return ner.label_distribution(lines.select("doc_id", F.when(k == 0, "a").when(k == 1, "b").when(k == 2, "c").otherwise("d").alias("label")), ["a", "b", "c"])


_SPANS = """r AS (SELECT doc_id, CAST(doc_id % 30 AS INTEGER) AS a, CAST(doc_id % 30 + 10 AS INTEGER) AS b, CASE doc_id % 3 WHEN 0 THEN 'HARD_SKILL' WHEN 1 THEN 'SOFT_SKILL' ELSE 'LANG' END AS label FROM documents),
m AS (SELECT doc_id, CAST(n_chars % 30 AS INTEGER) AS a, CAST(n_chars % 30 + 10 AS INTEGER) AS b, CASE n_chars % 3 WHEN 0 THEN 'HARD_SKILL' WHEN 1 THEN 'EXPERIENCE' ELSE 'LANG' END AS label FROM documents)"""


def _spans(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    def made(of: str, second: str) -> DataFrame:
        k = F.col(of) % 3
        return _docs(spark, d).select("doc_id", (F.col(of) % 30).cast("int").alias("start"), (F.col(of) % 30 + 10).cast("int").alias("end"), F.when(k == 0, "HARD_SKILL").when(k == 1, second).otherwise("LANG").alias("label"))

    return made("doc_id", "SOFT_SKILL"), made("n_chars", "EXPERIENCE")


@query(f"""
WITH {_SPANS}
SELECT 'merged' AS kind, doc_id, a AS start, b AS "end", label FROM (SELECT * FROM r UNION SELECT * FROM m)
UNION ALL SELECT 'routed', doc_id, a, b, label FROM r WHERE label IN ('HARD_SKILL', 'SOFT_SKILL') UNION ALL SELECT 'routed', doc_id, a, b, label FROM m WHERE label NOT IN ('HARD_SKILL', 'SOFT_SKILL')
UNION ALL SELECT 'apart', doc_id, a, b, label FROM r WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = r.doc_id AND r.a < m.b AND r.b > m.a)""")
def spans_combined(spark: SparkSession, d: str) -> DataFrame:
    """Spans of two sources: both, by label, without overlaps."""
    rules, model = _spans(spark, d)
    parts = {"merged": ner.merged(rules, model), "routed": ner.routed(rules, model), "apart": ner.without_overlaps(rules, model)}
    out = [p.select(F.lit(k).alias("kind"), "doc_id", "start", "end", "label") for k, p in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("""
WITH n AS (SELECT url, row_number() OVER (ORDER BY lower(url), url) AS k FROM (SELECT DISTINCT url FROM pages WHERE url IS NOT NULL))
SELECT url AS filename, printf('resume_%04d', k) AS resume_id, CAST(k AS INTEGER) AS number FROM n""")
def resume_files(spark: SparkSession, d: str) -> DataFrame:
    """Files numbered in the order of their names, and the numbers again."""
    files = t(spark, d, "pages").filter("url is not null").select(F.col("url").alias("filename")).distinct()
    return io.numbered_resumes(files).select("filename", "resume_id", io.resume_number("resume_id").alias("number"))


@query("""
SELECT l_orderkey, CASE WHEN count(DISTINCT l_linestatus) = 1 THEN min(l_linestatus) ELSE 'mixed' END AS status,
  round(CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE ((CASE WHEN l_orderkey % 5 = 0 THEN 0 WHEN l_orderkey % 4 >= 2 THEN 1 ELSE (l_orderkey % 4 - 2) / 6 END) + 0) / 2 * 0.5 END, 9) AS languages FROM lineitem GROUP BY l_orderkey""")
def statuses_in_one(spark: SparkSession, d: str) -> DataFrame:
    """One status for several; a component over all languages asked for."""
    rows = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_linestatus").alias("s"))
    k = F.col("l_orderkey")
    none = F.create_map().cast("map<string,int>")
    asked = F.when(k % 3 == 0, none).otherwise(F.create_map(F.lit("en"), F.lit(2), F.lit("kk"), F.lit(3)))
    own = F.when(k % 5 == 0, none).otherwise(F.create_map(F.lit("en"), (k % 4).cast("int")))
    return rows.select("l_orderkey", ranking.status_summary(F.col("s")).alias("status"), F.round(ranking.language_component(asked, own, F.lit(0.5)), 9).alias("languages"))


@query("""
WITH c AS (SELECT p_partkey, unnest([{'f': 'size', 'v': p_size - 25.0}, {'f': 'price', 'v': 1000 - p_retailprice}, {'f': 'key', 'v': p_partkey % 7 * 10.0 + 0.5}, {'f': 'one', 'v': 1.25}, {'f': 'two', 'v': -2.125}]) AS e FROM part),
r AS (SELECT p_partkey, e.f AS f, row_number() OVER (PARTITION BY p_partkey ORDER BY abs(e.v) DESC, CASE e.f WHEN 'size' THEN 0 WHEN 'price' THEN 1 WHEN 'key' THEN 2 WHEN 'one' THEN 3 ELSE 4 END) AS n FROM c)
SELECT p_partkey, string_agg(f, ',' ORDER BY f) AS top FROM r WHERE n <= 4 GROUP BY p_partkey""")
def largest_contributions(spark: SparkSession, d: str) -> DataFrame:
    """The four contributions that weigh most."""
    item = lambda f, v: F.struct(F.lit(f).alias("feature"), F.round(v.cast("double"), 9).alias("contribution"))
    found = F.array(item("size", F.col("p_size") - 25.0), item("price", 1000 - F.col("p_retailprice")), item("key", F.col("p_partkey") % 7 * 10.0 + 0.5), item("one", F.lit(1.25)), item("two", F.lit(-2.125)))
    return t(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(ranking.top_contributions(found)["feature"]), ",").alias("top"))


# ---- pairs ---------------------------------------------------------------------------------------


@query("""
SELECT l_orderkey, l_returnflag, l_quantity > 25 AS uncertain, l_linenumber AS place FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_quantity > 25, l_linestatus <> 'O', l_linenumber) AS n FROM lineitem) WHERE n = 1""")
def evidence_chosen(spark: SparkSession, d: str) -> DataFrame:
    """One source for each skill: certain, then confirmed."""
    rows = t(spark, d, "lineitem").select("l_orderkey", "l_returnflag", (F.col("l_quantity") > 25).alias("uncertain"), F.when(F.col("l_linestatus") == "O", "hr").otherwise("resume").alias("source"), F.col("l_linenumber").alias("place"))
    return pairs.best_evidence(rows, ["l_orderkey", "l_returnflag"]).select("l_orderkey", "l_returnflag", "uncertain", "place")


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS turn FROM l WHERE trim(s) <> '')
SELECT doc_id, CAST(turn AS INTEGER) AS turn, md5(substr(s, 1, 400)) AS quote FROM n WHERE turn <= 3""")
def quotes_of_documents(spark: SparkSession, d: str) -> DataFrame:
    """The first three quotes, 400 characters each."""
    lines = _docs(spark, d).select("doc_id", F.explode(tx.numbered_lines("text")).alias("l")).select("doc_id", F.col("l.start").alias("place"), F.col("l.text").alias("quote"))
    return pairs.first_quotes(lines, ["doc_id"]).select("doc_id", "turn", F.md5("quote").alias("quote"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'x,y' ELSE 'a,x' END AS asked FROM documents")
def skills_to_ask(spark: SparkSession, d: str) -> DataFrame:
    """Two skills to ask about, uncertain ones first."""
    rows = _docs(spark, d).select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("a"))).alias("u"), F.array(*map(F.lit, "xyz")).alias("m"))
    return rows.select("doc_id", F.array_join(pairs.questions("u", "m"), ",").alias("asked"))


@query(r"""
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'used   here' WHEN 1 THEN 'used python here' ELSE 'used python here' || chr(10) || 'python' END || '|' || source AS masked FROM documents""")
def evidence_source(spark: SparkSession, d: str) -> DataFrame:
    """What a resume may be read for, weak and removed skills masked, confirmed ones at the end."""
    none, python, k = F.array().cast("array<string>"), F.array(F.lit("python")), F.col("doc_id") % 3
    text = pairs.evidence_text(F.array(F.lit("used python here")), F.when(k != 1, python).otherwise(none), none, F.when(k == 2, python).otherwise(none), {"python": []})
    return _docs(spark, d).select("doc_id", F.concat(text, F.lit("|"), "source").alias("masked"))


@query("""
SELECT p_partkey AS vacancy_id, CASE WHEN p_partkey % 4 = 1 AND p_partkey % 3 <> 0 THEN least(1.0, p_size / 10.0 / 3) ELSE (p_partkey % 10) / 10.0 END AS prefilter FROM part WHERE p_partkey % 3 = 0 OR p_partkey % 4 = 1""")
def semantic_prefilter(spark: SparkSession, d: str) -> DataFrame:
    """Semantic scores onto a catalogue, custom rows bounded."""
    k = F.col("p_partkey")
    rows = t(spark, d, "part").select(k.alias("vacancy_id"), (k % 4 == 1).alias("is_custom"), (F.col("p_size") / 10.0).alias("baseline"))
    scores = t(spark, d, "part").filter("p_partkey % 3 = 0").select(k.alias("vacancy_id"), ((k % 10) / 10.0).alias("semantic"))
    return pairs.prefiltered(rows, scores).select("vacancy_id", F.col("prefilter").cast("double").alias("prefilter"))


@query("SELECT vec_id, len(embedding) AS dims FROM embeddings WHERE vec_id % 5 > 0")
def guarded_index(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of rows whose text is still that of the index."""
    digest = F.sha2(F.col("vec_id").cast("string"), 256)
    index = t(spark, d, "embeddings").select("vec_id", digest.alias("text_sha256"), "embedding")
    rows = t(spark, d, "embeddings").select("vec_id", F.when(F.col("vec_id") % 5 == 0, "0").otherwise(digest).alias("text_sha256"))
    return pairs.guarded(rows, index, "vec_id").select("vec_id", F.size("embedding").cast("long").alias("dims"))


@query(f"SELECT doc_id FROM (SELECT doc_id, {_TRADE_SQL} AS x FROM documents) WHERE regexp_matches(x, '(?i)software|developer|qa') OR doc_id % 4 = 0")
def rows_in_scope(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a trade: by role or by skill."""
    title = F.element_at(F.array(*map(F.lit, _TRADE)), (F.col("doc_id") % len(_TRADE) + 1).cast("int"))
    skills = F.when(F.col("doc_id") % 4 == 0, F.array(F.lit("sql"))).otherwise(F.array().cast("array<string>"))
    return pairs.in_scope(_docs(spark, d).select("doc_id", title.alias("title"), skills.alias("skills")), "title", "skills", "software|developer|qa").select("doc_id")


@query("""
SELECT c_custkey, c_name, coalesce(array_to_string(list_sort(list_distinct(list(CAST(o_orderkey AS VARCHAR)) FILTER (o_orderkey IS NOT NULL))), ','), '') AS vacancy_ids
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name""")
def public_candidates(spark: SparkSession, d: str) -> DataFrame:
    """What may be shown of candidates, with the ids of their vacancies."""
    links = t(spark, d, "orders").select(F.col("o_custkey").alias("candidate_id"), F.col("o_orderkey").cast("string").alias("vacancy_id"))
    rows = workspace.linked_ids(t(spark, d, "customer").withColumnRenamed("c_custkey", "candidate_id"), links)
    out = pairs.public(rows, ["candidate_id", "c_name", "vacancy_ids"])
    return out.select(F.col("candidate_id").alias("c_custkey"), "c_name", F.array_join("vacancy_ids", ",").alias("vacancy_ids"))


@query("SELECT doc_id FROM documents WHERE length(trim(text)) > 0")
def usable_resumes(spark: SparkSession, d: str) -> DataFrame:
    """Resumes with a text."""
    return pairs.usable(_docs(spark, d).withColumn("text_length", F.length(F.trim("text")))).select("doc_id")


@query("""
SELECT query_id, vacancy_id, CAST(rank AS INTEGER) AS rank FROM (SELECT o_custkey AS query_id, o_orderkey AS vacancy_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 5""")
def reranked_top(spark: SparkSession, d: str) -> DataFrame:
    """By score, then id."""
    rows = t(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("vacancy_id"), F.col("o_totalprice").cast("double").alias("score"))
    return retrieval.ranked(rows, ["query_id"], "score", ["vacancy_id"], 5).select("query_id", "vacancy_id", "rank")


@query("""
SELECT doc_id, array_to_string(list_transform(list_filter([source, lang], lambda s: trim(s) <> ''), lambda s: trim(s)), '|') AS fields FROM documents""")
def allowed_columns(spark: SparkSession, d: str) -> DataFrame:
    """Exactly the columns that are allowed (P10)."""
    rows = validation.allowed_only(_docs(spark, d).select("doc_id", "source", "lang"), ["doc_id", "source", "lang"])
    return rows.select("doc_id", F.concat_ws("|", F.trim("source"), F.trim("lang")).alias("fields"))
