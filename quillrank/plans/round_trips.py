"""Queries that write a table with one of the engine's sinks and read it back with one of its scans.

Documents, customers and conversations are written to the folder that the cluster shares; what is read back is held
against the tables themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import retrieval
from ..sources import io
from .catalogue import WORDS, query, shared_folder, t


def _csv(rows: DataFrame, name: str) -> str:
    """Rows as a CSV as other programs write it: all cells quoted, quotes doubled, lines inside cells."""
    path = shared_folder(rows.sparkSession, name)
    rows.write.csv(path, header=True, quoteAll=True, escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return path


@query(r"SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5(replace(text, chr(13), '')) AS text, source, lpad(CAST(doc_id AS VARCHAR), 7, '0') AS padded FROM documents")
def csv_verbatim(spark: SparkSession, d: str) -> DataFrame:
    """Cells of a CSV as they are: lines and quotes inside, zeros in front, no type guessed."""
    docs = t(spark, d, "documents").select("doc_id", F.replace("text", F.lit("\r"), F.lit("")).alias("text"), "source", F.lpad(F.col("doc_id").cast("string"), 7, "0").alias("padded"))
    return io.read_csv(spark, _csv(docs, "csv")).select("doc_id", F.md5("text").alias("text"), "source", "padded")


@query("""
SELECT 'r' || c_custkey AS resume_id, c_mktsegment || ',' || lower(c_name) AS skills, CASE WHEN c_custkey % 4 = 0 THEN 2 ELSE 0 END AS errors, c_custkey % 3 = 0 AS review_required,
  CASE WHEN c_custkey % 7 > 0 THEN CAST(length(c_name) AS INTEGER) END AS text_length FROM customer""")
def resume_scan(spark: SparkSession, d: str) -> DataFrame:
    """Resumes with typed skills, errors and lengths (S3)."""
    k = F.col("c_custkey")
    rows = t(spark, d, "customer").select(
        F.concat(F.lit("r"), k).alias("resume_id"), F.to_json(F.array(F.col("c_mktsegment"), F.lower("c_name"))).alias("skills"), F.when(k % 4 == 0, '[{"page":1,"error":"x"},{"page":2,"error":"y"}]').otherwise("[]").alias("extraction_errors"),
        F.when(k % 3 == 0, "True").otherwise("False").alias("review_required"), F.when(k % 7 > 0, F.length("c_name").cast("string")).otherwise("many").alias("text_length"), F.col("c_name").alias("text"),
    )
    got = io.read_resumes(spark, _csv(rows, "resumes"))
    return got.select("resume_id", F.array_join("skills", ",").alias("skills"), F.size("extraction_errors").alias("errors"), "review_required", "text_length")


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'doc' || c_custkey WHEN c_custkey % 3 = 1 THEN 'res' || c_custkey ELSE 'cv_' || substr(sha256(c_name), 1, 16) END AS id FROM customer""")
def resume_ids(spark: SparkSession, d: str) -> DataFrame:
    """The first id that is not blank, else a hash of the text."""
    k = F.col("c_custkey")
    rows = t(spark, d, "customer").select("c_custkey", F.when(k % 3 == 0, F.concat(F.lit(" doc"), k)).otherwise(" ").alias("document_id"), F.when(k % 3 == 1, F.concat(F.lit("res"), k)).alias("resume_id"), F.lit("").alias("cv_id"), F.col("c_name").alias("text"))
    return rows.select("c_custkey", io.resume_id().alias("id"))


_DISPLAY = "'Title: ' || p_name || CASE WHEN p_size % 2 = 0 THEN chr(10) || 'Experience: ' || p_size || ' years' ELSE '' END || chr(10) || 'Requirements: ' || p_type || CASE WHEN p_size % 5 = 0 THEN '' ELSE chr(10) || 'Description: ' || p_brand END"


@query(f"""
SELECT p_partkey, {_DISPLAY} AS display, sha256({_DISPLAY}) AS source_sha256, CASE WHEN p_partkey % 2 = 0 THEN 'own' || p_partkey ELSE 'vac_' || substr(sha256({_DISPLAY}), 1, 16) END AS vacancy_id FROM part""")
def vacancy_displays(spark: SparkSession, d: str) -> DataFrame:
    """Labelled fields of a vacancy, blank ones left out, their hash and an id."""
    k, size = F.col("p_partkey"), F.col("p_size")
    rows = t(spark, d, "part").select(
        "p_partkey", F.when(k % 2 == 0, F.concat(F.lit("own"), k)).otherwise(" ").alias("vacancy_id"), F.col("p_name").alias("title"), F.when(size % 2 == 0, F.concat(size, F.lit(" years"))).alias("experience"),
        F.col("p_type").alias("requirements"), F.lit("  ").alias("responsibilities"), F.when(size % 5 > 0, F.col("p_brand")).otherwise("").alias("text"),
    )
    return io.vacancy_display(rows).select("p_partkey", "display", "source_sha256", "vacancy_id")


_NAMED = "list_filter([" + ", ".join(f"'{w}'" for w in sorted(WORDS)) + "], lambda w: regexp_matches(lower(x), '(^|[^\\pL\\pM\\pN_])' || w || '([^\\pL\\pM\\pN_]|$)'))"


@query(f"""
WITH v AS (SELECT conv_id, turn, role || chr(10) || 'the ' || role || chr(10) || text AS x, text FROM conversations)
SELECT 'v' || conv_id || '-' || turn AS vacancy_id, array_to_string({_NAMED}, ',') AS skills, md5(replace(text, chr(13), '')) AS text FROM v""")
def vacancy_list(spark: SparkSession, d: str) -> DataFrame:
    """A catalogue whose skills are found anew in title, requirements and text."""
    rows = t(spark, d, "conversations").select(F.concat(F.lit("v"), "conv_id", F.lit("-"), "turn").alias("vacancy_id"), F.col("role").alias("title"), F.concat(F.lit("the "), "role").alias("requirements"), F.replace("text", F.lit("\r"), F.lit("")).alias("text"), F.lit("stale").alias("skills"))
    got = io.read_vacancies(spark, _csv(rows, "vacancies"), WORDS)
    return got.select("vacancy_id", F.array_join("skills", ",").alias("skills"), F.md5("text").alias("text"))


@query("SELECT doc_id, md5(text) AS text, source, CAST(n_chars AS DOUBLE) / 4 AS quarter FROM documents")
def json_lines(spark: SparkSession, d: str) -> DataFrame:
    """JSON lines with declared types, written and read."""
    path = shared_folder(spark, "jsonl")
    t(spark, d, "documents").select("doc_id", "text", "source", (F.col("n_chars").cast("double") / 4).alias("quarter")).write.json(path)
    got = io.read_jsonl(spark, path, "doc_id bigint, text string, source string, quarter double")
    return got.select("doc_id", F.md5("text").alias("text"), "source", "quarter")


@query("""
SELECT conv_id AS id, 'p' || conv_id AS pair_id, CASE WHEN conv_id % 3 = 1 THEN NULL ELSE 10 * conv_id + CASE WHEN conv_id % 3 = 0 THEN 1 ELSE 0 END END AS annotation, CASE WHEN conv_id % 3 = 1 THEN NULL ELSE 'good' || conv_id END AS value
FROM (SELECT DISTINCT conv_id FROM conversations)""")
def annotation_export(spark: SparkSession, d: str) -> DataFrame:
    """Tasks of an export, an array of nested JSON, each with its last annotation that was not cancelled."""
    k = F.col("conv_id")

    def annotation(n: int, cancelled) -> object:
        result = F.array(F.struct(F.lit("r").alias("id"), F.lit("overall").alias("from_name"), F.lit("rating").alias("type"), F.concat(F.lit("good"), k).alias("value")))
        return F.struct((k * 10 + n).alias("id"), cancelled.alias("was_cancelled"), result.alias("result"))

    task = F.struct(k.alias("id"), F.struct(F.concat(F.lit("p"), k).alias("pair_id")).alias("data"), F.array(annotation(0, k % 3 == 1), annotation(1, k % 3 > 0)).alias("annotations"))
    path = shared_folder(spark, "export")
    tasks = t(spark, d, "conversations").select("conv_id").distinct().select(F.to_json(task).alias("task"), F.floor(k / 1000).alias("file"))
    # a file is one array of a thousand tasks at most
    tasks.groupBy("file").agg(F.concat(F.lit("["), F.concat_ws(",", F.collect_list("task")), F.lit("]")).alias("value")).repartition("file").write.partitionBy("file").text(path)
    got = io.read_annotation_export(spark, f"{path}/*")
    return got.select("id", "pair_id", F.col("annotation.id").alias("annotation"), F.col("annotation.result")[0]["value"].alias("value"))


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN doc_id % 3 = 0 THEN '''=1+' WHEN doc_id % 3 = 1 THEN '''@' ELSE '' END || source AS cell FROM documents")
def csv_for_spreadsheets(spark: SparkSession, d: str) -> DataFrame:
    """An export for spreadsheets read back: ';', a byte order mark, no cell that is a formula."""
    path = shared_folder(spark, "export-csv")
    k = F.col("doc_id")
    io.export_csv(t(spark, d, "documents").select(k.cast("string").alias("doc_id"), F.concat(F.when(k % 3 == 0, "=1+").when(k % 3 == 1, "@").otherwise(""), "source").alias("cell")), path, ["doc_id", "cell"])
    return io.read_csv(spark, path, sep=";").select("doc_id", "cell")


@query("SELECT vec_id, len(embedding) AS dims, (SELECT count(*) FROM embeddings) AS rows_in_manifest FROM embeddings")
def published_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Vectors and their manifest, which is published last."""
    path = shared_folder(spark, "index")
    rows = t(spark, d, "embeddings").select("vec_id", "embedding")
    io.publish(rows, rows.agg(F.count(F.lit(1)).alias("rows")), path)
    manifest = spark.read.schema("rows bigint").json(f"{path}/manifest")
    return spark.read.parquet(f"{path}/data").crossJoin(F.broadcast(manifest)).select("vec_id", F.size("embedding").cast("long").alias("dims"), F.col("rows").alias("rows_in_manifest"))


@query("SELECT c_custkey, c_name || chr(10) || 'and more' AS title, c_mktsegment AS city, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal || ' KZT' END AS salary, 'free ' || c_nationkey AS text FROM customer")
def vacancy_files(spark: SparkSession, d: str) -> DataFrame:
    """Labelled fields of vacancy files in three languages."""
    salary = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("Зарплата : "), "c_acctbal", F.lit(" KZT\n"))).otherwise("")
    file = F.concat(F.lit("free "), "c_nationkey", F.lit("\nTitle: "), "c_name", F.lit("\nand more\n"), salary, F.lit("ҚАЛА："), "c_mktsegment")
    got = t(spark, d, "customer").select("c_custkey", io.parsed_vacancies(file).alias("f"))
    return got.select("c_custkey", *[F.col("f")[k].alias(k) for k in ("title", "city", "salary", "text")])


@query("SELECT doc_id, source, (SELECT count(*) FROM documents WHERE lower(source) = 'src3' AND contains(lower(text), 'the')) AS total FROM documents WHERE lower(source) = 'src3' AND contains(lower(text), 'the') ORDER BY doc_id LIMIT 20")
def catalogue_page(spark: SparkSession, d: str) -> DataFrame:
    """A page of a catalogue: of one city and with a substring, both asked for at once."""
    page, total = retrieval.search(t(spark, d, "documents"), ["text"], "The", "SRC3", "source", order="doc_id")
    return page.select("doc_id", "source").crossJoin(F.broadcast(total))


@query(r"""
WITH l AS (SELECT doc_id, md5(text) AS digest FROM documents)
SELECT 'doc_' || substr(sha256(digest), 1, 12) AS id, doc_id FROM l""")
def ids_of_texts(spark: SparkSession, d: str) -> DataFrame:
    """Ids made of a prefix and a hash."""
    return t(spark, d, "documents").select(tx.hex_id("doc_", 12, F.md5("text")).alias("id"), "doc_id")
