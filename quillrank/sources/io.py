"""Scans and sinks. Schemas are declared: an inferred one would turn the id 007 into 7."""

from __future__ import annotations

import io as _io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import skills as sk
from ..functions import text as tx
from ..operators import ordering


def strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


VACANCY = strings("vacancy_id", "title", "company", "city", "salary", "experience", "employment", "text", "requirements", "responsibilities", "skills", "url", "publish_date", "category")
RESUME = strings("schema_version", "resume_id", "document_id", "filename", "source_sha256", "text_version", "text_sha256", "layouts", "extraction_errors", "review_required", "raw_text", "clean_text", "text", "skills", "skill_count", "raw_length", "clean_length", "text_length")
SHORTLIST = T.StructType([*strings("vacancy_id", "title", "requirements", "responsibilities", "experience").fields, *(T.StructField(n, T.DoubleType()) for n in ("skill_score", "semantic_score", "hybrid_score"))])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, sep: str = ",") -> DataFrame:
    """A CSV of strings as they are: quoted newlines, 'NA' and numerals kept, no trimming, a byte order mark dropped.

    Columns are taken by header name; without a schema all of the header's are strings.
    """
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', sep=sep, nullValue="\x00", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, encoding="UTF-8")
    raw = raw.toDF(*[c.lstrip("﻿") for c in raw.columns])
    if schema is None:
        return raw
    have = set(raw.columns)
    return raw.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256 of the bytes of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def read_vacancies(spark: SparkSession, path: str, lexicon=None) -> DataFrame:
    """The catalogue with skills found anew in title, requirements and text."""
    rows = read_csv(spark, path, VACANCY)
    full = F.concat_ws("\n", "title", "requirements", "text")
    return rows.withColumn("skills", sk.extract(full, lexicon) if lexicon is not None else sk.extract(full))


def read_resumes(spark: SparkSession, path: str) -> DataFrame:
    """Resumes with typed skills, errors and lengths; null skills mean the JSON is none (S3)."""
    rows = read_csv(spark, path, RESUME)
    rows = rows.withColumn("skills", sk.parse_json("skills")).withColumn("extraction_errors", F.from_json("extraction_errors", "array<struct<page:int,error:string>>"))
    for c in ("skill_count", "raw_length", "clean_length", "text_length"):
        rows = rows.withColumn(c, F.col(c).try_cast("int"))
    return rows.withColumn("review_required", F.lower("review_required").isin("true", "1"))


def resume_id(*names: str, text: str = "text") -> Column:
    """The first id that is not blank, else a hash of the text."""
    some = [F.nullif(F.trim(F.col(n)), F.lit("")) for n in names or ("document_id", "resume_id", "cv_id")]
    return F.coalesce(*some, tx.hex_id("cv_", 16, text))


def vacancy_display(rows: DataFrame) -> DataFrame:
    """display (labelled fields, blank ones left out), its hash, and an id where none is given."""
    parts = [F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) != "", F.concat(F.lit(f"{label}: "), F.col(c))) for label, c in (("Title", "title"), ("Experience", "experience"), ("Requirements", "requirements"), ("Responsibilities", "responsibilities"), ("Description", "text"))]
    out = rows.withColumn("display", F.concat_ws("\n", *parts)).withColumn("source_sha256", F.sha2("display", 256))
    return out.withColumn("vacancy_id", F.coalesce(F.nullif(F.trim("vacancy_id"), F.lit("")), F.concat(F.lit("vac_"), F.substring("source_sha256", 1, 16))))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Lines of JSON; a line that does not fit fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


EXPORT = "id bigint, data struct<pair_id:string,cv_id:string,vacancy_id:string,cv_text:string,vacancy_display:string>, annotations array<struct<id:bigint,was_cancelled:boolean,result:array<struct<id:string,from_name:string,type:string,value:string>>>>"


def read_annotation_export(spark: SparkSession, path: str) -> DataFrame:
    """One row per task with its last annotation that was not cancelled; values stay JSON, read by their field."""
    rows = spark.read.schema(EXPORT).option("multiLine", True).json(path)
    done = F.filter("annotations", lambda a: ~F.coalesce(a["was_cancelled"], F.lit(False)))
    return rows.select("id", "data.*", F.try_element_at(done, F.lit(-1)).alias("annotation"))


def write_once(rows: DataFrame, path: str) -> None:
    """Parquet; refuses a place that is taken."""
    rows.write.mode("errorifexists").parquet(path)


def publish(rows: DataFrame, manifest: DataFrame, path: str) -> None:
    """Data first, then the manifest, so that whoever finds the manifest finds all of it."""
    rows.write.mode("errorifexists").parquet(f"{path}/data")
    manifest.coalesce(1).write.mode("errorifexists").json(f"{path}/manifest")


def export_csv(rows: DataFrame, path: str, columns: list[str]) -> None:
    """A CSV for spreadsheets: ';', a byte order mark in the first header, no cell that is a formula."""
    cells = [tx.export_cell(c).alias(c if i else f"﻿{c}") for i, c in enumerate(columns)]
    rows.select(*cells).write.mode("errorifexists").csv(path, sep=";", header=True, quoteAll=True, escape='"')


MOST_BYTES, MOST_CHARS, MOST_UNZIPPED = 8 << 20, 60_000, 30 << 20


def upload_text(name: str, data: bytes) -> str:
    """The text of an upload: txt or docx, within bounds; no document type in its XML."""
    if len(data) > MOST_BYTES:
        raise ValueError("too large")
    kind = name.rpartition(".")[2].lower()
    if kind == "txt":
        text = data.decode("utf-8-sig")
    elif kind == "docx":
        with zipfile.ZipFile(_io.BytesIO(data)) as z:
            if sum(i.file_size for i in z.infolist()) > MOST_UNZIPPED:
                raise ValueError("too large when unpacked")
            xml = z.read("word/document.xml")
        if b"<!DOCTYPE" in xml or b"<!ENTITY" in xml:
            raise ValueError("a document type is not allowed")
        w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
        marks = {f"{w}t": lambda e: e.text or "", f"{w}tab": lambda e: "\t", f"{w}br": lambda e: "\n"}
        text = "\n".join("".join(marks[e.tag](e) for e in p.iter() if e.tag in marks) for p in ElementTree.fromstring(xml).iter(f"{w}p"))
    else:
        raise ValueError(f"not a readable kind: {kind}")
    if len(text) > MOST_CHARS:
        raise ValueError("too long")
    return text.strip()


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """path, text, error of resume files; files over the bound are refused unread."""
    files = spark.read.format("binaryFile").load(path)

    @F.pandas_udf("text string, error string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for names, contents in batches:
            rows = []
            for name, data in zip(names, contents, strict=True):
                try:
                    rows.append((upload_text(name, bytes(data or b"")), None))
                except Exception as e:  # a file that cannot be read is a row with its reason
                    rows.append((None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["text", "error"])

    content = F.when(F.col("length") <= MOST_BYTES, F.col("content"))
    return files.select("path", "length", run("path", content).alias("r")).select("path", F.col("r.text").alias("text"), F.when(F.col("length") > MOST_BYTES, "too large").otherwise(F.col("r.error")).alias("error"))


def numbered_resumes(files: DataFrame) -> DataFrame:
    """Files in the order of their names in lower case, with ids resume_0001 and on (S23); files of one name come in any order."""
    at = ordering.numbered(files.withColumn("_lower", F.lower("filename")), [("_lower", False), ("filename", False)], "_place")
    return at.withColumn("resume_id", F.format_string("resume_%04d", "_place")).drop("_lower", "_place")


def resume_number(c: str | Column) -> Column:
    """resume_0006 -> 6."""
    col = F.col(c) if isinstance(c, str) else c
    return F.element_at(F.split(col, "_"), -1).try_cast("int")


# Labels of vacancy files in three languages.
LABELS = {
    "title": "title|название|должность|лауазым", "company": "company|компания|компания атауы", "city": "city|город|қала",
    "salary": "salary|зарплата|жалақы", "experience": "experience|опыт|тәжірибе", "requirements": "requirements|требования|талаптар",
    "responsibilities": "responsibilities|обязанности|міндеттер",
}


def parse_vacancy(text: str) -> dict[str, str]:
    """Labelled fields of a vacancy file; lines without a label belong to the field before, or to the text."""
    out, now = {}, "text"
    for line in text.splitlines():
        for name, labels in LABELS.items():
            if m := re.match(rf"\s*(?:{labels})\s*[:：]\s*(.*)$", line, re.I):
                now, line = name, m[1]
                break
        out[now] = f"{out[now]}\n{line}" if now in out else line
    return {k: v.strip() for k, v in out.items() if v.strip()}


def parsed_vacancies(c: str | Column) -> Column:
    """:func:`parse_vacancy` of a column of files' texts, as a map of the fields that a file has; null for a null text."""

    @F.pandas_udf("map<string,string>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else parse_vacancy(t) for t in texts], dtype=object)

    return run(F.col(c) if isinstance(c, str) else c)
