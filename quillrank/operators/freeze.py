"""Frozen datasets: content-addressed, checked when they are opened, and published by a manifest written last.

A part's digest adds up a hash of each row, so it is the same whatever the order, the partitioning or the files, and is
found by partial sums; rows repeated are counted. The digest of the whole is that of its parts' and names the folder.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .grouping import leaks

MANIFEST = "manifest.json"
_PIECES, _DIGITS = 4, 15


class Changed(ValueError):
    """The data are not those that were frozen."""


class Leak(ValueError):
    """A key lies in more than one part."""


def row_form(columns: list[str]) -> Column:
    """A row as one string, no two different rows alike: each value with its length, null apart from every value."""
    value = lambda c: F.col(f"`{c}`").cast("string")
    return F.concat(*[F.when(value(c).isNull(), F.lit("N;")).otherwise(F.concat(F.length(value(c)), F.lit(":"), value(c), F.lit(";"))) for c in columns])


def digests(rows: DataFrame, part: str = "split") -> DataFrame:
    """``part, rows, digest`` for each value of the column ``part``; columns of nested types are read as JSON."""
    flat = rows.select(F.col(part).alias("_part"), *[(F.to_json(c) if t.startswith(("array", "struct", "map")) else F.col(f"`{c}`")).alias(c) for c, t in sorted(rows.dtypes) if c != part])
    h = F.sha2(row_form([c for c in flat.columns if c != "_part"]), 256)
    pieces = [F.sum(F.conv(F.substring(h, 1 + _DIGITS * k, _DIGITS), 16, 10).cast("decimal(20,0)")).alias(f"s{k}") for k in range(_PIECES)]
    own = flat.groupBy(F.col("_part").cast("string").alias("part")).agg(F.count(F.lit(1)).alias("rows"), *pieces)
    return own.select("part", "rows", F.sha2(F.concat_ws("|", F.col("rows").cast("string"), *[F.col(f"s{k}").cast("string") for k in range(_PIECES)]), 256).alias("digest"))


def whole_digest(parts: DataFrame) -> str:
    """The digest of all parts (part, digest): few rows, joined in order of their names."""
    line = F.concat(F.coalesce("part", F.lit("")), F.lit("="), "digest")
    return parts.agg(F.sha2(F.array_join(F.sort_array(F.collect_list(line)), ";"), 256)).first()[0]


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at(path))


def publish_json(spark: SparkSession, path: str, value: dict) -> None:
    """A small JSON file that is there whole or not at all, and is never overwritten: who claims the place first writes it."""
    fs, at = _fs(spark, path)
    if fs.exists(at(path)) or not fs.createNewFile(at(f"{path}.claim")):
        raise FileExistsError(path)
    aside = f"{path}.{uuid.uuid4().hex}"
    out = fs.create(at(aside), False)
    out.write(bytearray(json.dumps(value, sort_keys=True, ensure_ascii=False).encode()))
    out.close()
    if not fs.rename(at(aside), at(path)):
        raise FileExistsError(path)


def read_json(spark: SparkSession, path: str) -> dict:
    lines = spark.read.text(path, wholetext=True).collect()
    return json.loads(lines[0].value)


def freeze(rows: DataFrame, path: str, columns: list[str], part: str = "split", apart: tuple[str, ...] = ("candidate_group_id", "cv_id"), about: dict | None = None) -> dict:
    """Freeze ``columns`` (ids and targets, not texts) of rows under ``path``; the manifest.

    A value of ``apart`` in more than one part refuses the freeze, as does a path that has a manifest. Digests are taken of
    what was written, as it is read back. ``about`` goes into the manifest as it is.
    """
    spark = rows.sparkSession
    if exists(spark, f"{path}/{MANIFEST}"):
        raise FileExistsError(f"{path}/{MANIFEST}")
    for key in apart:
        if found := leaks(rows, key, part).limit(1).collect():
            raise Leak(f"{key} {found[0][0]!r} lies in several parts")
    own = rows.select(part, *[c for c in columns if c != part])
    at = f"{path}/data-{uuid.uuid4().hex[:12]}"
    own.write.partitionBy(part).mode("errorifexists").parquet(at)
    back = _read(spark, at, own.schema.json())
    parts = digests(back, part)
    manifest = {"data": at.rpartition("/")[2], "part": part, "schema": own.schema.json(), "parts": {r.part: {"rows": r.rows, "digest": r.digest} for r in parts.collect()}, "digest": whole_digest(parts), "about": about or {}}
    publish_json(spark, f"{path}/{MANIFEST}", manifest)
    return manifest


def _read(spark: SparkSession, at: str, schema: str) -> DataFrame:
    from pyspark.sql import types as T

    return spark.read.schema(T.StructType.fromJson(json.loads(schema))).parquet(at)


def manifest_of(spark: SparkSession, path: str) -> dict:
    """The manifest of a frozen dataset; FileNotFoundError where the freeze did not end."""
    if not exists(spark, f"{path}/{MANIFEST}"):
        raise FileNotFoundError(f"{path}/{MANIFEST}")
    return read_json(spark, f"{path}/{MANIFEST}")


def compared(spark: SparkSession, path: str) -> DataFrame:
    """``part, rows, digest, rows_now, digest_now, same``: each part as it was frozen and as it is."""
    m = manifest_of(spark, path)
    then = spark.createDataFrame([(k, v["rows"], v["digest"]) for k, v in sorted(m["parts"].items())], "part string, rows bigint, digest string")
    now = digests(_read(spark, f"{path}/{m['data']}", m["schema"]), m["part"]).withColumnsRenamed({"rows": "rows_now", "digest": "digest_now"})
    return then.join(now, "part", "full_outer").withColumn("same", F.col("digest").eqNullSafe(F.col("digest_now")))


def opened(spark: SparkSession, path: str, parts: list[str] | None = None) -> DataFrame:
    """The rows of a frozen dataset, or of some parts, after its digests were held against the manifest; :class:`Changed` names the parts that differ."""
    m = manifest_of(spark, path)
    if bad := sorted(r.part or "" for r in compared(spark, path).filter("not same").collect()):
        raise Changed(f"not as frozen: {', '.join(bad)}")
    rows = _read(spark, f"{path}/{m['data']}", m["schema"])
    return rows if parts is None else rows.filter(reduce(add, [(F.col(m["part"]) == p).cast("int") for p in parts]) > 0)
