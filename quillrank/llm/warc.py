"""WARC archives: a writer with revisit records, and a sequential reader.

A record is one gzip member. The reader feeds zlib a block at a time, takes the member's header,
frames the block by Content-Length and holds both digests against the bytes; it needs memory for
one record. Archives lie in the shared folder. Only files whose task was committed are named in the
manifest that the reader goes by, so a task that ran twice leaves no second copy in the results.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import bounded_batches, fresh_dir, written

LEAST_REVISIT = 1000
ROLL = 64 << 20
BLOCK = 1 << 16


class WarcError(ValueError):
    """An archive that does not hold what it says."""


class Record(NamedTuple):
    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes


def sha1_label(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    """A record's URN holds its page id, so that a reference to it can be followed without an index."""
    return f"<urn:quillrank:page:{'' if page_id is None else page_id}>"


def page_of(urn: str) -> int | None:
    return int(found) if (found := urn.rpartition(":")[2].rstrip(">")) else None


def encode_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One gzip member. A revisit keeps the HTTP header of its response, with the payload's length, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", " ".join(url.split())))
    if revisit:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to))]
    head += [("WARC-Payload-Digest", sha1_label(payload)), ("WARC-Block-Digest", sha1_label(block)), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    raw = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def _fields(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise WarcError(f"not a header line: {line[:80]!r}")
        out[name.decode().strip().lower()] = value.decode().strip()
    return out


def members(stream: BinaryIO) -> Iterator[bytes]:
    """What each gzip member of a stream holds."""
    pending = b""
    while pending := pending or stream.read(BLOCK):
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            if not pending and not (pending := stream.read(BLOCK)):
                raise WarcError("the archive ends within a member")
            try:
                parts.append(z.decompress(pending))
            except zlib.error as e:
                raise WarcError(f"not a gzip member: {e}") from e
            pending = z.unused_data
        yield b"".join(parts)


def read_records(stream: BinaryIO) -> Iterator[Record]:
    """The records of an archive, in order. Raises WarcError on wrong framing or a digest that does not match."""
    for raw in members(stream):
        head, blank, rest = raw.partition(b"\r\n\r\n")
        if not head.startswith(b"WARC/") or not blank:
            raise WarcError(f"not a record: {raw[:40]!r}")
        headers = _fields(head)
        if not (said := headers.get("content-length", "")).isdigit():
            raise WarcError("no content length")
        block, end = rest[: int(said)], rest[int(said) :]
        if len(block) != int(said) or end != b"\r\n\r\n":
            raise WarcError("the block is not as long as its content length")
        if sha1_label(block) != headers["warc-block-digest"]:
            raise WarcError("the block digest does not match")
        http, _, payload = block.partition(b"\r\n\r\n")
        fields = _fields(http)
        if headers["warc-type"] == "response":
            if len(payload) != int(fields["content-length"]) or sha1_label(payload) != headers["warc-payload-digest"]:
                raise WarcError("the payload digest does not match")
        yield Record(headers, fields, payload)


def planned(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """``page_id, url, payload, refers_to, revisit``: which rows of pages are revisits.

    Of rows with equal payloads of at least ``least`` bytes, that with the largest page_id is the
    response (rows that share this id too; a null id is smaller than any, and equal payloads
    under null ids alone are all responses). The copies are found on digests and joined back by the
    unique (page_id, digest), so a payload with many copies loads no task more than another.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("digest", F.sha1("payload"))
    marks = p.filter(F.octet_length("payload") >= least).select("page_id", "digest")
    tops = marks.groupBy("digest").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "top")
    again = marks.join(tops, "digest").filter("top is not null and not (page_id <=> top)").select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "top").distinct()
    out = p.join(again, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left")
    return out.select("page_id", "url", "payload", F.col("top").alias("refers_to"), F.col("top").isNotNull().alias("revisit"))


def write_warc(plan: DataFrame, folder: str) -> DataFrame:
    """Write the rows of :func:`planned` as archives in ``folder``; the manifest: ``path, records``."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        fs, root = FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        out, paths, records = None, [], []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None or size >= ROLL:
                    if out is not None:
                        out.close()
                    paths.append(f"{root}/{uuid.uuid4().hex}.warc.gz")
                    records.append(0)
                    out, size = fs.open_output_stream(paths[-1], compression=None), 0
                member = encode_record(row[0], row[1], row[2], row[3], row[4])
                out.write(member)
                size += len(member)
                records[-1] += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(records, pa.int64())], ["path", "records"])

    return bounded_batches(plan).select("page_id", "url", "payload", "refers_to", "revisit").mapInArrow(write, "path string, records bigint")


def read_warc(manifest: DataFrame, folder: str) -> DataFrame:
    """A row per record: ``page_id, url, payload_bytes, payload_digest`` (hex), ``record_type, refers_to``.

    A revisit's length and digest are those its headers give of the full payload.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        fs, _ = FileSystem.from_uri(folder)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        for batch in batches:
            for path, said in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = []
                with fs.open_input_stream(path, compression=None) as stream:
                    for r in read_records(stream):
                        h = r.headers
                        digest = base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:")).hex()
                        refers = page_of(h["warc-refers-to"]) if "warc-refers-to" in h else None
                        rows.append((page_of(h["warc-record-id"]), h.get("warc-target-uri"), int(r.http["content-length"]), digest, h["warc-type"], refers))
                if len(rows) != said:
                    raise WarcError(f"{path} has {len(rows)} records, not {said}")
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    spread = manifest.repartition(max(1, manifest.count()))
    return spread.select("path", "records").mapInArrow(read, "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def archive_round_trip(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Write pages (page_id, url, html) as WARC archives in the shared folder and read them back.

    A null html is an empty payload, a null url has no target, a null page_id stays null; repeated
    rows give repeated records; an empty table gives no rows. Other columns are not read.
    """
    spark = pages.sparkSession
    folder = fresh_dir(spark, "warc")
    if "://" not in folder and ":" not in folder.split("/")[0]:
        folder = f"file://{folder}"
    manifest = written(write_warc(planned(pages, least), folder), "warc-manifest")
    return read_warc(manifest, folder)
