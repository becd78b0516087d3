"""Matrices in NPY files as a Spark data source, read and written by ranges of rows.

A matrix is one ``.npy`` file, as numpy saves it, or a folder of such files with a manifest. Rows are read in ranges of about
``RANGE_BYTES``, each by a seek, so no task holds a matrix. What is written is a folder: each task writes its rows in
files of at most that size, and the manifest, which names the files, their rows and their SHA-256, comes last, so that a run that
is lost, or a task that runs twice, leaves files which nobody reads.

Defined results: two dimensions, C order, ``<f4`` or ``<f8``; any other header, a file longer or shorter than its header says, a
file of the folder whose hash has changed, a folder without a manifest, rows of different lengths, and null vectors, components or
rows are errors. A matrix of no rows is a folder whose manifest has no files. Components that are no numbers come back as they are.
"""

from __future__ import annotations

import hashlib
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..operators import ordering

RANGE_BYTES = 16 << 20
MANIFEST = "manifest.json"
KINDS = {"<f4": ("float", pa.float32()), "<f8": ("double", pa.float64())}


class MatrixError(ValueError):
    """A file is not the matrix it should be."""


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


@dataclass(frozen=True)
class Header:
    rows: int
    width: int
    kind: str
    starts: int

    @property
    def row_bytes(self) -> int:
        return self.width * np.dtype(self.kind).itemsize


def header_of(path: str) -> Header:
    """The header of a matrix file, held against the file's size."""
    fs, at = _place(path)
    with fs.open_input_file(at) as f:
        try:
            version = np.lib.format.read_magic(f)
            shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
        except ValueError as e:
            raise MatrixError(f"{path}: no matrix header: {e}") from e
        starts, size = f.tell(), f.size()
    if len(shape) != 2 or fortran or dtype.str not in KINDS:
        raise MatrixError(f"{path}: a matrix has two dimensions, C order and components <f4 or <f8, not {shape}, {dtype.str}")
    found = Header(shape[0], shape[1], dtype.str, starts)
    if size != starts + found.rows * found.row_bytes:
        raise MatrixError(f"{path}: {size} bytes, but the header says {starts + found.rows * found.row_bytes}")
    return found


def manifest_of(path: str) -> dict | None:
    """The manifest of a folder; None if the path is a file."""
    fs, at = _place(path)
    kind = fs.get_file_info(at).type
    if kind == pafs.FileType.NotFound:
        raise MatrixError(f"{path}: nothing there")
    if kind == pafs.FileType.File:
        return None
    if fs.get_file_info(f"{at}/{MANIFEST}").type != pafs.FileType.File:
        raise MatrixError(f"{path}: no manifest, so the matrix was not written to its end")
    with fs.open_input_file(f"{at}/{MANIFEST}") as f:
        return json.loads(f.read())


@dataclass
class _Range(InputPartition):
    path: str
    first: int  # the matrix row that the range begins with
    skip: int  # rows of the file before it
    rows: int
    sha256: str | None = None


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.bytes = int(options.get("rangebytes", RANGE_BYTES))

    def partitions(self) -> list[_Range]:
        manifest = manifest_of(self.path)
        if manifest is not None:
            return [_Range(f"{self.path}/{p['file']}", p["first"], 0, p["rows"], p["sha256"]) for p in manifest["files"]]
        head = header_of(self.path)
        step = max(1, self.bytes // max(1, head.row_bytes))
        return [_Range(self.path, i, i, min(step, head.rows - i)) for i in range(0, head.rows, step)]

    def read(self, partition: _Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a matrix without rows
            return
        head = header_of(partition.path)
        fs, at = _place(partition.path)
        with fs.open_input_file(at) as f:
            if partition.sha256 is not None:
                data = f.read()  # one file of the folder, of about RANGE_BYTES
                if hashlib.sha256(data).hexdigest() != partition.sha256:
                    raise MatrixError(f"{partition.path}: changed since its manifest was written")
                data = data[head.starts :]
            else:
                f.seek(head.starts + partition.skip * head.row_bytes)
                data = f.read(partition.rows * head.row_bytes)
        if len(data) != partition.rows * head.row_bytes:
            raise MatrixError(f"{partition.path}: ends early")
        flat = np.frombuffer(data, head.kind)
        lists = pa.ListArray.from_arrays(np.arange(partition.rows + 1, dtype=np.int32) * head.width, pa.array(flat, KINDS[head.kind][1]))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(partition.first, partition.first + partition.rows)), lists], ["row", "vector"])


@dataclass
class _Written(WriterCommitMessage):
    files: list[dict]


class _Writer(DataSourceWriter):
    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.path = options["path"]
        self.bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.kind = {"float": "<f4", "double": "<f8"}[schema["vector"].dataType.elementType.typeName()]
        fs, at = _place(self.path)
        if fs.get_file_info(at).type != pafs.FileType.NotFound:
            raise MatrixError(f"{self.path}: the place is taken")

    def _file(self, first: int, rows: list[list[float]]) -> dict:
        if any(v is None or None in v or len(v) != len(rows[0]) for v in rows):
            raise MatrixError(f"rows from {first} on: vectors of one length without nulls are needed")
        out = io.BytesIO()
        np.save(out, np.asarray(rows, self.kind).reshape(len(rows), -1), allow_pickle=False)
        name = f"part-{first:012d}-{uuid.uuid4().hex}.npy"
        fs, at = _place(self.path)
        fs.create_dir(at, recursive=True)
        with fs.open_output_stream(f"{at}/{name}") as f:
            f.write(out.getvalue())
        return {"file": name, "first": first, "rows": len(rows), "width": len(rows[0]), "sha256": hashlib.sha256(out.getvalue()).hexdigest()}

    def write(self, iterator: Iterator) -> _Written:
        files, first, held, size = [], 0, [], 0
        for row in iterator:
            if row["row"] is None or row["vector"] is None:
                raise MatrixError("a row without number or vector")
            if held and (row["row"] != first + len(held) or size >= self.bytes):
                files.append(self._file(first, held))
                held, size = [], 0
            if not held:
                first = row["row"]
            held.append(row["vector"])
            size += len(row["vector"]) * np.dtype(self.kind).itemsize
        return _Written(files + ([self._file(first, held)] if held else []))

    def commit(self, messages: list[_Written | None]) -> None:
        files = sorted((f for m in messages if m is not None for f in m.files), key=lambda f: f["first"])
        ends = [0] + [f["first"] + f["rows"] for f in files]
        if [f["first"] for f in files] != ends[:-1] or len({f["width"] for f in files}) > 1:
            raise MatrixError("rows are numbered from 0 without gaps and have one length")
        value = {"rows": ends[-1], "width": files[0]["width"] if files else 0, "kind": self.kind, "files": files}
        fs, at = _place(self.path)
        fs.create_dir(at, recursive=True)
        with fs.open_output_stream(f"{at}/{MANIFEST}") as f:
            f.write(json.dumps(value).encode())


class NpyMatrix(DataSource):
    """``spark.read.format("npymatrix")``: row (long, from 0) and vector; option ``rangeBytes``."""

    @classmethod
    def name(cls) -> str:
        return "npymatrix"

    def schema(self) -> str:
        manifest = manifest_of(self.options["path"])
        kind = manifest["kind"] if manifest is not None else header_of(self.options["path"]).kind
        return f"row bigint, vector array<{KINDS[kind][0]}>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, schema)


def read_matrix(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """row, vector of a matrix file, or of a folder that :func:`write_matrix` made."""
    spark.dataSource.register(NpyMatrix)
    return spark.read.format("npymatrix").option("rangeBytes", range_bytes).load(path)


def write_matrix(rows: DataFrame, key: str, vector: str, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Write vectors in the order of their keys, which must differ; gives key and row of each."""
    rows.sparkSession.dataSource.register(NpyMatrix)
    at = ordering.numbered(rows.select(key, vector), [(key, False)], "_place")
    at = at.select(key, (F.col("_place") - 1).alias("row"), F.col(vector).alias("vector"))
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    out = at.select("row", "vector").repartitionByRange(parts, "row").sortWithinPartitions("row")
    out.write.format("npymatrix").option("rangeBytes", range_bytes).mode("append").save(path)
    return at.drop("vector")
