"""Matrix files, and places of rows in the order of a whole table."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillrank.operators import ordering
from quillrank.sources import npy


def _matrix(n=1000, width=6, kind="<f4"):
    return np.random.default_rng(3).normal(size=(n, width)).astype(kind)


@pytest.mark.parametrize("kind", ["<f4", "<f8"])
def test_a_file_of_numpy_is_read_by_ranges_of_rows(spark, tmp_path, kind):
    m = _matrix(kind=kind)
    np.save(tmp_path / "m.npy", m)
    got = npy.read_matrix(spark, f"{tmp_path}/m.npy", 4096)
    assert got.rdd.getNumPartitions() > 5
    rows = sorted(got.collect())
    assert [r.row for r in rows] == list(range(1000)) and np.array_equal(np.array([r.vector for r in rows], kind), m)


def test_what_is_written_is_read_and_loads_in_numpy(spark, tmp_path):
    m = _matrix()
    rows = spark.createDataFrame([(5000 - 3 * i, v.tolist()) for i, v in enumerate(m)], "id int, v array<float>")
    places = npy.write_matrix(rows, "id", "v", f"{tmp_path}/out", 2048)
    back = npy.read_matrix(spark, f"{tmp_path}/out").join(places, "row").join(rows, "id")
    assert back.count() == 1000 and back.filter("vector = v").count() == 1000
    assert [r.id for r in places.orderBy("row").collect()] == sorted(5000 - 3 * i for i in range(1000))
    manifest = json.loads((tmp_path / "out" / npy.MANIFEST).read_text())
    whole = np.concatenate([np.load(tmp_path / "out" / p["file"]) for p in manifest["files"]])
    assert np.array_equal(whole, m[::-1]) and len(manifest["files"]) >= 12 and max(p["rows"] for p in manifest["files"]) <= 86
    with pytest.raises(Exception, match="taken"):
        npy.write_matrix(rows, "id", "v", f"{tmp_path}/out")


def test_empty_and_odd_matrices(spark, tmp_path):
    none = spark.createDataFrame([], "id int, v array<double>")
    npy.write_matrix(none, "id", "v", f"{tmp_path}/none")
    assert npy.read_matrix(spark, f"{tmp_path}/none").collect() == []
    np.save(tmp_path / "zero.npy", np.zeros((0, 4)))
    assert npy.read_matrix(spark, f"{tmp_path}/zero.npy").collect() == []
    for i, bad in enumerate([[(1, [1.0]), (2, None)], [(1, [1.0]), (2, [1.0, None])], [(1, [1.0]), (2, [1.0, 2.0])]]):
        with pytest.raises(Exception, match="vector|length"):
            npy.write_matrix(spark.createDataFrame(bad, "id int, v array<double>"), "id", "v", f"{tmp_path}/bad{i}")
        with pytest.raises(Exception, match="no manifest|nothing there"):
            npy.read_matrix(spark, f"{tmp_path}/bad{i}").collect()


def test_wrong_files_are_refused(spark, tmp_path):
    for name, m in (("ints", np.zeros((2, 2), "<i4")), ("cube", np.zeros((2, 2, 2))), ("fortran", np.asfortranarray(np.ones((3, 2))))):
        np.save(tmp_path / f"{name}.npy", m)
        with pytest.raises(Exception, match="two dimensions"):
            npy.read_matrix(spark, f"{tmp_path}/{name}.npy").collect()
    (tmp_path / "text.npy").write_text("no matrix at all")
    with pytest.raises(Exception, match="no matrix header"):
        npy.read_matrix(spark, f"{tmp_path}/text.npy").collect()
    np.save(tmp_path / "cut.npy", _matrix())
    (tmp_path / "cut.npy").write_bytes((tmp_path / "cut.npy").read_bytes()[:-4])
    with pytest.raises(Exception, match="bytes"):
        npy.read_matrix(spark, f"{tmp_path}/cut.npy").collect()


def test_a_changed_file_of_a_folder_is_refused(spark, tmp_path):
    npy.write_matrix(spark.createDataFrame([(i, [float(i)]) for i in range(10)], "id int, v array<double>"), "id", "v", f"{tmp_path}/out")
    part = next((tmp_path / "out").glob("part-*"))
    data = bytearray(part.read_bytes())
    data[-1] ^= 1
    part.write_bytes(data)
    with pytest.raises(Exception, match="changed since"):
        npy.read_matrix(spark, f"{tmp_path}/out").collect()


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_places_are_those_of_one_sorted_table(spark, parts):
    rows = [(i, None if i % 11 == 0 else i * 37 % 50, f"n{i * 13 % 7}") for i in range(500)]
    df = spark.createDataFrame(rows, "id int, a int, b string").repartition(5)
    got = {r.id: r.place for r in ordering.numbered(df, [("a", True), ("b", False), ("id", True)], parts=parts).collect()}
    want = df.orderBy(F.desc("a"), "b", F.desc("id")).collect()
    assert [r.id for r in want] == sorted(got, key=got.get) and sorted(got.values()) == list(range(1, 501))


def test_places_of_no_rows_equal_rows_and_a_taken_name(spark):
    df = spark.createDataFrame([(1,)] * 300 + [(None,)] * 5, "a int")
    assert sorted(r.place for r in ordering.numbered(df, [("a", False)]).collect()) == list(range(1, 306))
    assert ordering.numbered(df.limit(0), [("a", False)]).count() == 0
    with pytest.raises(ValueError):
        ordering.numbered(df, [("a", False)], "a")
