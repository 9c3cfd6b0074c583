import os
import struct

import pytest
from pyspark.sql import functions as F

from nearfield.sources import results as IO
from nearfield.sources import tables as T
from nearfield.sources import vecfile as VF
from tests.model import frame


def record(fmt, values):
    return struct.pack(f"<i{len(values)}{fmt}", len(values), *values)


def packed(fmt, rows):
    head = struct.pack("<II", len(rows), len(rows[0]))
    return head + b"".join(struct.pack(f"<{len(r)}{fmt}", *r) for r in rows)


def save(path, data):
    path.write_bytes(data)
    return str(path)


def rows(df):
    return [list(r["v"]) for r in sorted(df.collect(), key=lambda r: r["vec_id"])]


def test_record_files(spark, tmp_path):
    floats = save(tmp_path / "a.fvecs", record("f", [1, 2]) + record("f", [3, 4]))
    assert rows(VF.read_fvecs(spark, floats)) == [[1, 2], [3, 4]]
    assert rows(VF.read_fvecs(spark, floats, max_rows=1)) == [[1, 2]]
    ints = save(tmp_path / "a.ivecs", record("i", [10, 11, 12]) + record("i", [20, 21, 22]))
    read = VF.read_ivecs(spark, ints)
    assert rows(read) == [[10, 11, 12], [20, 21, 22]]
    truth = sorted(tuple(r) for r in VF.truth_rows(read).collect())
    assert truth[:2] == [(0, 1, 10), (0, 2, 11)] and len(truth) == 6


def test_counted_files(spark, tmp_path):
    floats = save(tmp_path / "a.fbin", packed("f", [[1, 2, 3], [4, 5, 6]]))
    assert rows(VF.read_fbin(spark, floats)) == [[1, 2, 3], [4, 5, 6]]
    ints = save(tmp_path / "a.ibin", packed("i", [[10, 11], [20, 21]]))
    assert rows(VF.read_ibin(spark, ints, max_rows=1)) == [[10, 11]]


def test_extension_decides_whatever_its_case(spark, tmp_path):
    path = save(tmp_path / "A.FVECS", record("f", [1.5]))
    assert rows(VF.read_vectors(spark, path)) == [[1.5]]
    assert VF.read_vectors(spark, path).schema["v"].dataType.simpleString() == "array<float>"
    with pytest.raises(Exception, match="unsupported vector file extension"):
        VF.read_vectors(spark, save(tmp_path / "a.txt", b"")).collect()


@pytest.mark.parametrize(
    "name, data, message",
    [
        ("a.fvecs", record("f", [1, 2]) + record("f", [3]) + b"\0" * 4, "rows that are not of dimension 2"),
        ("b.fvecs", record("f", [1, 2])[:-2], "ends inside row 0"),
        ("c.ivecs", record("i", [1, 2]) + record("i", [3, 4])[:5], "ends inside row 1"),
        ("d.fvecs", struct.pack("<i", 0), "dimension below 1"),
        ("e.fvecs", b"\1\0", "needs 4 bytes of dimension"),
        ("f.fbin", packed("f", [[1, 2], [3, 4]])[:-1], "too short for 2 rows"),
        ("g.ibin", struct.pack("<II", 3, 0), "dimension below 1"),
        ("h.ibin", b"\1", "needs 8 bytes of header"),
    ],
)
def test_bad_files(spark, tmp_path, name, data, message):
    with pytest.raises(Exception, match=message):
        VF.read_vectors(spark, save(tmp_path / name, data)).collect()


def test_missing_and_empty_files(spark, tmp_path):
    with pytest.raises(Exception, match="cannot open"):
        VF.read_fvecs(spark, str(tmp_path / "none.fvecs")).collect()
    assert rows(VF.read_fvecs(spark, save(tmp_path / "x.fvecs", b""))) == []


def test_ranges_cover_each_row_once(monkeypatch, tmp_path):
    path = save(tmp_path / "a.fvecs", b"".join(record("f", [i, -i]) for i in range(50)))
    monkeypatch.setattr(VF, "PARTITION_BYTES", 12 * 7)
    monkeypatch.setattr(VF, "BATCH_BYTES", 12 * 3)
    reader = VF.VecFileReader(path, "fvecs", 0)
    parts = reader.partitions()
    ids = [i for p in parts for b in reader.read(p) for i in b.column(0).to_pylist()]
    assert len(parts) == 8 and ids == list(range(50))
    limited = VF.VecFileReader(path, "fvecs", 9)
    assert sum(p.count for p in limited.partitions()) == 9


def test_id_filter_limits_the_read(spark, tmp_path):
    path = save(tmp_path / "a.fvecs", b"".join(record("f", [i]) for i in range(50)))
    reader = VF.VecFileReader(path, "fvecs", 0)
    list(reader.pushFilters([VF.LessThan(("vec_id",), 5)]))
    assert sum(p.count for p in reader.partitions()) == 5
    kept = T.first_rows(VF.read_fvecs(spark, path), 5)
    assert rows(kept) == [[float(i)] for i in range(5)]
    # Rows past the bound are not even read: a damaged tail goes unnoticed.
    torn = save(tmp_path / "b.fvecs", b"".join(record("f", [i]) for i in range(50)) + b"\1\0\0\0\0")
    assert T.first_rows(VF.read_fvecs(spark, torn), 5).count() == 5
    with pytest.raises(Exception, match="ends inside row"):
        VF.read_fvecs(spark, torn).collect()
    assert T.first_rows(VF.read_fvecs(spark, path), 0).count() == 50


@pytest.mark.parametrize("kind", VF.KINDS)
def test_write_and_read_back(spark, tmp_path, kind):
    vectors = [[i, i + 1, -i] for i in range(100)]
    path = str(tmp_path / kind)
    points = frame(spark, vectors).repartition(5)
    if kind in VF.INT_KINDS:
        points = points.withColumn("v", F.col("v").cast("array<int>"))
    VF.write_vectors(points, path, kind)
    assert rows(VF.read_vectors(spark, path)) == vectors
    found = VF.vector_file_inventory(spark, [path]).collect()
    assert sum(r["rows"] for r in found) == 100
    assert all(r["dim"] == 3 and r["consistent"] and r["kind"] == kind for r in found)


def test_append_follows_and_overwrite_replaces(spark, tmp_path):
    path = str(tmp_path / "twice")
    first, second = [[i, 0] for i in range(30)], [[i, 1] for i in range(20)]
    VF.write_vectors(frame(spark, first), path, "fbin")
    VF.write_vectors(frame(spark, second), path, "fbin")
    assert rows(VF.read_vectors(spark, path)) == first + second
    VF.write_vectors(frame(spark, second), path, "fvecs", mode="overwrite")
    assert rows(VF.read_vectors(spark, path)) == second
    assert all(name.endswith(".fvecs") for name in os.listdir(path) if name[0] != ".")


@pytest.mark.parametrize("mode", ["append", "overwrite"])
def test_a_failed_write_leaves_the_folder_as_it_was(spark, tmp_path, mode):
    path = str(tmp_path / "kept")
    kept = [[i, i] for i in range(10)]
    VF.write_vectors(frame(spark, kept), path, "ibin")
    before = sorted(os.listdir(path))
    with pytest.raises(Exception, match="not all of dimension"):
        VF.write_vectors(frame(spark, [[1, 2]] * 50 + [[1]]).coalesce(1), path, "ibin", mode=mode)
    assert sorted(os.listdir(path)) == before and rows(VF.read_vectors(spark, path)) == kept


def test_counted_file_above_the_copy_buffer(spark, tmp_path):
    path = str(tmp_path / "long")
    wide = F.transform(F.sequence(F.lit(0), F.lit(1023)), lambda x: (x + F.col("id")).cast("float"))
    VF.write_vectors(spark.range(3000).select(F.col("id").alias("vec_id"), wide.alias("v")), path, "fbin")
    found = VF.read_vectors(spark, path)
    assert found.count() == 3000
    assert found.filter((F.col("v")[0] != F.col("vec_id")) | (F.col("v")[1023] != F.col("vec_id") + 1023)).count() == 0


def test_rows_before_a_missing_tail(spark, tmp_path):
    torn = save(tmp_path / "torn.fbin", packed("f", [[1, 2], [3, 4], [5, 6]])[:-1])
    assert rows(VF.read_fbin(spark, torn, max_rows=2)) == [[1, 2], [3, 4]]
    with pytest.raises(Exception, match="too short for 3 rows"):
        VF.read_fbin(spark, torn, max_rows=3).collect()


def test_inventory_lists_hdf5(spark, tmp_path):
    save(tmp_path / "a.hdf5", b"\x89HDF\r\n\x1a\n" + b"\0" * 40)
    save(tmp_path / "b.hdf5", b"text")
    found = {r["path"].rsplit("/", 1)[1]: r for r in VF.vector_file_inventory(spark, [str(tmp_path)]).collect()}
    assert {n: (r["kind"], r["rows"], r["consistent"]) for n, r in found.items()} == {
        "a.hdf5": ("hdf5", None, True), "b.hdf5": ("hdf5", None, False)
    }


def test_inventory_flags_a_wrong_length(spark, tmp_path):
    save(tmp_path / "good.fbin", packed("f", [[1, 2]]))
    save(tmp_path / "short.fbin", struct.pack("<II", 20000, 3072))
    save(tmp_path / "tail.fvecs", record("f", [1, 2]) + b"\0")
    save(tmp_path / "notes.txt", b"x")
    found = {r["path"].rsplit("/", 1)[1]: r for r in VF.vector_file_inventory(spark, [str(tmp_path)]).collect()}
    assert {n: r["consistent"] for n, r in found.items()} == {
        "good.fbin": True, "short.fbin": False, "tail.fvecs": False
    }
    assert found["short.fbin"]["head_hex"] == "204e0000000c0000"


def test_metrics_round_trip(spark, tmp_path):
    table = spark.createDataFrame(
        [("a", "hash", 1.5, 0.95, 120.25, 300)], "name string, " + IO.METRICS_SCHEMA
    )
    IO.write_metrics(table, str(tmp_path / "deep" / "metrics"))
    back = IO.read_metrics(spark, str(tmp_path / "deep" / "metrics")).first()
    assert tuple(back) == ("hash", 1.5, 0.95, 120.25, 300)
    IO.write_summary(table, str(tmp_path / "summary"))
    # Every part file starts with the header.
    text = {line for p in (tmp_path / "summary").glob("*.csv") for line in p.read_text().splitlines()}
    assert sorted(text, reverse=True) == [
        "name\tmode\tbuild_sec\trecall_at_10\tqps\tedges", "a\thash\t1.500000\t0.950000\t120.250000\t300"
    ]
    assert IO.read_summary(spark, str(tmp_path / "summary")).first()["edges"] == 300
