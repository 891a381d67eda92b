"""NumPy archives as a data source, and beats as a table function."""

from __future__ import annotations

import io
import zipfile

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from wavelattice.operators import signal
from wavelattice.sources import npz

CASES = "path string, patient_id string, fs double, abp array<double>, failure string"


@pytest.fixture
def source(spark):
    npz.register(spark)
    return spark


def test_round_trip_and_numpy_reads_it(source, tmp_path):
    rows = [(f"c{k}", f"p{k}", 125.0, [0.5 * k, float("nan")] * k, [[1.0, 2.0], [3.0, float(k)]], [k, 7], None if k == 2 else "x") for k in range(1, 6)]
    schema = "name string, patient_id string, fs double, abp array<double>, basis array<array<double>>, n array<int>, note string"
    df = source.createDataFrame(rows, schema).repartition(3)
    out = tmp_path / "cases"
    df.write.format("npz").mode("append").save(str(out))
    assert sorted(p.name for p in out.iterdir()) == [f"c{k}.npz" for k in range(1, 6)]
    with np.load(out / "c2.npz") as z:
        assert sorted(z.files) == ["abp", "basis", "fs", "n", "patient_id"]
        assert (str(z["patient_id"]), float(z["fs"]), z["basis"].tolist(), z["n"].tolist()) == ("p2", 125, [[1, 2], [3, 2]], [2, 7])
    found = source.read.format("npz").schema(schema.replace("name string", "path string")).load(str(out))
    got = sorted(found.collect(), key=lambda r: r.patient_id)
    for row, r in zip(rows, got, strict=True):
        assert r.path.endswith(f"/{row[0]}.npz") and np.array_equal(r.abp, row[3], equal_nan=True)
        assert tuple(r)[1:3] == row[1:3] and tuple(r)[4:] == row[4:]
    df.limit(1).write.format("npz").mode("overwrite").save(str(out))
    assert len(list(out.iterdir())) == 1


def test_only_what_is_asked_for_is_read(source, tmp_path):
    """A member that is damaged does not matter unless the schema names it; neither do archives in other folders."""
    data = io.BytesIO()
    np.savez(data, ABP=np.arange(4.0), patient_id="p", fs=np.array([125.0]))
    raw = data.getvalue()
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        at = z.getinfo("patient_id.npy").header_offset
    broken = bytearray(raw)
    broken[at + 194] ^= 255
    (tmp_path / "a.npz").write_bytes(bytes(broken))
    (tmp_path / "b.npz").write_bytes(raw)
    (tmp_path / "c.npz").write_bytes(b"no archive")
    (tmp_path / "_temporary-1").mkdir()
    (tmp_path / "_temporary-1" / "d.npz").write_bytes(raw)
    (tmp_path / "e.txt").write_text("x")
    path = str(tmp_path)
    rows = {r.path[-5]: r for r in source.read.format("npz").schema("path string, fs double, abp array<double>, missing long, failure string").load(path).collect()}
    assert sorted(rows) == ["a", "b", "c"]
    assert all(rows[k].abp == [0, 1, 2, 3] and rows[k].fs == 125 and rows[k].missing is None and rows[k].failure is None for k in "ab")
    assert rows["c"].abp is None and rows["c"].failure
    whole = {r.path[-5]: r for r in source.read.format("npz").load(path).collect()}
    assert whole["a"].failure and whole["b"].patient_id == "p" and not whole["b"].failure
    with pytest.raises(PySparkException):
        source.read.format("npz").schema("fs double").load(path).collect()


def test_partitions_go_by_bytes(spark, tmp_path):
    for k in range(6):
        np.savez(tmp_path / f"{k}.npz", abp=np.zeros(1000))
    size = (tmp_path / "0.npz").stat().st_size
    reader = lambda most: npz.NpzReader(spark.createDataFrame([], CASES).schema, {"path": str(tmp_path), "maxPartitionBytes": most})
    assert [len(p.paths) for p in reader(2 * size).partitions()] == [2, 2, 2]
    assert [len(p.paths) for p in reader(1).partitions()] == [1] * 6
    assert [len(p.paths) for p in reader(64 << 20).partitions()] == [6]


def test_a_failed_write_leaves_nothing(source, tmp_path):
    out = tmp_path / "out"
    for names in (["a", "a"], ["a", "../b"]):
        with pytest.raises(PySparkException):
            source.createDataFrame([(n, 1.0) for n in names], "name string, x double").repartition(2).write.format("npz").mode("append").save(str(out))
        assert not out.exists() or list(out.rglob("*.npz")) == []


def test_beats_by_table_function(spark):
    from wavelattice.plans.tables import pressures

    cases = pressures(spark, "/root/testdata/sf0.001").cache()
    want = signal.beat_catalog(cases).orderBy("patient_id", "beat_id").collect()
    signal.register_beats(spark)
    cases.createOrReplaceTempView("cases")
    found = spark.sql("SELECT c.patient_id, b.* FROM cases c, LATERAL beats(c.fs, c.abp) b ORDER BY patient_id, beat_id").collect()
    assert len(want) > 50 and [tuple(r) for r in found] == [tuple(r) for r in want]
    odd = spark.createDataFrame([(None, [1.0]), (125.0, None), (125.0, [float("nan")])], "fs double, abp array<double>")
    odd.createOrReplaceTempView("odd_cases")
    rows = spark.sql("SELECT b.* FROM odd_cases c, LATERAL beats(c.fs, c.abp) b").collect()
    assert len(rows) == 3 and all(r.beat_id is None and r.failure for r in rows)
    assert spark.sql("SELECT max(b.beat_id) AS m FROM cases c, LATERAL beats(c.fs, c.abp) b").first().m == max(r.beat_id or 0 for r in want)
    assert want and F
