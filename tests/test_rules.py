"""Record times, covariance metrics, file rules and manifest checks."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelattice.functions import scalars as S
from wavelattice.operators import guards, integrity, regression


def test_record_start_falls_back_to_the_path(spark):
    rows = [("p1-2101-02-03-04-05-06", "x"), (" ", "a/p1/p1-2101-02-03-04-05/"), (None, "p2-2101-02-03-04-05-07"), ("odd", "p2-2101-02-03-04-05"), ("", "p2-2101-02-30-04-05"), (None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, n string, p string")
    got = [r[0] for r in df.orderBy("i").select(S.record_start(F.col("n"), F.col("p")).cast("string")).collect()]
    assert got == ["2101-02-03 04:05:06", "2101-02-03 04:05:00", "2101-02-03 04:05:07", None, None, None]


def test_covariance_metrics(spark):
    x = np.random.default_rng(3).normal(size=(200, 4)) @ np.diag([5, 2, 1, 0.1]) + 1e6
    x[:, 3] = x[:, 0]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double, d double").repartition(4)
    r = regression.covariance_metrics(df, ["a", "b", "c", "d"]).first()
    values = np.maximum(np.linalg.eigvalsh(np.cov(x.T))[::-1], 0)
    p = values[values > 0] / values.sum()
    assert (r.n, r.trace) == (200, pytest.approx(values.sum())) and np.allclose(r.eigenvalues, values, atol=1e-6)
    assert r.effective_rank == pytest.approx(np.exp(-(p * np.log(p)).sum()), rel=1e-5)
    assert (r.d90, r.d95) == tuple(int(np.searchsorted(np.cumsum(values) / values.sum(), t) + 1) for t in (0.9, 0.95))
    assert regression.covariance_metrics(df.limit(1), ["a", "b"]).first().trace is None
    assert regression.covariance_metrics(df.limit(9).withColumn("a", F.lit(1.0)), ["a"]).first().d90 is None


def test_file_rules(spark):
    want = {
        "code/a.py": ("CANDIDATE", "scientific, audit or publication code"),
        "Code/Logs/a.py": ("PRIVATE", "private, patient-level, checkpoint or log naming"),
        "results/x/Summary.CSV": ("CANDIDATE", "candidate aggregate result"),
        "results/x/other.csv": ("MANUAL_REVIEW", ""),
        "results/summary.npz": ("PRIVATE", "raw array suffix"),
        "data/CHARTEVENTS.csv": ("PRIVATE", "restricted source data"),
        "README.md": ("CANDIDATE", "known aggregate"),
        "readme.md": ("MANUAL_REVIEW", ""),
        ".npz": ("MANUAL_REVIEW", ""),
        None: ("MANUAL_REVIEW", ""),
    }
    df = spark.createDataFrame([(p,) for p in want], "path string")
    assert {r.path: (r.file_class, r.reason) for r in integrity.classified_files(df).collect()} == want


def test_manifest_checks(spark):
    args = dict(required=["patient_id", "fs"], ident="patient_id", rate=125.0, seconds=1800, aliases=["ABP"])
    good = spark.createDataFrame([("a", 125.0, 1800, "ABP"), ("b", 125.0, 1800, " ABP ")], "patient_id string, fs double, duration_sec int, abp_source_name string")
    assert all(r.passed for r in guards.manifest_checks(good, "m", 2, **args).collect())
    bad = spark.createDataFrame([("a", "x"), ("a", None), (None, "125")], "patient_id string, fs string")
    rows = {r.name: (r.passed, r.detail) for r in guards.manifest_checks(bad, "m", 3, **args).collect()}
    assert rows == {"m_required_fields": (True, "complete"), "m_row_count": (True, "rows=3 expected=3"), "m_unique_ids": (False, "unique=1 expected=3"), "m_blank_ids": (False, "blank=1"), "m_sampling_rate": (False, "bad_rows=2"), "m_duration": (False, "bad_rows=3"), "m_source_names": (False, "bad_rows=3")}
    assert not any(r.passed for r in guards.manifest_checks(good.limit(0).drop("fs"), "m", 2, **args).collect() if r.name in ("m_required_fields", "m_row_count", "m_unique_ids"))
