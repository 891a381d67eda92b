"""Recordings in pieces against the whole ones, cut at every place."""

from __future__ import annotations

import numpy as np
import pytest

from wavelattice.operators import recordings as R
from wavelattice.operators import signal
from wavelattice.plans import release
from wavelattice.plans.tables import pressures

SCHEMA = "patient_id string, at long, abp array<double>, other int"


def pressure(n, seed):
    t = np.arange(n) / 125
    return 90 + 20 * np.sin(2 * np.pi * 1.2 * t) + 9 * np.sin(4.2 * np.pi * 1.2 * t + 0.5) + np.random.default_rng(seed).normal(0, 2, n)


def cut(name, x, ends):
    """Rows of a recording cut before each of ``ends``."""
    edges = [0, *ends, len(x)]
    return [(name, a, x[a:b].tolist(), 1) for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a]


def whole(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["patient_id"], r["at"])):
        out.setdefault(r["patient_id"], []).extend(r["abp"])
    return {k: np.array(v) for k, v in out.items()}


def test_filter_in_pieces_equals_the_whole_one(spark):
    x, coefficients = pressure(400, 0), signal.band_pass()
    cuts = {f"c{k}": [k] for k in range(1, 400, 3)} | {f"s{k}": list(range(k, 400, k)) for k in (1, 2, 15, 16, 17, 100)} | {"all": []}
    rows = [r for name, ends in cuts.items() for r in cut(name, x, ends)] + cut("short", x[:15], [4]) + cut("least", x[:16], [4])
    found = whole(R.zero_phase(spark.createDataFrame(rows, SCHEMA), *coefficients))
    assert set(found) == set(cuts) | {"least"}
    assert np.allclose(found.pop("least"), signal.zero_phase(x[:16], *coefficients), atol=1e-9)
    expected = signal.zero_phase(x, *coefficients)
    for name, y in found.items():
        # The direct form of the whole filter rounds to some 1e-9 itself; the cuts agree far closer.
        assert np.allclose(y, expected, rtol=0, atol=2e-9) and np.allclose(y, found["all"], rtol=0, atol=1e-11), name


def test_gaps_and_moments_across_pieces(spark):
    x = pressure(60, 1)
    x[[0, 1, 10, 11, 12, 13, 30, 58, 59]] = [np.nan, np.inf, np.nan, np.nan, -np.inf, np.nan, np.nan, np.nan, np.nan]
    good = np.isfinite(x)
    expected = np.where(good, x, np.interp(np.arange(60), np.flatnonzero(good), x[good]))
    cuts = {f"c{k}": [k] for k in range(1, 60)} | {"s1": list(range(1, 60)), "s4": list(range(4, 60, 4))}
    rows = [r for name, ends in cuts.items() for r in cut(name, x, ends)] + [("none", 0, [float("nan")] * 3, 1), ("flat", 0, [5.0, 5.0], 1), ("flat", 2, [5.0], 1), ("empty", 0, [], 1), ("null", 0, None, 1)]
    df = R.filled(spark.createDataFrame(rows, SCHEMA))
    found = whole(df)
    assert set(found) == set(cuts) | {"flat"}
    assert all(np.allclose(found[name], expected) for name in cuts)
    scaled = whole(R.standard(df))
    assert set(scaled) == set(cuts)
    assert all(np.allclose(y, signal.zscore(expected)) for y in scaled.values())


@pytest.mark.parametrize(("distance", "prominence"), [(1, 1.0), (4, 2.0), (9, 0.0)])
def test_peaks_in_pieces_equal_the_whole_ones(spark, monkeypatch, distance, prominence):
    monkeypatch.setattr(R, "LEADERS", 2)
    monkeypatch.setattr(R, "BUCKET", 16)
    rng, rows, expected = np.random.default_rng(distance), [], {}
    for i in range(30):
        # Few values give plateaus and ties; sums of steps give long rises and falls.
        x = rng.integers(0, 5, 70).astype(float) if i % 3 else np.cumsum(rng.integers(-1, 2, 70)).astype(float)
        if i == 28:
            x = np.arange(70.0)
        if i == 29:
            x = np.abs(np.arange(70.0) % 7 - 3) - np.arange(70) // 7
        for name, ends in ((f"{i}whole", []), (f"{i}ones", range(1, 70)), (f"{i}some", sorted(rng.choice(np.arange(1, 70), 12, replace=False).tolist()))):
            rows += cut(name, x, ends)
            expected[name] = signal.peaks(x, distance, prominence).tolist()
    found = {name: [] for name in expected}
    for r in R.peaks(spark.createDataFrame(rows, SCHEMA), distance, prominence).orderBy("peak").collect():
        found[r["patient_id"]].append(r["peak"])
    assert found == expected


def test_query_gives_the_peaks_of_whole_recordings(spark, data):
    expected = set()
    for r in pressures(spark, data).collect():
        x = np.array(r["abp"])
        if x.std() > 0:
            z = signal.zscore(signal.zero_phase(signal.zscore(x), *signal.band_pass()))
            expected |= {(r["patient_id"], int(k)) for k in signal.peaks(z)}
    assert {(r["patient_id"], r["peak"]) for r in release.long_recording_peaks(spark, data).collect()} == expected


def test_an_empty_table_has_no_peaks(spark):
    assert R.systolic_peaks(spark.createDataFrame([], SCHEMA)).count() == 0
