"""Filters, beats, spectra, windows, sources and streams on synthetic data."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelattice.operators import integrity, localize, signal, spectral
from wavelattice.sources import files
from wavelattice.streaming import blocks as streaming


def pressure(seconds=60, rate=1.2, fs=125.0, seed=0):
    t = np.arange(int(seconds * fs)) / fs
    return 90 + 20 * np.sin(2 * np.pi * rate * t) + 5 * np.sin(4 * np.pi * rate * t + 0.5) + np.random.default_rng(seed).normal(0, 0.2, t.size)


def test_filter_has_half_power_at_its_edges():
    b, a = signal.band_pass()
    z = np.exp(2j * np.pi * np.array([0.5, 5.0, np.sqrt(2.5)]) / 125)
    gain = np.abs(np.polyval(b, z) / np.polyval(a, z))
    assert gain[:2] == pytest.approx(np.sqrt(0.5), abs=1e-6) and gain[2] == pytest.approx(1, abs=1e-3)
    assert b == pytest.approx([0.01099322143901515, 0, -0.0219864428780303, 0, 0.01099322143901515])
    assert np.abs(np.roots(a)).max() < 1


def test_zero_phase_keeps_the_place_of_a_wave():
    t = np.arange(2500) / 125
    x = np.sin(2 * np.pi * 1.5 * t)
    y = signal.zero_phase(x + 3, *signal.band_pass())
    assert np.abs(y[600:1900] - x[600:1900]).max() < 0.05


def test_peaks_by_hand():
    x = np.array([0, 1, 0, 2, 2, 0, 5, 0, 0.1, 0, 3, 0], float)
    assert signal.peaks(x, 1, 0.5).tolist() == [1, 3, 6, 10]
    assert signal.peaks(x, 4, 0.5).tolist() == [1, 6, 10]
    assert signal.peaks(x, 1, 2.5).tolist() == [6, 10]


def test_catalog_finds_beats_and_reports_failures(spark):
    cases = [("a", 125.0, pressure().tolist()), ("b", 125.0, [1.0] * 9000), ("c", 125.0, [float("nan")] * 500), ("d", 125.0, [1.0, 2.0])]
    beats = signal.beat_catalog(spark.createDataFrame(cases, "patient_id string, fs double, abp array<double>"))
    rows = {r["patient_id"]: (r["n"], r["f"]) for r in beats.groupBy("patient_id").agg(F.count("beat_id").alias("n"), F.max("failure").alias("f")).collect()}
    assert 65 <= rows["a"][0] <= 72 and rows["a"][1] is None
    assert all(rows[k][0] == 0 and rows[k][1] for k in "bcd")
    kept = signal.quality(signal.representations(beats)).collect()
    assert len(kept) >= 60 and all(abs(np.mean(r["shape_norm"])) < 1e-10 and abs(np.std(r["shape_norm"]) - 1) < 1e-10 for r in kept)


def test_spectra_find_a_planted_subspace(spark):
    rng = np.random.default_rng(0)
    basis = spectral.random_basis(rng, 4)
    truth = rng.normal(size=(200, 4)) * [4, 3, 2, 1.5] @ basis.T
    rows = [(i, i % 5, *((truth[i] + rng.normal(size=64) * 0.2).tolist() for _ in range(3))) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, fold long, a array<double>, o array<double>, e array<double>")
    f = spectral.Folds(df, "fold", ["a", "o", "e"])
    values, vectors = spectral.eigen(f.replicate_operator())
    assert spectral.positive_rank(values) >= 4 and spectral.projector_overlap(vectors[:, :4], basis) > 0.95
    curve = spectral.reconstruction_curve(f, 6)
    assert curve[3][1] > 0.9 and curve[3][1] > curve[0][1]
    x = np.array([r[2] for r in rows])
    fold = np.arange(200) % 5
    sse = sst = 0.0
    for k, b in f.bases(4, "ordinary").items():
        y = x[fold == k] - x[fold != k].mean(axis=0)
        sst += (y**2).sum()
        sse += ((y - y @ b @ b.T) ** 2).sum()
    assert curve[3][4] == pytest.approx(1 - sse / sst)
    assert np.allclose(spectral.positive_part(np.diag([2.0, -1.0])), np.diag([2.0, 0.0]))


def test_spectrum_metrics_by_hand(spark):
    m = spectral.spectrum_metrics(spectral.spectrum_table(spark, np.array([6.0, 3.0, 1.0, -2.0]))).first()
    assert (m["n"], m["rank"], m["d90"], m["d95"]) == (4, 3, 2, 3)
    assert m["negative_mass"] == pytest.approx(2 / 12)
    assert m["effective_rank"] == pytest.approx(np.exp(-sum(p * np.log(p) for p in (0.6, 0.3, 0.1))))


def test_scan_finds_a_planted_window(spark):
    rng = np.random.default_rng(3)
    basis = rng.normal(size=(64, 8))
    basis[:, 0] = 0
    basis[40:46, 0] = 1
    basis = np.linalg.qr(basis)[0]
    best = {r["width"]: r for r in localize.best(localize.scan(spark, basis, ("shape",))).collect()}
    assert best[8]["fraction"] > 0.5 and 36 <= best[8]["start"] <= 44
    rest = localize.without(basis, np.array(best[8]["direction"]))
    assert rest.shape == (64, 7) and np.abs(rest.T @ (basis @ best[8]["direction"])).max() < 1e-10
    assert localize.scan(spark, basis).count() == 61 + 57 + 49 + 60 + 56 + 48 + 59 + 55 + 47


def test_sources_round_trip(spark, tmp_path):
    (tmp_path / "t.csv").write_text(" A ,B\n1,x\nbad,y\n")
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "t.csv"), "a int, b string").collect()] == [(1, "x"), (None, "y")]
    assert files.read_csv(spark, str(tmp_path / "t.csv")).columns == ["a", "b"]
    long = spark.createDataFrame([(i, j, float(i * 3 + j)) for i in range(2) for j in range(3)], "i int, j int, x double")
    wide = files.long_to_matrix(long, 3)
    assert wide.columns == ["row", "p01", "p02", "p03"]
    assert sorted(map(tuple, files.matrix_to_long(wide).collect())) == sorted(map(tuple, long.collect()))
    cases = tmp_path / "cases"
    cases.mkdir()
    np.savez(cases / "a.npz", ABP=np.arange(5.0), patient_id="p1", fs=125.0)
    np.savez(cases / "b.npz", ABP=np.arange(5.0))
    rows = sorted(files.read_cases(spark, str(cases)).collect(), key=lambda r: r["patient_id"] or "z")
    assert rows[0]["abp"] == [0, 1, 2, 3, 4] and rows[1]["failure"]
    assert files.inventory(spark, str(cases)).count() == 2
    files.write_document(str(tmp_path / "d.json"), {"a": 1})
    assert files.read_json(spark, str(tmp_path / "d.json")).first()["a"] == 1
    assert files.markdown(long.limit(1)).splitlines()[0] == "| i | j | x |"


def test_metrics_fail_when_missing(spark):
    rows = integrity.metric_rows(spark.range(3).agg(F.count("*").alias("n")), "s")
    assert integrity.metric_lookup(rows, ["n"]).first()["n"] == 3
    with pytest.raises(ValueError):
        integrity.metric_lookup(rows, ["m"])
    assert integrity.gate({"a": True, "b": False}) == "FAIL: b"
    same = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "k string, v double")
    assert [r["passed"] for r in integrity.replayed(same, same.limit(1), "k", "v", 1e-9).orderBy("k").collect()] == [True, False]


def test_stream_gives_the_batch_rows_of_closed_blocks(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet").select("user_id", "ts", "value")
    source = tmp_path / "in"
    for k, part in enumerate((events.where("day(ts) <= 15"), events.where("day(ts) > 15"))):
        part.coalesce(1).write.mode("append").parquet(str(source / f"k={k}"))
    batch = {(r["user_id"], r["start"]): (r["n_beats"], round(r["mean_value"], 9)) for r in streaming.block_summaries(events, width="1 day").collect()}
    stream = spark.readStream.schema("user_id long, ts timestamp_ntz, value double").option("maxFilesPerTrigger", 1).parquet(str(source / "k=*"))
    query = streaming.write_blocks(streaming.block_summaries(stream, width="1 day", late="40 days"), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    query.stop()
    found = spark.read.schema("user_id long, start timestamp, n_beats long, mean_value double").parquet(str(tmp_path / "out"))
    rows = {(r["user_id"], r["start"]): (r["n_beats"], round(r["mean_value"], 9)) for r in found.collect()}
    assert all(batch[k] == v for k, v in rows.items())
    state = streaming.block_summaries(stream, width="1 day", late="40 days")
    q = state.writeStream.format("memory").queryName("blocks").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    q.stop()
    assert {(r["user_id"], r["start"]): (r["n_beats"], round(r["mean_value"], 9)) for r in spark.table("blocks").collect()} == batch
