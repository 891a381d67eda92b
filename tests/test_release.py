"""Fits, waveforms, sources and guards against plain numpy and by hand."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelattice.functions import scalars as S
from wavelattice.operators import covariance, dependence, guards, integrity, regression, signal, spectral
from wavelattice.plans import stats
from wavelattice.sources import files


def fold_table(spark, n=80, seed=3):
    rng = np.random.default_rng(seed)
    age, sex, height = rng.uniform(20, 90, n), rng.integers(0, 2, n).astype(float), rng.normal(170, 10, n)
    y = np.sin(age / 15) + 0.4 * sex + 0.01 * height + rng.normal(0, 0.1, n)
    w = age * sex / 50 + rng.normal(0, 0.1, n)
    rows = [(int(i), int(i % 5), *map(float, r)) for i, r in enumerate(zip(age, sex, height, y, w, strict=True))]
    return np.array([r[1:] for r in rows]), spark.createDataFrame(rows, "id long, fold int, age double, sex double, height double, y double, w double")


def spline(x, train):
    a, b, c, d = np.quantile(train, regression.KNOTS)
    cube = lambda k: np.maximum(x - k, 0) ** 3
    return [(cube(k) - cube(c) * (d - k) / (d - c) + cube(d) * (c - k) / (d - c)) / (d - a) ** 3 for k in (a, b)]


def least_squares(x_train, y_train, x_test):
    beta = np.linalg.lstsq(np.column_stack([np.ones(len(x_train)), x_train]), y_train, rcond=None)[0]
    return np.column_stack([np.ones(len(x_test)), x_test]) @ beta


@pytest.mark.parametrize("model", sorted(regression.DESIGNS))
def test_nested_models_take_knots_from_the_training_fold(spark, model):
    t, df = fold_table(spark)
    fold, age, sex, height, y = t[:, 0], t[:, 1], t[:, 2], t[:, 3], t[:, 4:]
    want = np.empty_like(y)
    for k in range(5):
        train = fold != k
        a, h = spline(age, age[train]), spline(height, height[train])
        made = {"age": [age], "sex": [sex], "height": [height], "age_spline": a, "height_spline": h, "age_sex": [age * sex], "age_spline_sex": [c * sex for c in a], "height_sex": [height * sex]}
        x = np.column_stack([c for term in regression.DESIGNS[model] for c in made[term]])
        want[~train] = least_squares(x[train], y[train], x[~train])
    found = regression.nested_model(df, "fold", model, {"age": "age", "sex": "sex", "height": "height"}, ["y", "w"]).orderBy("id").collect()
    assert np.allclose([(r["pred_y"], r["pred_w"]) for r in found], want, atol=1e-7)


def brute_r2(fold, x, y):
    pred = np.empty_like(y)
    for k in np.unique(fold):
        train = fold != k
        pred[~train] = least_squares(x[train], y[train], x[~train])
    return 1 - ((y - pred) ** 2).sum() / ((y - y.mean(0)) ** 2).sum()


def test_block_gains_match_separate_fits(spark, data):
    f = stats.phenotypes(spark, data)
    rows = f.orderBy("c_custkey").collect()
    col = lambda *names: np.array([[r[n] for n in names] for r in rows], float)
    fold, base, block, y = col("fold")[:, 0], col("age", "site", "sex"), col("p2", "p3", "p7"), col("y", "w")
    joint, plain = brute_r2(fold, np.hstack([base, block]), y), brute_r2(fold, base, y)
    beta = np.linalg.lstsq(np.column_stack([np.ones(len(y)), base, block]), y, rcond=None)[0]
    for r in regression.block_gains(f, "fold", ["age", "site", "sex"], ["p2", "p3", "p7"], ["y", "w"]).collect():
        i = ["p2", "p3", "p7"].index(r["term"])
        assert r["n_exposed"] == block[:, i].sum() and r["n_exposed"] + r["n_unexposed"] == len(rows)
        assert r["marginal_delta"] == pytest.approx(brute_r2(fold, np.hstack([base, block[:, [i]]]), y) - plain, abs=1e-9)
        assert r["unique_delta"] == pytest.approx(joint - brute_r2(fold, np.hstack([base, np.delete(block, i, 1)]), y), abs=1e-9)
        assert r["block_delta"] == pytest.approx(joint - plain, abs=1e-9)
        assert r["joint_shift_norm"] == pytest.approx(np.linalg.norm(beta[4 + i]))


def test_moments_keep_their_digits_at_large_means(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 4)) + 1e8
    df = spark.createDataFrame([(i, i % 5, [float(v) for v in r], *map(float, r)) for i, r in enumerate(x)], "id long, fold int, v array<double>, a double, b double, c double, y double").repartition(5)
    assert np.allclose(covariance.as_array(covariance.covariance(df, "v")), np.cov(x.T), rtol=1e-6)
    z = x - 1e8
    want = np.empty(200)
    for k in range(5):
        train = np.arange(200) % 5 != k
        want[~train] = least_squares(z[train][:, :3], z[train][:, 3], z[~train][:, :3])
    found = regression.out_of_fold(df, "fold", ["a", "b", "c"], ["y"]).orderBy("id").collect()
    assert np.allclose([r["pred_y"] - 1e8 for r in found], want, atol=1e-4)


def test_equal_rows_are_at_no_distance(spark):
    rng = np.random.default_rng(8)
    a = np.repeat(rng.normal(size=(30, 6)) * 100 + 5000, 10, axis=0)
    d = dependence.distances(a, a)
    want = np.linalg.norm(a[:, None] - a[None], axis=2)
    assert (d[want == 0] == 0).all() and np.allclose(d, want, atol=1e-6)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(a)], "id long, v array<double>")
    found = {r["id"]: (r["neighbour"], r["distance"]) for r in dependence.nearest_neighbours(df, "id", "v", block=64).collect()}
    assert all(found[i] == (i // 10 * 10 + (i % 10 == 0), 0.0) for i in range(300))


def test_operators_of_all_splits_come_from_one_pass(spark):
    rng = np.random.default_rng(11)
    o, e = rng.normal(size=(2, 50, 4)) + 7
    df = spark.createDataFrame([(i, [float(v) for v in a], [float(v) for v in b]) for i, (a, b) in enumerate(zip(o, e, strict=True))], "id long, o array<double>, e array<double>").repartition(3)
    found = spectral.split_operators(df, "id", "o", "e", 3)
    for k in range(3):
        half = np.array([r[0] for r in df.orderBy("id").select(F.pmod(F.xxhash64(F.lit(k), F.col("id")), F.lit(2))).collect()])
        for side in (0, 1):
            a, b = o[half == side], e[half == side]
            c = (a - a.mean(0)).T @ (b - b.mean(0)) / (len(a) - 1)
            assert np.allclose(found[k][side], (c + c.T) / 2)


# ---------------------------------------------------------------- waveforms


def plain_filter(b, a, x, state):
    z, out = np.array(state, float), []
    for v in x:
        y = b[0] * v + z[0]
        z = np.append(z[1:], 0) + b[1:] * v - a[1:] * y
        out.append(y)
    return np.array(out)


@pytest.mark.parametrize("n", [1, 7, 511, 512, 513, 3000])
def test_filter_in_blocks_is_the_filter(n):
    rng = np.random.default_rng(n)
    b, a = signal.band_pass()
    x, state = rng.normal(size=n), rng.normal(size=4)
    assert np.allclose(signal.filtered(b, a, x, state), plain_filter(b, a, x, state), atol=1e-9)


def plain_peaks(x, distance, prominence):
    at, i = [], 1
    while i < len(x) - 1:
        j = i
        while j + 1 < len(x) and x[j + 1] == x[i]:
            j += 1
        if x[i - 1] < x[i] and j + 1 < len(x) and x[j + 1] < x[i]:
            at.append((i + j) // 2)
        i = j + 1
    kept = dict.fromkeys(at, True)
    order = np.argsort(x[at], kind="stable")[::-1] if at else []
    for k in order:
        if kept[at[k]]:
            for p in at:
                if p != at[k] and abs(p - at[k]) < distance:
                    kept[p] = False
    out = []
    for p in (p for p in at if kept[p]):
        a = max((i for i in range(p) if x[i] > x[p]), default=0)
        b = min((i for i in range(p + 1, len(x)) if x[i] > x[p]), default=len(x))
        if x[p] - max(x[a : p + 1].min(), x[p:b].min()) >= prominence:
            out.append(p)
    return out


def test_peaks_are_those_of_the_definition():
    rng = np.random.default_rng(4)
    for k in range(60):
        x = np.round(np.cumsum(rng.normal(size=200)), 1 if k % 2 else 6)
        assert signal.peaks(x, 5, 0.8).tolist() == plain_peaks(x, 5, 0.8)


# ---------------------------------------------------------------- sources and guards


def test_tables_and_files_are_found(spark, tmp_path):
    (tmp_path / "a" / "deep").mkdir(parents=True)
    (tmp_path / "a" / "Admissions.CSV").write_text("Id, Name \n1,x\n")
    (tmp_path / "a" / "admissions.csv.gz").write_bytes(b"x")
    (tmp_path / "a" / "deep" / "spec.json").write_text("{}")
    (tmp_path / "a" / "spec.json").write_text("{}")
    folder = f"file://{tmp_path}/a"
    found = files.locate_table(spark, folder, "ADMISSIONS")
    assert found.endswith("/Admissions.CSV") and files.header(spark, found) == ["Id", "Name"]
    assert files.locate_table(spark, folder, "none", required=False) is None
    with pytest.raises(FileNotFoundError):
        files.locate_table(spark, folder, "none")
    first, every = files.locate_named(spark, "spec.json", [folder, f"{folder}/deep", f"file://{tmp_path}/missing"])
    assert len(every) == 2 and first == min(every)
    assert files.locate_named(spark, "x", [], explicit=f"{folder}/spec.json")[0].endswith("/a/spec.json")
    assert files.locate_one(spark, [folder], ["adm*.gz", "adm*.csv.gz"]).endswith("admissions.csv.gz")
    with pytest.raises(FileNotFoundError):
        files.locate_one(spark, [folder], ["spec.json"])
    assert files.read_texts(spark, folder, suffixes=(".JSON",)).count() == 2
    assert files.read_texts(spark, folder, most_bytes=1).count() == 1


def test_coordinates_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, [0.5, 1.5], [2.0]), (2, [None, 3.0], None)], "id long, v array<double>, w array<double>")
    path = f"file://{tmp_path}/c"
    files.write_coordinates(df, path, "id", ["v", "w"])
    assert sorted(map(tuple, files.read_coordinates(spark, path, "id", ["v", "w"]).collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(ValueError):
        files.read_coordinates(spark, path, "id", ["x"])
    files.write_csv(df, f"file://{tmp_path}/csv")
    assert files.read_csv(spark, f"file://{tmp_path}/csv").count() == 2


def test_columns_are_detected_pinned_and_coded(spark):
    assert guards.detect_column(["Subject_ID", "age_years"], ["patient_id", "subject_id"], []) == "Subject_ID"
    assert guards.detect_column(["x", "Height_cm_mean"], ["height"], ["height", "cm"]) == "Height_cm_mean"
    assert guards.detect_column(["x"], ["height"], ["height"]) is None
    df = spark.createDataFrame([(" m ",), ("F",), ("f",)], "g string")
    assert [r["female"] for r in regression.coded_sex(df, "g").collect()] == [0.0, 1.0, 1.0]
    with pytest.raises(ValueError):
        regression.coded_sex(spark.createDataFrame([("x",)], "g string"), "g")
    assert guards.pinned_column(df, "g", 3).count() == 3
    with pytest.raises(guards.GuardError):
        guards.pinned_column(df, "g", 2)


def test_three_decisions(spark):
    kinds = "category string, passed boolean"
    decide = lambda rows: guards.preflight_decision(spark.createDataFrame(rows, kinds)).first()["decision"]
    assert decide([("required", True), ("future", True)]) == "PASS"
    assert decide([("required", True), ("future", None)]) == decide([("required", True)]) == "PARTIAL"
    assert decide([("required", False), ("future", True)]) == "FAIL"


def test_locks_refuse(spark):
    outputs = spark.createDataFrame([("a", "x"), ("b", "y")], "name string, content string")
    result = spark.createDataFrame([(3, "done")], "n long, decision string")
    assert integrity.output_lock(result, {"n": 3, "decision": "done"}, outputs, ["a", "b"]).count() == 2
    with pytest.raises(ValueError):
        integrity.output_lock(result, {"n": 4}, outputs, ["a"])
    with pytest.raises(ValueError):
        integrity.output_lock(result, {"n": 3}, outputs, ["a", "c"])
    lock = integrity.manifest(outputs, "name", "content")
    assert integrity.locked_inputs(lock, lock, "name").count() == 2
    with pytest.raises(ValueError):
        integrity.locked_inputs(lock, lock.withColumn("sha256", F.lit("0")), "name")


def test_matrix_checks(spark):
    good = spark.createDataFrame([(0, 0, 1.0), (0, 1, 0.5), (1, 0, 0.5), (1, 1, 2.0)], "i int, j int, c double")
    bad = good.withColumn("c", F.when((F.col("i") == 0) & (F.col("j") == 1), float("nan")).otherwise(F.col("c")))
    r = integrity.matrix_facts(good).first()
    assert (r["n_rows"], r["n_columns"], r["whole"], r["finite"], r["symmetry_error"]) == (2, 2, True, True, 0.0)
    assert not integrity.matrix_facts(bad).first()["finite"] and not integrity.matrix_facts(good.limit(3)).first()["whole"]
    assert integrity.largest_difference(good, good).first()[0] == 0.0 and integrity.largest_difference(good, good.limit(3)).first()[0] == float("inf")


def wave(rng, seconds, shift=0.0):
    """Beats of drifting length, height and shape."""
    out = []
    while len(out) < seconds * 125:
        n = int(95 + 20 * rng.standard_normal() * 0.3)
        i = np.arange(n) / n
        out += (80 + (40 + 6 * rng.standard_normal()) * np.exp(-(((i - 0.3 - shift) / 0.12) ** 2)) + 9 * np.exp(-(((i - 0.62) / 0.1) ** 2))).tolist()
    return out[: seconds * 125]


def plain_patient(x, seconds, width, least_beats):
    """One patient by the rule, in plain numpy: window first, all masks from the same beats."""
    total, beats = len(x) / 125, signal.catalog(np.array(x), 125.0)
    beats = beats[(beats.center_sec >= total - seconds) & (beats.center_sec <= total)]
    v = np.array(beats.absolute.tolist())
    shape = (v - v.mean(1)[:, None]) / v.std(1)[:, None]
    template = np.median(shape, axis=0)
    keep = np.array([np.corrcoef(s, template)[0, 1] >= 0.75 for s in shape])
    for m in (beats.duration_sec.to_numpy(), np.log(np.ptp(v, axis=1))):
        mad = np.median(np.abs(m - np.median(m)))
        keep &= (np.abs(m - np.median(m)) <= 5 * 1.4826 * mad) | (mad <= 1e-12)
    z = lambda m: (m - m.mean()) / m.std()
    q, kappa, n, odd = [], [], [], []
    block = np.minimum((beats.center_sec.to_numpy() - (total - seconds)) // width, seconds // width - 1).astype(int)
    for b in range(int(seconds // width)):
        own = shape[keep & (block == b)]
        if len(own) >= least_beats:
            q.append(z(own.mean(0)))
            kappa.append(own.mean(0).std())
            n.append(len(own))
            odd.append(b % 2 == 1)
    q, odd = np.array(q), np.array(odd)
    return {"all_rep": z(q.mean(0)), "odd_rep": z(q[odd].mean(0)), "even_rep": z(q[~odd].mean(0)), "within_cov": np.cov(q.T).ravel(), "eligible_blocks": len(q), "odd_blocks": odd.sum(), "even_blocks": (~odd).sum(), "median_block_coherence": np.median(kappa), "median_beats_per_block": np.median(n)}


def test_constructed_patients_follow_the_rule(spark):
    rng = np.random.default_rng(6)
    waves = {"long": wave(rng, 80, 0.2) + wave(rng, 70), "fit": wave(rng, 60)}
    cases = [(p, 125.0, x) for p, x in waves.items()] + [("rate", 100.0, waves["fit"]), ("short", 125.0, waves["fit"][:-50]), ("flat", 125.0, [80.0] * 7500)]
    cases += [("late", 125.0, wave(rng, 60) + [80.0] * 7500), ("part", 125.0, wave(rng, 20) + [80.0] * 5000), ("gone", 125.0, [float("nan")] * 7500)]
    df = spark.createDataFrame(cases, "patient_id string, fs double, abp array<double>")
    patients, failures = signal.constructed(df, seconds=60.0, width=6.0, least_beats=4)
    found = {r.patient_id: r for r in patients.collect()}
    assert found.keys() == waves.keys()
    for p, x in waves.items():
        for name, want in plain_patient(x, 60.0, 6.0, 4).items():
            assert np.allclose(found[p][name], want, atol=1e-9), (p, name)
    why = {r.patient_id: r.failure for r in failures.collect()}
    assert why == {"rate": "sampling rate", "short": "shorter than the window", "flat": "catalog failed", "gone": "catalog failed", "late": "fewer than 8 beats in the window", "part": "too few eligible blocks"}
    assert all(r["n_wrong"] == 0 for r in signal.shape_invariants(patients, ["all_rep", "odd_rep", "even_rep"]).collect())
    few, none = signal.constructed(df.limit(2), seconds=60.0, width=6.0, least_beats=500)
    assert few.count() == 0 and {r.failure for r in none.collect()} == {"too few eligible blocks"}
