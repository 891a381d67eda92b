"""Operators on small fixtures, against numpy and by hand."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelattice.functions import scalars as S
from wavelattice.functions import vectors as V
from wavelattice.operators import blocks, covariance, dependence, guards, integrity, linkage, regression
from wavelattice.plans import geometry, stats


@pytest.fixture(scope="module")
def vectors(spark):
    x = np.random.default_rng(0).normal(size=(40, 8))
    return x, spark.createDataFrame([(i, i % 5, i // 5, [float(v) for v in r]) for i, r in enumerate(x)], "id long, patient long, block long, v array<double>")


def test_vector_functions(spark, vectors):
    x, df = vectors
    rows = df.select(V.mean(F.col("v")), V.population_sd(F.col("v")), V.norm(F.col("v")), V.effective_support(V.unit_sum(F.col("v"))), V.normalised(F.col("v"), 8), V.normalised(F.col("v"), 9), V.differences(F.col("v"), 2), V.sign_fixed(F.col("v"))).collect()
    for v, r in zip(x, rows, strict=True):
        p = np.maximum(v, 0) / np.maximum(v, 0).sum()
        p = p[p > 0]
        assert np.allclose([r[0], r[1], r[2], r[3]], [v.mean(), v.std(), np.linalg.norm(v), np.exp(-(p * np.log(p)).sum())])
        assert np.allclose(r[4], (v - v.mean()) / v.std()) and r[5] is None
        assert np.allclose(r[6], np.diff(v, 2))
        assert np.allclose(r[7], v * np.sign(v[np.abs(v).argmax()]))


def test_normalised_rejects_flat_and_not_finite(spark):
    df = spark.createDataFrame([([1.0, 1.0],), ([1.0, float("nan")],), ([1.0, None],), (None,)], "v array<double>")
    assert [r[0] for r in df.select(V.normalised(F.col("v"), 2)).collect()] == [None] * 4


def test_resampled_keeps_the_first_and_leaves_out_the_last(spark):
    row = spark.createDataFrame([([0.0, 1.0, 2.0, 3.0, 4.0],)], "v array<double>").select(V.resampled(F.col("v"), 8)).first()[0]
    assert np.allclose(row, np.arange(8) * 0.5)


def test_covariances_match_numpy(spark, vectors):
    x, df = vectors
    assert np.allclose(covariance.as_array(covariance.covariance(df, "v")), np.cov(x.T))
    within = np.mean([np.cov(x[[i for i in range(40) if i % 5 == p]].T) for p in range(5)], axis=0)
    assert np.allclose(covariance.as_array(covariance.mean_within_covariance(df, "patient", "v")), within)


def test_covariance_does_not_depend_on_the_partitions(spark, vectors):
    _, df = vectors
    a, b = (covariance.as_array(covariance.covariance(df.repartition(n), "v")) for n in (1, 7))
    assert np.allclose(a, b, atol=1e-12)


def test_nearest_and_distance_correlation_over_many_blocks(spark, vectors):
    x, df = vectors
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    np.fill_diagonal(d, np.inf)
    found = {r["id"]: (r["neighbour"], r["distance"]) for r in dependence.nearest_neighbours(df, "id", "v", block=7).collect()}
    assert {i: n for i, (n, _) in found.items()} == {i: int(d[i].argmin()) for i in range(40)}
    assert np.allclose([found[i][1] for i in range(40)], d.min(axis=1))

    def centre(m):
        m = np.linalg.norm(m[:, None] - m[None], axis=2)
        return m - m.mean(0) - m.mean(1)[:, None] + m.mean()

    x = (x - x.mean(0)) / x.std(0)
    a, b = centre(x[:, :3]), centre(x[:, 3:])
    want = np.sqrt((a * b).mean() / np.sqrt((a * a).mean() * (b * b).mean()))
    split = df.select("id", F.slice("v", 1, 3).alias("x"), F.slice("v", 4, 5).alias("y"))
    assert dependence.distance_correlation(split, "id", "x", "y", block=9).first()["dcor"] == pytest.approx(want)
    flat = df.select("id", F.slice("v", 1, 3).alias("x"), F.array(F.lit(1.0)).alias("y"))
    assert dependence.distance_correlation(flat, "id", "x", "y").first()["dcor"] == 0


def test_out_of_fold_matches_least_squares(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 3))
    y = x @ [1.0, -2.0, 0.5] + rng.normal(size=60) * 0.1
    df = spark.createDataFrame([(int(i), int(i % 5), *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))], "id long, fold int, a double, b double, c double, y double")
    found = {r["id"]: r["pred_y"] for r in regression.out_of_fold(df, "fold", ["a", "b", "c"], ["y"]).collect()}
    for f in range(5):
        train = np.arange(60) % 5 != f
        beta = np.linalg.lstsq(np.column_stack([np.ones(train.sum()), x[train]]), y[train], rcond=None)[0]
        for i in np.flatnonzero(~train):
            assert found[i] == pytest.approx(beta[0] + x[i] @ beta[1:])


def test_spline_fails_on_tied_knots(spark):
    df = spark.createDataFrame([(1.0,)] * 9, "x double")
    with pytest.raises(ValueError):
        regression.spline_knots(df, "x")


def test_interval_edges(spark):
    day = "2020-01-0{}"
    stays = spark.createDataFrame([(1, 1, day.format(1), day.format(3)), (1, 2, day.format(3), day.format(5)), (2, 3, day.format(1), day.format(2))], "subject long, interval_id long, start string, stop string")
    stays = stays.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "stop")})
    moments = spark.createDataFrame([(1, 1, day.format(3)), (2, 2, day.format(4)), (3, 3, day.format(1)), (4, 1, day.format(1))], "p long, subject long, t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    exact = {r["p"]: (r["n_exact"], r["exact_id"]) for r in linkage.containment(moments, stays, "subject", probe_id="p").collect()}
    assert exact == {1: (2, None), 2: (0, None), 3: (0, None), 4: (1, 1)}
    near = {r["p"]: (r["gap_h"], r["direction"], r["ties"], r["nearest_id"]) for r in linkage.nearest(moments, stays, "subject", probe_id="p").collect()}
    assert near == {1: (0.0, "inside", 2, 1), 2: (48.0, "after_end", 1, 3), 3: (None, "missing", 0, None), 4: (0.0, "inside", 1, 1)}
    assert {r["p"]: r["n_prior"] for r in linkage.prior_history(moments, stays, "subject", probe_id="p").collect()} == {1: 0, 2: 1, 3: 0, 4: 0}


def test_validated_join_finds_repeated_keys(spark):
    a = spark.createDataFrame([(1,), (2,)], "k int")
    with pytest.raises(guards.GuardError):
        guards.validated_join(a, a.union(a), ["k"])
    with pytest.raises(guards.GuardError):
        guards.validated_join(a, a, ["k"], rows=3)
    assert guards.validated_join(a, a, ["k"], rows=2).count() == 2


def test_blocks_are_half_open_but_the_last(spark):
    df = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 59.9, 60.0, 119.9, 120.0, 120.1)], "c double")
    assert [r[0] for r in df.select(blocks.tumbling_block(F.col("c"), F.lit(0.0), 60.0, 2)).collect()] == [None, 0, 0, 1, 1, 1, None]


def test_scalars(spark):
    df = spark.createDataFrame([("p012-2101-02-03-04-05-06", "428.0 "), ("p1-2101-13-03-04-05", None), ("x", "v45.1")], "n string, c string")
    rows = df.select(S.record_time(F.col("n")).cast("string"), S.clean_code(F.col("c")), S.in_group(S.clean_code(F.col("c")), S.CODE_GROUPS["renal_failure"]), S.trailing_id(F.col("n"))).collect()
    assert [tuple(r) for r in rows] == [("2101-02-03 04:05:06", "4280", False, 6), (None, "", False, 5), (None, "V451", True, None)]


@pytest.mark.parametrize("blocked", [False, True])
def test_whole_permutation_tests_cover_all_rows(spark, data, blocked):
    rows = stats.halves(spark, data).orderBy("id").collect()
    ids, labels = [r["id"] for r in rows], np.array([r["label"] for r in rows])
    x, y = (np.array([r[c] for r in rows]) for c in "xy")
    x, y = ((m - m.mean(0)) / m.std(0) for m in (x, y))
    assert len(rows) > 100

    def centre(m):
        m = np.linalg.norm(m[:, None] - m[None], axis=2)
        return m - m.mean(0) - m.mean(1)[:, None] + m.mean()

    a, found = centre(x), []
    for rep in range(10):
        moved = np.arange(len(ids))
        if rep:
            for group in [labels == g for g in np.unique(labels)] if blocked else [np.ones(len(ids), bool)]:
                own = np.flatnonzero(group)
                moved[own] = sorted(own, key=lambda i: (hashlib.sha256(f"7:{rep}:{ids[i]}".encode()).hexdigest(), ids[i]))
        b = centre(y[moved])
        found.append(np.sqrt(max((a * b).mean(), 0) / np.sqrt((a * a).mean() * (b * b).mean())))
    query = stats.fold_blocked_perm_hash if blocked else stats.dcor_perm_hash
    row = query(spark, data).first()
    assert row["observed"] == pytest.approx(found[0], abs=2e-6) and row["n_reps"] == 9
    assert row["p"] == pytest.approx((1 + sum(v >= found[0] - 1e-12 for v in found[1:])) / 10)


def test_lines_digest_is_streamed_in_order_and_covers_all(spark, data):
    rows = [(i % 7 if i % 5 else None, None if i % 11 == 0 else f"é{i}") for i in range(500)]
    df = spark.createDataFrame(rows, "k int, line string").repartition(6)
    digest = lambda lines: hashlib.sha256("".join(t + "\n" for t in lines).encode()).hexdigest()
    full = [r for r in rows if r[1] is not None]
    assert integrity.lines_digest(df, "line").first()[0] == digest(sorted(t for _, t in full))
    assert integrity.lines_digest(df, "line", ["k"]).first()[0] == digest(t for _, t in sorted(full, key=lambda r: (r[0] is None, r[0] or 0, r[1])))
    assert integrity.lines_digest(df.limit(0), "line").first()[0] == hashlib.sha256(b"\n").hexdigest()
    assert "collect_list" not in integrity.lines_digest(df, "line")._jdf.queryExecution().toString()
    names = [r[0] for r in spark.read.parquet(f"{data}/customer.parquet").select("c_name").collect()]
    assert geometry.sorted_lines_digest(spark, data).first()[0] == digest(sorted(names))
