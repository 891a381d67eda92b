"""Keyed permutations and the nulls that use them, against plain reruns."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wavelattice.operators import dependence, nulls
from wavelattice.plans import stats as stats_plans
from wavelattice.sources import shared


def z(m):
    s = m.std(axis=0)
    return (m - m.mean(axis=0)) / np.where(s <= 1e-12, 1, s)


def dcor(x, y):
    def centre(m):
        m = np.linalg.norm(m[:, None] - m[None], axis=2)
        return m - m.mean(0) - m.mean(1)[:, None] + m.mean()

    a, b = centre(z(x)), centre(z(y))
    return np.sqrt(max((a * b).mean(), 0) / np.sqrt((a * a).mean() * (b * b).mean()))


def ols(x, y, at):
    one = lambda m: np.column_stack([np.ones(len(m)), m])
    return one(at) @ np.linalg.lstsq(one(x), y, rcond=None)[0]


def table(spark, n=300, seed=4):
    rng = np.random.default_rng(seed)
    age, sex = rng.normal(50, 12, n), (rng.random(n) < 0.5).astype(float)
    p = (rng.random((n, 3)) < [0.2, 0.4, 0.6]).astype(float)
    y = np.column_stack([0.03 * age + p[:, 0], 5 * np.sin(age / 9)]) + rng.normal(size=(n, 2))
    fold = rng.integers(0, 4, n)
    rows = [(int(1000 - i), int(fold[i]), *map(float, (age[i], sex[i], *p[i], *y[i]))) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, fold int, age double, sex double, p0 double, p1 double, p2 double, y double, w double").repartition(6)
    at = np.arange(n)[::-1]  # in the order of ids
    return df, fold[at], np.column_stack([age, sex])[at], p[at], y[at]


@given(st.integers(1, 700), st.integers(0, 5), st.integers(1, 10_000))
def test_keyed_orders_are_bijections(n, seed, rep):
    found = nulls.keyed_order(np.arange(n), n, seed, rep)
    assert sorted(found.tolist()) == list(range(n))
    assert nulls.keyed_order(np.arange(n), n, seed, 0).tolist() == list(range(n))
    k = n // 2
    assert nulls.keyed_order(k, n, seed, rep) == found[k]


def test_keyed_orders_are_even_and_differ():
    n, reps = 20, 4000
    at = nulls.keyed_order(np.arange(n)[None], n, 3, np.arange(1, reps + 1)[:, None])
    for k in range(n):
        counts = np.bincount(at[:, k], minlength=n)
        assert ((counts - reps / n) ** 2 / (reps / n)).sum() < 55  # 19 degrees of freedom
    pairs = np.bincount(at[:, 3] * n + at[:, 11], minlength=n * n)
    expected = reps / (n * (n - 1))
    assert ((pairs[pairs > 0] - expected) ** 2 / expected).sum() < 520
    assert len({tuple(r) for r in at.tolist()}) == reps
    fixed = (at == np.arange(n)).sum(axis=1)
    assert abs(fixed.mean() - 1) < 0.1 and abs(fixed.var() - 1) < 0.2


def test_groups_keep_their_rows():
    perm = nulls.Order([5, 1, 30, 5], 2)
    rows = np.arange(41)
    for rep in (1, 2):
        at = perm(rows, rep)
        for start, stop in ((0, 5), (5, 6), (6, 36), (36, 41)):
            assert sorted(at[start:stop]) == list(range(start, stop))
    many = [(tuple(perm(rows, r)[:5]), tuple(perm(rows, r)[36:] - 36)) for r in range(1, 60)]
    assert any(a != b for a, b in many)


@pytest.mark.parametrize("held", [256 << 20, 0])
def test_matrix_reads_rows_by_number(spark, monkeypatch, held):
    monkeypatch.setattr(shared, "HELD", held)
    df = spark.range(1000).select((F.lit(999) - F.col("id")).alias("k"), F.array(F.col("id").cast("double"), F.lit(1.5)).alias("v"), F.col("id").cast("int").alias("i"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        m = shared.write_matrix(df.repartition(5), ["k"], ["v", "i"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert (m.rows, m.width, len(m.parts) > 1) == (1000, 3, True)
    assert m.read(10, 13).tolist() == [[989, 1.5, 989], [988, 1.5, 988], [987, 1.5, 987]]
    at = np.array([[999, 0], [500, 500]])
    assert m.take(at)[..., 0].tolist() == [[0, 999], [499, 499]]
    assert m.read(0, 1000)[:, 2].tolist() == list(range(999, -1, -1))


@pytest.mark.parametrize("within", [None, "fold"])
def test_correlation_null_is_that_of_plain_permutations(spark, monkeypatch, within):
    monkeypatch.setattr(nulls, "BLOCK", 64)
    df, fold, x, _, y = table(spark)
    vectors = df.select("id", "fold", F.array("age", "sex").alias("x"), F.array("y", "w").alias("y"))
    found = {r.rep: r.dcor for r in nulls.correlation_null(vectors, "id", "x", "y", 70, 9, within).collect()}
    assert sorted(found) == list(range(71))
    order = np.argsort(fold, kind="stable") if within else np.arange(len(y))
    perm = nulls.Order(np.bincount(fold).tolist() if within else [len(y)], 9)
    a, b = x[order], y[order]
    for rep in range(71):
        at = perm(np.arange(len(y)), rep)
        if within:
            assert (fold[order] == fold[order][at]).all()
        assert found[rep] == pytest.approx(dcor(a, b[at]), abs=1e-9)


@pytest.mark.parametrize("whole", [1 << 18, 0])
def test_pipeline_replay_in_strips_and_at_once(spark, monkeypatch, whole):
    monkeypatch.setattr(nulls, "WHOLE", whole)
    test_pipeline_replay_is_a_plain_rerun(spark, monkeypatch)


def test_pipeline_replay_is_a_plain_rerun(spark, monkeypatch):
    monkeypatch.setattr(nulls, "BLOCK", 64)
    df, fold, x, p, y = table(spark)
    found = {r.rep: r.dcor for r in nulls.pipeline_replay(df, "id", "fold", ["age", "sex"], ["y", "w"], 40, 7, ["age", "p0"]).collect()}
    fitted, perm = ols(x, y, x), nulls.Order([len(y)], 7)
    for rep in range(41):
        at = fitted + (y - fitted)[perm(np.arange(len(y)), rep)]
        pred = np.empty_like(at)
        for k in range(4):
            train = fold != k
            pred[~train] = ols(x[train], at[train], x[~train])
        assert found[rep] == pytest.approx(dcor(np.column_stack([x[:, 0], p[:, 0]]), at - pred), abs=1e-9)


def test_freedman_lane_is_a_plain_refit_of_both_models(spark, monkeypatch):
    monkeypatch.setattr(nulls, "BLOCK", 64)
    df, _, x, p, y = table(spark)
    stats = nulls.freedman_lane(df, "id", ["age", "sex"], ["p0", "p1", "p2"], ["y", "w"], 50, 3)
    found = {(r.term, r.rep): r.statistic for r in stats.collect()}
    perm = nulls.Order([len(y)], 3)
    want = {}
    for k in range(3):
        reduced, full = np.column_stack([x, np.delete(p, k, 1)]), np.column_stack([x, np.delete(p, k, 1), p[:, k]])
        fitted = ols(reduced, y, reduced)
        for rep in range(51):
            at = fitted + (y - fitted)[perm(np.arange(len(y)), rep)]
            want[f"p{k}", rep] = ((at - ols(reduced, at, reduced)) ** 2).sum() - ((at - ols(full, at, full)) ** 2).sum()
    assert found.keys() == want.keys()
    assert all(found[k] == pytest.approx(want[k], rel=1e-8, abs=1e-8) for k in want)
    ps = {r.term: r for r in dependence.benjamini_hochberg(dependence.permutation_p(stats, "statistic", ["term"]), "p").collect()}
    for k in range(3):
        over = sum(want[f"p{k}", r] >= want[f"p{k}", 0] - 1e-12 for r in range(1, 51))
        assert (ps[f"p{k}"].n_reps, ps[f"p{k}"].p) == (50, pytest.approx((over + 1) / 51))
    assert ps["p0"].p < 0.05


def test_replicates_are_worked_out_once(spark):
    df, *_ = table(spark, 60)
    vectors = df.select("id", "fold", F.array("age", "sex").alias("x"), F.array("y", "w").alias("y"))
    for stats in (
        nulls.correlation_null(vectors, "id", "x", "y", 5, 9),
        nulls.correlation_null(vectors, "id", "x", "y", 5, 9, "fold"),
        nulls.hash_null(vectors, "id", "x", "y", 5, 9),
        nulls.pipeline_replay(df, "id", "fold", ["age", "sex"], ["y", "w"], 5, 7),
        nulls.freedman_lane(df, "id", ["age", "sex"], ["p0", "p1"], ["y", "w"], 5, 3).withColumnRenamed("statistic", "dcor"),
    ):
        assert "MapInArrow" not in dependence.null_summary(stats, "dcor")._jdf.queryExecution().toString()


@pytest.mark.parametrize("within", [None, "fold"])
def test_hash_null_is_that_of_plain_orders(spark, monkeypatch, within):
    monkeypatch.setattr(nulls, "BLOCK", 32)
    df, fold, x, _, y = table(spark)
    vectors = df.select("id", "fold", F.array("age", "sex").alias("x"), F.array("y", "w").alias("y"))
    found = {r.rep: r.dcor for r in nulls.hash_null(vectors, "id", "x", "y", 6, 9, within).collect()}
    ids = np.arange(1000 - len(y) + 1, 1001)
    want = {}
    for rep in range(7):
        at = np.arange(len(y))
        for g in np.unique(fold) if rep and within else [None] if rep else []:
            own = np.flatnonzero(fold == g) if within else np.arange(len(y))
            at[own] = sorted(own, key=lambda i: hashlib.sha256(f"9:{rep}:{ids[i]}".encode()).hexdigest())
        want[rep] = pytest.approx(dcor(x, y[at]), abs=1e-9)
    assert found == want


@pytest.mark.parametrize("query", [stats_plans.dcor_perm_hash, stats_plans.fold_blocked_perm_hash, stats_plans.distance_correlation])
def test_vectors_are_not_sent_to_tiles(spark, data, monkeypatch, query):
    monkeypatch.delattr(dependence, "_tiles")
    assert query(spark, data).count() == 1


def test_equal_rows_are_at_0_and_all_pairs_are_compared_once(spark):
    v = np.random.default_rng(2).normal(size=(40, 3)) + 50
    d = dependence.apart(dependence.sides(v), dependence.sides(v[::-1]))
    assert (np.diag(d[::-1]) == 0).all()
    assert d == pytest.approx(np.linalg.norm(v[:, None] - v[None, ::-1], axis=2), abs=1e-9)
    m = shared.write_matrix(spark.createDataFrame([(i, r[:2].tolist(), r[2:].tolist()) for i, r in enumerate(v)], "k long, x array<double>, y array<double>"), ["k"], ["x", "y"])
    sums = dependence.row_sums(spark, m, 2, block=7).orderBy("row").collect()
    a, b = (np.linalg.norm(c[:, None] - c[None], axis=2) for c in (v[:, :2], v[:, 2:]))
    assert [r.sa for r in sums] == pytest.approx(a.sum(axis=1)) and [r.sb for r in sums] == pytest.approx(b.sum(axis=1))
    assert [sum(r[c] for r in sums) for c in ("ab", "aa", "bb")] == pytest.approx([(a * b).sum(), (a * a).sum(), (b * b).sum()])


def test_standardised_vectors(spark):
    df = spark.createDataFrame([(1, "a", [1.0, 5.0]), (2, "a", [3.0, 5.0]), (3, "b", [7.0, 1.0])], "id long, g string, v array<double>")
    assert {r.id: r.v for r in dependence.standardised(df, ["v"], ["g"]).collect()} == {1: [-1, 0], 2: [1, 0], 3: [0, 0]}
    assert np.allclose([r.v for r in dependence.standardised(df, ["v"]).orderBy("id").collect()], z(np.array([[1, 5], [3, 5], [7, 1.0]])))


def test_empty_tables(spark):
    df, *_ = table(spark)
    vectors = df.where("id < 0").select("id", F.array("age").alias("x"), F.array("y").alias("y"))
    assert nulls.correlation_null(vectors, "id", "x", "y", 5, 1).collect() == []
