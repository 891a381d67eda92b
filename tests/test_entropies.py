"""Entropy gains and their surrogates against plain numpy."""

from __future__ import annotations

import numpy as np
import pytest

from wavelattice.operators import entropies as E


def vectors(n, seed):
    latent = np.random.default_rng(seed).normal(size=(n, 4))
    mixed = latent @ np.random.default_rng(seed + 1).normal(size=(4, 4))
    return np.repeat(mixed, 16, axis=1) + np.random.default_rng(seed + 2).normal(size=(n, 64)) * 0.3 + 1e4


def test_gains_are_ordered():
    g = E.entropy_gains(vectors(400, 0))
    assert 0 <= g["delta_2"] <= g["delta_4"] <= g["delta_8"] <= g["delta_all"]


def brute(x, patient, kind, form, replicates, seed):
    """Surrogates made whole, row by row."""
    own, cells, gained = E.part_of(64, kind), [], []
    for rep in range(replicates + 1):
        where = E.partners(np.arange(len(x)), len(x), E.patient_seed(seed, patient, kind), rep, own[-1] + 1)
        for part in range(own[-1] + 1):
            assert sorted(where[:, part]) == list(range(len(x)))
        made = np.array([[x[where[i, own[j]], j] for j in range(64)] for i in range(len(x))])
        cells.append(made)
        if form != "as_is":
            made = made - made.mean(axis=1, keepdims=True)
        if form == "normalised":
            made = made / made.std(axis=1, keepdims=True)
        c = np.cov(made.T)
        gained.append(E.entropy(E.pinched(c, 4)) - E.entropy(c))
    if replicates:
        blocks = np.array_split(np.arange(64), 4) if kind == "blocks" else [[j] for j in range(64)]
        # A part keeps its own covariance, and links to other parts are lost.
        for block in blocks[:4]:
            assert np.allclose(np.cov(cells[1][:, block].T), np.cov(x[:, block].T))
        assert not np.allclose(cells[1], cells[0])
    return gained[0], gained[0] - np.median(gained[1:])


@pytest.mark.parametrize(("kind", "form"), [("blocks", "as_is"), ("positions", "as_is"), ("blocks", "normalised"), ("blocks", "centred")])
def test_surrogates_equal_brute_force_at_every_chunk(spark, kind, form):
    people = {"a": vectors(90, 3), "b": vectors(30, 5), "c": vectors(31, 7)}
    rows = [(p, i, v.tolist(), "x") for p, x in people.items() for i, v in enumerate(x)]
    rows += [("one", 0, [1.0] * 64, "x"), ("flat", 0, [2.0] * 64, "x"), ("flat", 1, [2.0] * 64, "x"), ("a", 99, None, "x"), (None, 0, [3.0] * 64, "x")]
    df = spark.createDataFrame(rows, "patient string, i int, v array<double>, n string")
    for chunk in (16_384, 30, 7):
        found = {r["patient"]: r for r in E.block_entropies(df, "patient", "v", 33, 5, kind, ["i"], form, chunk).collect()}
        assert set(found) == {"a", "b", "c", "one", "flat", None}
        for p, x in people.items():
            base, excess = brute(x, p, kind, form, 33, 5)
            assert found[p]["n"] == len(x)
            assert found[p]["delta_4"] == pytest.approx(base, abs=1e-7) and found[p]["excess_4"] == pytest.approx(excess, abs=1e-7)
        for p in ("one", "flat", None):
            assert np.isnan(found[p]["delta_4"]) and np.isnan(found[p]["excess_4"])


def test_without_surrogates_and_without_rows(spark):
    x = vectors(40, 1)
    df = spark.createDataFrame([("a", v.tolist()) for v in x], "patient string, v array<double>")
    row = E.block_entropies(df, "patient", "v").first()
    assert {k: row[k] for k in ("delta_2", "delta_4", "delta_8", "delta_all")} == pytest.approx(E.entropy_gains(x), abs=1e-7)
    assert np.isnan(row["excess_4"])
    assert E.block_entropies(df.where("false"), "patient", "v", 3).count() == 0
