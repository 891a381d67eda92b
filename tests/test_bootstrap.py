"""Bootstrapped medians against a plain rerun."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from wavelattice.operators import dependence


def weight(seed, rep, ident):
    u = int(hashlib.sha256(f"{seed}:{rep}:{ident}".encode()).hexdigest()[:12], 16) / float(1 << 48)
    return sum(u >= p for p in dependence.POISSON)


@pytest.mark.parametrize("grouped", [False, True])
def test_medians_are_those_of_repeated_rows_and_are_not_gathered(spark, grouped):
    rng = np.random.default_rng(3)
    rows = [(i, ["a", "b", None][i % 3] if i % 50 else "one", None if i % 17 == 0 else float(rng.integers(0, 40)) / 7) for i in range(700)]
    rows += [(1000, "null", None), (1001, "null", None)]
    df = spark.createDataFrame(rows, "id long, g string, v double").repartition(5)
    found = dependence.bootstrap_medians(df, "id", "v", 9, 4, ["g"] if grouped else None)
    assert "percentile(" not in found._jdf.queryExecution().toString()
    want = {}
    for rep in range(1, 10):
        for g in {r[1] for r in rows} if grouped else [None]:
            drawn = [(v, weight(4, rep, i)) for i, own, v in rows if not grouped or own == g]
            if any(w for _, w in drawn):
                values = [v for v, w in drawn if v is not None for _ in range(w)]
                want[(g, rep) if grouped else rep] = pytest.approx(np.median(values), rel=1e-12) if values else None
    assert {(r.g, r.rep) if grouped else r.rep: r.median for r in found.collect()} == want
