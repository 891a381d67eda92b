"""Vector codes and the VA-file against plain numpy."""

from __future__ import annotations

import hashlib
import math

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from wavelattice.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, parts=8):
    """Codes, errors, errors by label and codebooks of rows (id, integers, label), by comparing everything."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0], r[1]))
    cut = [[r[1][k * len(r[1]) // parts : (k + 1) * len(r[1]) // parts] for k in range(parts)] for r in rows]
    books = [[c[k] for c in cut[:16]] for k in range(parts)]

    def assign(k):
        out = []
        for c in cut:
            far = [sum((a - b) ** 2 for a, b in zip(c[k], e, strict=True)) for e in books[k]]
            out.append((far.index(min(far)), min(far)))
        return out

    for _ in range(6):
        for k in range(parts):
            got = assign(k)
            for e in range(len(books[k])):
                mine = [c[k] for c, (g, _) in zip(cut, got, strict=True) if g == e]
                if mine:
                    books[k][e] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    final = [assign(k) for k in range(parts)]
    made = [(r[0], "".join(f"{f[i][0]:02x}" for f in final), sum(f[i][1] for f in final), r[2]) for i, r in enumerate(rows)]
    by = {}
    for _, _, e, label in made:
        by[label] = by.get(label, 0) + e
    text = ",".join(str(x) for b in books for e in b for x in e)
    return [(i, c, e, by[label], hashlib.sha256(text.encode()).hexdigest()) for i, c, e, label in made], books


@given(st.lists(st.lists(st.integers(-50, 50), min_size=3, max_size=3), min_size=1, max_size=16), st.lists(st.lists(st.integers(-90, 90), min_size=3, max_size=3), min_size=1, max_size=20))
def test_bounds_hold_and_the_nearest_is_found(entries, queries):
    entries, queries = np.array(entries), np.array(queries)
    file = codes.VaFile(entries, bits=2)
    exact = ((queries[:, None] - entries) ** 2).sum(axis=2)
    lower, upper = file.bounds(queries)
    assert (lower <= exact).all() and (exact <= upper).all()
    best, off, compared = file.nearest(queries)
    assert best.tolist() == exact.argmin(axis=1).tolist() and off.tolist() == exact.min(axis=1).tolist()
    assert len(queries) <= compared <= exact.size


def test_most_entries_are_never_compared():
    rng = np.random.default_rng(1)
    entries, queries = rng.integers(-500, 500, (16, 8)), rng.integers(-500, 500, (1000, 8))
    assert codes.VaFile(entries).nearest(queries)[2] < 0.5 * 16 * 1000


def test_codes_are_those_of_plain_numpy(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.2, 16).astype(np.float32)], None if i % 5 == 0 else int(i % 3)) for i in rng.permutation(150)]
    rows += [(200, rows[3][1], 1), (7, rows[4][1], 2), (7, rows[5][1], 2), (7, rows[5][1], 2), (None, rows[6][1], 0)]
    odd = [(300, None, 1), (301, [None] * 16, 1), (302, [math.nan] + [0.0] * 15, 1), (-5, [math.inf] * 16, 1), (-6, [0.5] * 15, 1), (-7, [-4e4] + [0.0] * 15, 1), (303, [], None)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows + odd], SCHEMA + ", code string, _sum int").repartition(5)
    found = sorted((tuple(r) for r in codes.compress(table).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)
    want, books = plain([(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows])
    assert found == sorted(want, key=repr)
    made = codes.integers(table, "vec_id", "embedding")
    assert (codes.train(made) == np.array(books)).all()
    near = codes.decode(codes.encode(made, np.array(books)), np.array(books), 16).select("_code", "_near").first()
    assert near._near == [x for k, b in enumerate(books) for x in b[near._code[k]]]


def test_few_rows_and_lengths_that_do_not_divide(spark):
    rows = [(i, [i + 0.25] * 5, 1) for i in range(3)]
    found = codes.compress(spark.createDataFrame(rows, SCHEMA)).orderBy("vec_id").collect()
    assert [r.code for r in found] == ["0000000000000000", "0101010101000000", "0202020202000000"]
    assert [r.error for r in found] == [0, 0, 0]


def test_no_rows(spark):
    assert codes.compress(spark.createDataFrame([], SCHEMA)).collect() == []
    assert codes.compress(spark.createDataFrame([(1, None, 1)], SCHEMA)).collect() == []
    assert [r.code for r in codes.compress(spark.createDataFrame([(1, [], 1)], SCHEMA)).collect()] == ["00" * 8]
