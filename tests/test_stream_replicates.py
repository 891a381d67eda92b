"""Representatives over a stream that is stopped and started again, against the batch operators."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

import numpy as np
from pyspark.sql import functions as F

from wavelattice.operators import blocks
from wavelattice.streaming import replicates

SCHEMA = "patient string, at timestamp, shape array<double>"


def test_a_restarted_stream_gives_the_batch_rows(spark, tmp_path):
    rng = np.random.default_rng(2)
    start = datetime(2100, 1, 1, tzinfo=timezone.utc)
    rows = []
    for p in range(6):
        for second in sorted(rng.choice(600, 150 + 10 * p, replace=False).tolist()):
            rows.append((f"p{p}", start + timedelta(seconds=int(second)), rng.normal(size=64).tolist()))
    rows += [("flat", start + timedelta(seconds=k), [1.0] * 64) for k in range(300)] + [("few", start, [1.0, 2.0] * 32), ("p0", start, None)]
    cut = start + timedelta(seconds=330)
    parts = [[r for r in rows if r[1] < cut], [r for r in rows if r[1] >= cut], [("end", start + timedelta(days=1), [0.0] * 64)]]
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    seen = []
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
        stream = replicates.replicate_stream(spark.readStream.schema(SCHEMA).parquet(str(folder)), width=60, least_beats=9, least=4, least_half=2, late="30 seconds")
        seen.append({r.patient: r for r in replicates.finished(spark, stream, out, state).collect()})
    assert any(seen[0][p].n_blocks < seen[2][p].n_blocks for p in seen[0])
    batch = spark.createDataFrame([r for part in parts for r in part], SCHEMA).withColumn("block", F.floor(F.unix_millis("at") / 60000).cast("long"))
    shapes = blocks.central_shape(batch, ["patient", "block"], "shape").where("n >= 9 and q is not null")
    want = {r.patient: r for r in blocks.replicates(shapes, "patient", "block", "q", least=4, least_half=2).collect()}
    assert len(want) >= 4 and seen[2].keys() == want.keys()
    for p, r in want.items():
        got = seen[2][p]
        assert (got.n_blocks, got.n_odd, got.n_even) == (r.n_blocks, r.n_odd, r.n_even)
        for c in ("all_rep", "odd_rep", "even_rep"):
            assert np.allclose(got[c], r[c], atol=1e-9)
