"""Running values and interval joins against plain loops."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wavelattice.operators import linkage, sweeps
from wavelattice.operators.sweeps import Running
from wavelattice.plans import core

DAY = datetime(2100, 1, 1)


@pytest.fixture(scope="module")
def many_parts(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def made(seed=3):
    """Moments and stays of one hot subject and a few others, on few hours, so that ends meet and gaps tie."""
    rng = random.Random(seed)
    at = lambda top: DAY + timedelta(hours=rng.randrange(top))
    probes = [(p, rng.choice(["hot"] * 8 + ["a", "b", "c"]), at(400)) for p in range(300)] + [(900, None, DAY), (901, "a", None), (902, "nowhere", DAY)]
    stays = []
    for i in range(250):
        start = at(400)
        stays.append((rng.choice(["hot"] * 8 + ["a", "b", "d"]), 1000 - i, start, start + timedelta(hours=rng.randrange(12)), int(rng.random() < 0.1)))
    stays += [("hot", 1, DAY, DAY - timedelta(hours=5), 0), (None, 2, DAY, DAY, 1), ("hot", 3, None, DAY, 0), ("hot", 4, DAY, None, 1)]
    return probes, stays


def frames(spark):
    probes, stays = made()
    return spark.createDataFrame(probes, "p long, subject string, t timestamp").repartition(5), spark.createDataFrame(stays, "subject string, interval_id long, start timestamp, stop timestamp, flag int").repartition(5)


def test_a_hot_key_spreads_over_tasks(spark, many_parts):
    df = spark.range(5000).select(F.when(F.col("id") % 10 > 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.col("id").alias("t"), (F.col("id") % 7).alias("x"))
    got = sweeps.running(df, "k", ["t"], {"s": Running("sum", F.col("x")), "m": Running("min", F.when(F.col("x") == 6, F.col("t")), backward=True), "part": Running("max", F.spark_partition_id())}).collect()
    hot = sorted((r.t, r.s, r.m) for r in got if r.k == "hot")
    total, want = 0, []
    for t, _, _ in hot:
        total += t % 7
        want.append((t, total))
    assert [(t, s) for t, s, _ in hot] == want
    marked = [t for t, _, _ in hot if t % 7 == 6]
    assert all(m == next((x for x in marked if x >= t), None) for t, _, m in hot[::97])


def test_containment(spark, many_parts):
    probes, stays = made()
    found = {r.p: (r.n_exact, r.exact_id) for r in linkage.containment(*frames(spark), "subject", probe_id="p").collect()}
    assert len(found) == len(probes)
    for p, s, t in probes:
        held = [i for k, i, a, b, _ in stays if k is not None and k == s and t and a and b and a <= t <= b]
        assert found[p] == (len(held), held[0] if len(held) == 1 else None)
    assert max(n for n, _ in found.values()) > 3


def test_nearest(spark, many_parts):
    probes, stays = made()
    found = {r.p: (r.gap_h, r.direction, r.ties, r.nearest_id) for r in linkage.nearest(*frames(spark), "subject", probe_id="p").collect()}
    assert len(found) == len(probes)
    for p, s, t in probes:
        gaps = []
        for k, i, a, b, _ in stays:
            if k is not None and k == s and t and a and b and a <= b:
                gap, way = ((a - t), "before_start") if t < a else ((t - b), "after_end") if t > b else (timedelta(0), "inside")
                gaps.append((gap.total_seconds() / 3600, i, way))
        want = min(gaps, default=(None, None, "missing"))
        assert found[p] == (want[0], want[2], sum(g[0] == want[0] for g in gaps), want[1])
    assert {d for _, d, _, _ in found.values()} == {"before_start", "after_end", "inside", "missing"}
    assert max(n for _, _, n, _ in found.values()) > 3


def test_prior_history(spark, many_parts):
    probes, stays = made()
    found = {r.p: (r.n_prior, r.prior_flag) for r in linkage.prior_history(*frames(spark), "subject", probe_id="p", flag="flag").collect()}
    for p, s, t in probes:
        ended = [f for k, _, _, b, f in stays if k is not None and k == s and t and b and b < t]
        assert found[p] == (len(ended), max(ended, default=None))


def test_no_intervals_and_no_probes(spark):
    probes, stays = frames(spark)
    none = linkage.nearest(probes, stays.where("interval_id < 0"), "subject", probe_id="p")
    assert {r.direction for r in none.collect()} == {"missing"} and none.count() == 303
    assert linkage.containment(probes.where("p < 0"), stays, "subject", probe_id="p").count() == 0
    assert {r.n_prior for r in linkage.prior_history(probes, stays.where("interval_id < 0"), "subject", probe_id="p").collect()} == {0}


def test_links_are_those_of_the_three_joins(spark, many_parts):
    probes, stays = frames(spark)
    on = {"key": "subject", "probe_id": "p"}
    found = {r.p: r.asDict() for r in sweeps.links(probes, stays, flag="flag", **on).collect()}
    want: dict = {}
    for joined in (sweeps.containment(probes, stays, **on), sweeps.nearest(probes, stays, **on), sweeps.prior_history(probes, stays, flag="flag", **on)):
        for r in joined.collect():
            want.setdefault(r.p, {}).update(r.asDict())
    assert found == want and len(found) == 303


def test_hot_subjects_are_swept_once_and_in_steps(spark, data):
    plan = core.hot_subject_links(spark, data)._jdf.queryExecution().toString()
    assert "Window" not in plan and plan.count("Join ") < 20
