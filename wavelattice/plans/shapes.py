"""Queries of bases, residuals, scales and decisions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import characterize, localize
from .core import replicate_shapes, rounded
from .geometry import BASIS, _score
from .stats import _FITS, _FRAME, frame, oof_r2_delta
from .tables import LONG, REPS, beats, shapes

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


_Z = "z AS (SELECT vec_id, patient, block, " + ", ".join(f"{_score('x', k)} AS z{k + 1}" for k in range(8)) + " FROM l GROUP BY vec_id, patient, block)"
_ENERGY = " + ".join(f"z{k + 1} * z{k + 1}" for k in range(8))


@query(f"WITH {LONG}, {_Z}, t AS (SELECT vec_id, var_pop(x) * count(*) AS e FROM l GROUP BY vec_id) SELECT vec_id, round(({_ENERGY}) / e, 6) AS in_basis, round(1 - ({_ENERGY}) / e, 6) AS residual FROM z JOIN t USING (vec_id)")
def projection_energy_split(spark, d):
    return rounded(characterize.energy_split(shapes(spark, d), "v", BASIS).select("vec_id", "in_basis", "residual"))


_BACK = " + ".join(f"z{k + 1} * {'cos' if k % 2 == 0 else 'sin'}(2 * pi() * {k // 2 + 1} * pos / 64) * sqrt(2.0 / 64)" for k in range(8))
_LEFT = f"WITH {LONG}, {_Z}, mn AS (SELECT vec_id, avg(x) AS m FROM l GROUP BY vec_id), rs AS (SELECT pos, sum((x - m - ({_BACK})) ** 2) AS e FROM l JOIN mn USING (vec_id) JOIN z USING (vec_id) GROUP BY pos), rp AS (SELECT pos, e / sum(e) OVER () AS share FROM rs)"


@query(_LEFT + " SELECT pos::INT AS pos, round(share, 6) AS share FROM rp")
def residual_profile(spark, d):
    return rounded(characterize.residual_profile(shapes(spark, d), "v", BASIS))


@query(_LEFT + ", w AS (SELECT a.pos, sum(b.share) AS total FROM rp a JOIN rp b ON b.pos BETWEEN a.pos AND a.pos + 7 WHERE a.pos <= 56 GROUP BY a.pos) SELECT 8 AS width, arg_min(pos, (-round(total, 12), pos))::INT AS start, round(max(total), 6) AS total FROM w")
def residual_window(spark, d):
    profile = characterize.residual_profile(shapes(spark, d), "v", BASIS)
    return rounded(localize.best_window(localize.window_sums(profile, [], "pos", "share", (8,)), []).select("width", "start", "total"))


@query(
    f"WITH {LONG}, {_Z}, mu AS (SELECT pos, avg(x) AS m FROM l GROUP BY pos) "
    + " UNION ALL ".join(f"SELECT {k + 1} AS axis, pos::INT AS pos, round(m - s * b, 6) + 0.0 AS low, round(m + s * b, 6) + 0.0 AS high FROM (SELECT pos, m, {'cos' if k % 2 == 0 else 'sin'}(2 * pi() * {k // 2 + 1} * pos / 64) * sqrt(2.0 / 64) AS b, (SELECT stddev_samp(z{k + 1}) FROM z) AS s FROM mu)" for k in range(8))
)
def excursion_curves(spark, d):
    return rounded(characterize.excursions(shapes(spark, d), "v", BASIS))


@query(
    f"WITH {REPS}, mu AS (SELECT pos, avg(a) AS m FROM r GROUP BY pos), p AS (SELECT patient, sum((a - m) ** 2) AS rad, sum((o - e) ** 2) AS rep FROM r JOIN mu USING (pos) GROUP BY patient), "
    "b AS (SELECT sqrt(avg(rad)) AS radius_rms, sqrt(avg(rep)) AS replicate_rms FROM p), wi AS (SELECT patient, pos, var_pop(x) AS v FROM l GROUP BY patient, pos), w AS (SELECT sqrt(avg(v)) AS within_rms FROM (SELECT patient, sum(v) AS v FROM wi GROUP BY patient)) "
    "SELECT round(radius_rms, 6) AS radius_rms, round(replicate_rms, 6) AS replicate_rms, round(within_rms, 6) AS within_rms, round(within_rms / radius_rms, 6) AS within_over_radius, round(radius_rms / replicate_rms, 6) AS radius_over_replicate FROM b CROSS JOIN w"
)
def scale_family(spark, d):
    return rounded(characterize.scale_family(replicate_shapes(spark, d), shapes(spark, d), "patient"))


@query(
    f"WITH {LONG}, {_Z}, p AS (SELECT patient, " + ", ".join(f"avg(z{k}) AS m{k}, var_samp(z{k}) AS v{k}" for k in range(1, 9)) + " FROM z GROUP BY patient) "
    + " UNION ALL ".join(f"SELECT 'z{k}' AS axis, round(var_samp(m{k}), 8) AS between, round(avg(v{k}), 8) AS within, round(var_samp(m{k}) / avg(v{k}), 6) AS ratio FROM p" for k in range(1, 9))
)
def axis_variance_ratios(spark, d):
    z = V.projected(F.col("v"), BASIS)
    scores = shapes(spark, d).select("patient", *(c.alias(f"z{k + 1}") for k, c in enumerate(z)))
    out = characterize.axis_variances(scores, "patient", [f"z{k}" for k in range(1, 9)])
    return out.select("axis", F.round("between", 8).alias("between"), F.round("within", 8).alias("within"), F.round("ratio", 6).alias("ratio"))


@query(
    "WITH b AS (SELECT user_id, value, epoch_us(ts) / 1e6 - min(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id) AS center FROM events), k AS (SELECT user_id, floor(center / 86400) AS block, median(value) AS a, median(value + 1) AS b, median(center - 86400 * floor(center / 86400) + 1) AS c FROM b GROUP BY ALL) "
    "SELECT user_id, round(avg(a), 6) AS level, round(ln(avg(b)), 6) AS log_scale, round(ln(avg(c)), 6) AS log_duration FROM k GROUP BY user_id"
)
def conventional_factors(spark, d):
    b = beats(spark, d).withColumn("block", F.floor(F.col("center") / 86_400)).withColumn("scale", F.col("value") + 1)
    b = b.withColumn("duration", F.col("center") - 86_400 * F.col("block") + 1)
    return rounded(characterize.conventional_factors(b, "user_id", "block", "value", "scale", "duration"))


@query(f"WITH {_FRAME} SELECT count(*) AS n, round(sqrt(regr_slope(y, sex) ** 2 + regr_slope(w, sex) ** 2), 6) AS norm FROM fr")
def coefficient_norm(spark, d):
    return rounded(characterize.coefficient_norm(frame(spark, d), "sex", ["y", "w"]))


@query(
    f"WITH {_FITS}, t AS (SELECT 1 - (sum((y - p1) ** 2) + sum((w - w1) ** 2)) / (var_pop(y) * count(*) + var_pop(w) * count(*)) AS r1, 1 - (sum((y - py) ** 2) + sum((w - pw) ** 2)) / (var_pop(y) * count(*) + var_pop(w) * count(*)) AS r2 FROM pd) "
    "SELECT CASE WHEN r2 - r1 >= 0.03 THEN 'MATERIAL_NONLINEAR_CONSTITUTIONAL_MEAN_SIGNAL_REINTERPRET_LINEAR_STAGE7B' WHEN r2 - r1 >= 0.01 THEN 'MODEST_NONLINEAR_CONSTITUTIONAL_INFORMATION_NO_STRONG_REVERSAL' ELSE 'NO_MATERIAL_OOF_MEAN_GAIN_BUT_RESIDUAL_MODEL_FREE_DEPENDENCE_FLAG' END AS decision, "
    "CASE WHEN r1 < 0.3 THEN 'GO' WHEN r1 < 0.6 THEN 'MODIFY' ELSE 'STRONG' END AS band FROM t"
)
def audit_decisions(spark, d):
    return oof_r2_delta(spark, d).select(characterize.nonlinear_decision(F.col("delta"), F.lit(True)).alias("decision"), characterize.identifiability_band(F.col("r2_one")).alias("band"))
