"""Queries of regression, dependence and inference, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import dependence, nulls, regression
from .core import rounded
from .tables import SHAPES, shapes, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def frame(spark, d):
    """Customers with a fold, two predictors and two targets."""
    spent = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("s"), F.count("*").alias("n"))
    c = table(spark, d, "customer").join(spent, "c_custkey")
    return c.select("c_custkey", S.stable_fold(F.col("c_custkey")).alias("fold"), (F.col("c_acctbal") / 1000).alias("age"), F.col("c_nationkey").cast("double").alias("site"), F.ln("s").alias("y"), F.col("n").cast("double").alias("w"), (F.col("c_mktsegment") == "MACHINERY").cast("double").alias("sex"))


_FRAME = (
    "fr AS (SELECT c_custkey, (('0x' || substr(sha256('20260820:' || c_custkey), 1, 16))::UBIGINT % 5)::INT AS fold, c_acctbal / 1000 AS age, c_nationkey::DOUBLE AS site, ln(s) AS y, n::DOUBLE AS w, (c_mktsegment = 'MACHINERY')::INT::DOUBLE AS sex "
    "FROM customer JOIN (SELECT o_custkey, sum(o_totalprice) AS s, count(*) AS n FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey)"
)
_FITS = (
    f"{_FRAME}, k AS (SELECT DISTINCT fold AS f FROM fr), mo AS (SELECT f, avg(age) AS ma, avg(site) AS mb, avg(y) AS my, avg(w) AS mw, var_pop(age) AS aa, var_pop(site) AS bb, covar_pop(age, site) AS ab, covar_pop(age, y) AS ay, covar_pop(site, y) AS bye, covar_pop(age, w) AS aw, covar_pop(site, w) AS bw FROM fr JOIN k ON fold <> f GROUP BY f), "
    "pd AS (SELECT fr.*, my + (ay * bb - bye * ab) / (aa * bb - ab * ab) * (age - ma) + (bye * aa - ay * ab) / (aa * bb - ab * ab) * (site - mb) AS py, mw + (aw * bb - bw * ab) / (aa * bb - ab * ab) * (age - ma) + (bw * aa - aw * ab) / (aa * bb - ab * ab) * (site - mb) AS pw, my + ay / aa * (age - ma) AS p1, mw + aw / aa * (age - ma) AS w1 FROM fr JOIN mo ON fold = f)"
)


@query(f"WITH {_FITS} SELECT c_custkey, fold, round(py, 6) AS pred_y, round(pw, 6) AS pred_w FROM pd")
def oof_linear_2pred(spark, d):
    return rounded(regression.out_of_fold(frame(spark, d), "fold", ["age", "site"], ["y", "w"]).select("c_custkey", "fold", "pred_y", "pred_w"))


@query(
    f"WITH {_FITS}, t AS (SELECT var_pop(y) * count(*) + var_pop(w) * count(*) AS sst, sum((y - py) ** 2) + sum((w - pw) ** 2) AS sse2, sum((y - p1) ** 2) + sum((w - w1) ** 2) AS sse1 FROM pd), "
    "r AS (SELECT 1 - sse1 / sst AS r2_one, 1 - sse2 / sst AS r2_two FROM t) SELECT round(r2_one, 6) AS r2_one, round(r2_two, 6) AS r2_two, round(r2_two - r2_one, 6) + 0.0 AS delta, CASE WHEN r2_two - r2_one >= 0.03 THEN 'MATERIAL_GE_0.03' WHEN r2_two - r2_one >= 0.01 THEN 'MODEST_0.01_TO_LT_0.03' ELSE 'NO_MATERIAL_GAIN_LT_0.01' END AS band FROM r"
)
def oof_r2_delta(spark, d):
    f = frame(spark, d)
    one = regression.aggregate_r2(regression.out_of_fold(f, "fold", ["age"], ["y", "w"]), ["y", "w"]).select(F.col("r2").alias("r2_one"))
    two = regression.aggregate_r2(regression.out_of_fold(f, "fold", ["age", "site"], ["y", "w"]), ["y", "w"]).select(F.col("r2").alias("r2_two"))
    both = one.crossJoin(F.broadcast(two)).withColumn("delta", F.col("r2_two") - F.col("r2_one"))
    return rounded(both.withColumn("band", S.delta_band(F.col("delta"))))


@query(f"WITH {_FITS} SELECT round(var_samp(y - py) + var_samp(w - pw), 6) AS residual_trace, round(var_samp(y) + var_samp(w), 6) AS total_trace, round((var_samp(y - py) + var_samp(w - pw)) / (var_samp(y) + var_samp(w)), 6) AS fraction FROM pd")
def residual_trace_fraction(spark, d):
    return rounded(regression.residual_trace_fraction(regression.out_of_fold(frame(spark, d), "fold", ["age", "site"], ["y", "w"]), ["y", "w"]))


@query(
    f"WITH {_FRAME}, q AS (SELECT quantile_cont(age, 0.05) AS a, quantile_cont(age, 0.35) AS b, quantile_cont(age, 0.65) AS c, quantile_cont(age, 0.95) AS d FROM fr) SELECT c_custkey, round((greatest(age - a, 0) ** 3 - greatest(age - c, 0) ** 3 * (d - a) / (d - c) + greatest(age - d, 0) ** 3 * (c - a) / (d - c)) / (d - a) ** 3, 6) + 0.0 AS s1, "
    "round((greatest(age - b, 0) ** 3 - greatest(age - c, 0) ** 3 * (d - b) / (d - c) + greatest(age - d, 0) ** 3 * (c - b) / (d - c)) / (d - a) ** 3, 6) + 0.0 AS s2 FROM fr CROSS JOIN q"
)
def rcs4_basis(spark, d):
    f = frame(spark, d)
    one, two = regression.spline_columns(F.col("age"), regression.spline_knots(f, "age"))
    return rounded(f.select("c_custkey", one.alias("s1"), two.alias("s2")))


@query()
def nested_models(spark, d):
    """R² of every nested design, out of fold, with knots of each training fold."""
    f = frame(spark, d)
    out = None
    for name in regression.DESIGNS:
        x = regression.nested_model(f, "fold", name, {"age": "age", "sex": "sex", "height": "site"}, ["y", "w"])
        row = regression.aggregate_r2(x, ["y", "w"]).withColumn("model", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out.select("model", "n", "r2")


_GEOMETRY = (
    "m AS (SELECT 'scores' AS of, count(*) AS n, var_samp(y) AS a, var_samp(w) AS d, covar_samp(y, w) AS b FROM pd UNION ALL SELECT 'residuals', count(*), var_samp(y - py), var_samp(w - pw), covar_samp(y - py, w - pw) FROM pd), "
    "v AS (SELECT of, n, a + d AS t, ((a + d) / 2 + sqrt(((a - d) / 2) ** 2 + b * b)) AS l1, ((a + d) / 2 - sqrt(((a - d) / 2) ** 2 + b * b)) AS l2 FROM m)"
)


@query(f"WITH {_FITS}, {_GEOMETRY} SELECT of, n, round(t, 6) AS trace, round(exp(-(l1 / t * ln(l1 / t) + l2 / t * ln(l2 / t))), 6) AS effective_rank, CASE WHEN l1 / t >= 0.9 THEN 1 ELSE 2 END AS d90, CASE WHEN l1 / t >= 0.95 THEN 1 ELSE 2 END AS d95, round(l1, 6) AS largest, round(l2, 6) AS least FROM v")
def residual_geometry(spark, d):
    """Trace, effective rank and dimensions of the covariance of scores and of their out-of-fold residuals."""
    found = regression.residual_geometry(regression.out_of_fold(frame(spark, d), "fold", ["age", "site"], ["y", "w"]), ["y", "w"])
    return rounded(found.select("of", "n", "trace", "effective_rank", "d90", "d95", F.get("eigenvalues", F.lit(0)).alias("largest"), F.get("eigenvalues", F.lit(1)).alias("least")))


@query(f"WITH {_FITS} SELECT axis, count(*) AS n, round(1 - sum((v - p) ** 2) / (var_pop(v) * count(*)), 6) AS r2 FROM (SELECT 'y' AS axis, y AS v, py AS p FROM pd UNION ALL SELECT 'w', w, pw FROM pd) GROUP BY axis")
def axis_r2(spark, d):
    return rounded(regression.axis_r2(regression.out_of_fold(frame(spark, d), "fold", ["age", "site"], ["y", "w"]), ["y", "w"]))


def phenotypes(spark, d):
    """Customers with three 0/1 conditions beside the baseline."""
    return frame(spark, d).withColumns({f"p{k}": (F.col("c_custkey") % k == 0).cast("double") for k in (2, 3, 7)})


@query()
def block_gains(spark, d):
    """Gains of three conditions over the baseline, and their shifts by three scales."""
    gains = regression.block_gains(phenotypes(spark, d), "fold", ["age", "site", "sex"], ["p2", "p3", "p7"], ["y", "w"])
    scales = frame(spark, d).agg(F.stddev_pop("y").alias("y_sd"), F.stddev_pop("w").alias("w_sd"))
    return regression.scaled_shifts(gains, scales)


_PAIR = f"WITH {SHAPES}, s AS (SELECT vec_id AS id, v[1:32] AS x, v[33:64] AS y FROM e)"
_DIST = "sqrt(list_sum(list_transform(list_zip({0}, {1}), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"


def halves(spark, d):
    return shapes(spark, d).select(F.col("vec_id").alias("id"), F.slice("v", 1, 32).alias("x"), F.slice("v", 33, 32).alias("y"), "label")


@query(f"{_PAIR}, p AS (SELECT {_DIST.format('a.x', 'b.x')} AS dist FROM s a JOIN s b ON a.id < b.id), m AS (SELECT id, unnest(range(32)) AS pos, unnest(x) AS x FROM s), r AS (SELECT sum(v) AS r2, max(n) AS n FROM (SELECT pos, var_pop(x) AS v, count(*) AS n FROM m GROUP BY pos)) SELECT n, round(sqrt(r2), 6) AS radius_rms, round(sqrt(avg(dist * dist)), 6) AS pair_rms FROM p CROSS JOIN r GROUP BY n, r2")
def pairwise_scale(spark, d):
    return rounded(dependence.pairwise_rms(halves(spark, d), "x"))


_NN = f"{_PAIR}, p AS (SELECT a.id, b.id AS o, {_DIST.format('a.x', 'b.x')} AS dist FROM s a JOIN s b ON a.id <> b.id), nn AS (SELECT id, arg_min(o, dist) AS neighbour, min(dist) AS distance FROM p GROUP BY id)"


@query(_NN + " SELECT id, neighbour, round(distance, 6) AS distance FROM nn")
def nearest_neighbour(spark, d):
    return rounded(dependence.nearest_neighbours(halves(spark, d), "id", "x"))


@query(_NN + f", t AS (SELECT id, {_DIST.format('x', 'y')} AS moved FROM s) SELECT count(*) AS n, round(avg((moved >= distance)::INT), 6) AS fraction FROM nn JOIN t USING (id)")
def nn_crossing_fraction(spark, d):
    from ..functions.vectors import distance

    h = halves(spark, d)
    nn = dependence.nearest_neighbours(h, "id", "x").join(h, "id")
    moved = distance(F.col("x"), F.col("y"))
    return rounded(nn.agg(F.count("*").alias("n"), F.avg((moved >= F.col("distance")).cast("int")).alias("fraction")))


def _standard(table: str, out: str) -> str:
    """``out``: the table with both vectors less their means and by their population deviations."""
    moments = ", ".join(f"m{c} AS (SELECT list(m ORDER BY pos) AS m{c}, list(s ORDER BY pos) AS s{c} FROM (SELECT pos, avg(c) AS m, CASE WHEN stddev_pop(c) <= 1e-12 THEN 1.0 ELSE stddev_pop(c) END AS s FROM (SELECT unnest(range(len({c}))) AS pos, unnest({c}) AS c FROM {table}) GROUP BY pos))" for c in "xy")
    scaled = ", ".join(f"list_transform(list_zip({c}, m{c}, s{c}), lambda z: (z[1] - z[2]) / z[3]) AS {c}" for c in "xy")
    return f"{moments}, {out} AS (SELECT * REPLACE ({scaled}) FROM {table} CROSS JOIN mx CROSS JOIN my)"


_DCOR = (
    "d AS (SELECT rep, a.id AS i, b.id AS j, {x} AS a, {y} AS b FROM s a JOIN s b USING (rep)), ra AS (SELECT rep, i, avg(a) AS ra, avg(b) AS rb FROM d GROUP BY rep, i), g AS (SELECT rep, avg(a) AS ga, avg(b) AS gb FROM d GROUP BY rep), "
    "c AS (SELECT d.rep, a - p.ra - q.ra + ga AS a, b - p.rb - q.rb + gb AS b FROM d JOIN ra p ON p.rep = d.rep AND p.i = d.i JOIN ra q ON q.rep = d.rep AND q.i = d.j JOIN g ON g.rep = d.rep), "
    "dc AS (SELECT rep, sqrt(greatest(avg(a * b), 0) / sqrt(avg(a * a) * avg(b * b))) AS dcor FROM c GROUP BY rep)"
).format(x=_DIST.format("a.x", "b.x"), y=_DIST.format("a.y", "b.y"))


@query(f"WITH {SHAPES}, b AS (SELECT 0 AS rep, vec_id AS id, v[1:32] AS x, v[33:64] AS y FROM e), {_standard('b', 's')}, {_DCOR} SELECT (SELECT count(*) FROM s) AS n, round(dcor, 6) AS dcor FROM dc")
def distance_correlation(spark, d):
    return rounded(dependence.distance_correlation(halves(spark, d), "id", "x", "y"))


def _perm_sql(within: str) -> str:
    part = f"PARTITION BY rep{within}"
    return (
        f"WITH {SHAPES}, a AS (SELECT vec_id AS id, v[1:32] AS x, v[33:64] AS y, label FROM e), {_standard('a', 'b')}, r AS (SELECT unnest(range(0, 10)) AS rep), "
        f"t AS (SELECT rep, id, label, x, row_number() OVER ({part} ORDER BY id) AS k FROM b CROSS JOIN r), w AS (SELECT rep, label, y, row_number() OVER ({part} ORDER BY CASE WHEN rep = 0 THEN '' ELSE sha256('7:' || rep || ':' || id) END, id) AS k FROM b CROSS JOIN r), "
        f"s AS (SELECT rep, t.id, t.x, w.y FROM t JOIN w USING (rep, k{within})), {_DCOR}, o AS (SELECT dcor FROM dc WHERE rep = 0) "
        "SELECT round(o.dcor, 6) AS observed, count(*) AS n_reps, round((1 + count(*) FILTER (dc.dcor >= o.dcor - 1e-12)) / (count(*) + 1), 6) AS p FROM dc CROSS JOIN o WHERE rep > 0 GROUP BY o.dcor"
    )


def _permutation(h, within):
    return rounded(dependence.permutation_p(nulls.hash_null(h, "id", "x", "y", 9, 7, within), "dcor"))


@query(_perm_sql(""))
def dcor_perm_hash(spark, d):
    """A permutation test over all blocks in orders by hash, as SQL can deal them too; ``dcor_permutation`` is the full size."""
    return _permutation(halves(spark, d), None)


@query(_perm_sql(", label"))
def fold_blocked_perm_hash(spark, d):
    """The same with values kept within their group."""
    return _permutation(halves(spark, d), "label")


_P = "p AS (SELECT event_type AS test, avg((value > 80)::INT) / 10 AS p FROM events GROUP BY event_type)"


def tests_table(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("test")).agg((F.avg((F.col("value") > 80).cast("int")) / 10).alias("p"))


@query(f"WITH {_P}, k AS (SELECT *, row_number() OVER (ORDER BY p) AS r, count(*) OVER () AS m FROM p) SELECT test, round(p, 8) AS p, round(min(least(1.0, m * p / r)) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 8) AS q FROM k")
def bh_fdr(spark, d):
    return rounded(dependence.benjamini_hochberg(tests_table(spark, d), "p"), 8)


@query(f"WITH {_P}, k AS (SELECT *, row_number() OVER (ORDER BY p) AS r, count(*) OVER () AS m FROM p) SELECT test, round(p, 8) AS p, round(max(least(1.0, (m - r + 1) * p)) OVER (ORDER BY r), 8) AS holm_p FROM k")
def holm(spark, d):
    return rounded(dependence.holm(tests_table(spark, d), "p"), 8)


@query(f"WITH {_P} SELECT test, CASE WHEN p >= 0.03 THEN 'MATERIAL_GE_0.03' WHEN p >= 0.01 THEN 'MODEST_0.01_TO_LT_0.03' ELSE 'NO_MATERIAL_GAIN_LT_0.01' END AS band FROM p")
def decision_bands(spark, d):
    return tests_table(spark, d).select("test", S.delta_band(F.col("p")).alias("band"))


@query()
def bootstrap_median_ci(spark, d):
    return dependence.interval(dependence.bootstrap_medians(frame(spark, d), "c_custkey", "y", 2000, 11), "median")


def _keyed_sql(rows: str, seed: int) -> str:
    """``walked(rep, g, k, n, w, x)``: a keyed permutation's steps from the numbers of ``rows(rep, g, k, n)``, ``g`` being the
    group's number; the last step is below n."""
    inner = "SELECT rep, g, k, n, w, x >> w AS l, x & ((1 << w) - 1) AS r FROM {source}"
    for i in range(nulls.ROUNDS):
        key = f"((({seed} + 7919 * g) * 1000003 + rep) % 1073741824 * 69069 + {i * 40503}) % 1073741824"
        inner = f"SELECT rep, g, k, n, w, l, r, ((r + {key}) * {nulls._A}) & {nulls._MASK} AS t FROM ({inner})"
        inner = f"SELECT rep, g, k, n, w, l, r, (xor(t, t >> 15) * {nulls._B}) & {nulls._MASK} AS t FROM ({inner})"
        inner = f"SELECT rep, g, k, n, w, r AS l, xor(l, xor(t, t >> 13) & ((1 << w) - 1)) AS r FROM ({inner})"
    step = f"SELECT rep, g, k, n, w, (l << w) | r AS x FROM ({inner})"
    wide = "list_min(list_filter(range(1, 31), lambda w: (1::BIGINT << (2 * w)) >= n))"
    return f"walked(rep, g, k, n, w, x) AS ({step.format(source=f'(SELECT rep, g, k, n, {wide} AS w, k AS x FROM {rows})')} UNION ALL {step.format(source='walked WHERE x >= n')})"


@query(f"WITH RECURSIVE a AS (SELECT unnest(range(1, 4))::BIGINT AS rep, 0::BIGINT AS g, k, n FROM (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS k, count(*) OVER () AS n FROM embeddings)), {_keyed_sql('a', 5)} SELECT rep::INT AS rep, k, x AS at FROM walked WHERE x < n")
def keyed_permutations(spark, d):
    """Three keyed permutations of all blocks."""
    return nulls.keyed_permutations(shapes(spark, d), ["vec_id"], 3, 5)


def _full_sql(group: str) -> str:
    """Distances once, then re-indexed by 999 keyed permutations (of rows in the order of ``group`` and id)."""
    near = _DIST.format("a.{0}", "b.{0}")
    return (
        f"WITH RECURSIVE {SHAPES}, u AS (SELECT vec_id AS id, v[1:32] AS x, v[33:64] AS y, label FROM e), {_standard('u', 's')}, "
        f"o AS MATERIALIZED (SELECT x, y, (row_number() OVER (ORDER BY {group} id) - 1)::INT AS i, (row_number() OVER (PARTITION BY {group} 0 ORDER BY id) - 1)::BIGINT AS k, count(*) OVER (PARTITION BY {group} 0) AS n, (dense_rank() OVER (ORDER BY {group} 0) - 1)::BIGINT AS g FROM s), "
        f"d AS MATERIALIZED (SELECT a.i, b.i AS j, {near.format('x')} AS a, {near.format('y')} AS b FROM o a CROSS JOIN o b), "
        "ra AS (SELECT i, avg(a) AS ra, avg(b) AS rb FROM d GROUP BY i), g AS (SELECT avg(a) AS ga, avg(b) AS gb FROM d), "
        "c AS MATERIALIZED (SELECT d.i, d.j, a - p.ra - q.ra + ga AS a, b - p.rb - q.rb + gb AS b FROM d JOIN ra p ON p.i = d.i JOIN ra q ON q.i = d.j CROSS JOIN g), "
        f"t AS (SELECT r.rep::BIGINT AS rep, g, k, n FROM (SELECT g, k, n FROM o) CROSS JOIN (SELECT unnest(range(1, 1000)) AS rep) r), {_keyed_sql('t', 7)}, "
        "m AS MATERIALIZED (SELECT w.rep::INT AS rep, o.i, (o.i - o.k + w.x)::INT AS x FROM walked w JOIN o ON o.k = w.k AND o.g = w.g WHERE w.x < w.n), "
        "dc AS (SELECT p.rep, sum(c.a * z.b) AS s FROM c JOIN m p ON p.i = c.i JOIN m q ON q.rep = p.rep AND q.i = c.j JOIN c z ON z.i = p.x AND z.j = q.x GROUP BY p.rep), "
        "h AS (SELECT count(*) AS nn, sqrt(avg(a * a) * avg(b * b)) AS v, avg(a * b) AS ab FROM c), "
        "f AS (SELECT sqrt(greatest(s / nn, 0) / v) AS dcor, sqrt(greatest(ab, 0) / v) AS observed FROM dc CROSS JOIN h) "
        "SELECT round(observed, 6) AS observed, count(*) AS n_reps, round((1 + count(*) FILTER (dcor >= observed - 1e-12)) / (count(*) + 1), 6) AS p, round(median(dcor), 6) AS null_median, round(quantile_cont(dcor, 0.95), 6) AS null_q95, round(observed - quantile_cont(dcor, 0.95), 6) AS observed_minus_q95 FROM f GROUP BY observed"
    )


@query(_full_sql(""))
def dcor_permutation(spark, d):
    """The permutation test of distance correlation over all blocks, 999 replicates."""
    return rounded(dependence.null_summary(nulls.correlation_null(halves(spark, d), "id", "x", "y", 999, 7), "dcor"))


@query(_full_sql("label,"))
def fold_blocked_permutation(spark, d):
    """The same with values kept within their group."""
    return rounded(dependence.null_summary(nulls.correlation_null(halves(spark, d), "id", "x", "y", 999, 7, "label"), "dcor"))


@query()
def pipeline_replay_null(spark, d):
    """Fitted values plus permuted residuals, the out-of-fold fit run anew for each of 999 replicates."""
    stats = nulls.pipeline_replay(frame(spark, d), "c_custkey", "fold", ["age", "site", "sex"], ["y", "w"], 999, 17, ["age", "site"])
    return dependence.null_summary(stats, "dcor")


EIGHT = (2, 3, 5, 7, 11, 13, 17, 19)


@query()
def freedman_lane(spark, d):
    """Eight conditions, each over the baseline and the other seven: 2,000 replicates and the false discovery rate."""
    f = frame(spark, d).withColumns({f"p{k}": (F.col("c_custkey") % k == 0).cast("double") for k in EIGHT})
    stats = nulls.freedman_lane(f, "c_custkey", ["age", "site", "sex"], [f"p{k}" for k in EIGHT], ["y", "w"], 2000, 13)
    return dependence.benjamini_hochberg(dependence.permutation_p(stats, "statistic", ["term"]), "p").select("term", "observed", "n_reps", "p", "q")
