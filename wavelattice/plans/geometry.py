"""Queries of spectra, projections, localisation, waveforms, manifests and metrics, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import vectors as V
from ..operators import covariance, entropies, integrity, localize, signal, spectral
from ..streaming.blocks import block_summaries
from .core import replicate_shapes, rounded
from .tables import LONG, REPS, pressures, shapes, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def folded(spark, d) -> DataFrame:
    return replicate_shapes(spark, d).withColumn("fold", S.stable_fold(F.col("patient")))


def folds(spark, d) -> spectral.Folds:
    return spectral.Folds(folded(spark, d), "fold", ["all_rep", "odd_rep", "even_rep"])


# ---------------------------------------------------------------- reconstruction and scores

_FOLD = "fo AS (SELECT DISTINCT patient, (('0x' || substr(sha256('20260820:' || patient), 1, 16))::UBIGINT % 5)::INT AS fold FROM r)"


@query(
    f"WITH {REPS}, {_FOLD}, mu AS (SELECT g.fold, r.pos, avg(r.a) AS m FROM (SELECT DISTINCT fold FROM fo) g JOIN fo ON fo.fold <> g.fold JOIN r ON r.patient = fo.patient GROUP BY g.fold, r.pos), "
    "x AS (SELECT r.patient, r.pos, a - m AS a, o - m AS o, e - m AS e FROM r JOIN fo USING (patient) JOIN mu ON mu.fold = fo.fold AND mu.pos = r.pos), "
    "k AS (SELECT unnest(range(1, 13)) AS k), p AS (SELECT patient, k, sqrt(2.0 / 64) AS w, sum(a * cos(2 * pi() * k * pos / 64)) AS ac, sum(a * sin(2 * pi() * k * pos / 64)) AS sa, sum(o * cos(2 * pi() * k * pos / 64)) AS oc, sum(o * sin(2 * pi() * k * pos / 64)) AS so, sum(e * cos(2 * pi() * k * pos / 64)) AS ec, sum(e * sin(2 * pi() * k * pos / 64)) AS se FROM x CROSS JOIN k GROUP BY patient, k), "
    "en AS (SELECT k, sum(w * w * (ac * ac + sa * sa)) AS a, sum(w * w * (oc * oc + so * so)) AS o, sum(w * w * (ec * ec + se * se)) AS e FROM p GROUP BY k), st AS (SELECT sum(a * a) AS a, sum(o * o) AS o, sum(e * e) AS e FROM x) "
    "SELECT (2 * en.k)::INT AS dimension, round(sum(en.a) OVER w / st.a, 6) AS r2_all, round(sum(en.o) OVER w / st.o, 6) AS r2_odd, round(sum(en.e) OVER w / st.e, 6) AS r2_even FROM en CROSS JOIN st WINDOW w AS (ORDER BY en.k)"
)
def fourier_cv_curve(spark, d):
    f = folds(spark, d)
    rows = []
    for n in range(2, 25, 2):
        bases = dict.fromkeys(f.parts, spectral.fourier_basis(n))
        rows.append((n, *(float(f.r2(bases, k)) for k in (0, 1, 2))))
    return rounded(spark.createDataFrame(rows, "dimension int, r2_all double, r2_odd double, r2_even double"))


BASIS = [V.fourier_vector(k // 2 + 1, "cos" if k % 2 == 0 else "sin") for k in range(8)]


def _score(column: str, k: int) -> str:
    wave = "cos" if k % 2 == 0 else "sin"
    return f"sum({column} * {wave}(2 * pi() * {k // 2 + 1} * pos / 64)) * sqrt(2.0 / 64)"


@query(f"WITH {REPS} SELECT patient, " + ", ".join(f"round({_score('a', k)}, 6) + 0.0 AS z{k + 1}" for k in range(8)) + " FROM r GROUP BY patient")
def projection_scores(spark, d):
    z = V.projected(F.col("all_rep"), BASIS)
    return rounded(replicate_shapes(spark, d).select("patient", *(c.alias(f"z{k + 1}") for k, c in enumerate(z))))


@query(f"WITH {REPS}, z AS (SELECT patient, " + ", ".join(f"{_score('o', k)} AS o{k}, {_score('e', k)} AS e{k}" for k in range(8)) + " FROM r GROUP BY patient) " + " UNION ALL ".join(f"SELECT {k + 1} AS axis, round(corr(o{k}, e{k}), 6) + 0.0 AS correlation, round(stddev_samp(o{k}), 6) AS odd_sd, round(stddev_samp(e{k}), 6) AS even_sd FROM z" for k in range(8)))
def axis_reliability(spark, d):
    r = replicate_shapes(spark, d)
    odd, even = V.projected(F.col("odd_rep"), BASIS), V.projected(F.col("even_rep"), BASIS)
    z = r.select(*(c.alias(f"o{k}") for k, c in enumerate(odd)), *(c.alias(f"e{k}") for k, c in enumerate(even)))
    one = z.agg(*(a for k in range(8) for a in (F.corr(f"o{k}", f"e{k}").alias(f"c{k}"), F.stddev_samp(f"o{k}").alias(f"s{k}"), F.stddev_samp(f"e{k}").alias(f"t{k}"))))
    rows = [F.struct(F.lit(k + 1).alias("axis"), F.col(f"c{k}").alias("correlation"), F.col(f"s{k}").alias("odd_sd"), F.col(f"t{k}").alias("even_sd")) for k in range(8)]
    return rounded(one.select(F.explode(F.array(*rows)).alias("r")).select("r.*"))


@query(
    f"WITH {LONG}, v AS (SELECT pos, var_samp(x) AS value FROM l GROUP BY pos), s AS (SELECT value, value / sum(value) OVER () AS share, row_number() OVER (ORDER BY value DESC) AS r FROM v), c AS (SELECT *, sum(share) OVER (ORDER BY r) AS cum FROM s) "
    "SELECT count(*) AS n, count(*) AS rank, round(exp(-sum(share * ln(share))), 6) AS effective_rank, min(r) FILTER (cum >= 0.9 - 1e-12)::INT AS d90, min(r) FILTER (cum >= 0.95 - 1e-12)::INT AS d95, 0.0 AS negative_mass FROM c WHERE value > 1e-10"
)
def spectrum_metrics(spark, d):
    """Of the diagonal of the covariance, as a spectrum."""
    c = covariance.covariance(shapes(spark, d), "v").where("i = j and c > 1e-10").select(F.col("c").alias("value"))
    return rounded(spectral.spectrum_metrics(c.withColumn("value", F.col("value"))))


@query()
def srep_spectrum(spark, d):
    values, _ = spectral.eigen(folds(spark, d).replicate_operator())
    return spectral.spectrum_table(spark, values)


@query()
def pca_vs_replicate_angles(spark, d):
    f = folds(spark, d)
    a, b = spectral.eigen(f.replicate_operator())[1][:, :8], spectral.eigen(f.mean_covariance())[1][:, :8]
    overlap = spectral.projector_overlap(a, b)
    return spark.createDataFrame([(k + 1, float(x), overlap) for k, x in enumerate(spectral.principal_angles(a, b))], "k int, degrees double, overlap double")


@query()
def cv_reconstruction_curve(spark, d):
    rows = spectral.reconstruction_curve(folds(spark, d))
    return spark.createDataFrame(rows, "dimension int, r2_all double, r2_odd double, r2_even double, ordinary_r2_all double")


@query()
def dimension_rule(spark, d):
    return spectral.chosen_dimension(cv_reconstruction_curve(spark, d))


@query()
def random_subspace_baseline(spark, d):
    """Median and 95th percentile of R² of 200 random bases, and the part of them below the replicate basis."""
    f, rng = folds(spark, d), np.random.default_rng(20260821)
    values = [(i, float(f.r2(dict.fromkeys(f.parts, spectral.random_basis(rng, 8))))) for i in range(200)]
    primary = f.r2(f.bases(8, "replicate"))
    t = spark.createDataFrame(values, "i int, r2 double")
    q = F.percentile("r2", F.array(F.lit(0.5), F.lit(0.95)))
    return t.agg(q.alias("q"), F.avg((F.col("r2") < primary).cast("int")).alias("below_primary")).select(F.col("q")[0].alias("median"), F.col("q")[1].alias("p95"), F.lit(float(primary)).alias("primary_r2"), "below_primary")


@query()
def halfsplit_overlap(spark, d):
    """Overlap of the eight-dimensional bases of 100 random halves, from one pass of sums of products."""
    out = []
    for k, halves in spectral.split_operators(folded(spark, d), "patient", "odd_rep", "even_rep", 100).items():
        found = [spectral.eigen(m) for m in halves]
        if len(found) == 2 and min(spectral.positive_rank(v) for v, _ in found) >= 8:
            out.append((k, spectral.projector_overlap(found[0][1][:, :8], found[1][1][:, :8])))
    return spark.createDataFrame(out, "split int, overlap double")


# ---------------------------------------------------------------- localisation


def profile(spark, d) -> DataFrame:
    """By label, where along the phase the squared shapes lie, as a distribution."""
    long = shapes(spark, d).select("label", F.posexplode("v").alias("pos", "x"))
    sums = long.groupBy("label", "pos").agg(F.sum(F.col("x") * F.col("x")).alias("e"))
    total = sums.groupBy("label").agg(F.sum("e").alias("t"))
    return sums.join(total, "label").select("label", "pos", (F.col("e") / F.col("t")).alias("share"))


_PROFILE = f"{LONG}, ps AS (SELECT label, pos, sum(x * x) AS e FROM l GROUP BY label, pos), pf AS (SELECT label, pos, e / sum(e) OVER (PARTITION BY label) AS share FROM ps)"
_WINDOWS = _PROFILE + ", wi AS (SELECT a.label, w.w AS width, a.pos AS start, sum(b.share) AS total FROM pf a CROSS JOIN (SELECT unnest([4, 8, 16]) AS w) w JOIN pf b ON b.label = a.label AND b.pos >= a.pos AND b.pos < a.pos + w.w WHERE a.pos + w.w <= 64 GROUP BY a.label, w.w, a.pos)"


@query(f"WITH {_WINDOWS}, k AS (SELECT *, row_number() OVER (PARTITION BY label, width ORDER BY round(total, 12) DESC, start) AS r FROM wi) SELECT label, width::INT AS width, start::INT AS start, round(total, 6) AS total FROM k WHERE r = 1")
def phase_profile_windows(spark, d):
    return rounded(localize.best_window(localize.window_sums(profile(spark, d), ["label"], "pos", "share"), ["label"]))


@query(f"WITH {_WINDOWS} SELECT label, width::INT AS width, start::INT AS start, round(total, 6) AS total FROM wi WHERE width = 8 AND (start + width <= 36 OR start >= 52)")
def second_locus_candidates(spark, d):
    windows = localize.window_sums(profile(spark, d), ["label"], "pos", "share", (8,))
    return rounded(localize.outside_guard(windows, 40, 8))


@query(f"WITH {LONG}, dd AS (SELECT vec_id, label, x, lead(x) OVER w - x AS d1, lead(x, 2) OVER w - 2 * lead(x) OVER w + x AS d2 FROM l WINDOW w AS (PARTITION BY vec_id ORDER BY pos)) SELECT label, round(sum(x * x), 6) AS shape, round(sum(d1 * d1), 6) AS slope, round(sum(d2 * d2), 6) AS curvature FROM dd GROUP BY label")
def finite_difference_energy(spark, d):
    e = shapes(spark, d)
    cols = {n: V.dot(V.differences(F.col("v"), k), V.differences(F.col("v"), k)) for n, k in localize.METRICS.items()}
    return rounded(e.select("label", *(c.alias(n) for n, c in cols.items())).groupBy("label").agg(*(F.sum(n).alias(n) for n in cols)))


@query(
    "WITH b AS (SELECT i, pos, CASE WHEN i % 2 = 0 THEN cos(2 * pi() * (i // 2 + 1) * pos / 64) ELSE sin(2 * pi() * (i // 2 + 1) * pos / 64) END * sqrt(2.0 / 64) AS v FROM range(8) t(i) CROSS JOIN range(40, 48) u(pos)), "
    "g AS (SELECT x.i, y.i AS j, sum(x.v * y.v) AS g FROM b x JOIN b y USING (pos) GROUP BY x.i, y.i), f AS (SELECT p.i, p.j, (a.g + c.g) / 2 + sqrt(((a.g - c.g) / 2) ** 2 + p.g ** 2) AS fraction FROM g p JOIN g a ON a.i = p.i AND a.j = p.i JOIN g c ON c.i = p.j AND c.j = p.j WHERE p.i < p.j) "
    "SELECT i::INT AS i, j::INT AS j, round(fraction, 6) AS fraction, row_number() OVER (ORDER BY round(fraction, 12) DESC, i, j)::INT AS rank FROM f"
)
def pair_localization_closed_form(spark, d):
    b = np.array(BASIS).T[40:48]
    g = b.T @ b
    rows = [(i, j, float(g[i, j])) for i in range(8) for j in range(8)]
    return rounded(localize.axis_pairs(spark.createDataFrame(rows, "i int, j int, g double")))


def replicate_basis(spark, d) -> np.ndarray:
    return spectral.eigen(folds(spark, d).replicate_operator())[1][:, :8]


@query()
def window_scan_top_direction(spark, d):
    return localize.best(localize.scan(spark, replicate_basis(spark, d)))


@query()
def second_direction(spark, d):
    """The best windows of what is orthogonal to the first direction."""
    b = replicate_basis(spark, d)
    first = localize.best(localize.scan(spark, b, ("shape",), (8,))).first()
    return localize.best(localize.scan(spark, localize.without(b, np.array(first["direction"]))))


# ---------------------------------------------------------------- waveforms


@query()
def beat_catalog_synthetic(spark, d):
    """Beats of waveforms made of all vectors: counts and mean pressures of those that pass the checks."""
    kept = signal.quality(signal.representations(signal.beat_catalog(pressures(spark, d))))
    return kept.groupBy("patient_id").agg(F.count("*").alias("n_beats"), F.avg("duration_sec").alias("mean_duration"), F.avg("map_proxy").alias("mean_pressure"), F.avg("pp").alias("mean_pulse"))


@query()
def beats_lateral(spark, d):
    """The same waveforms' beats by the table function, in SQL."""
    signal.register_beats(spark)
    return spark.sql("SELECT c.patient_id, b.beat_id, b.left_sec, b.right_sec, b.center_sec, b.duration_sec, b.failure FROM {cases} c, LATERAL beats(c.fs, c.abp) b", cases=pressures(spark, d))


@query()
def block_entropy_deltas(spark, d):
    return entropies.block_entropies(shapes(spark, d), "patient", "v", surrogates=200, seed=20260816, order=["vec_id"])


# ---------------------------------------------------------------- manifests, leaks, metrics


@query("SELECT doc_id, octet_length(encode(text)) AS bytes, sha256(text) AS sha256 FROM documents")
def sha_manifest(spark, d):
    return integrity.manifest(table(spark, d, "documents"), "doc_id", "text")


@query(
    "WITH a AS (SELECT doc_id AS name, sha256(text) AS s FROM documents WHERE doc_id % 6 <> 1), b AS (SELECT doc_id AS name, sha256(CASE WHEN doc_id % 5 = 0 THEN upper(lang) ELSE text END) AS s FROM documents WHERE doc_id % 6 <> 2) "
    "SELECT * FROM (SELECT coalesce(a.name, b.name) AS name, CASE WHEN b.s IS NULL THEN 'missing' WHEN a.s IS NULL THEN 'extra' WHEN a.s <> b.s THEN 'changed' END AS status FROM a FULL JOIN b ON a.name = b.name) WHERE status IS NOT NULL"
)
def manifest_diff(spark, d):
    """Missing, extra and changed documents between two lists; every document is on at least one of them."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("name"), "text", "lang")
    changed = docs.where("name % 6 <> 2").withColumn("text", F.when(F.col("name") % 5 == 0, F.upper("lang")).otherwise(F.col("text")))
    return integrity.manifest_difference(integrity.manifest(docs.where("name % 6 <> 1"), "name", "text"), integrity.manifest(changed, "name", "text"), "name")


@query(" UNION ALL ".join(f"SELECT lang, '{n}' AS rule, sum(len(regexp_extract_all(text, '{p}')))::BIGINT AS n_hits, count(*) FILTER (regexp_matches(text, '{p}')) AS n_rows FROM documents GROUP BY lang" for n, p in S.LEAKS.items()))
def leak_scan_counts(spark, d):
    return integrity.leak_scan(table(spark, d, "documents"), "text", ["lang"])


@query("SELECT sha256(string_agg(c_name, chr(10) ORDER BY c_name) || chr(10)) AS sha256 FROM customer")
def sorted_lines_digest(spark, d):
    return integrity.lines_digest(table(spark, d, "customer"), "c_name")


@query("SELECT sha256(string_agg(c_name, chr(10) ORDER BY c_nationkey, c_name) || chr(10)) AS sha256 FROM customer")
def ordered_lines_digest(spark, d):
    """The digest of lines in a stated order."""
    return integrity.lines_digest(table(spark, d, "customer"), "c_name", ["c_nationkey"])


@query("SELECT event_type, (json_extract(props, '$.k'))::INT % 5 AS k, count(*) AS n FROM events GROUP BY ALL")
def json_label_counts(spark, d):
    k = F.from_json("props", "k int").getField("k") % 5
    return table(spark, d, "events").groupBy("event_type", k.alias("k")).agg(F.count("*").alias("n"))


_METRICS = (
    "m AS (SELECT 'orders' AS section, 'n' AS metric, count(*)::DOUBLE AS value FROM orders UNION ALL SELECT 'orders', 'mean_price', round(avg(o_totalprice), 6) FROM orders UNION ALL SELECT 'events', 'n_events', count(*)::DOUBLE FROM events)"
)


def metrics(spark, d) -> DataFrame:
    orders = table(spark, d, "orders").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 6).alias("mean_price"))
    events = table(spark, d, "events").agg(F.count("*").alias("n_events"))
    return integrity.metric_rows(orders, "orders").unionByName(integrity.metric_rows(events, "events"))


@query(f"WITH {_METRICS} SELECT section, metric, value, '' AS unit, '' AS role, '' AS source, '' AS note FROM m")
def metric_long_union(spark, d):
    return metrics(spark, d)


@query(f"WITH {_METRICS} SELECT max(value) FILTER (metric = 'n') AS n, max(value) FILTER (metric = 'n_events') AS n_events FROM m")
def metric_map_lookup(spark, d):
    return integrity.metric_lookup(metrics(spark, d), ["n", "n_events"])


@query("SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) AS n_beats, round(avg(value), 6) AS mean_value FROM events GROUP BY ALL")
def block_summaries_batch(spark, d):
    blocks = block_summaries(table(spark, d, "events"), width="1 day")
    return rounded(blocks.withColumn("start", F.col("start").cast("timestamp_ntz")))
