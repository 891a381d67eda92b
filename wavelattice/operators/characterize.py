"""What bases, residuals and coefficients look like: energy splits, excursions, scales, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V


def energy_split(df: DataFrame, vector: str, basis: list[list[float]]) -> DataFrame:
    """``df`` with the part of each vector's centred energy that lies in a basis, and the rest."""
    inside = sum((z * z for z in V.projected(F.col("_c"), basis)), F.lit(0.0))
    out = df.withColumn("_c", V.centred(F.col(vector)))
    part = F.when(V.dot(F.col("_c"), F.col("_c")) > V.TINY, inside / V.dot(F.col("_c"), F.col("_c")))
    return out.withColumn("in_basis", part).withColumn("residual", 1 - part).drop("_c")


def residual_profile(df: DataFrame, vector: str, basis: list[list[float]]) -> DataFrame:
    """``pos, share``: where along the phase the energy outside a basis lies, as a distribution."""
    left = df.select(V.residual(V.centred(F.col(vector)), basis).alias("_r")).select(F.posexplode("_r").alias("pos", "x"))
    sums = left.groupBy("pos").agg(F.sum(F.col("x") * F.col("x")).alias("_e"))
    total = sums.agg(F.sum("_e").alias("_t"))
    return sums.crossJoin(F.broadcast(total)).select("pos", (F.col("_e") / F.col("_t")).alias("share"))


def excursions(df: DataFrame, vector: str, basis: list[list[float]]) -> DataFrame:
    """``axis, pos, low, high``: the mean vector less and plus one deviation of each axis' score."""
    scores = V.projected(F.col(vector), basis)
    sds = df.agg(*(F.stddev_samp(z).alias(f"s{k}") for k, z in enumerate(scores)))
    mean = _mean(df, vector)
    rows = F.array(*(F.struct(F.lit(k + 1).alias("axis"), F.col(f"s{k}").alias("sd"), V.literal(b).alias("b")) for k, b in enumerate(basis)))
    one = mean.crossJoin(F.broadcast(sds)).select("_m", F.explode(rows).alias("r"))
    long = one.select("r.axis", "r.sd", F.posexplode(F.arrays_zip(F.col("_m").alias("m"), F.col("r.b").alias("b"))).alias("pos", "z"))
    move = F.col("sd") * F.col("z.b")
    return long.select("axis", "pos", (F.col("z.m") - move).alias("low"), (F.col("z.m") + move).alias("high"))


def _mean(df: DataFrame, vector: str) -> DataFrame:
    means = df.select(F.posexplode(vector).alias("_pos", "_x")).groupBy("_pos").agg(F.avg("_x").alias("_v"))
    return means.agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_v"))), lambda r: r["_v"]).alias("_m"))


def scale_family(reps: DataFrame, within: DataFrame, patient: str) -> DataFrame:
    """``radius_rms, replicate_rms, within_rms`` and their ratios, every patient with one weight.

    ``reps``: all, odd and even vectors of each patient; ``within``: ``patient, v``, the blocks' vectors.
    """
    mean = _mean(reps, "all_rep")
    one = reps.crossJoin(F.broadcast(mean)).select(
        V.distance(F.col("all_rep"), F.col("_m")).alias("radius"), V.distance(F.col("odd_rep"), F.col("even_rep")).alias("halves")
    )
    between = one.agg(F.sqrt(F.avg(F.col("radius") * F.col("radius"))).alias("radius_rms"), F.sqrt(F.avg(F.col("halves") * F.col("halves"))).alias("replicate_rms"))
    long = within.select(patient, F.posexplode("v").alias("pos", "x")).groupBy(patient, "pos").agg(F.var_pop("x").alias("v"))
    inner = long.groupBy(patient).agg(F.sum("v").alias("v")).agg(F.sqrt(F.avg("v")).alias("within_rms"))
    out = between.crossJoin(F.broadcast(inner))
    return out.withColumn("within_over_radius", F.col("within_rms") / F.col("radius_rms")).withColumn("radius_over_replicate", F.col("radius_rms") / F.col("replicate_rms"))


def axis_variances(scores: DataFrame, patient: str, axes: list[str]) -> DataFrame:
    """``axis, between, within, ratio``: variance of patients' mean scores, and the mean of variances within patients."""
    each = scores.groupBy(patient).agg(*(a for z in axes for a in (F.avg(z).alias(f"m_{z}"), F.var_samp(z).alias(f"v_{z}"))))
    one = each.agg(*(a for z in axes for a in (F.var_samp(f"m_{z}").alias(f"b_{z}"), F.avg(f"v_{z}").alias(f"w_{z}"))))
    rows = F.array(*(F.struct(F.lit(z).alias("axis"), F.col(f"b_{z}").alias("between"), F.col(f"w_{z}").alias("within")) for z in axes))
    return one.select(F.explode(rows).alias("r")).select("r.*").withColumn("ratio", F.when(F.col("within") > 0, F.col("between") / F.col("within")))


def conventional_factors(beats: DataFrame, patient: str, block: str, level: str, scale: str, duration: str) -> DataFrame:
    """``patient, level, log_scale, log_duration``: medians within blocks, their means over a patient's blocks."""
    mids = beats.groupBy(patient, block).agg(F.median(level).alias("a"), F.median(scale).alias("b"), F.median(duration).alias("c"))
    return mids.groupBy(patient).agg(F.avg("a").alias("level"), F.ln(F.avg("b")).alias("log_scale"), F.ln(F.avg("c")).alias("log_duration"))


def nonlinear_decision(delta: Column, dependence: Column) -> Column:
    """The verdict of the non-linear audit from the largest gain and a flag of residual dependence."""
    return (
        F.when(delta >= 0.03, "MATERIAL_NONLINEAR_CONSTITUTIONAL_MEAN_SIGNAL_REINTERPRET_LINEAR_STAGE7B")
        .when(delta >= 0.01, "MODEST_NONLINEAR_CONSTITUTIONAL_INFORMATION_NO_STRONG_REVERSAL")
        .when(dependence, "NO_MATERIAL_OOF_MEAN_GAIN_BUT_RESIDUAL_MODEL_FREE_DEPENDENCE_FLAG")
        .otherwise("NONLINEAR_AUDIT_SUPPORTS_WEAK_CONSTITUTIONAL_PREDICTABILITY")
    )


def identifiability_band(r2: Column) -> Column:
    return F.when(r2 < 0.30, "GO").when(r2 < 0.60, "MODIFY").otherwise("STRONG")


def coefficient_norm(df: DataFrame, predictor: str, targets: list[str]) -> DataFrame:
    """``n, norm``: the length of a predictor's slopes over all targets, from one pass of sums."""
    slopes = [F.regr_slope(t, predictor) for t in targets]
    return df.agg(F.count("*").alias("n"), F.sqrt(sum((s * s for s in slopes), F.lit(0.0))).alias("norm"))


def cohort_summary(df: DataFrame, kind: str, ident: str, value: str, replicates: int = 200, seed: int = 11) -> DataFrame:
    """``kind, n, median, low, high, share_positive`` by representation; the interval is that of medians of rows weighted
    by Poisson draws from a hash."""
    from .dependence import bootstrap_medians

    plain = df.groupBy(kind).agg(F.count(value).alias("n"), F.median(value).alias("median"), F.avg((F.col(value) > 0).cast("int")).alias("share_positive"))
    medians = bootstrap_medians(df, ident, value, replicates, seed, [kind])
    q = F.percentile("median", F.array(F.lit(0.025), F.lit(0.975)))
    interval = medians.groupBy(kind).agg(q.alias("_q")).select(kind, F.col("_q")[0].alias("low"), F.col("_q")[1].alias("high"))
    return plain.join(interval, kind).select(kind, "n", "median", "low", "high", "share_positive")


def crossing_fractions(steps: DataFrame, patient: str, step: str, nearest: DataFrame, distance: str) -> DataFrame:
    """``n, median_crosses, p95_crosses, max_crosses``: parts of patients whose own steps (median, 95th percentile,
    largest) reach the distance to their nearest neighbour."""
    q = F.percentile(step, F.array(F.lit(0.5), F.lit(0.95)))
    own = steps.groupBy(patient).agg(q.alias("_q"), F.max(step).alias("_max")).join(nearest.select(patient, distance), patient)
    share = lambda c: F.avg((c >= F.col(distance)).cast("int"))
    return own.agg(F.count("*").alias("n"), share(F.col("_q")[0]).alias("median_crosses"), share(F.col("_q")[1]).alias("p95_crosses"), share(F.col("_max")).alias("max_crosses"))
