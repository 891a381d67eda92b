"""Beats into time blocks, blocks into odd and even replicates, and what is measured on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V


def tumbling_block(center: Column, start: Column, width: float = 60.0, blocks: int = 30) -> Column:
    """Half-open blocks of ``width`` from ``start``, the last one closed; null outside."""
    at = center - start
    return F.when((at >= 0) & (at <= width * blocks), F.least(F.floor(at / width), F.lit(blocks - 1)).cast("int"))


def trailing(df: DataFrame, center: str, total: Column, seconds: float = 1800.0) -> DataFrame:
    """Rows of the last ``seconds`` of a recording of ``total`` seconds, both ends closed; none where it is shorter."""
    start = total - seconds
    return df.where((start >= 0) & (F.col(center) >= start) & (F.col(center) <= total))


def element_means(df: DataFrame, keys: list[str], vector: str, out: str) -> DataFrame:
    """Element-wise mean of equally long vectors by key, with the number of vectors.

    Elements are averaged where they lie, and combined before the shuffle; only one row a key and element is left.
    """
    long = df.where(F.col(vector).isNotNull()).select(*keys, F.posexplode(vector).alias("_pos", "_x"))
    means = long.groupBy(*keys, "_pos").agg(F.avg("_x").alias("_m"), F.count("*").alias("_n"))
    return means.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_m"))), lambda r: r["_m"]).alias(out), F.max("_n").alias("n"))


def element_medians(df: DataFrame, keys: list[str], vector: str, out: str) -> DataFrame:
    long = df.where(F.col(vector).isNotNull()).select(*keys, F.posexplode(vector).alias("_pos", "_x"))
    medians = long.groupBy(*keys, "_pos").agg(F.median("_x").alias("_m"))
    return medians.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_m"))), lambda r: r["_m"]).alias(out))


def central_shape(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """``keys, n, kappa, q``: coherence (population deviation of the mean shape) and the normalised mean shape."""
    out = element_means(df, keys, vector, "_mean")
    return out.select(*keys, "n", V.population_sd(F.col("_mean")).alias("kappa"), V.normalised(F.col("_mean")).alias("q"))


def replicates(blocks: DataFrame, patient: str, block: str, vector: str, *, least: int = 6, least_half: int = 3) -> DataFrame:
    """Per patient with enough blocks: counts and the representatives of all, odd and even blocks.

    A representative is the normalised mean of its blocks' shapes; a block is odd by its zero-based number.
    """
    odd = F.pmod(F.col(block), F.lit(2)) == 1
    long = blocks.where(F.col(vector).isNotNull()).select(patient, odd.alias("_odd"), F.posexplode(vector).alias("_pos", "_x"))
    sums = [F.avg("_x").alias("all"), F.avg(F.when(F.col("_odd"), F.col("_x"))).alias("odd"), F.avg(F.when(~F.col("_odd"), F.col("_x"))).alias("even")]
    # Every block has one row a position, so that its counts come with the means.
    means = long.groupBy(patient, "_pos").agg(*sums, F.count("*").alias("_n"), F.count_if("_odd").alias("_o"))
    rows = F.array_sort(F.collect_list(F.struct("_pos", "all", "odd", "even")))
    reps = means.groupBy(patient).agg(rows.alias("_r"), F.max("_n").alias("n_blocks"), F.max("_o").alias("n_odd"))
    reps = reps.withColumn("n_even", F.col("n_blocks") - F.col("n_odd"))
    enough = (F.col("n_blocks") >= least) & (F.col("n_odd") >= least_half) & (F.col("n_even") >= least_half)
    return reps.where(enough).select(patient, "n_blocks", "n_odd", "n_even", *(V.normalised(F.col(f"_r.{k}")).alias(f"{k}_rep") for k in ("all", "odd", "even")))


def yield_table(counts: DataFrame, patient: str, block: str, n: str, thresholds: list[int], *, least: int, least_half: int) -> DataFrame:
    """For each minimum of beats a block: patients with enough blocks, and the spread of their eligible blocks."""
    odd = F.pmod(F.col(block), F.lit(2)) == 1
    steps = F.explode(F.array(*(F.lit(t) for t in thresholds))).alias("threshold")
    rows = counts.select(patient, block, n, steps)
    met = F.col(n) >= F.col("threshold")
    each = rows.groupBy("threshold", patient).agg(F.count_if(met).alias("total"), F.count_if(met & odd).alias("odd"), F.count_if(met & ~odd).alias("even"))
    usable = (F.col("total") >= least) & (F.col("odd") >= least_half) & (F.col("even") >= least_half)
    return each.groupBy("threshold").agg(F.count("*").alias("n_patients"), F.count_if(usable).alias("n_usable"), F.min("total").alias("min_total"), F.median("total").alias("median_total"), F.max("total").alias("max_total"))


def chosen_threshold(yields: DataFrame, least_usable: int) -> DataFrame:
    """The largest threshold that leaves enough patients (null where none does)."""
    return yields.agg(F.max(F.when(F.col("n_usable") >= least_usable, F.col("threshold"))).alias("threshold"))


def adjacent_steps(blocks: DataFrame, patient: str, block: str, vector: str) -> DataFrame:
    """Distance of each block's shape to the one before, where the numbers follow each other."""
    w = Window.partitionBy(patient).orderBy(block)
    out = blocks.withColumn("_before", F.lag(vector).over(w)).withColumn("_last", F.lag(block).over(w))
    return out.where(F.col(block) == F.col("_last") + 1).select(patient, block, V.distance(F.col(vector), F.col("_before")).alias("step"))


def deviation_kept(df: DataFrame, keys: list[str], value: str, out: str, *, width: float = 5.0) -> DataFrame:
    """``df`` with whether the value is within ``width`` scaled median deviations of its group's median.

    Where the median deviation is (nearly) 0, every value is kept.
    """
    mids = df.groupBy(*keys).agg(F.median(value).alias("_mid"))
    joined = df.join(mids, keys)
    mads = joined.groupBy(*keys).agg(F.median(F.abs(F.col(value) - F.col("_mid"))).alias("_mad"))
    near = F.abs(F.col(value) - F.col("_mid")) <= width * 1.4826 * F.col("_mad")
    return joined.join(mads, keys).withColumn(out, (F.col("_mad") <= 1e-12) | near)


def template_correlation(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """``df`` with the correlation of each vector with the element-wise median of its group."""
    return df.join(element_medians(df, keys, vector, "_template"), keys).withColumn("correlation", V.correlation(F.col(vector), F.col("_template"))).drop("_template")
