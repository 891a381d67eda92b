"""Grouped summaries, flags and their prevalence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import exposure_role


def group_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, median, mean, extremes, sample deviation, quartiles and their distance."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = df.groupBy(*keys).agg(F.count(value).alias("n"), q.alias("_q"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), F.stddev_samp(value).alias("sd"))
    return out.select(*keys, "n", F.col("_q")[1].alias("median"), "mean", "min", "max", "sd", F.col("_q")[0].alias("q25"), F.col("_q")[2].alias("q75"), (F.col("_q")[2] - F.col("_q")[0]).alias("iqr"))


QUANTILES = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}


def quantile_profile(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, mean, extremes and five exact quantiles."""
    q = F.percentile(value, F.array(*(F.lit(x) for x in QUANTILES.values())))
    out = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), q.alias("_q"))
    return out.select(*keys, "n", "mean", "min", "max", *(F.col("_q")[i].alias(k) for i, k in enumerate(QUANTILES)))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows of each value, null too."""
    return df.groupBy(column).agg(F.count("*").alias("n"))


def flags_by_key(df: DataFrame, keys: list[str], flags: dict[str, Column]) -> DataFrame:
    """For each key whether any row has the flag (0 or 1)."""
    return df.groupBy(*keys).agg(*(F.max(F.coalesce(c, F.lit(False)).cast("int")).alias(n) for n, c in flags.items()))


def combined_flag(prior: Column, current: Column) -> Column:
    """Any of both where the current one is known; else 1 where the prior one is, and unknown otherwise."""
    return F.when(current.isNotNull(), F.greatest(F.coalesce(prior, F.lit(0)), current)).when(prior == 1, F.lit(1))


def prevalence(df: DataFrame, flags: list[str]) -> DataFrame:
    """``flag, n_known, n_exposed, rate, role`` for each nullable flag, in one pass."""
    aggs = [a for f in flags for a in (F.count(f).alias(f"k_{f}"), F.coalesce(F.sum(f), F.lit(0)).cast("long").alias(f"e_{f}"))]
    rows = [F.struct(F.lit(f).alias("flag"), F.col(f"k_{f}").alias("n_known"), F.col(f"e_{f}").alias("n_exposed")) for f in flags]
    out = df.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return out.withColumn("rate", F.when(F.col("n_known") > 0, F.col("n_exposed") / F.col("n_known"))).withColumn("role", exposure_role(F.col("n_exposed"), F.col("n_known") - F.col("n_exposed")))
