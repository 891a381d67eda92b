"""Linking moments to intervals: containment, the nearest, prior history, preferences, sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import seconds_between
from .sweeps import containment as containment
from .sweeps import links as links
from .sweeps import nearest as nearest
from .sweeps import prior_history as prior_history


def gap_hours(t: Column, start: Column, stop: Column) -> Column:
    return F.when(t < start, seconds_between(t, start) / 3600).when(t > stop, seconds_between(stop, t) / 3600).otherwise(F.lit(0.0))


def preferred_link(first: DataFrame, second: DataFrame, probe_id: str) -> DataFrame:
    """The exact link of the first kind where there is one, else of the second, and which it was."""
    both = first.select(probe_id, F.col("exact_id").alias("_a")).join(second.select(probe_id, F.col("exact_id").alias("_b")), probe_id)
    via = F.when(F.col("_a").isNotNull(), "first").when(F.col("_b").isNotNull(), "second").otherwise("none")
    return both.select(probe_id, F.coalesce("_a", "_b").alias("link_id"), via.alias("via"))


def threshold_sweep(df: DataFrame, value: str, thresholds: list[float]) -> DataFrame:
    """``threshold, n_within, n_known`` in one pass over the rows."""
    aggs = [F.count_if(F.col(value) <= t).alias(f"t{i}") for i, t in enumerate(thresholds)]
    rows = [F.struct(F.lit(float(t)).alias("threshold"), F.col(f"t{i}").alias("n_within"), F.col("known").alias("n_known")) for i, t in enumerate(thresholds)]
    return df.agg(*aggs, F.count(value).alias("known")).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def crosstab(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """One row: how many rows meet both conditions, only one, or neither (null counts as not met)."""
    a, b = F.coalesce(a, F.lit(False)), F.coalesce(b, F.lit(False))
    return df.agg(F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("only_first"), F.count_if(~a & b).alias("only_second"), F.count_if(~a & ~b).alias("neither"))


def middle_row(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The middle row of each key in an order (the lower one of an even number)."""
    w = Window.partitionBy(key)
    ranked = df.withColumn("_rank", F.row_number().over(w.orderBy(*order))).withColumn("_n", F.count("*").over(w))
    return ranked.where(F.col("_rank") == F.expr("(_n + 1) div 2")).drop("_rank", "_n")
