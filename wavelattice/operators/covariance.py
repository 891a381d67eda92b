"""Covariance operators of vectors, from sums of products that tasks reduce before anything is shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cross_moments(df: DataFrame, a: str, b: str) -> DataFrame:
    """``i, j, n, ma, mb, c``: counts, means and centred sums of products of elements ``i`` of ``a`` and ``j`` of ``b``.

    Every task multiplies its own vectors, less their means, as matrices and passes on one row a pair of elements; the
    parts are put together by their means, so that large means cost no digits. Rows with a null vector are left out;
    all vectors must have the length of the first.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        n, ma, mb, c = 0, 0.0, 0.0, 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (as_matrix(v) for v in batch.columns)
            k, mx, my = len(x), x.mean(axis=0), y.mean(axis=0)
            c = c + (x - mx).T @ (y - my) + np.outer(mx - ma, my - mb) * (n * k / (n + k))
            ma, mb = ma + (mx - ma) * (k / (n + k)), mb + (my - mb) * (k / (n + k))
            n += k
        if n:
            i, j = (k.ravel() for k in np.indices(c.shape))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(np.full(i.size, n)), pa.array(ma[i]), pa.array(mb[j]), pa.array(c.ravel())], names=["i", "j", "n", "ma", "mb", "c"])

    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("_a"), F.col(b).alias("_b"))
    parts = rows.mapInArrow(run, "i int, j int, n long, ma double, mb double, c double")
    all_ = Window.partitionBy("i", "j")
    whole = [(F.sum(F.col("n") * F.col(m)).over(all_) / F.sum("n").over(all_)).alias(f"_{m}") for m in ("ma", "mb")]
    moved = F.col("c") + F.col("n") * (F.col("ma") - F.col("_ma")) * (F.col("mb") - F.col("_mb"))
    return parts.select("*", *whole).groupBy("i", "j").agg(F.sum("n").alias("n"), F.max("_ma").alias("ma"), F.max("_mb").alias("mb"), F.sum(moved).alias("c"))


def as_matrix(column: pa.Array) -> np.ndarray:
    """Equally long lists of numbers as the rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def covariance(df: DataFrame, vector: str) -> DataFrame:
    """``i, j, c``: covariance (n - 1) of the elements."""
    m = cross_moments(df, vector, vector)
    return m.select("i", "j", (F.col("c") / (F.col("n") - 1)).alias("c"))


def symmetric_cross_covariance(df: DataFrame, odd: str, even: str) -> DataFrame:
    """``i, j, c``: half the cross-covariance of both replicates and half its transpose."""
    m = cross_moments(df, odd, even)
    c = m.select("i", "j", (F.col("c") / (F.col("n") - 1)).alias("c"))
    both = c.unionByName(c.select(F.col("j").alias("i"), F.col("i").alias("j"), "c"))
    return both.groupBy("i", "j").agg((F.sum("c") / 2).alias("c"))


def mean_within_covariance(df: DataFrame, patient: str, vector: str) -> DataFrame:
    """``i, j, c``: mean over patients of each one's covariance over its blocks; patients with one block are left out.

    The sums of products about each patient's mean need no pair of elements to be shuffled: every block's deviations
    are weighted by 1 / (n - 1) and multiplied where they lie.
    """
    from .blocks import element_means

    centred = df.where(F.col(vector).isNotNull()).join(element_means(df, [patient], vector, "_mean"), patient).where("n > 1")
    scaled = F.zip_with(vector, "_mean", lambda x, m: (x - m) / F.sqrt(F.col("n") - 1))
    rows = centred.select(patient, scaled.alias("_d"))
    patients = rows.select(patient).distinct().count()
    return cross_moments(rows, "_d", "_d").select("i", "j", ((F.col("c") + F.col("n") * F.col("ma") * F.col("mb")) / F.lit(float(max(1, patients)))).alias("c"))


def trace(matrix: DataFrame) -> DataFrame:
    return matrix.where("i = j").agg(F.sum("c").alias("trace"))


def as_array(matrix: DataFrame) -> np.ndarray:
    """A small matrix on the driver (as many rows as the square of the vectors' length)."""
    rows = matrix.collect()
    n = 1 + max(r["i"] for r in rows)
    out = np.zeros((n, n))
    for r in rows:
        out[r["i"], r["j"]] = r["c"]
    return out
